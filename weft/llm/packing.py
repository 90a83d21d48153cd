"""Best-fit packing of token pieces by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence. The program, to cover every piece with as few
configurations as can be, is solved by multiplicative weights: an unbounded-knapsack dynamic program over the capacity
finds the configurations of most weight, they are used as far as their lengths' demand goes, in whole sequences, and the
weights of what they cover are lowered by a factor. The weights are also prices, which prove by duality how few sequences
any packing can have (solve_with_report). The few pieces left over are packed by best fit, longest first, also
by histogram; where that misses the bound some of the program's sequences are opened again for it (_rounded).

Scale. The driver sees the histogram alone: at most `capacity` lengths. The plan it sends out has a row for each length of
each configuration, which the number of rounds and lengths bounds, not the number of pieces. Pieces get their rank among
those of their length by counts of salted groups, so one length that a third of all pieces have is no hot group.
"""

from __future__ import annotations

import bisect
import contextlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, new_dir, small_batches, staged, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Pricing rounds of the linear program, and the factor's exponent.
ROUNDS, ETA = 300, 1.0
#: Share of the best weight by which a configuration that is used in a round may fall short.
NEAR = 0.1
#: Share of the pieces at which the program has converged.
OPEN = 0.01
#: Share of the program's sequences that is opened again first, where rounding costs sequences.
REOPEN = 1 / 64
#: Pieces of one length that share a salted group.
GROUP = 128


def _price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room c the most weight that fits, best[c] = max over l of weight[l] + best[c - l], and the length it takes. weight[0] is unused."""
    best = np.zeros(capacity + 1)  # best[capacity - c], so that best of c - 1, c - 2, ... is a slice that runs forward
    took = np.zeros(capacity + 1, np.int32)
    w = weight[1:]
    for c in range(1, capacity + 1):
        sums = w[:c] + best[capacity - c + 1 :]
        k = int(sums.argmax())
        idle = best[capacity - c + 1]
        best[capacity - c], took[c] = (sums[k], k + 1) if sums[k] > idle else (idle, 0)
    return best[::-1], took


def _fill(took: list[int], c: int) -> list[int]:
    """The multiset of lengths of most weight for room c."""
    out = []
    while c > 0:
        n = took[c]
        out += [n] * (n > 0)
        c -= n or 1
    return out


def _fill_within(n: int, weight: np.ndarray, best: np.ndarray, left: np.ndarray, capacity: int) -> Counter:
    """A configuration that has n and takes no length more often than left allows: at each room the length that promises most."""
    need, w = Counter([n]), np.where(left > 0, weight, -1.0)
    w[n] = w[n] if left[n] > 1 else -1.0
    c = capacity - n
    while c > 0:
        sums = w[1 : c + 1] + best[c - 1 :: -1]
        m = int(sums.argmax()) + 1
        if w[m] < 0:
            break
        need[m] += 1
        c -= m
        if need[m] == left[m]:
            w[m] = -1.0
    return need


def dual_bound(demand: np.ndarray, weight: np.ndarray, best: float) -> float:
    """The worth of all pieces at prices at which no sequence is worth more than `best`, in sequences: by linear duality no packing needs fewer."""
    return float(demand @ np.maximum(weight, 0)) / best if best > 0 else 0.0


def _program(left: np.ndarray, capacity: int, rounds: int) -> tuple[Counter, float]:
    """Configurations and their uses, and the best dual bound of all rounds' prices; takes what they cover off left. Uses are whole from the start, so rounding loses none.

    A pricing round gives the best fill of every room, so the best configuration that has a given length is known for each
    length. All that come within NEAR of the round's best are used if they leave no room (or, after a round that
    found none, no more than its best one); each takes half of its scarcest length, or one sequence. The rounds end when less than OPEN of the pieces is left.
    """
    plan: Counter = Counter()
    total, whole, bound = int(left.sum()), left.astype(float), 0.0
    if left[capacity]:
        plan[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    demand = np.maximum(left, 1).astype(float)
    size = np.arange(capacity + 1) / capacity
    factor = 1 + size / 20  # of equal fills, that of the longer pieces
    full = True  # whether the last round found configurations without room
    for _ in range(rounds):
        if left.sum() < OPEN * total or not left.any():
            break
        weight = np.where(left > 0, size * factor, -1.0)
        best, took = _price(weight, capacity)
        if (left[1:capacity] > 0).sum() == (whole[1:capacity] > 0).sum():  # prices of lengths that are used up are gone, and with them the bound
            bound = max(bound, dual_bound(whole, np.where(np.arange(capacity + 1) == capacity, best[capacity], weight), best[capacity]))
        took = took.tolist()
        least = capacity if full else sum(_fill(took, capacity))
        before = sum(plan.values())
        value = weight + best[::-1]  # of the best configuration that has the length
        for n in map(int, np.flatnonzero((left > 0) & (value >= (1 - NEAR) * best[capacity]))[::-1]):
            if not left[n]:
                continue
            need = Counter([n, *_fill(took, capacity - n)])
            if over := [m for m, k in need.items() if left[m] < k]:  # the price of a length it would use too often falls
                factor[over] *= np.exp(-ETA / 2)
                need = _fill_within(n, weight, best, left, capacity)
            config = need.elements()
            if sum(m * k for m, k in need.items()) < least:
                continue
            step = max(1, min(int(left[m]) // k for m, k in need.items()) // 2)
            plan[tuple(sorted(config, reverse=True))] += step
            for m, k in need.items():
                left[m] -= k * step
                factor[m] *= np.exp(-ETA * k * step / demand[m])
        full = sum(plan.values()) > before
    return plan, max(bound, float(np.arange(capacity + 1) @ whole) / capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences use each. Every piece of the histogram is in exactly one."""
    return solve_with_report(histogram, capacity, rounds)[0]


def solve_with_report(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, float]]:
    """solve's configurations, with the number of sequences, the bound that the program's prices prove, the gap between
    the two, and the share of the pieces that the program placed (best fit places the rest)."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    total = int(left.sum())
    plan, bound = _program(left, capacity, rounds)
    least = int(np.ceil(bound - 1e-6))
    packed, rest = _rounded(plan, left, capacity, least)
    used = sum(packed.values())
    return sorted(packed.items(), reverse=True), {"sequences": used, "least": least, "gap": used / max(1, least) - 1, "by_program": 1 - rest / max(1, total)}


def _rounded(plan: Counter, left: np.ndarray, capacity: int, least: int) -> tuple[Counter, int]:
    """The program's sequences with what it left packed by best fit, and how many pieces best fit placed.

    What is left has few short pieces to fill gaps with. If that costs more sequences than the bound, the program's
    sequences of most pieces are opened again, REOPEN of them and twice as many each time, and packed with the rest; the
    fewest sequences count, the least opened of equal ones. All opened is best fit alone, so it is never beaten by that.
    """
    best, share = None, 0.0
    order = sorted(plan.items(), key=lambda x: (-len(x[0]), x[0]))
    while True:
        kept, open_ = Counter(plan), left.copy()
        budget = int(np.ceil(share * sum(plan.values())))
        for config, k in order:
            if budget <= 0:
                break
            n = min(k, budget)
            budget -= n
            kept[config] -= n
            for m in config:
                open_[m] += n
        rest = int(open_.sum())
        kept += _best_fit(open_, capacity)  # drops configurations without use
        if best is None or sum(kept.values()) < sum(best[0].values()):
            best = kept, rest
        if sum(best[0].values()) <= least or share >= 1:
            return best
        share = min(1.0, max(REOPEN, 2 * share))


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best fit, longest first, for all pieces of a length at a time. Sequences of equal content are counted together."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []  # sorted

    def put(config, k):
        room = capacity - sum(config)
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room][config] += k

    for n in map(int, np.flatnonzero(left)[::-1]):
        k = int(left[n])
        while k:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n  # new sequences are best filled with the same length before others open
                if k >= each:
                    put((n,) * each, k // each)
                    k %= each
                else:
                    put((n,) * k, 1)
                    k = 0
                continue
            same = by_room[rooms[i]]
            config, have = next(iter(same.items()))
            t = min(k, have)
            if t == have:
                del same[config]
                if not same:
                    rooms.pop(i)
            else:
                same[config] -= t
            put((*config, n), t)
            k -= t
    out: Counter = Counter()
    for c in by_room.values():
        out.update(c)
    return out


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length of each configuration: the pieces of that length it takes, by rank, and where they go."""
    used: Counter = Counter()
    rows, first = [], 0
    for config, k in plan:
        offset = 0
        for n, c in sorted(Counter(config).items(), reverse=True):
            rows.append((n, used[n], c, first, offset))
            used[n] += c * k
            offset += n * c
        first += k
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) | table[:, 1], "start": table[:, 1], "each": table[:, 2], "first": table[:, 3], "offset": table[:, 4]}


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, small: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): documents with their end id, cut where longer than capacity."""

    def cut(batches):
        from .tokens import encoder

        enc = encoder(tokenizer, small)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for b in batches:
            for first, ids, at in enc.parts(b.column(1)):
                cols: list = [[], [], [], [], [], []]
                for i, doc_id in enumerate(b.column(0).slice(first, len(at) - 1).to_pylist()):
                    raw = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    for p in range(0, -(-len(raw) // (4 * capacity))):
                        part = raw[4 * capacity * p : 4 * capacity * (p + 1)]
                        for col, x in zip(cols, (doc_id, p, p * capacity, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            col.append(x)
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=names[: 5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, rounds: int = ROUNDS, small: bool = False, **cols) -> DataFrame:
    """Pieces with sequence_id and offset. Null and empty texts are their end id; null ids are kept; repeated rows are packed each.
    small: encode in less memory and more time, with the same result."""
    spark = docs.sparkSession
    base = new_dir(spark, "pack")
    with small_batches(spark) if small else contextlib.nullcontext():
        pieces = staged(token_pieces(docs, tokenizer, small=small, capacity=capacity, end_id=end_id, with_ids=with_ids, **cols), f"{base}/pieces")
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = solve(counted, capacity, rounds)
    sent = spark.sparkContext.broadcast(places(plan))
    groups = 1 << max(0, (max(counted.values(), default=1) // GROUP).bit_length())
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    salted = pieces.withColumn("salt", salt)
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base_rank = _running(per, base)
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("inside", inside).join(base_rank, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("inside")).cast("long"))
    names = [*pieces.columns]

    def place(batches):
        t = sent.value
        for b in batches:
            n, rank = (np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(t["key"], (n << 44) | rank, "right") - 1
            k = rank - t["start"][at]
            each = t["each"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(t["first"][at] + k // each), pa.array(t["offset"][at] + (k % each) * n)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(lean(place), f"{kinds}, sequence_id long, offset long")


def _running(per: DataFrame, base: str) -> DataFrame:
    """(length, salt, before): the pieces in a length's salted groups of smaller salt, by two levels of sums so no window grows long."""
    wide = 1 << 10
    per = staged(per.withColumn("top", F.floor(F.col("salt") / wide)), f"{base}/counts")
    tops = per.groupBy("length", "top").agg(F.sum("n").alias("m"))
    below = F.coalesce(F.sum("m").over(Window.partitionBy("length").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("length", "top", below.alias("below"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("length", "top").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("within", within).join(tops, ["length", "top"]).select("length", "salt", (F.col("within") + F.col("below")).alias("before"))
