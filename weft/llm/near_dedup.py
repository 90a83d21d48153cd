"""MinHash near-dedup with sequential Bayesian verification.

Documents with the same shingle set are one class, with a number of its own. Texts of one id are joined by further links;
rows without an id are told apart by a digest of their texts. Classes meet in the buckets of banded signatures. A candidate pair's
signatures are compared batch by batch; after each batch the posterior of the similarity (uniform prior) decides: a pair
goes once the chance that it reaches the threshold falls below MISS. Survivors are verified on their full shingle sets.

No group emits all its pairs. First each bucket's members are paired with its smallest (one pair a member). Members that
are then still in different components are compared in blocks of bounded size, screened and verified inside the task,
which emits links that join components only: fewer than the block has rows. A larger bucket is cut in blocks, and each two
blocks meet in a task of their own. So the components are those of all links between candidates.

Scale. Signatures, buckets and links are tables; components come from contraction by joins, each round written to the
shared folder. Broadcast is one filter of fixed size (FILTER_BITS) that keeps other documents' sets from being shuffled;
when it fills up, more sets go through an exact semi-join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, new_dir, small_batches, staged, text_or_empty, without

SHINGLE, THRESHOLD = 5, 80
HASHES, BANDS, ROWS = 128, 24, 4
BATCH = 32
#: Chance at which a pair is given up after a batch.
MISS = 1e-5
FILTER_BITS = 1 << 24
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: What stands for a missing id where ids are hashed into the filter; a document with this very id passes it too.
NO_ID = (1 << 63) - 1

_rng = np.random.Generator(np.random.PCG64(7))
_FACTOR = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> list[int]:
    """After 32, 64, ... hashes: the fewest matches with which the similarity may still reach the threshold with chance miss.

    The chance that a Beta(m + 1, n - m + 1) variable reaches t is that of at most m successes in n + 1 trials at t.
    """
    t, out = threshold / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss and m < n:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 512):
        out = np.minimum(out, ((s[i : i + 512, None] * _FACTOR + _SHIFT) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return (out & np.uint32(0xFFFF)).astype(np.uint16)  # equal hashes stay equal; others agree by chance once in 65,536


def _sets(batch_texts: pa.Array, k: int):
    from .words import chunks, shingle_hashes, word_hashes

    for at, part in chunks(batch_texts):
        for i, s in enumerate(shingle_hashes(*word_hashes(part), k)):
            yield at + i, s


def _text_digest(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart; null for the others."""
    return F.when(F.col(id_col).cast("long").isNull(), F.sha2(text_or_empty(text_col), 256))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, text_key (of rows without an id), n_shingles, set_key (of the set; null if empty), sig."""

    def make(batches):
        import xxhash

        for b in batches:
            n, keys, sigs = [], [], []
            for _, s in _sets(b.column(1), k):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(_signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_digest(id_col, text_col).alias("text_key"))
    return rows.mapInArrow(lean(make), "doc_id long, text_key string, n_shingles long, set_key binary, sig binary")


def _band_keys(reps: DataFrame) -> DataFrame:
    def make(batches):
        from .words import mixed

        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = mixed(key + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(b.column(0)), BANDS))], names=["key", "node"])

    return reps.select("node", "sig").mapInArrow(lean(make), "key long, node long")


def _close(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two tables of signatures stay after all batches, and their matches (-1: given up)."""
    out = np.full(len(x), -1, np.int32)
    live, same = np.arange(len(x)), np.zeros(len(x), np.int32)
    for i, m in enumerate(least):
        cut = slice(BATCH * i, BATCH * (i + 1))
        same = same + (x[live, cut] == y[live, cut]).sum(axis=1)
        keep = same >= m
        live, same = live[keep], same[keep]
        if not len(live):
            return out
    out[live] = same
    return out


def _screen(pairs: DataFrame, cand: DataFrame, least: list[int]) -> DataFrame:
    """Pairs (a, b) whose signatures stay."""

    def test(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(_close(x, y, least) >= 0))

    left, right = cand.select(F.col("node").alias("a"), F.col("sig").alias("sa")), cand.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(test), "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b, linked: by the full sets."""

    def test(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                linked.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(test), "a long, b long, linked boolean")


def contract(labels: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """labels (node, label) after the links (a, b) are followed: label is the smallest node of the component."""
    turn = 0
    while True:
        la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        cross = staged(links.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).distinct(), f"{path}/{turn}-cross")
        if cross.isEmpty():
            return labels
        up = staged(cross.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("up")), f"{path}/{turn}-up")
        while True:  # shorten the way to the root until it is one step
            far = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            turn += 1
            longer = staged(up.join(far, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), f"{path}/{turn}-up")
            up = longer.select("node", "up")
            if longer.where("moved").isEmpty():
                break
        turn += 1
        labels = staged(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{path}/{turn}-labels")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(x), len(y)) * 100 < threshold * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _compare_blocks(rows: DataFrame, least: list[int], threshold: int) -> DataFrame:
    """rows: key, i, j, side, node, label, sig, set. Links (a, b) between components, verified on full sets inside the task.

    Every pair of a block that is not connected yet is screened; survivors are verified, and a link joins its two
    components for the rest of the block. So a block emits fewer links than it has rows.
    """

    def of_group(side, node, label, sig, sets):
        root, out = label.copy(), []
        cross = (side != side[0]).any()
        first = np.flatnonzero(side == 0)
        far = np.flatnonzero(side == 1)
        for n, i in enumerate(first):
            other = far if cross else first[n + 1 :]
            other = other[root[other] != root[i]]
            if not len(other):
                continue
            same = _close(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], least)
            for o in other[np.argsort(-same, kind="stable")][: int((same >= 0).sum())]:
                if root[o] != root[i] and _linked(sets[i], sets[o], threshold):
                    out.append((int(min(node[i], node[o])), int(max(node[i], node[o]))))
                    root[root == root[o]] = root[i]
        return out

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rest = yield from groups(t, False)
        if rest is not None and rest.num_rows:
            yield from groups(rest, True)

    def groups(t, last):
        t = t.combine_chunks()
        k = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in ("key", "i", "j")], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cut, *([len(k)] if last else [])]
        side, node, label = (np.asarray(t.column(c)) for c in ("side", "node", "label"))
        sig, sets = t.column("sig"), t.column("set")
        out = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            s = np.frombuffer(b"".join(sig.slice(a, z - a).to_pylist()), np.uint16).reshape(-1, HASHES)
            own = [np.frombuffer(x, np.uint64) for x in sets.slice(a, z - a).to_pylist()]
            out += of_group(side[a:z], node[a:z], label[a:z], s, own)
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return t.slice(edges[-1])

    names = ["key", "i", "j", "side", "node", "label", "sig", "set"]
    dealt = rows.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _near(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, miss: float, block: int) -> DataFrame:
    """near_dedup's rows with text_key."""
    spark = docs.sparkSession
    base = new_dir(spark, "near")
    least = least_matches(threshold, miss)
    with small_batches(spark):
        prints = staged(fingerprints(docs, id_col, text_col, shingle), f"{base}/prints")
    classes = prints.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.min("text_key").alias("least_key"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), f"{base}/classes")
    keys = staged(_band_keys(classes), f"{base}/keys")
    marks = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    alike = marks.groupBy("n", "pivot", "x", "y").agg(F.min("key").alias("key"))  # buckets of the same members are one
    buckets = staged(keys.join(alike.select("key", "n", "pivot"), "key"), f"{base}/buckets")
    cand = staged(classes.select("node", "sig", "set_key", F.coalesce("least_id", F.lit(NO_ID)).alias("who")).join(buckets.select("node").distinct(), "node", "left_semi"), f"{base}/candidates")

    # Sets of candidates, from the whole texts of the row with each one's smallest id; the filter spares the others.
    h = F.pmod(F.xxhash64("who"), F.lit(FILTER_BITS))
    words = cand.groupBy(F.shiftrightunsigned(h, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))).alias("f"))
    may = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("who"), F.col(text_col).cast("string").alias("text")).withColumn("w", F.shiftrightunsigned(h, 6))
    may = may.join(F.broadcast(words), "w").where(F.getbit("f", (h % 64).cast("int")) == 1).select("text")

    def make_sets(batches):
        import xxhash

        for b in batches:
            sets = [s.tobytes() for _, s in _sets(b.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "set"])

    with small_batches(spark):
        one = may.mapInArrow(lean(make_sets), "set_key binary, set binary").groupBy("set_key").agg(F.first("set").alias("set"))  # partial sums first: equal sets are one a task
        sets = staged(one.join(cand.select("node", "set_key"), "set_key").select("node", "set"), f"{base}/sets")

    # Ids that stand for several texts: their classes are linked, whatever the texts.
    nothing = F.lit(b"")
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("set_key", nothing)).alias("lo"), F.max(F.coalesce("set_key", nothing)).alias("hi")).where("lo <> hi")
    several = staged(several, f"{base}/several")
    spread = prints.where("n_shingles > 0").select("doc_id", "set_key").join(several.select("doc_id"), "doc_id", "left_semi").distinct().join(classes.select("set_key", "node"), "set_key")
    spread = staged(spread.select("doc_id", "node"), f"{base}/spread")
    own = spread.join(spread.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))

    labels = cand.select("node").union(spread.select("node")).distinct().select("node", F.col("node").alias("label"))
    labels = contract(staged(labels, f"{base}/nodes"), own, f"{base}/own-labels")
    pairs = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    with small_batches(spark):
        tested = staged(_verify(_screen(pairs, cand, least), sets, threshold), f"{base}/star")
    labels = contract(labels, tested.where("linked"), f"{base}/star-labels")

    # What a bucket still holds of different components, in blocks.
    rest = buckets.where("n > 2 and node <> pivot").join(labels, "node")
    mixed_keys = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    blocks = F.ceil(F.col("m") / block).cast("int")
    rows = rest.select("key", "node", "label").join(mixed_keys, "key").join(cand.select("node", "sig").join(sets, "node"), "node").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", "node", "label", "sig", "set", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    with small_batches(spark):
        links = staged(_compare_blocks(rows, least, threshold), f"{base}/links")
    labels = contract(labels, links, f"{base}/labels")

    # A component has the smallest id of its classes or, without any, the smallest text.
    placed = classes.select("set_key", "node", "n", "least_id", "least_key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = placed.groupBy("label").agg(F.min("least_id").alias("first_id"), F.min("least_key").alias("first_key"), F.sum("n").alias("rows")).where("rows > 1")
    told = placed.select("set_key", "label").join(found, "label").select("set_key", "first_id", "first_key", F.lit(True).alias("shared"))
    out = prints.drop("sig").join(told, "set_key", "left")
    shared = F.col("shared").isNotNull()
    out = out.withColumn("component_id", F.when(shared, F.col("first_id")).otherwise(F.col("doc_id")))
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id")).otherwise(~shared | (F.col("first_id").isNull() & (F.col("text_key") == F.col("first_key"))))
    if not several.where(F.col("lo") == nothing).isEmpty():  # texts without words of ids that have others too
        of_id = out.where("n_shingles > 0").join(several.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(kept, F.lit(False)).alias("kept"), "text_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, threshold: int = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Sets are of `shingle` words, five unless asked otherwise.

    Texts without words (null and empty ones too) are linked with nothing. Rows that repeat an id count as one document:
    their texts' components are joined and all of them stay or go. Rows without an id are documents of their own, equal ones
    of them one; they come after all others: a component without any id has a null component_id, and of its texts that of
    the smallest SHA-256 stays. An empty table gives an empty result.
    """
    return _near(docs, id_col, text_col, shingle, threshold, miss, block).drop("text_key")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, threshold: int = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose document stands for its component, with all their columns."""
    key = lambda c: F.coalesce(c, F.lit(""))
    gone = _near(docs, id_col, text_col, shingle, threshold, miss, block).where("not kept").select(F.col("doc_id").alias("__id"), key(F.col("text_key")).alias("__key")).distinct()
    return without(docs, staged(gone, new_dir(docs.sparkSession, "gone")), id_col, key(_text_digest(id_col, text_col)))
