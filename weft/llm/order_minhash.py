"""Document fingerprints by order MinHash.

A text's k-mers (runs of K code points) are numbered by occurrence, so that a k-mer that repeats gives different members.
For each of HASHES hash functions the LEAST members of smallest hash are chosen and put back in the order in which the text
has them; the hash of that tuple is one entry of the fingerprint. Two texts share an entry with a chance that falls with
their edit distance: other members as well as another order of the same ones change it. The likeness of two fingerprints
is the share of equal entries.

A text shorter than K is one k-mer, an empty text has none; tuples of texts with fewer members are shorter. So equal texts
have equal fingerprints whatever their length, and two empty texts have likeness 1.

Scale. Texts are dealt by ranges of the id in one shuffle and streamed in order; each meets the next one in its task. The
last text of a range meets the first of the following one in a small second step: one text a range. A text is in memory
with its hashes (some 40 bytes a code point), HASHES times COLUMNS of them at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, new_dir, small_batches, staged
from .words import mixed

K, LEAST, HASHES = 10, 2, 128
#: Members that are hashed at once.
COLUMNS = 4096
#: Code points of texts that are cut at once; a longer text is cut alone.
AT_ONCE = 1 << 17

_rng = np.random.Generator(np.random.PCG64(11))
_FACTOR = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TOP = np.uint32(0xFFFFFFFF)
_room = np.empty(HASHES * COLUMNS, np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k code points, by runs of powers of two; of a shorter text, of the whole."""
    k = min(k, len(codes))
    n = len(codes) - k + 1
    if not k:
        return np.zeros(0, np.uint64)
    power, size, out, done = mixed(codes.astype(np.uint64) + np.uint64(k << 32)), 1, None, 0
    while True:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else mixed(out * np.uint64(3) + part)
            done += size
        if size * 2 > k:
            return out
        power = mixed(power[:-size] * np.uint64(3) + power[size:])
        size *= 2


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value occurs before its place."""
    order = np.argsort(h)
    s = h[order]
    twin = np.flatnonzero(s[1:] == s[:-1])
    out = np.zeros(len(h), np.uint64)
    if len(twin):  # of the few that repeat: by value, then by place
        mine = np.unique(np.concatenate([twin, twin + 1]))
        place = np.sort(order[mine])
        place = place[np.argsort(h[place], kind="stable")]
        s = h[place]
        at = np.arange(len(place))
        out[place] = at - np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), at, 0))
    return out


def _minima(x: np.ndarray, take: int) -> np.ndarray:
    """For each hash function the places of the take members of smallest hash, in the text's order: a row each."""
    rows, best, where = np.arange(HASHES), [], []
    for a in range(0, len(x), COLUMNS):
        some = x[None, a : a + COLUMNS]
        v = np.multiply(_FACTOR[:, None], some, out=_room[: HASHES * some.shape[1]].reshape(HASHES, -1))
        for _ in range(min(take, v.shape[1])):
            i = v.argmin(axis=1)
            best.append(v[rows, i])
            where.append(a + i)
            v[rows, i] = _TOP
    places = np.stack(where, axis=1)
    if places.shape[1] > take:
        chosen = np.lexsort((places, np.stack(best, axis=1)), axis=1)[:, :take]
        places = np.take_along_axis(places, chosen, axis=1)
    return np.sort(places, axis=1)


def _some(texts: list[str], k: int, least: int) -> np.ndarray:
    codes, ends = code_points("".join(texts)), np.cumsum([len(t) for t in texts])
    runs, h, counts = kmers(codes, k), [], []
    for t, z in zip(texts, ends.tolist(), strict=True):
        own = runs[z - len(t) : z - k + 1] if len(t) >= k else kmers(codes[z - len(t) : z], k)  # no run reaches over a text's end
        h.append(own)
        counts.append(occurrences(own))
    edges = np.append(0, np.cumsum([len(x) for x in h]))
    members = mixed(np.concatenate(h) + mixed(np.concatenate(counts) + np.uint64(1)))
    keys = (members >> np.uint64(32)).astype(np.uint32)
    tuples = np.full((len(texts), HASHES), least, np.uint64)
    chosen, given = np.zeros((least, len(texts), HASHES), np.uint64), np.minimum(np.diff(edges), least)
    for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if z > a:
            chosen[: given[i], i] = members[a + _minima(keys[a:z], int(given[i])).T]
    for j in range(least):
        tuples = np.where((given > j)[:, None], mixed(tuples * np.uint64(5) + chosen[j]), tuples)
    return (tuples >> np.uint64(48)).astype("<u2")


def text_fingerprints(texts: list[str], k: int = K, least: int = LEAST) -> np.ndarray:
    """A row of HASHES entries of 16 bits for each text."""
    out, group, size = [np.zeros((0, HASHES), "<u2")], [], 0
    for t in texts:
        if group and size + len(t) > AT_ONCE:
            out.append(_some(group, k, least))
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        out.append(_some(group, k, least))
    return np.concatenate(out)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROW = pa.schema([*_PAIR, ("place", pa.int64()), ("head", pa.bool_()), ("text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _pairs(ids: list, texts: list[str], own: np.ndarray, following: list[str], other: np.ndarray, k: int, least: int) -> list[dict]:
    """Rows of texts, each with the following one."""
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    prints = text_fingerprints(changed, k, least)
    near, next_ = (prints == own).mean(axis=1), (own == other).mean(axis=1)
    return [
        {"doc_id": ids[i], "n_chars": len(texts[i]), "edited_sha256": hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).digest(), "fingerprint": own[i].tobytes(), "edited_fingerprint": prints[i].tobytes(), "near_edited": float(near[i]), "near_next": float(next_[i])}
        for i in range(len(texts))
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, least: int = LEAST) -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows in descending order of doc_id; rows without an id come last and rows of one id are in order of
    a hash of their texts; after the last comes the first (a single document follows itself). Null texts are empty, an
    empty table gives no rows, further columns play no part.
    """
    spark = docs.sparkSession
    base = new_dir(spark, "prints")

    def run(batches):
        from pyspark import TaskContext

        place, held = TaskContext.get().partitionId(), None
        end = lambda x, head: {"doc_id": x[0], "fingerprint": x[2].tobytes(), "text": x[1], "place": place, "head": head}
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            own = text_fingerprints(texts, k, least)
            if held is None:
                yield pa.RecordBatch.from_pylist([end((ids[0], texts[0], own[0]), True)], _ROW)
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], own])
            held = ids[-1], texts[-1], own[-1]
            yield pa.RecordBatch.from_pylist(_pairs(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:], k, least), _ROW)
        if held is not None:
            yield pa.RecordBatch.from_pylist([end(held, False)], _ROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("__tie")]
    rows = rows.withColumn("__tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(spark):
        done = staged(rows.mapInArrow(lean(run), f"{_DDL}, place long, head boolean, text string"), f"{base}/ranges")

    # The last text of a range and the first of the following one: a row a range.
    ends = done.where("place is not null")
    following = ends.where("head").select("place").withColumn("after", F.coalesce(F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy())))
    tails = ends.where("not head").join(following, "place").select("doc_id", "text", "fingerprint", "after")
    heads = ends.where("head").select(F.col("place").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))

    def meet(batches):
        for b in batches:
            own, other = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 4))
            yield pa.RecordBatch.from_pylist(_pairs(b.column(0).to_pylist(), b.column(1).to_pylist(), own, b.column(3).to_pylist(), other, k, least), pa.schema(_PAIR))

    met = tails.join(heads, "after").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(lean(meet), _DDL)
    columns = [c for c, _ in _PAIR]
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return done.where("place is null").select(*columns).unionByName(met).select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
