"""Line dedup with two Bloom filters.

Pass one reads every line: each task keeps two Bloom filters of its own, for hashes seen once and hashes seen twice, and
sends their set segments on; merged, "twice" holds what any task has twice and what two tasks have once each. Pass two
reads the texts again and lets only lines that the filter of twice-seen hashes may hold through: these suspects, and
nothing else, shuffle for the exact count of documents on the whole key. Confirmed repeats keep one occurrence.

Scale. The filters are sized from the input, BITS_A_BYTE bits for each byte that Spark expects to read, between FEWEST_BITS
and MOST_BITS (128 MB, the bound of what is broadcast; a task holds two of them). Beyond that more lines are suspects and
the confirmation, a plain distributed aggregate, does more of the work; results stay the same. Segments merge in rounds of
FAN tasks each. A line that a third of all documents hold sends one row a task (partial aggregates) and its
dealing back is a join that Spark may split. Documents without a dropped line are never shuffled: a filter of the
documents with one, of fixed size too, tells them apart.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, new_dir, staged

LEAST_LENGTH, LEAST_DOCS = 20, 3
#: Bits of a filter by bytes of input (lines of some 50 bytes, 16 bits each, in columns packed to half), their range, and bits set for a hash.
BITS_A_BYTE, FEWEST_BITS, MOST_BITS, PROBES = 0.5, 1 << 22, 1 << 30, 4
#: Bits of a segment, and tasks whose segments meet in one row's merge.
SEGMENT, FAN = 1 << 16, 64
DOC_FILTER_BITS = 1 << 24


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least)


def _keys(text: bytes, least: int):
    for line in text.split(b"\n"):
        key = line_key(line)
        if _long_enough(key, least):
            yield key


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each 64-bit hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _hashed(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def filter_bits_for(df: DataFrame) -> int:
    """Bits of a filter for what Spark's own estimate says of the size of df's input: a power of two."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << max(FEWEST_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, int(size * BITS_A_BYTE).bit_length()))


class _Filter:
    """A Bloom filter as packed bits."""

    def __init__(self, bits: int):
        self.bits, self.raw = bits, np.zeros(-(-bits // 8), np.uint8)

    def holds(self, at: np.ndarray) -> np.ndarray:
        return ((self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, at: np.ndarray) -> None:
        at = np.unique(at)
        if len(at):
            byte, first = np.unique(at >> 3, return_index=True)
            self.raw[byte] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)


def _pack(once: np.ndarray, twice: np.ndarray) -> dict:
    """A segment's filters, compressed."""
    return {"once": zlib.compress(once.tobytes(), 1), "twice": zlib.compress(twice.tobytes(), 1)}


def _bits(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8).copy()


def twice_seen(texts: DataFrame, path: str, least: int = LEAST_LENGTH, bits: int = FEWEST_BITS) -> bytearray:
    """The merged filter of hashes that may have been seen in two documents. texts has one column, binary."""
    size = min(SEGMENT, bits)

    def build(batches):
        from pyspark import TaskContext

        once, twice = _Filter(bits), _Filter(bits)
        for b in batches:
            keys = [k for text in b.column(0).to_pylist() for k in set(_keys(text or b"", least))]  # once a document
            if keys:
                hashes, n = np.unique(_hashed(keys), return_counts=True)
                at = _places(hashes, bits)
                twice.add(at[once.holds(at) | (n > 1)].ravel())
                once.add(at.ravel())
        group = TaskContext.get().partitionId() // FAN
        step = size // 8
        used = np.unique(np.flatnonzero(once.raw) // step)
        for lo in range(0, len(used), 256):
            rows = [{"segment": int(s), "team": group} | _pack(once.raw[s * step : (s + 1) * step], twice.raw[s * step : (s + 1) * step]) for s in used[lo : lo + 256]]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def merge(batches):
        state: dict = {"at": None}

        def done():
            return [{"segment": state["at"][0], "team": state["at"][1] // FAN} | _pack(state["once"], state["twice"])]

        for b in batches:
            out = []
            for row in b.to_pylist():
                at, o, t = (row["segment"], row["team"]), _bits(row["once"]), _bits(row["twice"])
                if at != state["at"]:
                    if state["at"] is not None:
                        out += done()
                    state = {"at": at, "once": o, "twice": t}
                else:
                    state["twice"] |= t | (state["once"] & o)
                    state["once"] |= o
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state["at"] is not None:
            yield pa.RecordBatch.from_pylist(done(), schema)

    schema = pa.schema([("segment", pa.int32()), ("team", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    kind = "segment int, team int, once binary, twice binary"
    parts, turn = staged(texts.mapInArrow(build, kind), f"{path}/0"), 0
    while True:  # each round joins FAN tasks' segments, until all are in team 0 and merged
        turn += 1
        last = (parts.agg(F.max("team")).first()[0] or 0) == 0
        parts = staged(parts.repartition("segment", "team").sortWithinPartitions("segment", "team").mapInArrow(merge, kind), f"{path}/{turn}")
        if last:
            break
    out = bytearray(bits // 8)
    for row in parts.select("segment", "twice").toLocalIterator():  # bits / 8 bytes in all
        raw = zlib.decompress(row["twice"])
        out[row["segment"] * size // 8 : row["segment"] * size // 8 + len(raw)] = raw
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, filter_bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, and kept_text.

    Texts are cut at line feeds only; null and empty texts are one empty line. A key of least_length code points or more
    that least_docs documents hold loses all its lines except those of the largest doc_id that holds it (null counts as
    smallest); that document keeps every occurrence. Rows that repeat an id are one document. Extra columns are not looked
    at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = new_dir(spark, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    filter_bits = filter_bits or filter_bits_for(rows)
    sent = spark.sparkContext.broadcast(bytes(twice_seen(rows.select("text"), f"{base}/filters", least_length, filter_bits)))

    def suspects(batches):
        import xxhash

        twice = _Filter(0)
        twice.bits, twice.raw = filter_bits, np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ids, keys = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own := list(set(_keys(text, least_length))):
                    hit = twice.holds(_places(_hashed(own), filter_bits))
                    got = [own[i] for i in np.flatnonzero(hit)]
                    ids += [doc_id] * len(got)
                    keys += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary())], names=["doc_id", "key", "hash"])

    found = staged(rows.mapInArrow(suspects, "doc_id long, key binary, hash binary"), f"{base}/suspects")
    repeated_ids = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated_ids:
        found = found.distinct()
    # Exact confirmation on the whole key; a hash that different keys share is confirmed for each of them.
    confirmed = found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.first("hash").alias("hash")).where(F.col("n") >= least_docs)
    confirmed = staged(confirmed, f"{base}/confirmed")
    drops = found.select("doc_id", "hash", "key").join(confirmed.select("hash", F.col("key").alias("whole"), "keep_id"), "hash").where("key = whole and not (doc_id <=> keep_id)")
    by_doc = staged(drops.groupBy("doc_id").agg(F.collect_list("key").alias("gone")), f"{base}/drops")  # at most a document's own lines

    def kept(batches):
        for b in batches:
            texts, n, lost = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if line_key(x) not in gone]
                else:
                    stay = lines
                texts.append(b"\n".join(stay))
                n.append(len(lines))
                lost.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    h = F.pmod(F.xxhash64("doc_id"), F.lit(DOC_FILTER_BITS))
    marks = by_doc.groupBy(F.shiftrightunsigned(h, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))).alias("f"))
    tested = rows.withColumn("w", F.shiftrightunsigned(h, 6)).join(F.broadcast(marks), "w", "left").withColumn("may", F.coalesce(F.getbit("f", (h % 64).cast("int")) == 1, F.lit(False)))
    whole = tested.where("not may").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("gone"))
    right = by_doc.withColumnRenamed("doc_id", "id")
    part = tested.where("may").select("doc_id", "text").join(right, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "gone")
    return whole.unionByName(part).mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.lower(F.sha2(F.col("kept_text").cast("binary"), 256)).alias("kept_sha256"))


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
