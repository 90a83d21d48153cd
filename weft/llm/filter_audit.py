"""Filter interaction audit: what five quality filters remove in every order of application.

Texts are scanned as Arrow buffers. A table gives each byte its classes (white space, capital, symbol, first byte of a
code point); prefix sums of a class, taken at the texts' edges, count it in all texts at once. Word hashes come from one
prefix sum too (a polynomial modulo 2^64, shifted to a common power). A document's hashes are sorted; neighbours with equal
hashes are verified on their bytes, so distinct words are exact; where two words share a hash, the document's words are
compared as bytes. The filters become bits of a mask, and everything after that is sums over masks.

Scale. One pass over the texts, from which a row of some 60 bytes a document comes; no text is shuffled. Equal texts meet
as rows counted by digest, part and mask (partial sums first), so a text that a third of all documents repeat is a
handful of rows. The 120 orders meet at most 32 masks a part.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, lean, new_dir, small_batches, staged
from .tokens import _flat
from .words import chunks, mixed

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
A, B, C, D, E = (1 << i for i in range(5))

_SPACE, _CAPITAL, _SYMBOL, _FIRST = 1, 2, 4, 8
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[list(ASCII_SPACE)] |= _SPACE
_CLASSES[65:91] |= _CAPITAL
_CLASSES[list(SYMBOLS)] |= _SYMBOL
_CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= _FIRST
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers never vanish modulo 2^64
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers 0 to n of the base."""
    global _powers
    while len(_powers) <= n:
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, len(_powers), 1 << 64))])
    return _powers


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the runs of equal length at a and b are equal, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    same, live, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        rest = np.minimum(length[live] - done, 8).astype(np.uint64)
        mask = np.where(rest == 8, ~np.uint64(0), (np.uint64(1) << (rest * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        good = (eight[a[live] + done] ^ eight[b[live] + done]) & mask == 0
        same[live[~good]] = False
        done += 8
        live = live[good & (length[live] > done)]
    return same


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_chars, n_words, n_distinct, n_capitals and n_symbols of each text (large strings without nulls)."""
    at, data = _flat(texts)
    kind = _CLASSES[data]

    def total(bit):
        sums = np.concatenate([[0], np.cumsum(kind & bit != 0, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    solid = kind & _SPACE == 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads, tails = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    begins[heads], ends[tails] = solid[heads], solid[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    edges = np.searchsorted(first, at)
    words = np.diff(edges)

    power = _power_table(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * power[: len(data)])])
    length = last - first
    hashes = mixed((sums[last] - sums[first]) * power[len(data) - first] + length.astype(np.uint64))
    order = np.empty(len(first), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        order[a:b] = a + np.argsort(hashes[a:b])
    h, own = hashes[order], np.repeat(np.arange(len(words)), words)
    twin = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])) + 1
    x, y = order[twin - 1], order[twin]
    same = length[x] == length[y]
    same[same] = _same_bytes(data, first[x[same]], first[y[same]], length[x[same]])
    distinct = words - np.bincount(own[twin], minlength=len(words))
    for i in np.unique(own[twin[~same]]):  # different words with one hash
        distinct[i] = len({data[a:b].tobytes() for a, b in zip(first[edges[i] : edges[i + 1]], last[edges[i] : edges[i + 1]], strict=True)})
    return {"n_chars": total(_FIRST), "n_words": words, "n_distinct": distinct, "n_capitals": total(_CAPITAL), "n_symbols": total(_SYMBOL)}


def fail_mask(n: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    fails = ((A, n["n_words"] < LEAST_WORDS), (B, 100 * n["n_distinct"] < DISTINCT_PERCENT * n["n_words"]), (C, 100 * n["n_capitals"] > CAPITAL_PERCENT * n["n_chars"]), (D, n["n_symbols"] > 0))
    return sum(bit * failed.astype(np.int32) for bit, failed in fails)


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per row of docs: doc_id, part (null: empty), the five counts, mask (filters A to D) and the text's SHA-256."""
    counts = ["n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols"]

    def make(batches):
        for b in batches:
            for at, part in chunks(b.column(2)):
                n = scan(part)
                digests = [hashlib.sha256(x.as_buffer()).digest() for x in part.cast(pa.large_binary())]
                arrays = [b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), *[pa.array(n[c], pa.int64()) for c in counts], pa.array(fail_mask(n), pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", *counts, "mask", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(make), f"doc_id long, part string, {', '.join(f'{c} long' for c in counts)}, mask int, digest binary")


def masked_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic: how many documents fail just these filters.

    E: a smaller doc_id has the same text. Rows that share the smallest id of a text do not fail it, nor do rows without an
    id, which are smaller than none. Labels without an id count for nothing; of several for an id, any 1 counts.
    """
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"__{c}")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    kind = ["digest", "part", "mask", "__quality", "__toxic"]
    x = masks.select("doc_id", "part", "mask", "digest").join(known, "doc_id", "left").fillna(0, ["__quality", "__toxic"])
    ids = x.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    there = F.col("doc_id").isNotNull()
    alike = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(there, F.col("n"))).alias("with_id"), F.min(F.when(there, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    late = F.coalesce(F.col("with_id"), F.lit(0)) - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    told = alike.withColumn("least", least).withColumn("late", late)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("late")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(E)).alias("mask"), F.col("late").alias("n"))))
    rows = told.select("part", "__quality", "__toxic", both.alias("m")).where("m.n > 0")
    n = F.col("m.n")
    return rows.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("__quality")).alias("good"), F.sum(n * F.col("__toxic")).alias("toxic"))


def _bit(order: Column, step: Column) -> Column:
    """The mask's bit of the filter at a step."""
    return sum((F.when(F.instr(order, f) == step, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def _earlier(order: Column, step: Column) -> Column:
    return sum((F.when(F.instr(order, f) < step, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the step's counts for all 120 orders, from masked_counts.

    shapley: a document that fails s filters is removed first by each of them in 120 / s of the orders.
    """
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    x = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    x = x.withColumn("bit", _bit(F.col("filter_order"), F.col("step"))).withColumn("earlier", _earlier(F.col("filter_order"), F.col("step")))
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("earlier")) != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    first = F.col("n") * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return x.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", mask == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, first)), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The interactions of the five filters over docs. Null texts and parts are empty; an empty table gives no rows;
    repeated rows count as often as they occur; further columns, whatever their names, play no part."""
    with small_batches(docs.sparkSession):
        masks = staged(document_masks(docs, **columns), new_dir(docs.sparkSession, "audit"))
    return interactions(masked_counts(masks, labels))
