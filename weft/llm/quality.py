"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut in pieces of PIECE bytes (all of it); every piece is compressed with either dictionary. The score is the
difference of the two sizes a byte of text, put through a logistic curve fitted on labelled rows that the dictionaries have
not seen. Nothing else goes into it.

The fit uses at most SAMPLE labelled rows of either class, those of smallest hash of their id, and of them, in that order,
the rows up to SAMPLE_BYTES of text (bounds of what the driver holds). So the sample is the same for any file layout. All
else reads all rows and whole texts, in one pass without a shuffle.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, lean

PIECE = 512
DICT_BYTES = 256 << 10
#: Labelled rows of a class that the fit uses at most, and the bytes of text after which no further row is brought to the driver.
SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
FOLDS, CUT = 5, 0.3
LEVEL = 3


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS).cast("int")


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: tuple = ()  # intercept and slope on the difference
    prior: float = 0.5

    def scorer(self):
        """texts (bytes) to scores, in this process."""
        if not self.weights:
            return lambda texts: np.full(len(texts), self.prior)
        measure, (w0, w1) = _measure(self.good, self.bad), self.weights

        def score(texts):
            x = np.array([measure(t) for t in texts], float)
            return 1 / (1 + np.exp(-np.clip(w0 + w1 * x, -35, 35)))

        return score


def _measure(good: bytes, bad: bytes):
    """A function from a text to the difference of its packed sizes with either dictionary a byte; 0 for an empty text."""
    import zstandard

    packers = []
    for d in (good, bad):
        z = zstandard.ZstdCompressionDict(d)
        z.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def measure(text: bytes) -> float:
        difference = 0
        for i in range(0, len(text), PIECE):
            part = text[i : i + PIECE]
            difference += len(packers[1](part)) - len(packers[0](part))
        return difference / max(1, len(text))

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * np.array([0, *[1] * (len(w) - 1)]) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w * np.array([0, *[1] * (len(w) - 1)]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: their text itself is the dictionary
        return b"".join(pieces)[-DICT_BYTES:] or b"\0" * 8


def fit(texts: list[bytes], labels: list[int], share_good: float) -> Model:
    """Three fifths of the sample train the dictionaries, the rest the curve; share_good is the classes' true proportion."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y[0]) if len(y) else 0.5)
    part = np.array([zlib.crc32(t) % 5 for t in texts])
    train = part < 3
    pick = lambda k: [t for t, q, tr in zip(texts, y, train, strict=True) if q == k and tr] or [t for t, q in zip(texts, y, strict=True) if q == k]
    good, bad = _dictionary(pick(1)), _dictionary(pick(0))
    rest = ~train if (~train).sum() >= 20 and 0 < y[~train].mean() < 1 else np.ones(len(y), bool)
    measure = _measure(good, bad)
    x = np.array([measure(t) for t, r in zip(texts, rest, strict=True) if r])
    center, scale = x.mean(), x.std() + 1e-9
    w0, w1 = _logistic(((x - center) / scale)[:, None], y[rest].astype(float))
    m = y[rest].mean()  # the sample holds the classes in other proportion than the labels do
    w0 += np.log(share_good / (1 - share_good)) - np.log(m / (1 - m))
    return Model(good, bad, (float(w0 - w1 * center / scale), float(w1 / scale)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on labelled rows that are not held out (fold 0)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where((F.col("y").isin(0, 1)) & (fold("id") != 0)).groupBy("id").agg(F.min("y").alias("y"))
    count = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not count:
        return Model()
    picked = None
    for k in (0, 1):
        some = marked.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(picked), "id")  # at most 2 * SAMPLE rows
    upto = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, -1)  # over the sample only
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    got = [(r["id"], bytes(r["text"]), r["y"]) for r in rows.toLocalIterator()]
    got.sort()
    total = sum(count.values())
    return fit([t for _, t, _ in got], [y for _, _, y in got], min(max(count.get(1, 0) / total, 1e-6), 1 - 1e-6))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a row's whole text, as a column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = sent.value.scorer()  # dictionaries are built once a task
        for texts in batches:
            out = np.empty(len(texts))
            for i in range(0, len(texts), TEXTS):
                out[i : i + TEXTS] = of([(t or "").encode("utf-8", "replace") for t in texts.iloc[i : i + TEXTS]])
            yield pd.Series(out)

    return score(F.col(text_col).cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty and get the score of an empty text. Labels that are null or not 0 or 1 are not looked at, of
    labels that repeat an id the smaller. Documents that repeat an id are each scored, and each in the fit. Without labels every score is 0.5, with one class only it is that class. Null ids are in
    no fold that is held out.
    """
    model = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", *, cut: float = CUT) -> DataFrame:
    """The rows of docs whose text scores cut or more, with all their columns."""
    return docs.where(score_column(docs, train(docs, labels, text_col=text_col), text_col) >= cut)


