"""What the operators of this subpackage share: a shared work folder, written stages, lean workers, ASCII rules for text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary
    folder (tests); a cluster would not see it, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if not kept:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it belongs to the caller, who may delete it once the result is consumed."""
    return f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: lineage ends here, lost executors cost nothing that was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a worker gets at once.
TEXTS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS):
    """While it holds, Arrow brings Python workers at most `rows` rows at once; the session's own bound is put back after it.

    A batch of whole texts is in memory several times, in the executor and in the worker. It bounds what is written meanwhile.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def trim() -> None:
    """Gives memory that this process has freed back to the system: Arrow's, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        back(0)


def lean(make):
    """make, a function from batches to batches for a Python worker, which gives memory back between batches and at the end.

    Worker processes outlive their tasks, so that what one stage has freed would stay with its executor all through the next.
    """

    def trimmed(batches):
        for b in batches:
            yield b
            del b
            trim()

    @functools.wraps(make)
    def run(batches):
        try:
            yield from make(trimmed(batches))
        finally:
            trim()

    return run


#: Bits of a filter of ids: 262,144 longs, whatever it holds.
ID_FILTER_BITS = 1 << 24


def _suspects(docs: DataFrame, listed: DataFrame, id_col: str, key: Column | None) -> tuple[DataFrame, DataFrame, Column]:
    """The rows of docs that a filter of the listed ids (long, __id) rules out, the others, and when one of these is listed.

    The filter is of fixed size and broadcast; rows it rules out stay where they are, and only the others are shuffled
    for the exact comparison, so no text moves that is not suspected.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_FILTER_BITS))
    marks = listed.groupBy(F.shiftrightunsigned(h(F.col("__id")), 6).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (h(F.col("__id")) % 64).cast("int"))).alias("__f"))
    own = F.col(id_col).cast("long")
    tested = docs.withColumns({"__own": own, "__w": F.shiftrightunsigned(h(own), 6)}).join(F.broadcast(marks), "__w", "left")
    may = F.coalesce(F.getbit("__f", (h(F.col("__own")) % 64).cast("int")) == 1, F.lit(False))
    some = tested.where(may)
    same = F.col("__own").eqNullSafe(F.col("__id"))
    if key is not None:
        some = some.withColumn("__mine", key)
        same = same & (F.col("__mine") == F.col("__key"))
    return tested.where(~may).select(*docs.columns), some, same


def without(docs: DataFrame, gone: DataFrame, id_col: str, key: Column | None = None) -> DataFrame:
    """The rows of docs whose id (long) and key are not in gone (__id, and __key if there is a key), with all their columns. gone is a written table."""
    stay, some, same = _suspects(docs, gone, id_col, key)
    return stay.unionByName(some.join(gone, same, "left_anti").select(*docs.columns))


def one_of_each(docs: DataFrame, repeated: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs with one row of each id and key in repeated (a written table of __id and __key); other rows stay as they are.

    Of rows with one id and key that with the smallest hash of all its columns stays, whatever the layout of the files.
    """
    stay, some, same = _suspects(docs, repeated, id_col, key)
    alone = some.join(repeated, same, "left_anti").select(*docs.columns)
    order = F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    row = F.min_by(F.struct(*docs.columns), order).alias("__row")
    one = some.join(repeated, same, "left_semi").groupBy("__own", "__mine").agg(row).select("__row.*")
    return stay.unionByName(alone).unionByName(one)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def normalized(col: Column) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(col, SPACE + "+", " ")


def word_count(col: Column) -> Column:
    """Number of maximal runs of other characters than white space; 0 for null."""
    t = F.regexp_replace(F.coalesce(col, F.lit("")), SPACE + "+", " ")
    n = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    edge = F.when(t.startswith(" "), 1).otherwise(0) + F.when(t.endswith(" "), 1).otherwise(0)
    return F.when((t == "") | (t == " "), F.lit(0)).otherwise(n - edge).cast("long")
