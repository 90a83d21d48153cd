"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Level 0: the input's partitions are dealt to memtables; each memtable is flushed as one run, sorted by digest, holding
the smallest identifier and the count of each digest. Every run has a filter of fixed size. Compaction merges what the
filters of other runs may hold too and passes the rest through; it keeps the smallest identifier. Digests with more than
one row are hits, and hits are verified on their bytes before they count as copies.

Scale. Only digest rows (about 50 bytes a document) shuffle, and of texts only those of hits; both are combined before
the shuffle, so a group that holds a third of the rows sends one row a task. The filters are broadcast: FILTER_BITS bound
them (FILTER_BITS / 64 rows of a long for each run) whatever the input; when they fill up, more digests go through the
merge and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, normalized, one_of_each, staged, text_or_empty, without

#: Bits of a run's filter: 2^24 bits are 262,144 longs, the bound of what is broadcast for each run.
FILTER_BITS = 1 << 24
#: Number of level-0 runs that compaction merges at once.
RUNS = 4


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)), 6)


def _at(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64)).cast("int")


def _bit(key: Column) -> Column:
    """A long with the key's bit set; FILTER_BITS is a multiple of 64, so the place in the word is the hash modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _at(key))


def flush(digests: DataFrame, path: str, runs: int = RUNS) -> DataFrame:
    """Memtables to sorted runs (run, key, least, n), with filters of Parquet on the key.

    Each partition writes one file, in which the stretch of each run is sorted. A folder for each run would hold as many small
    files as partitions times runs, and where Hadoop has no native library executors start a process for each file.
    """
    run = F.pmod(F.shiftrightunsigned(F.col("uid"), 33), F.lit(runs)).cast("int")
    table = digests.groupBy(run.alias("run"), "key").agg(F.min("who").alias("least"), F.count("*").alias("n"))
    sorted_runs = table.sortWithinPartitions("run", "key")
    (sorted_runs.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", "65536").parquet(path))
    return digests.sparkSession.read.schema(table.schema).parquet(path)


def filters(runs_table: DataFrame, runs: int = RUNS) -> DataFrame:
    """The runs' filters side by side: word, f0, f1, ... At most FILTER_BITS / 64 rows."""
    bits = [F.bit_or(F.when(F.col("run") == r, _bit(F.col("key"))).otherwise(F.lit(0).cast("long"))).alias(f"f{r}") for r in range(runs)]
    return runs_table.groupBy(_word(F.col("key")).alias("word")).agg(*bits)


def compact(runs_table: DataFrame, path: str, runs: int = RUNS) -> DataFrame:
    """One sorted run of level 1 (key, least, n). Only keys that another run's filter may hold are merged."""
    elsewhere = F.lit(False)
    for r in range(runs):
        elsewhere = elsewhere | ((F.col("run") != r) & (F.getbit(F.col(f"f{r}"), _at(F.col("key"))) == 1))
    tested = runs_table.withColumn("word", _word(F.col("key"))).join(F.broadcast(filters(runs_table, runs)), "word")
    tested = staged(tested.select("key", "least", "n", elsewhere.alias("may")), f"{path}-tested")
    merged = tested.where("may").groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    alone = tested.where("not may").select("key", "least", "n")
    return staged(merged.unionByName(alone).sortWithinPartitions("key"), path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, runs: int = RUNS, digest_bits: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null and empty texts are equal to each other. Of equal texts the row with the smallest id stays; null ids come after
    all others; of rows that repeat an id and its text one stays. Other columns of docs are not looked at. An empty table
    gives an empty result. digest_bits shortens the index's keys (for tests of the byte verification).
    """
    spark = docs.sparkSession
    base = new_dir(spark, "lsm")
    norm = normalized(text_or_empty(text_col))
    sha = F.unhex(F.sha2(norm, 256))
    key = F.substring(sha, 1, max(1, digest_bits // 8))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    uid = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("sha"), uid.alias("uid"))
    rows = rows.select("*", F.substring("sha", 1, max(1, digest_bits // 8)).alias("key"), F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid").alias("who"))
    digests = staged(rows, f"{base}/digests")
    level0 = flush(digests, f"{base}/level0", runs)
    level1 = compact(level0, f"{base}/level1", runs)
    hits = level1.where("n > 1").select("key", F.col("least").alias("keeper"), F.col("n").alias("group_size"))

    # Byte verification: whole texts of hits are grouped by their bytes; a filter of the hits keeps other texts from the shuffle.
    seen = hits.groupBy(_word(F.col("key")).alias("word")).agg(F.bit_or(_bit(F.col("key"))).alias("f"))
    key2 = F.substring(F.unhex(F.sha2(F.col("norm"), 256)), 1, max(1, digest_bits // 8))
    may = src.withColumn("key", key2).withColumn("word", _word(F.col("key"))).join(F.broadcast(seen), "word").where(F.getbit(F.col("f"), _at(F.col("key"))) == 1)
    variants = may.groupBy("key", "norm").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id")).alias("least"), F.count("*").alias("n"))
    variants = staged(variants.select("key", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("x"), F.length("norm").alias("len"), "least", "n"), f"{base}/verified")
    clash = variants.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key", F.lit(True).alias("clash"))

    out = digests.join(hits, "key", "left")
    if not clash.isEmpty():
        # Keys that different texts share: each text is its own group.
        own = variants.join(clash, "key").select("key", F.unhex("sha").alias("sha"), F.col("least").alias("own"), F.col("n").alias("own_n"))
        one = digests.join(clash, "key").groupBy("key", "sha").agg(F.min("who").alias("own_who"))
        own = own.join(one, ["key", "sha"])
        out = out.join(own, ["key", "sha"], "left").select("doc_id", "uid", "sha", "who", F.coalesce("own_who", "keeper").alias("keeper"), F.coalesce("own_n", "group_size").alias("group_size"))
    keeper = F.coalesce(F.col("keeper"), F.col("who"))
    return out.select(
        "doc_id",
        keeper["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("uid") == keeper["uid"]).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Of texts only those of suspects shuffle.

    Of rows that repeat an id and its text that with the smallest hash of all columns stays.
    """
    base = new_dir(docs.sparkSession, "gone")
    rows = exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key"), "kept")
    told = rows.groupBy("__id", "__key").agg(F.bool_or("kept").alias("any"), F.count("*").alias("n")).where("not any or n > 1")
    told = staged(told, f"{base}/told")
    sha = F.sha2(normalized(text_or_empty(text_col)), 256)
    gone, repeated = told.where("not any").select("__id", "__key"), told.where("any").select("__id", "__key")
    stay = without(docs, gone, id_col, sha)
    return stay if repeated.isEmpty() else one_of_each(stay, repeated, id_col, sha)
