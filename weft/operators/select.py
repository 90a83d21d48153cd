"""Selection of context: weak topics, expansion, combining and capping, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

RATIO = 0.5
TOP_K = 3


def flag_insufficient(topics: DataFrame, ratio: float = RATIO, by: str = "query") -> DataFrame:
    """insufficient: score below ratio of the query's best; false where the best is not positive."""
    if ratio < 0:
        raise ValueError("ratio must not be negative")
    top = F.max("score").over(Window.partitionBy(by))
    return topics.withColumn("insufficient", (top > 0) & (F.col("score") < ratio * top))


def expand(topics: DataFrame, edges: DataFrame, *, depth: int = 2, max_nodes: int = 10, ratio: float = RATIO) -> DataFrame:
    """query, rank, file_id, neighbor, hop, npos: neighbours of weak topics only, in the topics' order. topics: query, file_id, score, rank."""
    weak = flag_insufficient(topics, ratio).where("insufficient")
    near = graph.neighbors(weak.select(F.col("file_id").alias("start")).distinct(), edges, depth, max_nodes)
    near = near.select(F.col("start").alias("file_id"), F.col("file_id").alias("neighbor"), "hop", F.col("rank").alias("npos"))
    return weak.join(near, "file_id").select("query", "rank", "file_id", "neighbor", "hop", "npos")


def combine_and_cap(topics: DataFrame, expansions: DataFrame, k: int = TOP_K) -> DataFrame:
    """query, file_id, pos: topics first, then neighbours in expansion order, first seen, 3k at most."""
    if k < 0:
        raise ValueError("k must not be negative")
    a = topics.select("query", "file_id", F.lit(0).alias("phase"), F.col("rank").alias("p"), F.lit(0).alias("n"))
    b = expansions.select("query", F.col("neighbor").alias("file_id"), F.lit(1).alias("phase"), F.col("rank").alias("p"), F.col("npos").alias("n"))
    order = [F.col(c) for c in ("phase", "p", "n")]
    first = a.unionByName(b).withColumn("r", F.row_number().over(Window.partitionBy("query", "file_id").orderBy(*order))).where("r = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("pos") <= 3 * k).select("query", "file_id", "pos")


def assemble(selected: DataFrame, files: DataFrame) -> DataFrame:
    """query, n_files, context: the files' blocks in order. files: file_id, path, content; unknown ids are left out, missing paths get a placeholder."""
    path = F.coalesce(F.nullif("path", F.lit("")), F.concat(F.lit("unknown/"), F.col("file_id").cast("string")))
    blocks = selected.join(files, "file_id").select("query", F.struct("pos", T.file_block(path, F.col("content")).alias("block")).alias("b"))
    return blocks.groupBy("query").agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "").alias("context"))
