"""The knowledge base's entities as views on the driver's tables. Keys start at 0 there and at 1 here (0 is unset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy readers; column pruning and filters reach Parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def paths(self) -> DataFrame:
        """file_id, path."""
        p = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
        return self.raw("part").select((F.col("p_partkey") + 1).alias("file_id"), p.alias("path"))

    def queries(self) -> DataFrame:
        return self.raw("part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query")).distinct()

    def files(self) -> DataFrame:
        """file_id, path, content, size_bytes, version, status."""
        path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
        return self.raw("documents").select((F.col("doc_id") + 1).alias("file_id"), path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("version"), F.lit("ACTIVE").alias("status"))

    def appends(self) -> DataFrame:
        """file_id, seq, data."""
        return self.raw("conversations").select((F.col("conv_id") + 1).alias("file_id"), F.col("turn").alias("seq"), F.col("text").alias("data"))

    def edge_events(self) -> DataFrame:
        """source, target, edge_type, weight, last_updated, seq: a part to the supplier's node, typed by the order."""
        kinds = ("SPLIT_SIBLING", "REDIRECT", "ENTITY_COOCCUR", "LLM_ASSERTED")
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_orderkey") % 4 + 1).cast("int"))
        n = F.lit(1000)
        return self.raw("lineitem").select(
            (F.col("l_partkey") % n + 1).alias("source"), (F.col("l_suppkey") * 7 % n + 1).alias("target"), kind.alias("edge_type"), F.col("l_quantity").cast("long").alias("weight"), F.unix_timestamp("l_shipdate").alias("last_updated"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
        )

    def mentions(self) -> DataFrame:
        """doc_id, entity, display, seq: capitalised runs of all documents; seq is a struct of document and place, in order of both."""
        from ..functions import text as T

        x = self.raw("documents").select("doc_id", F.posexplode(T.heuristic_entities(F.col("text"))).alias("pos", "display"))
        return x.select("doc_id", T.canonical_entity(F.col("display")).alias("entity"), "display", F.struct("doc_id", "pos").alias("seq"))

    def stages(self) -> DataFrame:
        """arm, stage, duration_seconds, provider, cost_usd, query_id, seq."""
        k = F.get_json_object("props", "$.k").cast("int")
        provider = F.when(F.col("event_id") % 3 == 0, "ollama").otherwise("openrouter")
        cost = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 1000)
        query = F.when(F.col("event_type") == "error", F.lit(None).cast("long")).otherwise(F.col("user_id"))
        return self.raw("events").select(F.col("event_type").alias("arm"), F.concat(F.lit("stage"), (k % 4).cast("string")).alias("stage"), F.col("value").alias("duration_seconds"), provider.alias("provider"), cost.alias("cost_usd"), query.alias("query_id"), F.col("event_id").alias("seq"))

    def manifest(self) -> DataFrame:
        """doc_id, primary_topic, cross_references."""
        t = F.col("doc_id") % 32
        return self.raw("documents").select("doc_id", t.alias("primary_topic"), F.array((t + 1) % 32, (t + 2) % 32).alias("cross_references"))
