"""Streams over logs that are written, read in batches, stopped and started again; their results are those of the batch queries."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators.shared import new_dir
from ..streaming import streams
from . import graph_queries as G
from .registry import query

#: Rows of a file of a log, so that a batch of a large log is many tasks' work.
FILE_ROWS = 1_000_000


def _log(t, rows, name: str, batches: int = 6) -> tuple[str, str, int]:
    """A folder with the rows as a log of files of at most some FILE_ROWS, a folder for all else, and how many of the files are one of so many batches."""
    base = new_dir(t.spark, name)
    files = -(-rows.count() // (batches * FILE_ROWS)) or 1
    rows.repartition(batches * files, "seq").write.parquet(f"{base}/log")  # by hash: rows dealt in turn would be sorted first
    return f"{base}/log", base, files


@query(f"WITH {G.COMPACTED} SELECT * FROM edges")
def stream_compaction(t):
    """Fails at its third batch after writing it, and is started again from the checkpoint: the batch runs twice and counts once."""
    events = t.edge_events()
    log, base, files = _log(t, events, "stream-compaction")
    target = streams.LevelledCompactor(f"{base}/parts")

    def writer(each):
        source = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(log)
        return source.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint")

    try:
        streams.drain(writer(streams.StopAfter(target, 2)))
    except StreamingQueryException:
        pass
    streams.drain(writer(target))
    return target.snapshot(t.spark, streams.committed(t.spark, f"{base}/checkpoint"))


def _in_turns(t, rows, turn, cuts, make, name):
    """Runs make(stream) over a log that grows: what lies before each of the cuts of turn is added and drained, from the same
    checkpoint each time. Returns what the stream has written, and its checkpoint."""
    base = new_dir(t.spark, name)
    streams.use_rocks(t.spark)
    low = None
    for cut in (*cuts, None):
        some = rows if low is None else rows.where(turn >= low)
        (some if cut is None else some.where(turn < cut)).write.mode("append").parquet(f"{base}/log")
        low = cut
        out = make(t.spark.readStream.schema(rows.schema).parquet(f"{base}/log"))
        streams.drain(out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    return t.spark.read.parquet(f"{base}/out"), f"{base}/checkpoint"


@query("""
    WITH x AS (SELECT conv_id + 1 AS file_id, turn AS seq, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS new_size FROM conversations), s AS (SELECT file_id, sum(n)::BIGINT AS size FROM x GROUP BY 1)
    SELECT file_id, seq, new_size::BIGINT AS new_size, size FROM x JOIN s USING (file_id) WHERE new_size - n <= 512 AND new_size > 512""")
def stream_crossings(t):
    """Three runs of one stream; size is what its state holds at the end, read from the checkpoint."""
    rows = t.appends()
    out, checkpoint = _in_turns(t, rows, F.col("seq"), (1, 3), lambda s: streams.crossings(s, 512), "stream-crossings")
    state = t.spark.read.format("statestore").option("stateVarName", "size").load(checkpoint)
    return out.join(state.select(F.col("key.file_id").alias("file_id"), F.col("value.size").alias("size")), "file_id").select("file_id", "seq", "new_size", "size")


@query("""
    WITH m AS (SELECT l_orderkey AS entity, l_partkey + 1 AS file_id, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2)
    SELECT a.file_id AS source, b.file_id AS target, count(*) AS weight FROM m a JOIN m b ON a.entity = b.entity AND a.seq > b.seq AND a.file_id <> b.file_id GROUP BY 1, 2""")
def stream_cooccurrence(t):
    """Links as mentions come, line by line of the orders, in three runs of one stream."""
    rows, base = G.order_mentions(t), new_dir(t.spark, "stream-cooccurrence")
    target, low = streams.Cooccurrer(base), None
    for cut in (3, 5, None):
        some = rows if low is None else rows.where(F.col("seq") >= low)
        (some if cut is None else some.where(F.col("seq") < cut)).write.mode("append").parquet(f"{base}/log")
        low = cut
        log = t.spark.readStream.schema(rows.schema).parquet(f"{base}/log")
        streams.drain(log.writeStream.foreachBatch(target).option("checkpointLocation", f"{base}/checkpoint"))
    out = target.links(t.spark, streams.committed(t.spark, f"{base}/checkpoint"))
    return out.groupBy("source", "target").agg(F.count("*").alias("weight"))
