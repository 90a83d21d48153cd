"""Append logs as streams: compaction, size tracking, leases, replay, metrics, entities; windows over events (beyond the reference)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import graph

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE_MS = 30_000


def use_rocks(spark: SparkSession) -> None:
    """transformWithState keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Compactor:
    """foreachBatch target: folds each batch of edge events into snapshots below path, one folder a batch.

    The folder's name carries the batch, so a batch that runs again overwrites its own snapshot and counts nothing twice.
    """

    def __init__(self, path: str):
        self.path = path

    def snapshot(self, spark: SparkSession, batch: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/batch={batch}") if batch >= 0 else None

    def __call__(self, events: DataFrame, batch: int) -> None:
        old = self.snapshot(events.sparkSession, batch - 1)
        new = graph.compact_edges(events) if old is None else graph.compact_incremental(old, events, -1)
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


class LevelledCompactor:
    """foreachBatch target: folds edge events into parts below path, and parts into larger ones, so that a batch costs what it
    holds and not what the graph holds.

    Batch b writes its own events, compacted, as level=0/part=b. Each FAN-th part of a level merges the last FAN of them into
    one part of the next. What a snapshot reads is a part for each digit of the number of batches, FAN - 1 a level at
    most. A part's name comes from the batch's number alone: a batch that runs again writes its parts anew and counts
    nothing twice.
    """

    FAN = 8

    def __init__(self, path: str):
        self.path = path

    def part(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/part={number}"

    def __call__(self, events: DataFrame, batch: int) -> None:
        graph.compact_part(events).write.mode("overwrite").parquet(self.part(0, batch))
        level, number = 0, batch
        while (number + 1) % self.FAN == 0:
            parts = [self.part(level, i) for i in range(number + 1 - self.FAN, number + 1)]
            level, number = level + 1, number // self.FAN
            graph.compact_part(events.sparkSession.read.parquet(*parts)).write.mode("overwrite").parquet(self.part(level, number))

    def parts(self, batches: int) -> list[str]:
        """The parts that together hold the first so many batches."""
        out, level, rest = [], 0, batches
        while rest:
            out += [self.part(level, i) for i in range(rest - rest % self.FAN, rest)]
            level, rest = level + 1, rest // self.FAN
        return out

    def snapshot(self, spark: SparkSession, batches: int) -> DataFrame:
        return graph.compact_part(spark.read.parquet(*self.parts(batches))).drop("seq")


class Stopped(Exception):
    """What a query is stopped with, to show that it goes on where it was."""


class StopAfter:
    """A foreachBatch target that does what another one does and then, once, at a batch, fails before the batch is committed."""

    def __init__(self, target, batch: int):
        self.target, self.batch = target, batch

    def __call__(self, rows: DataFrame, batch: int) -> None:
        self.target(rows, batch)
        if batch == self.batch:
            raise Stopped(f"stopped at batch {batch}")


def drain(writer) -> int:
    """Runs a stream over what is there, from its checkpoint on, until all of it is done; returns the number of batches so far."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return last["batchId"] + 1 if last else 0


def committed(spark: SparkSession, checkpoint: str) -> int:
    """How many batches a checkpoint has committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)


class _Sizes(StatefulProcessor):
    """Emits a file's crossing of the threshold, once."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        size = self.size.get()[0] if self.size.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            new = size + len((r.data or "").encode())
            if size <= self.threshold < new:
                out.append((key[0], int(r.seq), new))
            size = new
        self.size.update((size,))
        yield pd.DataFrame(out, columns=["file_id", "seq", "new_size"]).astype({"file_id": "int64", "seq": "int64", "new_size": "int64"})

    def close(self) -> None:
        pass


def crossings(appends: DataFrame, threshold: int) -> DataFrame:
    """Stream of file_id, seq, new_size where a file's appends first exceed the threshold."""
    return appends.groupBy("file_id").transformWithStateInPandas(_Sizes(threshold), "file_id long, seq long, new_size long", "Append", "None")


class _Leases(StatefulProcessor):
    """A claim holds its file for the lease; a claim on a held file is refused; the timer ends the lease."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.owner = handle, handle.getValueState("owner", "owner string, until long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for r in pd.concat(list(rows)).itertuples():
            held = self.owner.get() if self.owner.exists() else None
            free = held is None or held[1] <= now or held[0] == r.owner
            if free:
                self.owner.update((r.owner, now + self.lease_ms))
                self.handle.registerTimer(now + self.lease_ms)
            out.append((key[0], r.owner, bool(free)))
        yield pd.DataFrame(out, columns=["file_id", "owner", "granted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        held = self.owner.get() if self.owner.exists() else None
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.owner.clear()
        yield pd.DataFrame({"file_id": pd.Series(dtype="int64"), "owner": pd.Series(dtype="str"), "granted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def leases(claims: DataFrame, lease_ms: int = LEASE_MS) -> DataFrame:
    """Stream of file_id, owner, granted for claims (file_id, owner)."""
    return claims.groupBy("file_id").transformWithStateInPandas(_Leases(lease_ms), "file_id long, owner string, granted boolean", "Append", "ProcessingTime")


#: Rows of a frame that a processor gives out at once.
AT_ONCE = 10_000


class _Entities(StatefulProcessor):
    """Files that mention an entity and where each first did; a new file is linked to those before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file_id long", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        known = self.files.exists()
        first: dict[int, int] = {}  # of the batch's files that are new
        for r in pd.concat(list(rows)).sort_values(["seq", "file_id"]).itertuples():
            if int(r.file_id) not in first and not (known and self.files.containsKey((int(r.file_id),))):
                first[int(r.file_id)] = int(r.seq)
        if not first:
            return
        out = []
        before = ((o[0], s[0]) for o, s in self.files.iterator()) if known else ()
        for other, seq in chain(before, list(first.items())):  # the state is read once a batch
            out += [(file, other, key[0]) for file, own in first.items() if seq < own]
            if len(out) >= AT_ONCE:
                yield self._frame(out)
                out = []
        for file, seq in first.items():
            self.files.updateValue((file,), (seq,))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source", "target", "entity"]).astype({"source": "int64", "target": "int64"})

    def close(self) -> None:
        pass


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """Stream of source, target, entity for mentions (entity, file_id, seq) as they come."""
    return mentions.groupBy("entity").transformWithStateInPandas(_Entities(), "source long, target long, entity string", "Append", "None")


class Cooccurrer:
    """foreachBatch target: links as mentions (entity, file_id, seq) come, for logs of many entities: a batch is joins, and no
    entity is a call of its own, as it is with cooccurrences.

    Batch b writes where its new files first mentioned their entities as firsts/part=b, and their links to those before them
    as links/part=b. What was known comes from the parts below b alone, so a batch that runs again writes its parts anew.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, mentions: DataFrame, batch: int) -> None:
        spark, keys = mentions.sparkSession, ["entity", "file_id"]
        new = mentions.groupBy(*keys).agg(F.min("seq").alias("seq"))
        known = spark.read.parquet(*[f"{self.path}/firsts/part={i}" for i in range(batch)]) if batch else None
        if known is not None:
            new = new.join(known, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/firsts/part={batch}")
        new = spark.read.parquet(f"{self.path}/firsts/part={batch}")
        before = (new if known is None else known.unionByName(new)).select("entity", F.col("file_id").alias("target"), F.col("seq").alias("before"))
        links = new.withColumnRenamed("file_id", "source").join(before, "entity").where("before < seq and source <> target")
        links.select("source", "target", "entity").write.mode("overwrite").parquet(f"{self.path}/links/part={batch}")

    def links(self, spark: SparkSession, batches: int) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/links/part={i}" for i in range(batches)])


def tail_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's files as a stream; the checkpoint says how far it was read."""
    return spark.readStream.schema(schema).parquet(path)


def stage_metrics(records: DataFrame) -> DataFrame:
    """Calls, seconds and cost by arm and stage as they grow."""
    return records.groupBy("arm", "stage").agg(F.count("*").alias("calls"), F.sum("duration_seconds").alias("seconds"), F.sum("cost_usd").alias("cost"))


class _Cap(StatefulProcessor):
    """What each arm has spent; a paid call is refused once the cap is reached."""

    def __init__(self, cap: float, free: str):
        self.cap, self.free = cap, free

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        spent, out = self.spent.get()[0] if self.spent.exists() else 0.0, []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            refused = r.provider.lower() != self.free and spent >= self.cap
            out.append((key[0], int(r.seq), spent, refused))
            spent += 0.0 if refused else float(r.cost_usd)
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["arm", "seq", "spent_before", "refused"])

    def close(self) -> None:
        pass


def capped_costs(calls: DataFrame, cap: float, free: str = "ollama") -> DataFrame:
    """Stream of arm, seq, spent_before, refused for calls (arm, seq, provider, cost_usd) as they come."""
    return calls.groupBy("arm").transformWithStateInPandas(_Cap(cap, free), "arm string, seq long, spent_before double, refused boolean", "Append", "None")


def soak(spark: SparkSession, rows_per_second: int = 1000, files: int = 64) -> DataFrame:
    """A steady stream of file_id, seq, data, for mixed runs of appends and reads."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return r.select((F.col("value") % files + 1).alias("file_id"), F.col("value").alias("seq"), F.concat(F.lit("line "), F.col("value").cast("string"), F.lit("\n")).alias("data"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
