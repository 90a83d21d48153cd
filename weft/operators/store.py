"""The store as event tables: a view of the latest per key takes the place of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .number import numbered
from .scan import fold_states, scan
from .shared import new_dir, staged

# States of a file, the moves between them, and the most targets of a redirect.
STATES = ("ACTIVE", "SPLITTING", "SPLIT", "REDIRECT")
MOVES = {("ACTIVE", "SPLITTING"), ("SPLITTING", "ACTIVE"), ("SPLITTING", "SPLIT"), ("SPLITTING", "REDIRECT"), ("SPLIT", "REDIRECT")}
MAX_TARGETS = 8


def latest(events: DataFrame, key: str = "file_id") -> DataFrame:
    """The last event of each key by seq; keys whose last event is a delete are gone. One aggregate with partial results."""
    cols = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*cols), "seq").alias("e"))
    return last.where("e.op <> 'delete'").select(key, *[F.col(f"e.{c}").alias(c) for c in cols if c != "op"])


def replay(wal: DataFrame, checkpoint: int = -1, known: tuple = ("put", "delete")) -> DataFrame:
    """latest() of the records after the checkpoint; an unknown record type is an error."""
    checked = wal.withColumn("op", F.when(F.col("op").isin(*known), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown record "), F.col("op")))))
    return latest(checked.where(F.col("seq") > checkpoint))


def append_sizes(appends: DataFrame, threshold: int = T.SPLIT_THRESHOLD, bound: int | None = None) -> DataFrame:
    """file_id, seq, old_size, new_size, crossed for appends (file_id, seq, data), sizes in bytes. A file of more than bound appends is summed in ranges."""
    x = appends.select("file_id", "seq", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("n"))
    x = scan(x, ["file_id"], "seq", {"new_size": (F.sum, F.col("n"))}, upto=True, bound=bound).withColumn("old_size", F.col("new_size") - F.col("n"))
    return x.select("file_id", "seq", "old_size", "new_size", T.crossing(F.col("old_size"), F.col("new_size"), threshold).alias("crossed"))


def content_of(appends: DataFrame) -> DataFrame:
    """file_id, size_bytes, content: the appends of a file in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"])
    return appends.groupBy("file_id").agg(F.array_join(parts, "").alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))


def allocate_ids(new: DataFrame, used: DataFrame, order: str | list[str]) -> DataFrame:
    """file_id after the largest in use, in order; the first column of the order is a number."""
    top = used.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    keys = [order] if isinstance(order, str) else list(order)
    return numbered(new, *keys, name="__n").join(F.broadcast(top)).withColumn("file_id", F.col("top") + F.col("__n")).drop("__n", "top")  # one row is broadcast


def put_edges(edges: DataFrame, now: int) -> DataFrame:
    """Edges checked (ids set, type known, weight positive) and stamped."""
    from .graph import EDGE_TYPES

    good = (F.col("source") > 0) & (F.col("target") > 0) & F.col("edge_type").isin(*EDGE_TYPES) & (F.col("weight") > 0)
    return edges.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("bad edge")).cast("boolean"))).withColumn("last_updated", F.lit(now).cast("long"))


def put_segments(segments: DataFrame, catalog: DataFrame, order: str = "seq") -> DataFrame:
    """Segments with id 0 get a new id and create, others append: file_id, op, data, path."""
    made = allocate_ids(segments.where("file_id = 0").drop("file_id"), catalog, order).withColumn("op", F.lit("create"))
    return made.unionByName(segments.where("file_id <> 0").withColumn("op", F.lit("append")))


def validate_plan(ranges: DataFrame) -> DataFrame:
    """plan_id, valid, reason. ranges: plan_id, new_path, start, end, size, and proposal, the new file's number in its plan (a
    new file for each row without it). No range outside the file, none overlapping, no file without a range (null) or
    with an empty path, no path for two files.
    """
    if "proposal" not in ranges.columns:
        ranges = ranges.withColumn("proposal", F.monotonically_increasing_id())
    end_before = F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(Window.partitionBy("plan_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.withColumn("np", T.normalize_topic_path(F.col("new_path"))).withColumn("before", end_before)
    x = x.withColumn("bad", F.when(F.col("start").isNull() | F.col("end").isNull(), "no ranges").when((F.col("start") < 0) | (F.col("end") > F.col("size")) | (F.col("end") < F.col("start")), "bounds").when((F.col("end") > F.col("start")) & (F.col("before") > F.col("start")), "overlap"))
    files = x.groupBy("plan_id", "proposal").agg(F.min("np").alias("np"), F.min("bad").alias("bad"))
    paths = files.groupBy("plan_id").agg(F.countDistinct("np").alias("d"), F.count("*").alias("n"), F.min("bad").alias("bad"), F.bool_or(F.coalesce("np", F.lit("")) == "").alias("empty"))
    reason = F.coalesce("bad", F.when(F.col("empty"), "empty path"), F.when(F.col("d") < F.col("n"), "duplicate path"), F.lit("ok"))
    return paths.select("plan_id", (reason == "ok").alias("valid"), reason.alias("reason"))


def execute_split(plan: DataFrame, files: DataFrame, used: DataFrame) -> dict[str, DataFrame]:
    """All of a split's output from one plan: new files, stubs, paths and edges.

    plan: file_id, new_path, start, end (byte ranges, checked), and pos, the place of a range in its new file (by start
    without it); files: file_id, content. New ids follow the largest used, in order of file and path. A file has
    MAX_TARGETS targets at most.
    """
    ordered = plan.withColumn("np", T.normalize_topic_path(F.col("new_path")))
    if "pos" not in plan.columns:
        ordered = ordered.withColumn("pos", F.lit(0))
    grouped = ordered.groupBy("file_id", "np").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("ranges"))
    given = allocate_ids(grouped.withColumnRenamed("file_id", "old_id"), used, ["old_id", "np"])
    body = given.join(files.select(F.col("file_id").alias("old_id"), "content"), "old_id")
    body = body.select("old_id", "file_id", F.col("np").alias("path"), T.slice_bytes(F.col("content"), F.col("ranges")).cast("string").alias("content"))
    new = body.select("file_id", "path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.lit("ACTIVE").alias("status"), F.col("old_id").alias("parent_topic_id"), F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("path_hash"))
    stubs = body.groupBy("old_id").agg(F.array_sort(F.collect_list("file_id")).alias("targets"))
    many = F.when(F.size("targets") > MAX_TARGETS, F.raise_error(F.lit("too many targets")).cast("array<bigint>")).otherwise(F.col("targets"))
    stubs = stubs.select(F.col("old_id").alias("file_id"), many.alias("redirect_target_ids"), F.lit("REDIRECT").alias("status"), T.redirect_stub(F.col("targets")).alias("content"))
    ids = body.select("old_id", "file_id")
    sib = ids.join(ids.withColumnRenamed("file_id", "target"), "old_id").where("file_id <> target").select(F.col("file_id").alias("source"), "target", F.lit("SPLIT_SIBLING").alias("edge_type"))
    red = ids.select(F.col("old_id").alias("source"), F.col("file_id").alias("target"), F.lit("REDIRECT").alias("edge_type"))
    return {"files": new, "stubs": stubs, "paths": new.select("path", "file_id"), "edges": sib.unionByName(red).withColumn("weight", F.lit(1).cast("long"))}


def follow_redirects(stubs: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, content of all targets in order."""
    t = stubs.select("file_id", F.posexplode("redirect_target_ids").alias("pos", "target"))
    parts = t.join(files.select(F.col("file_id").alias("target"), "content"), "target").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("p"))
    return parts.select("file_id", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("content"))


def number_versions(writes: DataFrame, key: str = "file_id", order: str = "seq") -> DataFrame:
    return writes.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def visible(versions: DataFrame, epoch: int) -> DataFrame:
    """Each file's last version of the epoch or before."""
    return versions.where(F.col("epoch") <= epoch).groupBy("file_id").agg(F.max("version").alias("version"))


def content_at(requests: DataFrame, versions: DataFrame, *, missing: str = "error", bound: int | None = None) -> DataFrame:
    """file_id, epoch, version, content of requests (file_id, epoch): what the file held at the epoch.

    versions: file_id, epoch (distinct in a file), full, data. A full one holds the whole content, any other is appended to what
    was there. version is the epoch of the last one at or before the request; without one the request is an error, or with
    missing of "keep" a row with neither version nor content.

    An as-of join in one pass: requests and versions are put in order together, and the last version and the last full copy
    are carried forward (in ranges, where a file is large). A request then reads that copy and what was appended up to its
    version, no matter how many copies the file has before.
    """
    asked = requests.select("file_id", "epoch").distinct().withColumns({"__asks": F.lit(1), "full": F.lit(False), "data": F.lit(None).cast("string")})
    there = versions.select("file_id", "epoch", F.lit(0).alias("__asks"), F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("data", F.lit("")).alias("data"))
    given = F.col("__asks") == 0
    carried = {"version": (F.max, F.when(given, F.col("epoch"))), "copy": (F.max, F.when(given & F.col("full"), F.col("epoch")))}
    x = scan(there.unionByName(asked), ["file_id"], "epoch", carried, "__asks", upto=True, bound=bound)
    x = x.withColumn("copy", F.coalesce("copy", F.lit(-(1 << 63))))  # without a copy all that was appended counts
    wanted = x.where("__asks = 1")
    if missing != "keep":
        wanted = wanted.where(_or_error(F.col("version").isNotNull(), F.lit("no version of file "), F.col("file_id"), F.lit(" at "), F.col("epoch")))
    parts = x.where("__asks = 0").select("file_id", "copy", F.col("epoch").alias("at"), "data")
    met = wanted.select("file_id", "epoch", "version", "copy").join(parts, ["file_id", "copy"], "left").where(F.col("version").isNull() | (F.col("at") <= F.col("version")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "data"))), lambda y: y["data"]), "")
    out = met.groupBy("file_id", "epoch", "version").agg(body.alias("content"))
    return out.withColumn("content", F.when(F.col("version").isNotNull(), F.col("content")))


def collectable(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """file_id, version that no pinned epoch can see: superseded at or before the oldest pin, and never the current one."""
    w = versions.withColumn("superseded", F.lead("epoch").over(Window.partitionBy("file_id").orderBy("version")))
    oldest = pins.agg(F.min("epoch").alias("oldest"))
    return w.join(F.broadcast(oldest)).where(F.col("superseded").isNotNull() & (F.col("oldest").isNull() | (F.col("oldest") >= F.col("superseded")))).select("file_id", "version")


def transitions(events: DataFrame) -> DataFrame:
    """file_id, seq, status, legal: against the status before; a file begins ACTIVE."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("file_id").orderBy("seq")), F.lit("ACTIVE"))
    legal = F.concat(before, F.lit(">"), F.col("status")).isin(*[f"{a}>{b}" for a, b in sorted(MOVES)])
    return events.select("file_id", "seq", "status", (legal | (F.col("seq") == 0)).alias("legal"))


def scan_wal(records: DataFrame, checkpoint: int = -1) -> DataFrame:
    """Records (segment, seq, payload, crc) after the checkpoint. A last record that is torn is left out; any other is an error."""
    last = records.agg(F.max(F.struct("segment", "seq")).alias("last"))
    x = records.where(F.col("seq") > checkpoint).join(F.broadcast(last)).withColumn("whole", F.crc32(F.col("payload").cast("binary")) == F.col("crc"))
    torn = F.when(F.struct("segment", "seq") == F.col("last"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("seq").cast("string"))).cast("boolean"))
    return x.where(F.when(F.col("whole"), F.lit(True)).otherwise(torn)).drop("last", "whole")


def archivable(segments: DataFrame, checkpoint_segment: int) -> DataFrame:
    return segments.where(F.col("segment") < checkpoint_segment)


def truncate_log(log: DataFrame, high_water: int) -> DataFrame:
    """What is kept after compaction; numbers of what goes are never used again, since new ones follow the largest ever given."""
    return log.where(F.col("seq") > high_water)


def epoch_pins(events: DataFrame, bound: int | None = None) -> DataFrame:
    """epoch, n still held, from acquire (+1) and release (-1) events (epoch, seq, delta); releasing what is not held is an error."""
    x = scan(events.select("epoch", "seq", "delta"), ["epoch"], "seq", {"held": (F.sum, F.col("delta"))}, upto=True, bound=bound)
    good = F.when(F.col("held") >= 0, F.lit(True)).otherwise(F.raise_error(F.lit("released twice")).cast("boolean"))
    return x.where(good).groupBy("epoch").agg(F.sum("delta").alias("n")).where("n > 0")


def section_ranges(files: DataFrame) -> DataFrame:
    """file_id, ranges: contiguous byte ranges that begin at markers, each sought from the one before on; the first begins at 0 and the last ends the file.

    files: file_id, content, markers. A marker that does not occur in order is an error.
    """

    def step(a, m):
        p = F.call_function("locate", m, F.col("content"), a["next"])
        found = F.when(p > 0, p).otherwise(F.raise_error(F.concat(F.lit("no section at "), m)).cast("int"))
        return F.struct((found + 1).alias("next"), F.concat(a["at"], F.array(found)).alias("at"))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    chars = F.transform(F.aggregate("markers", start, step)["at"], lambda p, i: F.when(i == 0, F.lit(1)).otherwise(p))
    first = F.transform(chars, lambda p: T.char_to_byte_offset(F.col("content"), p - 1).cast("long"))
    ends = F.concat(F.slice(F.col("first"), F.lit(2), F.size("first")), F.array(F.octet_length("content").cast("long")))
    return files.withColumn("first", first).select("file_id", F.arrays_zip(F.col("first").alias("start"), ends.alias("end")).alias("ranges"))


def checked_ids(requests: DataFrame) -> DataFrame:
    """Requests by file_id; 0, which is unset, and null are errors."""
    return requests.where(F.when(F.col("file_id") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("file id 0 is invalid")).cast("boolean")))


def get_records(requests: DataFrame, catalog: DataFrame, *, missing: str = "error") -> DataFrame:
    """The catalog's rows for requests (file_id). missing: error, or keep (found says which are there)."""
    x = checked_ids(requests.select("file_id").distinct()).join(catalog.withColumn("found", F.lit(True)), "file_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return x if missing == "keep" else x.where(_or_error(F.col("found"), F.lit("no file "), F.col("file_id"))).drop("found")


def _or_error(good: Column, *words: Column) -> Column:
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(*[w.cast("string") for w in words])).cast("boolean"))


def get_files(requests: DataFrame, catalog: DataFrame, content: DataFrame, paths: DataFrame, *, missing: str = "error") -> DataFrame:
    """file_id, version, path, content (and found): content and version by id, the path if there is one, else empty. The smallest of several paths counts."""
    x = get_records(requests, catalog.select("file_id", "version"), missing="keep")
    x = x.join(content.select("file_id", "content").withColumn("__held", F.lit(True)), "file_id", "left").withColumn("found", F.col("found") & F.coalesce("__held", F.lit(False))).drop("__held")
    x = x.join(paths.groupBy("file_id").agg(F.min("path").alias("path")), "file_id", "left").withColumn("path", F.coalesce("path", F.lit("")))
    if missing == "keep":
        return x.select("file_id", "version", "path", "content", "found")
    return x.where(_or_error(F.col("found"), F.lit("no file "), F.col("file_id"))).select("file_id", "version", "path", "content")


def read_headers(requests: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, headers (text and byte offset) of the files asked for."""
    x = get_records(requests, files.select("file_id", "content"))
    return x.select("file_id", T.header_offsets(F.col("content")).alias("headers"))


def create_files(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows of new files (file_id, data), version 1; an id that is taken is an error."""
    x = checked_ids(new).join(catalog.select("file_id").distinct().withColumn("taken", F.lit(True)), "file_id", "left")
    x = x.where(_or_error(F.col("taken").isNull(), F.lit("file exists: "), F.col("file_id")))
    return x.select("file_id", F.lit(1).cast("long").alias("version"), F.octet_length("data").cast("long").alias("size_bytes"), F.lit("ACTIVE").alias("status"))


def admit_writes(writes: DataFrame, catalog: DataFrame) -> DataFrame:
    """writes (file_id, ...) with admitted and reason: a file that is not there, or that is being split, takes none."""
    x = checked_ids(writes).join(catalog.select("file_id", F.col("status").alias("__status")), "file_id", "left")
    reason = F.when(F.col("__status").isNull(), "not found").when(F.col("__status") == "SPLITTING", "split in progress")
    return x.withColumn("admitted", reason.isNull()).withColumn("reason", F.coalesce(reason, F.lit(""))).drop("__status")


def compare_and_set(requests: DataFrame, catalog: DataFrame, bound: int | None = None) -> DataFrame:
    """file_id, seq, swapped, version (after the request): requests (file_id, seq, expected, new_version) in order; one whose
    expected version is not the current one changes nothing. A file that is not in the catalog is an error.

    A block's map says to which version the expected ones lead. It holds only those that a request before the block can have
    set (or the catalog's own), as no other can be current when the block begins: in a log whose versions go up these are
    the few in flight, however many requests a file has.
    """
    now = catalog.select("file_id", F.col("version").cast("long").alias("state"))
    x = checked_ids(requests).select("file_id", "seq", F.col("expected").cast("long").alias("expected"), F.col("new_version").cast("long").alias("new_version"))
    x = x.join(now, "file_id", "left").where(_or_error(F.col("state").isNotNull(), F.lit("no file "), F.col("file_id")))
    made = x.groupBy("file_id", F.col("new_version").alias("expected")).agg(F.min("seq").alias("born"))
    never, always = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    x = x.join(made, ["file_id", "expected"], "left").withColumn("born", F.when(F.col("expected") == F.col("state"), always).otherwise(F.coalesce("born", never))).drop("state")

    def follow(entries, version):
        return F.coalesce(F.get(F.filter(entries, lambda y: y["expected"] == version), F.lit(0))["version"], version)

    def joined(first, old, new):
        known = lambda y: F.exists(old, lambda z: z["expected"] == y["expected"])
        return F.concat(old, F.filter(new, lambda y: (y["born"] < first) & ~known(y)))

    def moved(entries, to):
        return F.transform(entries, lambda y: F.struct(y["expected"].alias("expected"), to(y["version"]).alias("version"), y["born"].alias("born")))

    def as_map(events):
        first, none = F.element_at(events, 1)["seq"], F.expr("cast(array() as array<struct<expected:bigint,version:bigint,born:bigint>>)")

        def add(m, e):
            after = moved(m["entries"], lambda v: F.when(v == e["expected"], e["new_version"]).otherwise(v))
            own = F.array(F.struct(e["expected"].alias("expected"), e["new_version"].alias("version"), e["born"].alias("born")))
            return F.struct(m["first"].alias("first"), joined(m["first"], after, own).alias("entries"))

        return F.aggregate(events, F.struct(first.alias("first"), none.alias("entries")), add)

    def compose(f, g):
        return F.struct(f["first"].alias("first"), joined(f["first"], moved(f["entries"], lambda v: follow(g["entries"], v)), g["entries"]).alias("entries"))

    files = now.join(x.select("file_id").distinct(), "file_id", "left_semi")
    out = fold_states(x, "file_id", "seq", files, as_map=as_map, compose=compose, apply=lambda m, v: follow(m["entries"], v), step=lambda v, e: F.when(e["expected"] == v, e["new_version"]).otherwise(v), bound=bound)
    return out.select("file_id", "seq", F.coalesce(F.col("expected") == F.col("before"), F.lit(False)).alias("swapped"), F.col("state").alias("version"))


def guard_transitions(events: DataFrame, bound: int | None = None) -> DataFrame:
    """file_id, seq, accepted, status (after the event): a wanted status that may not follow the current one is refused and
    changes nothing; a file begins ACTIVE. Aborting a split is the move back to ACTIVE. A block's map has four states."""
    place = {s: i for i, s in enumerate(STATES)}
    wanted = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for s, i in place.items()], F.lit(-1))
    moves = F.array(*[F.lit(place[a] * len(STATES) + place[b]) for a, b in sorted(MOVES)])
    legal = lambda s, w: (w >= 0) & F.array_contains(moves, s * len(STATES) + w)
    step = lambda s, e: F.when(legal(s, e["wanted"]), e["wanted"]).otherwise(s)
    x = events.select("file_id", "seq", wanted.alias("wanted"))
    out = fold_states(
        x,
        "file_id",
        "seq",
        x.select("file_id", F.lit(place["ACTIVE"]).alias("state")).distinct(),
        as_map=lambda events: F.aggregate(events, F.array(*[F.lit(i) for i in range(len(STATES))]), lambda m, e: F.transform(m, lambda s: step(s, e))),
        compose=lambda f, g: F.transform(f, lambda s: F.get(g, s)),
        apply=F.get,
        step=step,
        bound=bound,
    )
    names = F.array(*map(F.lit, STATES))
    return out.select("file_id", "seq", legal(F.col("before"), F.col("wanted")).alias("accepted"), F.element_at(names, F.col("state") + 1).alias("status"))


def lease_decisions(claims: DataFrame, lease: int, bound: int | None = None) -> DataFrame:
    """file_id, seq, owner, granted, holder, until: what becomes of claims (file_id, seq, owner, at), in order of seq; at does not fall.

    A claim is granted on a file that nobody holds or whose lease is over, and its owner's next claims renew the lease;
    others are refused while it lasts. holder and until are those after the claim.

    No task walks through a file. The claims of one owner that follow each other within a lease are a session, and whoever is
    granted the file keeps it to the session's end: so a file is a fold over one number, the time from which it is free. A
    block's map has a step for each result it can end with, not for each claim.
    """
    base = new_dir(claims.sparkSession, "leases")  # each scan reads its rows several times, so they are written in between
    x = claims.select("file_id", "seq", "owner", F.col("at").cast("long").alias("at"))
    own = ["file_id", "owner"]
    x = staged(scan(x, own, "seq", {"prior": (F.max, F.col("at"))}, bound=bound), f"{base}/prior")
    new = (F.col("prior").isNull() | (F.col("at") >= F.col("prior") + lease)).cast("long")
    x = staged(scan(x, own, "seq", {"session": (F.sum, new)}, upto=True, bound=bound).drop("prior"), f"{base}/sessions")
    ends = x.groupBy(*own, "session").agg((F.max("at") + lease).alias("free"))
    x = staged(x.join(ends, [*own, "session"]).drop("session"), f"{base}/free")

    def merged(steps):  # of neighbours with one result the later says all
        return F.filter(steps, lambda y, i: F.coalesce(F.get(steps, i + 1)["free"] != y["free"], F.lit(True)))

    def result(steps, free):
        return F.coalesce(F.get(F.filter(steps, lambda y: free <= y["upto"]), F.lit(0))["free"], free)

    def moved(steps, to):
        return F.transform(steps, lambda y: F.struct(y["upto"].alias("upto"), to(y["free"]).alias("free")))

    def as_map(events):
        def add(m, e):
            after = moved(m, lambda free: F.when(e["at"] >= free, e["free"]).otherwise(free))
            return merged(F.concat(after, F.array(F.struct(e["at"].alias("upto"), e["free"].alias("free")))))

        return F.aggregate(events, F.expr("cast(array() as array<struct<upto:bigint,free:bigint>>)"), add)

    def compose(f, g):
        last = F.element_at(f, -1)["upto"]
        return merged(F.concat(moved(f, lambda free: result(g, free)), F.filter(g, lambda y: y["upto"] > last)))

    files = x.select("file_id", F.lit(-(1 << 63)).alias("state")).distinct()
    out = fold_states(x, "file_id", "seq", files, as_map=as_map, compose=compose, apply=result, step=lambda free, e: F.when(e["at"] >= free, e["free"]).otherwise(free), bound=bound)
    out = out.withColumn("fresh", F.col("at") >= F.col("before")).select("file_id", "seq", "owner", "at", "fresh")
    out = staged(out, f"{base}/folded")
    begun = out.where("fresh").select("file_id", F.col("seq").alias("start"), F.col("owner").alias("holder"))
    held = scan(out, ["file_id"], "seq", {"start": (F.max, F.when(F.col("fresh"), F.col("seq")))}, upto=True, bound=bound).join(begun, ["file_id", "start"])
    held = staged(held.withColumn("granted", F.col("owner") == F.col("holder")), f"{base}/held")
    until = scan(held, ["file_id"], "seq", {"until": (F.max, F.when(F.col("granted"), F.col("at") + lease))}, upto=True, bound=bound)
    return until.select("file_id", "seq", "owner", "granted", "holder", "until")


def index_paths(events: DataFrame) -> DataFrame:
    """The path index (path, file_id) after events (path, seq, op put or delete, file_id): a put of a path that is there replaces its file."""
    return latest(events, "path").select("path", "file_id")


def path_deletes(events: DataFrame, *then: str) -> DataFrame:
    """path, seq, found: whether each delete met its path. Events of a path are in order of seq, then of the other columns;
    without these the order of equal seq is open."""
    before = F.lag("op").over(Window.partitionBy("path").orderBy("seq", *then))
    return events.withColumn("found", F.coalesce(before == "put", F.lit(False))).where("op = 'delete'").select("path", "seq", "found")


def recover_splits(commits: DataFrame, catalog: DataFrame, paths: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """catalog, paths and edges after the split commits of the log are applied: old_id, old_path, file_id, new_path, size_bytes,
    a row for each new file. All of it replaces or is there already, so commits that were applied before change nothing."""
    from .graph import append_if_absent

    old = commits.select(F.col("old_id").alias("file_id"), F.lit("REDIRECT").alias("status"), F.lit(0).cast("long").alias("size_bytes")).distinct()
    new = commits.select("file_id", F.lit("ACTIVE").alias("status"), "size_bytes").distinct()
    put = new.unionByName(old)
    kept = catalog.select("file_id", "status", "size_bytes").join(put.select("file_id"), "file_id", "left_anti")
    named = commits.select(T.normalize_topic_path(F.col("new_path")).alias("path"), "file_id").unionByName(commits.select(T.normalize_topic_path(F.col("old_path")).alias("path"), F.col("old_id").alias("file_id"))).distinct()
    ids = commits.select("old_id", "file_id").distinct()
    sib = ids.join(ids.withColumnRenamed("file_id", "target"), "old_id").where("file_id <> target").select(F.col("file_id").alias("source"), "target", F.lit("SPLIT_SIBLING").alias("edge_type"))
    red = ids.select(F.col("old_id").alias("source"), F.col("file_id").alias("target"), F.lit("REDIRECT").alias("edge_type"))
    missing = append_if_absent(edges, sib.unionByName(red))
    return {
        "catalog": kept.unionByName(put),
        "paths": paths.select("path", "file_id").join(named.select("path"), "path", "left_anti").unionByName(named),
        "edges": edges.select("source", "target", "edge_type").unionByName(missing.select("source", "target", "edge_type")),
    }
