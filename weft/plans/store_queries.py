"""Queries on the store, on document formats and on event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pipelines, store
from ..operators.models import parse_segment
from ..operators.shared import new_dir
from ..sources import mailbox
from ..sources.readers import chat_ticket, iter_pages
from .registry import query

_OPS = """ops AS (SELECT o_custkey + 1 AS file_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'delete' ELSE 'put' END AS op, o_totalprice AS size_bytes,
    (['ACTIVE', 'SPLITTING', 'SPLIT', 'REDIRECT'])[o_orderkey % 4 + 1] AS status FROM orders)"""


def ops(t):
    status = F.element_at(F.array(*[F.lit(s) for s in store.STATES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    op = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "delete").otherwise("put")
    return t.raw("orders").select((F.col("o_custkey") + 1).alias("file_id"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_totalprice").alias("size_bytes"), status.alias("status"))


_LATEST = f"WITH {_OPS}, last AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) = 1), live AS (SELECT file_id, seq, size_bytes, status FROM last WHERE op <> 'delete')"


@query(_LATEST + " SELECT * FROM live")
def catalog_latest(t):
    return store.latest(ops(t))


@query(_LATEST.replace("FROM orders)", "FROM orders WHERE o_orderkey > 5000)") + " SELECT * FROM live")
def wal_replay(t):
    return store.replay(ops(t), 5000)


@query(_LATEST + " SELECT status, count(*) AS n FROM live GROUP BY 1")
def status_counts(t):
    return store.latest(ops(t)).groupBy("status").agg(F.count("*").alias("n"))


@query(_LATEST + " SELECT max(file_id) AS max_id, count(*) AS n FROM live")
def max_id(t):
    return store.latest(ops(t)).agg(F.max("file_id").alias("max_id"), F.count("*").alias("n"))


@query(f"WITH {_OPS}, x AS (SELECT file_id, seq, status, coalesce(lag(status) OVER (PARTITION BY file_id ORDER BY seq), 'ACTIVE') AS before FROM ops) SELECT file_id, seq, status, seq = 0 OR (before || '>' || status) IN ('ACTIVE>SPLITTING', 'SPLITTING>ACTIVE', 'SPLITTING>SPLIT', 'SPLITTING>REDIRECT', 'SPLIT>REDIRECT') AS legal FROM x")
def status_transitions(t):
    return store.transitions(ops(t))


@query("SELECT conv_id + 1 AS file_id, sum(strlen(text))::BIGINT AS size_bytes, md5(string_agg(text, '' ORDER BY turn)) AS content_md5 FROM conversations GROUP BY 1")
def append_content(t):
    return store.content_of(t.appends()).select("file_id", "size_bytes", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("WITH x AS (SELECT conv_id + 1 AS file_id, turn AS seq, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS new_size FROM conversations) SELECT file_id, seq, (new_size - n)::BIGINT AS old_size, new_size::BIGINT AS new_size, new_size - n <= 512 AND new_size > 512 AS crossed FROM x")
def split_crossings(t):
    return store.append_sizes(t.appends(), 512)


@query("WITH l AS (SELECT DISTINCT conv_id FROM conversations), u AS (SELECT max(doc_id) + 1 AS top FROM documents) SELECT conv_id, top + row_number() OVER (ORDER BY conv_id) AS file_id FROM l, u")
def allocate_ids(t):
    return store.allocate_ids(t.raw("conversations").select("conv_id").distinct(), t.files(), "conv_id").select("conv_id", "file_id")


@query("""
    WITH s AS (SELECT conv_id * 1000 + turn AS seq, CASE WHEN turn = 0 THEN 0 ELSE conv_id + 1 END AS file_id FROM conversations), u AS (SELECT max(doc_id) + 1 AS top FROM documents)
    SELECT seq, top + row_number() OVER (ORDER BY seq) AS file_id, 'create' AS op FROM s, u WHERE file_id = 0 UNION ALL SELECT seq, file_id, 'append' FROM s WHERE file_id <> 0""")
def put_segments(t):
    s = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("turn") == 0, F.lit(0)).otherwise(F.col("conv_id") + 1).cast("long").alias("file_id"))
    return store.put_segments(s, t.files()).select("seq", "file_id", "op")


def _plan(t):
    """Two ranges of every file over the threshold; every third plan overlaps, every third repeats its path."""
    f = t.files().where(F.col("size_bytes") > T.SPLIT_THRESHOLD)
    half, kind = F.floor(F.col("size_bytes") / 2), F.col("file_id") % 3
    parts = F.array(
        F.struct(F.lit("a/one").alias("new_path"), F.lit(0).cast("long").alias("start"), half.alias("end")),
        F.struct(F.when(kind == 2, "./a//one/").otherwise("a/two").alias("new_path"), F.when(kind == 1, half - 1).otherwise(half).alias("start"), F.col("size_bytes").alias("end")),
    )
    return f.select(F.col("file_id").alias("plan_id"), F.col("size_bytes").alias("size"), F.inline(parts))


@query("WITH d AS (SELECT doc_id + 1 AS plan_id FROM documents WHERE strlen(text) > 8192) SELECT plan_id, plan_id % 3 = 0 AS valid, CASE plan_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'overlap' ELSE 'duplicate path' END AS reason FROM d")
def split_plan_validate(t):
    return store.validate_plan(_plan(t))


@query("""
    WITH r AS (SELECT l_orderkey AS plan_id, l_linenumber // 2 AS proposal, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber // 2 = 1 THEN '' ELSE 'p' || (l_orderkey * 7 + l_linenumber // 2) % 5 % 4 END AS path,
      (l_linenumber * 12 + l_partkey % 5)::BIGINT AS s, (l_linenumber * 12 + l_partkey % 5 + l_suppkey % 9)::BIGINT AS e, 90 AS size FROM lineitem),
    b AS (SELECT *, max(CASE WHEN e > s THEN e END) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    f AS (SELECT plan_id, proposal, min(path) AS path, min(CASE WHEN e > size THEN 'bounds' WHEN e > s AND before > s THEN 'overlap' END) AS bad FROM b GROUP BY 1, 2),
    p AS (SELECT plan_id, coalesce(min(bad), CASE WHEN bool_or(path = '') THEN 'empty path' WHEN count(DISTINCT path) < count(*) THEN 'duplicate path' ELSE 'ok' END) AS reason FROM f GROUP BY 1)
    SELECT plan_id, reason = 'ok' AS valid, reason FROM p""")
def split_plan_ranges(t):
    """Plans of several files with several ranges each: an order's lines, two to a file."""
    p = F.floor(F.col("l_linenumber") / 2)
    path = F.when((F.col("l_orderkey") % 13 == 0) & (p == 1), "").otherwise(F.concat(F.lit("p"), ((F.col("l_orderkey") * 7 + p) % 5 % 4).cast("string")))
    start = (F.col("l_linenumber") * 12 + F.col("l_partkey") % 5).cast("long")
    r = t.raw("lineitem").select(F.col("l_orderkey").alias("plan_id"), p.alias("proposal"), path.alias("new_path"), start.alias("start"), (start + F.col("l_suppkey") % 9).alias("end"), F.lit(90).alias("size"))
    return store.validate_plan(r)


def _cut(t):
    """Files over the threshold, cut after the first line feed past the middle (or at the end)."""
    f = t.files().where(F.col("size_bytes") > T.SPLIT_THRESHOLD)
    half = F.floor(F.length("content") / 2).cast("int")
    found = F.instr(F.substr(F.col("content"), half + 1, F.lit(1 << 30)), "\n")
    chars = F.when(found > 0, half + found).otherwise(F.length("content"))
    cut = T.char_to_byte_offset(F.col("content"), chars).cast("long")
    two = F.array(F.struct(F.concat("path", F.lit("/1")).alias("new_path"), F.lit(0).cast("long").alias("start"), F.col("cut").alias("end")), F.struct(F.concat("path", F.lit("/2")).alias("new_path"), F.col("cut").alias("start"), F.col("size_bytes").alias("end")))
    return f.withColumn("cut", cut).select("file_id", F.inline(two))


_CUT = """d AS (SELECT doc_id + 1 AS old_id, lang || '/' || source || '/doc-' || doc_id || '.md' AS path, text, length(text) // 2 AS half FROM documents WHERE strlen(text) > 8192),
    c AS (SELECT *, CASE WHEN instr(substring(text, half + 1), chr(10)) > 0 THEN half + instr(substring(text, half + 1), chr(10)) ELSE length(text) END AS chars FROM d),
    parts AS (SELECT old_id, path || '/1' AS path, substring(text, 1, chars) AS content FROM c UNION ALL SELECT old_id, path || '/2', substring(text, chars + 1) FROM c),
    new AS (SELECT *, (SELECT max(doc_id) + 1 FROM documents) + row_number() OVER (ORDER BY old_id, path) AS file_id FROM parts)"""


@query(f"WITH {_CUT} SELECT file_id, path, strlen(content) AS size_bytes, old_id AS parent_topic_id, md5(content) AS content_md5 FROM new")
def split_execute(t):
    x = store.execute_split(_cut(t), t.files(), t.files())["files"]
    return x.select("file_id", "path", "size_bytes", "parent_topic_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH {_CUT} SELECT a.file_id AS source, b.file_id AS target, 'SPLIT_SIBLING' AS edge_type FROM new a JOIN new b ON a.old_id = b.old_id AND a.file_id <> b.file_id UNION ALL SELECT old_id, file_id, 'REDIRECT' FROM new")
def split_edges(t):
    return store.execute_split(_cut(t), t.files(), t.files())["edges"].select("source", "target", "edge_type")


@query(f"WITH {_CUT} SELECT old_id AS file_id, md5('REDIRECT-STUB v1' || chr(10) || string_agg(file_id || chr(10), '' ORDER BY file_id)) AS stub_md5 FROM new GROUP BY 1")
def redirect_stubs(t):
    return store.execute_split(_cut(t), t.files(), t.files())["stubs"].select("file_id", F.md5(F.col("content").cast("binary")).alias("stub_md5"))


@query("SELECT doc_id + 1 AS file_id, md5(text) AS content_md5 FROM documents WHERE strlen(text) > 8192")
def redirect_follow(t):
    out = store.execute_split(_cut(t), t.files(), t.files())
    return store.follow_redirects(out["stubs"], out["files"]).select("file_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""
    WITH d AS (SELECT doc_id + 1 AS old_id, 'x/' || doc_id AS path, text, length(text) // 3 AS a, 2 * (length(text) // 3) AS b FROM documents WHERE strlen(text) > 8192),
    p AS (SELECT old_id, path || '/1' AS path, substring(text, b + 1) || substring(text, 1, a) AS content FROM d UNION ALL SELECT old_id, path || '/2', substring(text, a + 1, b - a) FROM d)
    SELECT path, (SELECT max(doc_id) + 1 FROM documents) + row_number() OVER (ORDER BY old_id, path) AS file_id, strlen(content) AS size_bytes, md5(content) AS content_md5 FROM p""")
def split_section_order(t):
    """Files cut in three; the first new file has the last part, then the first."""
    f = t.files().where(F.col("size_bytes") > T.SPLIT_THRESHOLD).select("file_id", "content", "size_bytes", F.concat(F.lit("x/"), (F.col("file_id") - 1).cast("string")).alias("path"))
    third = F.floor(F.length("content") / 3).cast("int")
    a, b = (T.char_to_byte_offset(F.col("content"), third * n).cast("long") for n in (1, 2))
    part = lambda n, pos, s, e: F.struct(F.concat("path", F.lit(f"/{n}")).alias("new_path"), F.lit(pos).alias("pos"), s.alias("start"), e.alias("end"))
    zero = F.lit(0).cast("long")
    plan = f.select("file_id", F.inline(F.array(part(1, 0, b, F.col("size_bytes")), part(1, 1, zero, a), part(2, 0, a, b))))
    x = store.execute_split(plan, t.files(), t.files())["files"]
    return x.select("path", "file_id", "size_bytes", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_FOUND = "c AS (SELECT o_custkey + 1 AS file_id, count(*) AS version FROM orders GROUP BY 1), r AS (SELECT DISTINCT l_partkey + 1 AS file_id FROM lineitem)"


def counted(t):
    """A catalog: a version for each order of a customer."""
    return t.raw("orders").groupBy((F.col("o_custkey") + 1).alias("file_id")).agg(F.count("*").alias("version"))


@query(f"WITH {_FOUND} SELECT r.file_id, coalesce(version, 0) AS version, version IS NOT NULL AS found FROM r LEFT JOIN c USING (file_id)")
def catalog_get(t):
    r = t.raw("lineitem").select((F.col("l_partkey") + 1).alias("file_id"))
    return store.get_records(r, counted(t), missing="keep").select("file_id", F.coalesce("version", F.lit(0)).alias("version"), "found")


@query(f"""WITH {_FOUND}, p AS (SELECT p_partkey + 1 AS file_id, replace(p_name, ' ', '-') || '/' || lower(p_type) || '/' || p_partkey AS path FROM part WHERE p_partkey % 3 > 0)
    SELECT r.file_id, coalesce(version, 0) AS version, coalesce(path, '') AS path, coalesce(md5(text), '') AS content_md5, version IS NOT NULL AND doc_id IS NOT NULL AS found FROM r LEFT JOIN c USING (file_id) LEFT JOIN documents ON doc_id + 1 = r.file_id LEFT JOIN p ON p.file_id = r.file_id""")
def get_file_join(t):
    """Content, version and path by id; some files have no version, no content or no path."""
    r = t.raw("lineitem").select((F.col("l_partkey") + 1).alias("file_id"))
    x = store.get_files(r, counted(t), t.files(), t.paths().where("file_id % 3 <> 1"), missing="keep")
    return x.select("file_id", F.coalesce("version", F.lit(0)).alias("version"), "path", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("content_md5"), "found")


@query("""
    WITH RECURSIVE e AS (SELECT o_custkey + 1 AS file_id, o_orderkey AS seq, o_orderkey % 4 AS expected, (o_orderkey + 1) % 4 AS new_version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    f(file_id, seq, i, swapped, version) AS (SELECT file_id, seq, i, expected = 0, CASE WHEN expected = 0 THEN new_version ELSE 0 END FROM e WHERE i = 1
      UNION ALL SELECT e.file_id, e.seq, e.i, e.expected = f.version, CASE WHEN e.expected = f.version THEN e.new_version ELSE f.version END FROM f JOIN e ON e.file_id = f.file_id AND e.i = f.i + 1)
    SELECT file_id, seq, swapped, version FROM f""")
def catalog_compare_and_set(t):
    o = t.raw("orders").select((F.col("o_custkey") + 1).alias("file_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4).alias("expected"), ((F.col("o_orderkey") + 1) % 4).alias("new_version"))
    return store.compare_and_set(o, o.select("file_id", F.lit(0).cast("long").alias("version")).distinct())


@query(f"""
    WITH RECURSIVE {_OPS}, e AS (SELECT file_id, seq, status, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS i FROM ops),
    m AS (SELECT unnest(['ACTIVE>SPLITTING', 'SPLITTING>ACTIVE', 'SPLITTING>SPLIT', 'SPLITTING>REDIRECT', 'SPLIT>REDIRECT']) AS move),
    f(file_id, seq, i, accepted, status) AS (SELECT file_id, seq, i, 'ACTIVE>' || status IN (SELECT move FROM m), CASE WHEN 'ACTIVE>' || status IN (SELECT move FROM m) THEN status ELSE 'ACTIVE' END FROM e WHERE i = 1
      UNION ALL SELECT e.file_id, e.seq, e.i, f.status || '>' || e.status IN (SELECT move FROM m), CASE WHEN f.status || '>' || e.status IN (SELECT move FROM m) THEN e.status ELSE f.status END FROM f JOIN e ON e.file_id = f.file_id AND e.i = f.i + 1)
    SELECT file_id, seq, accepted, status FROM f""")
def guarded_transitions(t):
    return store.guard_transitions(ops(t))


@query(f"WITH {_OPS}, last AS (SELECT file_id, arg_max(status, seq) AS status FROM ops GROUP BY 1) SELECT l_orderkey * 8 + l_linenumber AS seq, l_partkey + 1 AS file_id, coalesce(status, '') NOT IN ('', 'SPLITTING') AS admitted, CASE WHEN status IS NULL THEN 'not found' WHEN status = 'SPLITTING' THEN 'split in progress' ELSE '' END AS reason FROM lineitem LEFT JOIN last ON last.file_id = l_partkey + 1")
def admit_writes(t):
    catalog = ops(t).groupBy("file_id").agg(F.max_by("status", "seq").alias("status"))
    w = t.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") + 1).alias("file_id"))
    return store.admit_writes(w, catalog)


_PATH_EVENTS = "pe AS (SELECT 'p/' || l_partkey AS path, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_suppkey % 5 = 0 THEN 'delete' ELSE 'put' END AS op, l_suppkey + 1 AS file_id FROM lineitem)"


def path_events(t):
    op = F.when(F.col("l_suppkey") % 5 == 0, "delete").otherwise("put")
    return t.raw("lineitem").select(F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), op.alias("op"), (F.col("l_suppkey") + 1).alias("file_id"))


@query(f"WITH {_PATH_EVENTS}, l AS (SELECT path, arg_max(op, seq) AS op, arg_max(file_id, seq) AS file_id FROM pe GROUP BY 1) SELECT path, file_id FROM l WHERE op = 'put'")
def path_index_upsert(t):
    return store.index_paths(path_events(t))


@query(f"WITH {_PATH_EVENTS}, l AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY path ORDER BY seq, op, file_id) = 'put', false) AS found FROM pe) SELECT path, seq, found FROM l WHERE op = 'delete'")
def path_index_delete(t):
    """Events of a path with equal seq go by what they do and then by file, so both sides have one order."""
    return store.path_deletes(path_events(t), "op", "file_id")


@query(f"WITH {_CUT}, old AS (SELECT DISTINCT old_id, regexp_replace(path, '/[12]$', '') AS path FROM parts) SELECT file_id AS id, path, 'ACTIVE' AS status, (SELECT count(*) FROM new n WHERE n.old_id = new.old_id) AS n_edges FROM new UNION ALL SELECT old_id, path, 'REDIRECT', 2 FROM old")
def split_recovery(t):
    """The commits of all splits applied to an empty store, and once more to the result."""
    out = store.execute_split(_cut(t), t.files(), t.files())["files"]
    commits = out.select(F.col("parent_topic_id").alias("old_id"), F.regexp_replace("path", "/[12]$", "").alias("old_path"), "file_id", F.col("path").alias("new_path"), "size_bytes")
    none = lambda kind: t.spark.createDataFrame([], kind)
    state = {"catalog": none("file_id long, status string, size_bytes long"), "paths": none("path string, file_id long"), "edges": none("source long, target long, edge_type string")}
    for _ in range(2):
        state = store.recover_splits(commits, **state)
    n = state["edges"].groupBy(F.col("source").alias("file_id")).agg(F.count("*").alias("n_edges"))
    n = n.withColumn("n_edges", F.col("n_edges"))
    x = state["catalog"].join(state["paths"], "file_id").join(n, "file_id")
    return x.select(F.col("file_id").alias("id"), "path", "status", F.when(F.col("status") == "ACTIVE", F.col("n_edges") + 1).otherwise(F.col("n_edges")).alias("n_edges"))


_VERSIONS = "v AS (SELECT o_custkey + 1 AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey // 100 AS epoch FROM orders)"


def versions(t):
    x = t.raw("orders").select((F.col("o_custkey") + 1).alias("file_id"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / 100).alias("epoch"))
    return store.number_versions(x).select("file_id", "version", "epoch")


@query(f"WITH {_VERSIONS} SELECT file_id, max(version) AS version FROM v WHERE epoch <= 70 GROUP BY 1")
def version_visible(t):
    return store.visible(versions(t), 70).select("file_id", F.col("version").cast("long").alias("version"))


@query("""
    WITH v AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS file_id, CASE WHEN conv_id % 3 = 0 THEN conv_id * 40 + turn ELSE turn * 3 + conv_id % 5 END AS epoch, turn % 3 = 0 AND conv_id % 4 > 0 AS full_copy, coalesce(text, '') AS text FROM conversations),
    r AS (SELECT DISTINCT file_id, epoch + d AS epoch FROM v, (SELECT unnest([-2, 0, 1, 4]) AS d)),
    w AS (SELECT r.file_id, r.epoch, v.epoch AS version FROM r ASOF LEFT JOIN v ON v.file_id = r.file_id AND v.epoch <= r.epoch),
    x AS (SELECT w.*, c.epoch AS copy FROM w ASOF LEFT JOIN (SELECT file_id, epoch FROM v WHERE full_copy) c ON c.file_id = w.file_id AND c.epoch <= w.epoch)
    SELECT x.file_id, x.epoch, version, md5(string_agg(v.text, '' ORDER BY v.epoch)) AS content_md5 FROM x LEFT JOIN v ON v.file_id = x.file_id AND v.epoch >= coalesce(copy, -1000) AND v.epoch <= version GROUP BY 1, 2, 3""")
def content_at_version(t):
    """Every file around each of its versions; file 0 has a third of all of them, and some requests come before the first."""
    hot, turn = F.col("conv_id") % 3 == 0, F.col("turn")
    v = t.raw("conversations").select(F.when(hot, F.lit(0)).otherwise(F.col("conv_id")).alias("file_id"), F.when(hot, F.col("conv_id") * 40 + turn).otherwise(turn * 3 + F.col("conv_id") % 5).alias("epoch"), ((turn % 3 == 0) & (F.col("conv_id") % 4 > 0)).alias("full"), F.col("text").alias("data"))
    around = F.explode(F.array(*[F.lit(d) for d in (-2, 0, 1, 4)]))
    r = v.select("file_id", "epoch", around.alias("d")).select("file_id", (F.col("epoch") + F.col("d")).alias("epoch"))
    return store.content_at(r, v, missing="keep").select("file_id", "epoch", "version", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH {_VERSIONS}, s AS (SELECT *, lead(epoch) OVER (PARTITION BY file_id ORDER BY version) AS superseded FROM v) SELECT file_id, version FROM s WHERE superseded IS NOT NULL AND 60 >= superseded")
def version_gc(t):
    pins = t.spark.createDataFrame([(80,), (60,), (95,)], "epoch long")
    return store.collectable(versions(t), pins).select("file_id", F.col("version").cast("long").alias("version"))


@query("SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey + 1 END AS epoch, sum(CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING n > 0")
def epoch_pins(t):
    """Each line pins an epoch, and those of more than 25 release it again; epoch 0 has a third of all events."""
    x = t.raw("lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey") + 1).alias("epoch"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2).alias("seq"), "l_quantity")
    pins = x.select("epoch", "seq", F.lit(1).cast("long").alias("delta"))
    return store.epoch_pins(pins.unionByName(x.where("l_quantity > 25").select("epoch", (F.col("seq") + 1).alias("seq"), F.lit(-1).cast("long").alias("delta"))))


def _subjects(t):
    s = F.concat(F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "Re: ").otherwise("FWD:  re : "), F.col("text"))
    reply = F.when(F.col("turn") % 5 == 4, F.concat(F.lit(" <m"), F.col("conv_id").cast("string"), F.lit("> "))).otherwise(" ")
    refs = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("<r"), F.col("conv_id").cast("string"), F.lit(">  <x>")))
    return t.raw("conversations").select("conv_id", "turn", s.alias("subject"), reply.alias("reply"), refs.alias("refs"))


_SUBJECT = """s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'Re: ' ELSE 'FWD:  re : ' END || text, '^\\s*((re|fwd?)\\s*:\\s*)+', '', 'i'), '\\s+', ' ', 'g')) AS n FROM conversations)"""


@query(f"WITH {_SUBJECT} SELECT conv_id, turn, lower(n) AS subject FROM s")
def subject_normalize(t):
    return _subjects(t).select("conv_id", "turn", T.normalize_subject(F.col("subject")).alias("subject"))


@query(f"WITH {_SUBJECT} SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN '<m' || conv_id || '>' WHEN 3 THEN '<r' || conv_id || '>' ELSE 'subject:' || lower(n) END AS thread FROM s")
def thread_key(t):
    return _subjects(t).select("conv_id", "turn", T.thread_key(F.col("reply"), F.col("refs"), F.col("subject")).alias("thread"))


@query("""
    WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 'AUTHOR: ' || role || chr(10) || 'BODY:' || chr(10) || text || chr(10) AS body FROM conversations),
    f AS (SELECT conv_id, string_agg('[[COMMENT ' || i || ' LEN=' || length(body) || ']]' || chr(10) || body || '[[/COMMENT ' || i || ']]' || chr(10), '' ORDER BY i) AS frames, count(*) AS n FROM c GROUP BY conv_id)
    SELECT conv_id, md5('TICKET_ID: T' || conv_id || chr(10) || 'SUBJECT: ' || chr(10) || 'STATUS: open' || chr(10) || 'PRIORITY: ' || chr(10) || 'CATEGORY: ' || chr(10) || 'REQUESTER: ' || chr(10) || 'ASSIGNEE: ' || chr(10) || 'CREATED_AT: ' || chr(10) || 'DESCRIPTION:' || chr(10) || chr(10) || 'COMMENTS: ' || n || chr(10) || frames) AS blob_md5 FROM f""")
def ticket_blob(t):
    c = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), F.col("text").alias("body")))).alias("c"))
    none = F.lit(None).cast("string")
    scalars = [(F.concat(F.lit("T"), F.col("conv_id").cast("string")) if x == "ticket_id" else F.lit("open") if x == "status" else none).alias(x) for x in ("ticket_id", "subject", "description", "status", "priority", "category", "requester", "assignee", "created_at")]
    x = c.select("conv_id", F.struct(*scalars, F.transform("c", lambda v: F.struct(v["author"].alias("author"), v["body"].alias("body"))).alias("comments")).alias("ticket"))
    return x.select("conv_id", F.md5(T.ticket_blob().cast("binary")).alias("blob_md5"))


_FRAMED = "f AS (SELECT page_id, CASE WHEN html = '' OR ends_with(html, chr(10)) THEN html ELSE html || chr(10) END AS body FROM pages)"


@query(f"WITH {_FRAMED} SELECT page_id, md5('[[PAGE 1 LEN=' || length(body) || ']]' || chr(10) || body || '[[/PAGE 1]]' || chr(10)) AS framed_md5 FROM f")
def framed_pages(t):
    return t.raw("pages").select("page_id", F.md5(T.frame_page(F.col("html"), F.lit(1)).cast("binary")).alias("framed_md5"))


@query(f"WITH {_FRAMED} SELECT page_id AS id, p AS page, md5(CASE p WHEN 1 THEN body ELSE '[[/PAGE 1]]' || chr(10) END) AS text_md5 FROM f, (SELECT unnest([1, 2]) AS p)")
def page_parse(t):
    """Two pages each; the second holds what looks like the first's end."""
    text = F.concat(T.frame_page(F.col("html"), F.lit(1)), T.frame_page(F.lit("[[/PAGE 1]]"), F.lit(2)))
    return iter_pages(t.raw("pages").select("page_id", text.alias("text")), "page_id").select("id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
    SELECT 'm' || conv_id || '-' || turn AS id, role || '@example.com' AS sender, 'Re: case ' || conv_id AS subject, CASE WHEN turn % 3 = 2 THEN '<m' || conv_id || '-0>' ELSE 'subject:case ' || conv_id END AS thread, md5(trim(text, ' ' || chr(9) || chr(10))) AS body_md5 FROM conversations""")
def mail_messages(t):
    """Conversations written as mail, one message a turn, and read back by the data source in small partitions."""
    n, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    reply = F.when(F.col("turn") % 3 == 2, F.map_from_arrays(F.array(F.lit("In-Reply-To")), F.array(F.concat(F.lit("<m"), n, F.lit("-0>"))))).otherwise(F.expr("cast(map() as map<string,string>)"))
    headers = F.map_concat(F.create_map(F.lit("Message-ID"), F.concat(F.lit("<m"), n, F.lit("-"), turn, F.lit(">")), F.lit("From"), F.concat(F.col("role"), F.lit("@example.com")), F.lit("Subject"), F.concat(F.lit("Re: case "), n)), reply)
    path = f"{new_dir(t.spark, 'mail')}/box"
    mailbox.write_mbox(t.raw("conversations").select(headers.alias("headers"), F.col("text").alias("body")), path)
    x = mailbox.mails(t.spark, path, partitionBytes=1 << 16)
    return x.select("id", "sender", "subject", "thread", F.md5(F.col("body").cast("binary")).alias("body_md5"))


# RE2 knows ASCII word boundaries only: letters and digits beyond ASCII become _, which is of no capitalised word.
@query("""
    WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{N}]', '_', 'g'), '\\b([A-Z][a-zA-Z0-9]*(?:\\s+[A-Z][a-zA-Z0-9]*)*)\\b', 1) AS runs FROM documents),
    c AS (SELECT doc_id, list_transform(runs, lambda r: CASE WHEN len(regexp_split_to_array(r, '\\s+')) > 1 AND lower(regexp_split_to_array(r, '\\s+')[1]) IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') THEN array_to_string(regexp_split_to_array(r, '\\s+')[2:], ' ') ELSE array_to_string(regexp_split_to_array(r, '\\s+'), ' ') END) AS e FROM d)
    SELECT doc_id, len(e) AS n_entities, md5(array_to_string(e, '|')) AS entities_md5 FROM c""")
def heuristic_entities(t):
    x = t.raw("documents").select("doc_id", T.heuristic_entities(F.col("text")).alias("e"))
    return x.select("doc_id", F.size("e").alias("n_entities"), F.md5(F.array_join("e", "|").cast("binary")).alias("entities_md5"))


@query("""
    WITH r AS (SELECT event_id, [user_id % 7, event_id % 6, 9, user_id % 4] AS raw FROM events),
    f AS (SELECT event_id, list_filter(list_concat(raw, [1, 2, 3, 4, 5]), lambda v: v BETWEEN 1 AND 5) AS l FROM r),
    u AS (SELECT event_id, v, min(i) AS i FROM (SELECT event_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM f) GROUP BY 1, 2)
    SELECT event_id, string_agg(v::VARCHAR, '' ORDER BY i) AS ordering FROM u GROUP BY 1""")
def rerank_parse(t):
    s = F.concat_ws(", ", (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 6).cast("string"), F.lit("9"), (F.col("user_id") % 4).cast("string"))
    x = t.raw("events").select("event_id", T.rerank_order(F.concat(F.lit("Order: "), s), F.lit(5)).alias("o"))
    return x.select("event_id", F.array_join(F.transform("o", lambda v: v.cast("string")), "").alias("ordering"))


@query(r"""
    WITH p AS (SELECT l_orderkey AS q, l_linenumber AS pos, 'docs/' || l_partkey || '.md' AS path, 'docs/' || (l_partkey + l_linenumber % 2) || '.md' AS cited FROM lineitem),
    c AS (SELECT q, string_agg('## File: ' || path || chr(10) || 'see ## File: no.md' || chr(10), '' ORDER BY pos) AS context FROM p GROUP BY q),
    g AS (SELECT q, unnest(regexp_extract_all(context, '(?m)^## File: (.+)$', 1)) AS path FROM c),
    u AS (SELECT DISTINCT q, cited FROM p EXCEPT SELECT q, trim(path) FROM g)
    SELECT c.q, count(cited) AS n_unknown, coalesce(string_agg(cited, '|' ORDER BY cited), '') AS unknown FROM c LEFT JOIN u ON u.q = c.q GROUP BY c.q""")
def unknown_citations(t):
    """An order is a question: its parts are the files of the context, and of those it cites some are not among them."""
    n = F.col("l_partkey")
    name = lambda c: F.concat(F.lit("docs/"), c.cast("string"), F.lit(".md"))
    x = t.raw("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("pos"), T.file_block(name(n), F.lit("see ## File: no.md")).alias("block"), name(n + F.col("l_linenumber") % 2).alias("cited"))
    c = x.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda y: y["block"]), "").alias("context"), F.collect_set("cited").alias("cited"))
    u = F.array_sort(T.unknown_citations(F.col("cited"), T.provided_paths(F.col("context"))))
    return c.select("q", F.size(u).cast("long").alias("n_unknown"), F.array_join(u, "|").alias("unknown"))


@query("SELECT doc_id, strlen(substring(text, 1, length(text) // 3)) AS byte_offset FROM documents")
def char_byte_offsets(t):
    third = F.floor(F.length("text") / 3).cast("int")
    return t.raw("documents").select("doc_id", T.char_to_byte_offset(F.col("text"), third).cast("long").alias("byte_offset"))


@query("""
    WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '  ' || props WHEN 1 THEN 'Answer: ' || props WHEN 2 THEN props || '}' WHEN 3 THEN '[' || user_id || ', null]' WHEN 4 THEN '[' || user_id || ',' ELSE '"' || event_type || '"' END AS body FROM events)
    SELECT event_id, json_valid(trim(body)) AS valid FROM x""")
def json_probe(t):
    m, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    body = F.when(m == 0, F.concat(F.lit("  "), "props")).when(m == 1, F.concat(F.lit("Answer: "), "props")).when(m == 2, F.concat("props", F.lit("}"))).when(m == 3, F.concat(F.lit("["), u, F.lit(", null]"))).when(m == 4, F.concat(F.lit("["), u, F.lit(",")))
    return t.raw("events").select("event_id", T.is_json(body.otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))).alias("valid"))


@query("""
    WITH x AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN '```c++ ' || props || '```' WHEN 2 THEN ' ```' || chr(10) || chr(10) || props || '``` ' WHEN 3 THEN props
      WHEN 4 THEN '```a-b_c' || chr(10) || props || chr(10) || props || chr(10) || '```' || chr(10) WHEN 5 THEN 'see ```' || props || '```' ELSE '```' || props END AS raw FROM events)
    SELECT event_id, CASE WHEN regexp_matches(raw, '(?s)^\\s*```[a-zA-Z0-9_+-]*\\s*\\n?(.*?)\\n?```\\s*$') THEN regexp_extract(raw, '(?s)^\\s*```[a-zA-Z0-9_+-]*\\s*\\n?(.*?)\\n?```\\s*$', 1) ELSE raw END AS body FROM x""")
def strip_code_fence(t):
    """Fences with and without tag and line feeds, in other text, and open ones."""
    m, p, n = F.col("event_id") % 7, F.col("props"), F.lit("\n")
    f = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = F.when(m == 0, f("```json\n", p, "\n```")).when(m == 1, f("```c++ ", p, "```")).when(m == 2, f(" ```\n\n", p, "``` ")).when(m == 3, p).when(m == 4, f("```a-b_c\n", p, n, p, "\n```\n")).when(m == 5, f("see ```", p, "```"))
    return t.raw("events").select("event_id", T.strip_code_fence(raw.otherwise(f("```", p))).alias("body"))


@query("""SELECT conv_id, turn, 'BTX-' || lpad(i::VARCHAR, 6, '0') AS ticket_id, substring(text, 1, 80) AS subject, 'closed' AS status, 'normal' AS priority, role AS category, 'customer-' || i || '@example.com' AS requester, 'support-bot@example.com' AS assignee,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(i), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, 'support-bot@example.com: ' || md5(text) AS comment FROM (SELECT *, conv_id * 7 + turn AS i FROM conversations)""")
def chat_tickets(t):
    row = F.struct(F.col("text").alias("instruction"), F.col("role").alias("category"), F.md5(F.col("text").cast("binary")).alias("response"))
    x = t.raw("conversations").select("conv_id", "turn", chat_ticket(row, F.col("conv_id") * 7 + F.col("turn")).alias("t"))
    c = F.col("t.comments")[0]
    return x.select("conv_id", "turn", *[f"t.{n}" for n in ("ticket_id", "subject", "status", "priority", "category", "requester", "assignee", "created_at")], F.concat(c["author"], F.lit(": "), c["body"]).alias("comment"))


@query("""
    WITH x AS (SELECT event_id, event_id % 8 AS m, CASE WHEN event_id % 8 = 1 THEN '' ELSE 't/' || user_id END AS target, CASE WHEN event_id % 8 = 3 THEN '' ELSE 'n/' || user_id END AS path FROM events)
    SELECT event_id, CASE m WHEN 0 THEN '' WHEN 1 THEN 'APPEND_EXISTING without target_topic' WHEN 2 THEN '' WHEN 3 THEN 'CREATE_NEW without new_topic_path' WHEN 4 THEN 'bad topic_action' WHEN 5 THEN 'missing entities' WHEN 6 THEN 'entities must be a list of strings' ELSE 'not JSON' END AS error,
      CASE WHEN m IN (0, 2) THEN target ELSE '' END AS target_topic FROM x""")
def segment_answers(t):
    """Answers of a segmenting model: good ones, and one for each rule."""
    m, u = F.col("event_id") % 8, F.col("user_id").cast("string")
    action = F.when(m.isin(0, 1), "APPEND_EXISTING").when(m == 4, "KEEP").otherwise("CREATE_NEW")
    fields = [action.alias("topic_action"), F.when(m == 1, "").otherwise(F.concat(F.lit("t/"), u)).alias("target_topic"), F.when(m == 3, "").otherwise(F.concat(F.lit("n/"), u)).alias("new_topic_path"), F.col("event_type").alias("content_markdown")]
    good = F.to_json(F.struct(*fields, F.array(F.lit("Ann")).alias("entities"), F.array().cast("array<string>").alias("related_topics")))
    less = F.to_json(F.struct(*fields, F.array(F.lit("x")).alias("related_topics")))
    odd = F.to_json(F.struct(*fields, F.array("event_id").alias("entities"), F.array(F.lit("x")).alias("related_topics")))
    answer = F.when(m == 5, less).when(m == 6, odd).when(m == 7, F.concat(F.lit("Sure: "), good)).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    x = t.raw("events").select("event_id", answer.alias("answer")).select("event_id", parse_segment(F.col("answer")).alias("s"))
    return x.select("event_id", F.coalesce("s.error", F.lit("")).alias("error"), F.coalesce("s.parsed.target_topic", F.lit("")).alias("target_topic"))


@query("SELECT doc_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, power(0.5, doc_id % 4) AS decay FROM documents")
def synthetic_times(t):
    return t.raw("documents").select("doc_id", T.synthetic_time(F.col("doc_id")).alias("created_at"), T.hop_decay(F.col("doc_id") % 4).alias("decay"))


# Windows over events go beyond the reference, which has none.


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    x = t.raw("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1")
def events_sliding(t):
    return t.raw("events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""
    WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def events_sessions(t):
    x = t.raw("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT o_custkey + 1 AS source, o_orderkey % 50 + 1 AS target, 'REDIRECT' AS edge_type, floor(o_totalprice)::BIGINT + 1 AS weight, 77::BIGINT AS last_updated FROM orders")
def put_edges(t):
    """Edges checked and stamped; a bad one would be an error."""
    e = t.raw("orders").select((F.col("o_custkey") + 1).alias("source"), (F.col("o_orderkey") % 50 + 1).alias("target"), F.lit("REDIRECT").alias("edge_type"), (F.floor("o_totalprice").cast("long") + 1).alias("weight"))
    return store.put_edges(e, 77)


@query("SELECT conv_id + 100000 AS file_id, 1::BIGINT AS version, strlen(coalesce(text, '')) AS size_bytes, 'ACTIVE' AS status FROM conversations WHERE turn = 0")
def create_files(t):
    """The first turn of each conversation as a new file; an id that the catalog has would be an error."""
    new = t.raw("conversations").where("turn = 0").select((F.col("conv_id") + 100_000).alias("file_id"), F.coalesce("text", F.lit("")).alias("data"))
    return store.create_files(new, t.files().where("file_id < 100000"))


@query("SELECT o_orderkey // 500 AS segment, o_orderkey AS seq, md5(o_orderpriority || o_orderkey) AS payload_md5 FROM orders WHERE o_orderkey > 700 AND o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def wal_scan(t):
    """Records after a checkpoint; the last one is torn, and left out."""
    last = t.raw("orders").agg(F.max("o_orderkey").alias("last"))
    payload = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    r = t.raw("orders").join(F.broadcast(last)).select(F.floor(F.col("o_orderkey") / 500).alias("segment"), F.col("o_orderkey").alias("seq"), payload.alias("payload"), (F.crc32(payload.cast("binary")) + F.when(F.col("o_orderkey") == F.col("last"), 1).otherwise(0)).alias("crc"))  # one row is broadcast
    return store.scan_wal(r, 700).select("segment", "seq", F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


@query("SELECT o_orderkey // 500 AS segment, count(*) AS n FROM orders WHERE o_orderkey // 500 < 2 GROUP BY 1")
def wal_archivable(t):
    """Segments that lie whole before the checkpoint's segment may be archived; its own may not."""
    s = t.raw("orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("segment")).agg(F.count("*").alias("n"))
    return store.archivable(s, 2)


@query("SELECT doc_id + 1 AS file_id, 0::BIGINT AS start_1, strlen(text) AS start_2, 2 * strlen(text) + 5 AS start_3, 3 * strlen(text) + 15 AS size FROM documents WHERE text <> ''")
def section_ranges(t):
    """Sections of each document that begin at markers, as byte ranges; the first begins with the file."""
    mark = lambda i: F.lit(f"\x01@{i}\x02\x03")
    f = t.raw("documents").where("text <> ''").select((F.col("doc_id") + 1).alias("file_id"), F.concat("text", mark(1), "text", mark(2), "text", mark(3)).alias("content"))
    f = f.withColumn("markers", F.array(F.substring("content", 1, 1), mark(1), mark(2)))
    r = store.section_ranges(f)
    x = r.select("file_id", F.transform("ranges", lambda y: y["start"]).alias("s"), F.element_at("ranges", 3)["end"].alias("size"))
    return x.select("file_id", F.get("s", F.lit(0)).alias("start_1"), F.get("s", F.lit(1)).alias("start_2"), F.get("s", F.lit(2)).alias("start_3"), "size")


def _batch(t):
    """A batch of segments, one a document, with the paths, catalog and mentions it meets."""
    d, n = t.raw("documents").select("doc_id"), F.col("doc_id")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    even = n - n % 2
    related = F.concat(F.array(name("topic/", even + 2)), F.when(n % 10 == 0, F.array(name("missing/", n))).otherwise(F.array().cast("array<string>")), F.when(n % 7 == 0, F.array(name("new/", n + 1))).otherwise(F.array().cast("array<string>")))
    action = F.when(n % 3 == 0, "APPEND_EXISTING").otherwise("CREATE_NEW")
    segments = d.select(n.alias("seq"), action.alias("topic_action"), F.when(n % 3 == 0, name("topic/", even)).alias("target_topic"), F.when(n % 3 == 0, "").otherwise(name("new/", n)).alias("new_topic_path"), name("text ", n).alias("content_markdown"), F.array(name("e", F.floor(n / 4))).alias("entities"), related.alias("related_topics"))
    paths = d.where("doc_id % 2 = 0").select(name("topic/", n).alias("path"), (n + 1).alias("file_id"))
    mentions = d.where("doc_id % 5 = 0").select(name("e", F.floor(n / 4)).alias("entity"), (n + 1).alias("file_id"), (n - 1_000_000).alias("seq"))
    return segments, paths, d.select((n + 1).alias("file_id")), mentions


@query("""
    WITH u AS (SELECT max(doc_id) + 1 AS top FROM documents), s AS (SELECT doc_id AS seq, doc_id % 3 = 0 AS append, doc_id - doc_id % 2 AS even FROM documents),
    p AS (SELECT seq, append, even, CASE WHEN append THEN even + 1 ELSE top + row_number() OVER (PARTITION BY append ORDER BY seq) END AS file_id FROM s, u),
    known AS (SELECT 'topic/' || doc_id AS path, doc_id + 1 AS file_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'new/' || seq, file_id FROM p WHERE NOT append),
    new AS (SELECT 'e' || (seq // 4) AS entity, file_id, seq FROM p), old AS (SELECT 'e' || (doc_id // 4) AS entity, doc_id + 1 AS file_id, doc_id - 1000000 AS seq FROM documents WHERE doc_id % 5 = 0),
    every AS (SELECT entity, file_id, min(seq) AS seq FROM (SELECT * FROM new UNION ALL SELECT * FROM old) GROUP BY 1, 2),
    co AS (SELECT a.file_id AS source, b.file_id AS target, count(*) AS weight FROM every a JOIN every b ON a.entity = b.entity AND a.seq > b.seq AND a.file_id <> b.file_id WHERE a.file_id IN (SELECT file_id FROM new) GROUP BY 1, 2),
    r AS (SELECT DISTINCT file_id AS source, 'topic/' || (even + 2) AS topic FROM p UNION SELECT file_id, 'missing/' || seq FROM p WHERE seq % 10 = 0 UNION SELECT file_id, 'new/' || (seq + 1) FROM p WHERE seq % 7 = 0),
    t AS (SELECT source, topic, k.file_id AS target FROM r LEFT JOIN known k ON k.path = topic WHERE k.file_id IS NULL OR k.file_id <> source)
    SELECT 'put' AS kind, file_id::VARCHAR AS a, seq::VARCHAR AS b, CASE WHEN append THEN 'append' ELSE 'create' END || ' text ' || seq AS c FROM p
    UNION ALL SELECT 'path', 'new/' || seq, file_id::VARCHAR, '' FROM p WHERE NOT append
    UNION ALL SELECT DISTINCT 'index', entity, file_id::VARCHAR, '' FROM every
    UNION ALL SELECT 'edge', source::VARCHAR, target::VARCHAR, 'ENTITY_COOCCUR ' || weight FROM co
    UNION ALL SELECT DISTINCT 'edge', source::VARCHAR, target::VARCHAR, 'LLM_ASSERTED 1' FROM t WHERE target IS NOT NULL
    UNION ALL SELECT 'error', source::VARCHAR, 'no topic ' || topic, '' FROM t WHERE target IS NULL""")
def ingest_segments(t):
    """All that a batch of segments writes: puts with new ids, paths, index, edges, and related topics that are none."""
    out = pipelines.execute_segments(*_batch(t))
    text = lambda c: F.col(c).cast("string")
    row = lambda kind, df, a, b, c: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit("")
    x = row("put", out["puts"], text("file_id"), text("seq"), F.concat("op", F.lit(" "), "data"))
    x = x.unionByName(row("path", out["paths"], F.col("path"), text("file_id"), none))
    x = x.unionByName(row("index", out["index"], F.col("entity"), text("file_id"), none))
    x = x.unionByName(row("edge", out["edges"], text("source"), text("target"), F.concat("edge_type", F.lit(" "), text("weight"))))
    return x.unionByName(row("error", out["errors"], text("file_id"), F.col("error"), none))


@query("""
    WITH RECURSIVE c AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS file_id, event_id AS seq, event_type AS owner, event_id // 2 AS tm FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS i FROM c),
    f(file_id, i, seq, owner, granted, holder, until) AS (SELECT file_id, i, seq, owner, true, owner, tm + 9 FROM e WHERE i = 1
      UNION ALL SELECT e.file_id, e.i, e.seq, e.owner, e.tm >= f.until OR e.owner = f.holder, CASE WHEN e.tm >= f.until THEN e.owner ELSE f.holder END, CASE WHEN e.tm >= f.until OR e.owner = f.holder THEN e.tm + 9 ELSE f.until END FROM f JOIN e ON e.file_id = f.file_id AND e.i = f.i + 1)
    SELECT file_id, seq, owner, granted, holder, until FROM f""")
def lease_decisions(t):
    """Claims of five owners on files of which one has a third of all, under contention."""
    c = t.raw("events").select(F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id") + 1).alias("file_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("owner"), F.floor(F.col("event_id") / 2).alias("at"))
    return store.lease_decisions(c, 9)
