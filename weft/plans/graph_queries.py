"""Queries on the edge graph and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..operators.shared import new_dir
from ..sources.readers import with_entities
from .registry import query

EVENTS = "SELECT l_partkey % 1000 + 1 AS source, l_suppkey * 7 % 1000 + 1 AS target, (['SPLIT_SIBLING', 'REDIRECT', 'ENTITY_COOCCUR', 'LLM_ASSERTED'])[l_orderkey % 4 + 1] AS edge_type, l_quantity::BIGINT AS weight, epoch(l_shipdate)::BIGINT AS last_updated, l_orderkey * 8 + l_linenumber AS seq FROM lineitem"
COMPACTED = f"""ev AS ({EVENTS}), edges AS (SELECT source, target, edge_type, CASE WHEN edge_type = 'ENTITY_COOCCUR' THEN sum(weight) ELSE arg_max(weight, last_updated * 100000000 + seq) END::BIGINT AS weight, max(last_updated) AS last_updated FROM ev GROUP BY source, target, edge_type)"""
_CODE = "CASE edge_type WHEN 'SPLIT_SIBLING' THEN 1 WHEN 'REDIRECT' THEN 2 WHEN 'ENTITY_COOCCUR' THEN 3 ELSE 4 END"


def neighbor_sql(depth: int, most: int, kind: str | None = None) -> str:
    only = f"WHERE edge_type = '{kind}'" if kind else ""
    second = ""
    if depth == 2:
        second = """ UNION ALL SELECT * FROM (SELECT h1.start, e.target AS file_id, e.edge_type, e.weight, 2 AS hop FROM h1 JOIN e ON e.source = h1.file_id WHERE e.target <> h1.start
            QUALIFY row_number() OVER (PARTITION BY h1.start, e.target ORDER BY e.weight DESC, e.code, e.source) = 1) s WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = s.start AND h1.file_id = s.file_id)"""
    return f""", e AS (SELECT *, {_CODE} AS code FROM edges {only}),
    h1 AS (SELECT start, e.target AS file_id, e.edge_type, e.weight, 1 AS hop FROM starts JOIN e ON e.source = start WHERE e.target <> start QUALIFY row_number() OVER (PARTITION BY start, e.target ORDER BY e.weight DESC, e.code, e.source) = 1),
    near AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, weight DESC, file_id) AS rank FROM (SELECT * FROM h1{second}) QUALIFY rank <= {most})"""


def compacted(t):
    return graph.compact_edges(t.edge_events())


@query(f"WITH {COMPACTED} SELECT * FROM edges")
def edge_compaction(t):
    return compacted(t)


@query(f"WITH {COMPACTED} SELECT * FROM edges")
def edge_compaction_incremental(t):
    e, mark = t.edge_events(), 40_000
    return graph.compact_incremental(graph.compact_edges(e.where(F.col("seq") <= mark)), e, mark)


@query(f"WITH {COMPACTED} SELECT source, count(*) AS degree, md5(string_agg(DISTINCT target::VARCHAR, ',' ORDER BY target::VARCHAR)) AS targets_md5 FROM edges GROUP BY source")
def adjacency_build(t):
    text = F.array_join(F.array_sort(F.transform("targets", lambda x: x.cast("string"))), ",")
    return graph.adjacency(compacted(t)).select("source", "degree", F.md5(text.cast("binary")).alias("targets_md5"))


@query(f"WITH {COMPACTED}, n AS (SELECT source AS n FROM edges UNION SELECT target FROM edges) SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT source) FROM edges) AS n_sources, (SELECT count(*) FROM n) AS n_nodes")
def graph_counts(t):
    return graph.counts(compacted(t))


@query(f"WITH {COMPACTED}, d AS (SELECT source, count(*) AS degree FROM edges GROUP BY source) SELECT source, degree, (sum(degree) OVER (ORDER BY source) - degree)::BIGINT AS start FROM d")
def csr_offsets(t):
    return graph.csr_offsets(compacted(t))


_STARTS = f"WITH {COMPACTED}, starts AS (SELECT n_nationkey + 1 AS start FROM nation)"


def starts(t):
    return t.raw("nation").select((F.col("n_nationkey") + 1).cast("long").alias("start"))


@query(_STARTS + neighbor_sql(1, 10) + " SELECT * FROM near")
def neighbors_1hop(t):
    return graph.neighbors(starts(t), compacted(t), 1, 10)


@query(_STARTS + neighbor_sql(2, 200) + " SELECT * FROM near")
def neighbors_2hop(t):
    return graph.neighbors(starts(t), compacted(t), 2, 200)


@query(_STARTS + neighbor_sql(2, 50, "ENTITY_COOCCUR") + " SELECT * FROM near")
def neighbors_filtered(t):
    return graph.neighbors(starts(t), compacted(t), 2, 50, "ENTITY_COOCCUR")


def order_mentions(t):
    """entity: an order; file: a part on it; seq: its line."""
    return t.raw("lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("entity"), (F.col("l_partkey") + 1).alias("file_id"), F.col("l_linenumber").cast("long").alias("seq"))


@query("""
    WITH m AS (SELECT l_orderkey AS entity, l_partkey + 1 AS file_id, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2)
    SELECT a.file_id AS source, b.file_id AS target, 'ENTITY_COOCCUR' AS edge_type, count(*) AS weight FROM m a JOIN m b ON a.entity = b.entity AND a.seq > b.seq AND a.file_id <> b.file_id GROUP BY 1, 2""")
def cooccur_edges(t):
    return graph.cooccurrence_edges(order_mentions(t))


@query("SELECT DISTINCT 'order ' || l_orderkey AS entity, l_partkey + 1 AS file_id, lpad((l_partkey + 1)::VARCHAR, 20, '0') AS padded FROM lineitem")
def entity_index(t):
    x = order_mentions(t).select("entity", "file_id").distinct()
    return x.withColumn("padded", F.element_at(F.split(T.entity_key(F.col("entity"), F.col("file_id")), "\0"), -1))


@query("WITH x AS (SELECT DISTINCT l_orderkey, l_partkey + 1 AS f FROM lineitem) SELECT 'order ' || l_orderkey AS entity, string_agg(f::VARCHAR, ',' ORDER BY f) AS file_ids FROM x GROUP BY l_orderkey")
def entity_lookup(t):
    x = order_mentions(t).groupBy("entity").agg(F.array_sort(F.collect_set("file_id")).alias("f"))
    return x.select("entity", F.array_join(F.transform("f", lambda v: v.cast("string")), ",").alias("file_ids"))


def name_mentions(t):
    """doc: an order; entity: the name of a part on it."""
    p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("display"))
    x = t.raw("lineitem").select("l_partkey", F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")).join(p, "l_partkey")
    return x.select("doc_id", T.canonical_entity(F.col("display")).alias("entity"), "display", "seq")


_NAMES = "m AS (SELECT l_orderkey AS doc_id, trim(lower(p_name)) AS entity FROM lineitem JOIN part ON l_partkey = p_partkey), de AS (SELECT DISTINCT doc_id, entity FROM m)"
_LINKS = "links AS (SELECT DISTINCT a.entity, b.entity AS other FROM de a JOIN de b ON a.doc_id = b.doc_id AND a.entity <> b.entity)"
_ROOTS = """names AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part UNION SELECT 'no such thing'), known AS (SELECT DISTINCT entity FROM m),
    exact AS (SELECT name AS query_id, entity FROM names JOIN known ON name = entity), rest AS (SELECT name FROM names WHERE name NOT IN (SELECT entity FROM known)),
    roots AS (SELECT * FROM exact UNION SELECT name, entity FROM rest JOIN known ON contains(name, entity) OR contains(entity, name))"""


@query(f"WITH {_NAMES}, {_LINKS}, n AS (SELECT entity, count(*) AS n_docs FROM de GROUP BY entity), l AS (SELECT entity, count(*) AS n_links FROM links GROUP BY entity) SELECT entity, n_docs, coalesce(n_links, 0) AS n_links FROM n LEFT JOIN l USING (entity)")
def entity_graph_build(t):
    nodes, links = graph.entity_graph(name_mentions(t))
    n = links.groupBy("entity").agg(F.count("*").alias("n_links"))
    return nodes.join(n, "entity", "left").select("entity", "n_docs", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def name_roots(t, nodes):
    full = t.raw("part").select(F.lower("p_name").alias("name"))
    names = full.unionByName(full.select(F.split("name", " ")[0].alias("name"))).unionByName(t.spark.createDataFrame([("no such thing",)], "name string")).distinct()
    return graph.link_entities(names.select(F.col("name").alias("query_id"), "name"), nodes)


@query(f"WITH {_NAMES}, {_ROOTS} SELECT query_id, entity FROM roots")
def entity_link(t):
    return name_roots(t, graph.entity_graph(name_mentions(t))[0])


@query(r"""
    WITH n AS (SELECT DISTINCT lower(p_name) AS entity FROM part UNION SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 7)
    SELECT doc_id, entity FROM documents JOIN n ON contains(lower(text), entity)""")
def entity_link_documents(t):
    """All names of parts and long words of the benchmark in the whole texts of all documents."""
    words = t.raw("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).where(F.length("name") >= 7)
    names = t.raw("part").select(F.lower("p_name").alias("name")).unionByName(words)
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return graph.mentioned(d, names).select(F.col("id").alias("doc_id"), F.col("name").alias("entity"))


def _retrieve(t, hops):
    m = name_mentions(t)
    nodes, links = graph.entity_graph(m)
    return graph.entity_retrieve(name_roots(t, nodes), links, m, 10, hops)


@query(f"WITH {_NAMES}, {_ROOTS}, s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM roots JOIN de USING (entity) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10")
def entity_graph_retrieve_0hop(t):
    return _retrieve(t, 0)


@query(f"""WITH {_NAMES}, {_LINKS}, {_ROOTS}, reach AS (SELECT query_id, entity, min(hop) AS hop FROM (SELECT query_id, entity, 0 AS hop FROM roots UNION ALL SELECT query_id, other, 1 FROM roots JOIN links USING (entity)) GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, sum(power(0.5, hop)) AS score FROM reach JOIN de USING (entity) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def entity_graph_retrieve_1hop(t):
    return _retrieve(t, 1)


def tree_mentions(t):
    """doc: a document; entities: itself and the one of half its number, so that the links are a tree as deep as the logarithm of the table."""
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    d = t.raw("documents").select("doc_id")
    return d.select("doc_id", F.explode(F.array(name(F.col("doc_id")), name(F.floor(F.col("doc_id") / 2)))).alias("display")).withColumns({"entity": F.col("display"), "seq": F.col("doc_id")})


@query("""
    WITH RECURSIVE de AS (SELECT doc_id, 'e' || doc_id AS entity FROM documents UNION SELECT doc_id, 'e' || (doc_id // 2) FROM documents),
    links AS (SELECT DISTINCT a.entity, b.entity AS other FROM de a JOIN de b ON a.doc_id = b.doc_id AND a.entity <> b.entity),
    walk(query_id, entity, hop) AS (SELECT 'q' || n_nationkey, 'e' || (n_nationkey * 7), 0 FROM nation UNION SELECT query_id, other, hop + 1 FROM walk JOIN links USING (entity) WHERE hop < 60),
    reach AS (SELECT query_id, w.entity, min(hop) AS hop FROM walk w GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, sum(power(0.5, hop)) AS score FROM reach JOIN de USING (entity) GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20""")
def entity_graph_retrieve_deep(t):
    """A walk to the end of the graph from an entity of each nation."""
    m = tree_mentions(t)
    n = t.raw("nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"), F.concat(F.lit("e"), (F.col("n_nationkey") * 7).cast("string")).alias("entity"))
    x = graph.entity_retrieve_deep(n, graph.entity_graph(m)[1], m, 20)
    return x.withColumn("score", F.round("score", 9))


_SEGMENTS = f"WITH {COMPACTED}, p AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS pos, row_number() OVER (ORDER BY source, target) - 1 AS place FROM (SELECT DISTINCT source, target FROM edges))"


@query(_SEGMENTS + " SELECT source, pos // 16 AS segment, min(place) AS start, string_agg(target::VARCHAR, ',' ORDER BY target) AS targets FROM p GROUP BY 1, 2")
def adjacency_segments(t):
    x = graph.segmented(compacted(t), 16)
    return x.select("source", "segment", "start", F.array_join(F.transform("targets", lambda v: v.cast("string")), ",").alias("targets"))


@query(f"WITH {COMPACTED} SELECT DISTINCT source, target FROM edges WHERE source IN (SELECT n_nationkey + 1 FROM nation)")
def segment_neighbors(t):
    return graph.segment_neighbors(starts(t).withColumnRenamed("start", "source"), graph.segmented(compacted(t), 16))


@query("""
    WITH m AS (SELECT source AS entity, doc_id + 1 AS file_id, doc_id AS seq FROM documents UNION ALL SELECT lang, doc_id + 1, doc_id FROM documents)
    SELECT entity, file_id, row_number() OVER (PARTITION BY entity ORDER BY seq) - 1 AS links, count(*) OVER (PARTITION BY entity) AS n_files FROM m""")
def cooccur_classes(t):
    """Entities that up to two thirds of all files share: the source and the language of each document."""
    d = t.raw("documents")
    m = lambda c: d.select(F.col(c).alias("entity"), (F.col("doc_id") + 1).alias("file_id"), F.col("doc_id").alias("seq"))
    return graph.cooccurrence_classes(m("source").unionByName(m("lang")))


@query("""
    WITH w AS (SELECT doc_id + 1 AS source, 'src/' || (doc_id * 3) AS topic FROM documents UNION ALL SELECT doc_id + 1, 'src/' || doc_id FROM documents), p AS (SELECT 'src/' || doc_id AS topic, doc_id + 1 AS target FROM documents)
    SELECT source, w.topic, coalesce(target, 0) AS target, target IS NOT NULL AS resolved FROM (SELECT DISTINCT * FROM w) w LEFT JOIN p ON p.topic = w.topic WHERE target IS NULL OR target <> source""")
def related_topic_resolution(t):
    d = t.raw("documents").select("doc_id")
    topic = lambda c: F.concat(F.lit("src/"), c.cast("string"))
    own = (F.col("doc_id") + 1).alias("source")
    wanted = d.select(own, topic(F.col("doc_id") * 3).alias("topic")).unionByName(d.select(own, topic(F.col("doc_id")).alias("topic")))
    x = graph.resolve_related(wanted, d.select(topic(F.col("doc_id")).alias("path"), (F.col("doc_id") + 1).alias("file_id")))
    return x.fillna(0, ["target"])


@query(f"WITH ev AS ({EVENTS}), log AS (SELECT DISTINCT source, target, edge_type FROM ev WHERE seq <= 40000), new AS (SELECT DISTINCT source, target, edge_type FROM ev WHERE seq > 40000) SELECT * FROM new EXCEPT SELECT * FROM log")
def edge_append_if_absent(t):
    e = t.edge_events()
    return graph.append_if_absent(e.where("seq <= 40000"), e.where("seq > 40000")).select("source", "target", "edge_type")


@query(f"WITH {COMPACTED}, s AS (SELECT DISTINCT source FROM edges UNION SELECT p_partkey + 1 FROM part) SELECT s.source, count(target) AS degree FROM s LEFT JOIN edges USING (source) GROUP BY 1")
def adjacency_of_all_nodes(t):
    """Nodes without an edge have degree 0."""
    return graph.adjacency(compacted(t), t.raw("part").select((F.col("p_partkey") + 1).alias("source"))).select("source", F.col("degree").cast("long").alias("degree"))


@query(f"WITH ev AS ({EVENTS}) SELECT ev.source, target, edge_type, weight, seq FROM ev WHERE seq > 40000 AND source IN (SELECT n_nationkey + 1 FROM nation)")
def edge_log_of_nodes(t):
    s = t.raw("nation").select((F.col("n_nationkey") + 1).cast("long").alias("source"))
    return graph.node_log(t.edge_events(), s, 40_000).select("source", "target", "edge_type", "weight", "seq")


@query(f"WITH ev AS ({EVENTS}) SELECT edge_type, CASE edge_type WHEN 'ENTITY_COOCCUR' THEN 1 WHEN 'LLM_ASSERTED' THEN 2 WHEN 'SPLIT_SIBLING' THEN 3 ELSE 4 END AS wire, edge_type AS back, count(*) AS n FROM ev GROUP BY 1")
def edge_types_on_the_wire(t):
    x = t.edge_events().groupBy("edge_type").agg(F.count("*").alias("n")).withColumn("wire", graph.to_wire(F.col("edge_type")))
    return x.select("edge_type", "wire", graph.from_wire(F.col("wire")).alias("back"), "n")


@query(f"WITH ev AS ({EVENTS}) SELECT source, target, edge_type, seq FROM ev WHERE edge_type IN ('SPLIT_SIBLING', 'REDIRECT')")
def structural_log(t):
    return graph.structural_log(t.edge_events()).select("source", "target", "edge_type", "seq")


@query("""
    WITH m AS (SELECT l_orderkey AS entity, l_partkey + 1 AS file_id, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2), n AS (SELECT DISTINCT l_partkey + 1 AS file_id FROM lineitem WHERE l_orderkey % 10 = 0)
    SELECT a.file_id AS source, b.file_id AS target, 'ENTITY_COOCCUR' AS edge_type, count(*) AS weight FROM m a JOIN m b ON a.entity = b.entity AND a.seq > b.seq AND a.file_id <> b.file_id WHERE a.file_id IN (SELECT file_id FROM n) GROUP BY 1, 2""")
def cooccur_new_edges(t):
    m = order_mentions(t)
    new = F.substring("entity", 7, 20).cast("long") % 10 == 0
    return graph.cooccurrence_of_new(m.where(~new), m.where(new))


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def set_union(t):
    return t.raw("lineitem").select(F.col("l_partkey").alias("k")).union(t.raw("orders").select("o_custkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t):
    return t.raw("lineitem").select(F.col("l_partkey").alias("k")).intersect(t.raw("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders")
def set_except(t):
    return t.raw("lineitem").select(F.col("l_partkey").alias("k")).subtract(t.raw("orders").select(F.col("o_custkey").alias("k")))


@query(f"WITH {COMPACTED} SELECT * FROM edges")
def snapshot_round_trip(t):
    """The compacted edges written as a snapshot and read back, count and checksum compared."""
    path = new_dir(t.spark, "snapshot")
    graph.write_snapshot(compacted(t), path)
    return graph.read_snapshot(t.spark, path)


@query(f"WITH ev AS ({EVENTS}), s AS (SELECT DISTINCT source, target, edge_type FROM ev WHERE edge_type IN ('SPLIT_SIBLING', 'REDIRECT')) SELECT * FROM s WHERE (source, target, edge_type) NOT IN (SELECT source, target, edge_type FROM ev WHERE seq <= 40000)")
def structural_append(t):
    """Sibling and redirect edges that the log does not have yet; another type would be an error."""
    e = t.edge_events()
    return graph.append_structural(e.where("seq <= 40000"), graph.structural_log(e)).select("source", "target", "edge_type")


@query("SELECT DISTINCT 'order ' || l_orderkey AS entity, l_partkey + 1 AS file_id FROM lineitem")
def entity_index_upsert(t):
    """The index of all but some lines, with all lines put in: entries that are there change nothing."""
    m = order_mentions(t)
    return graph.index_entities(m.where("seq % 3 > 0"), m.unionByName(m.where("seq = 1")))


_SAID = """x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '["Alpha ' || doc_id || '", "alpha ' || doc_id || '", " ' || source || ' "]' WHEN 1 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '["' || source || '", "two' || chr(10) || 'lines", ""]' || chr(10) || chr(96) || chr(96) || chr(96) WHEN 2 THEN '[]' ELSE 'none here' END AS response, source FROM documents)"""


@query(f"""WITH {_SAID} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Alpha ' || doc_id || '|' || source WHEN 1 THEN source || '|two' || chr(10) || 'lines' WHEN 2 THEN '' ELSE 'Of|Paris' END AS entities FROM x""")
def response_entities(t):
    """Entities of responses: JSON with repeats, fenced JSON with a raw line feed in a string, an empty list, and no JSON (the source's capitalised runs)."""
    n, tick = F.col("doc_id").cast("string"), F.lit("```")
    r = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('["Alpha '), n, F.lit('", "alpha '), n, F.lit('", " '), "source", F.lit(' "]')))
    r = r.when(F.col("doc_id") % 4 == 1, F.concat(tick, F.lit('json\n["'), F.col("source"), F.lit('", "two\nlines", ""]\n'), tick)).when(F.col("doc_id") % 4 == 2, F.lit("[]")).otherwise(F.lit("none here"))
    x = with_entities(t.raw("documents").select("doc_id", r.alias("response"), F.lit("Of late, and in Paris. paris").alias("said"), "source"), F.col("response"), F.col("said"))
    return x.select("doc_id", F.array_join("entities", "|").alias("entities"))
