"""Queries on paths, terms, search and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, search, select
from ..sources.tables import Tables
from .graph_queries import COMPACTED, neighbor_sql
from .registry import query

PATHS = "SELECT p_partkey + 1 AS file_id, replace(p_name, ' ', '-') || '/' || lower(p_type) || '/' || p_partkey AS path FROM part"
TERMS = """
    paths AS ({paths}), q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS query FROM part),
    qt AS (SELECT query, unnest(regexp_split_to_array(query, '[^a-zA-Z0-9]+')) AS term, generate_subscripts(regexp_split_to_array(query, '[^a-zA-Z0-9]+'), 1) AS i FROM q),
    terms AS (SELECT query, term, min(i) AS term_pos FROM qt WHERE term <> '' GROUP BY query, term),
    hits AS (SELECT query, term, term_pos, file_id, path FROM terms JOIN paths ON starts_with(path, term) QUALIFY row_number() OVER (PARTITION BY query, term ORDER BY path) <= 500),
    seen AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, file_id ORDER BY term_pos, path) = 1),
    pool AS (SELECT query, file_id, path, row_number() OVER (PARTITION BY query ORDER BY term_pos, path) AS pos FROM seen QUALIFY pos <= 2000),
    qset AS (SELECT query, list(DISTINCT lower(term)) AS qs FROM terms GROUP BY query),
    scored AS (SELECT p.*, len(list_intersect(qs, regexp_split_to_array(lower(path), '[^a-z0-9]+'))) / len(qs) AS score FROM pool p JOIN qset USING (query)),
    found AS (SELECT query, file_id, path, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 20)""".replace("{paths}", PATHS)
#: Of the best 20 of these paths all reach half the best score; at this ratio some are weak.
WEAK = 0.7
FLAGGED = TERMS + f", flagged AS (SELECT *, max(score) OVER (PARTITION BY query) > 0 AND score < {WEAK} * max(score) OVER (PARTITION BY query) AS insufficient FROM found)"


def found(t: Tables):
    return search.search_candidates(t.queries(), t.paths(), 20)


@query(f"WITH {TERMS} SELECT query, file_id, path, score, rank FROM found")
def search_candidates(t):
    return found(t)


@query(f"WITH {TERMS} SELECT query, file_id, rank FROM found WHERE rank <= 3")
def topk_stable(t):
    return search.top_k_stable(found(t).withColumnRenamed("rank", "pos"), "query", 3).select("query", "file_id", "rank")


@query(f"WITH {TERMS}, n AS (SELECT query, count(*) AS n FROM pool GROUP BY query) SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS most FROM n")
def candidate_pool_distribution(t):
    n = search.candidate_pool(t.queries(), t.paths()).groupBy("query").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query(f"WITH p AS ({PATHS}), x AS (SELECT unnest(['red', 'blue-b', 'gre', 'zzz', 'small-ring/eco', '']) AS prefix) SELECT prefix, path, file_id FROM x JOIN p ON starts_with(path, prefix)")
def prefix_scan(t):
    prefixes = t.spark.createDataFrame([(x,) for x in ("red", "blue-b", "gre", "zzz", "small-ring/eco", "")], "prefix string")
    return search.prefix_scans(t.paths(), prefixes).select("prefix", "path", "file_id")


@query(f"WITH p AS ({PATHS}), w AS (SELECT replace(p_name, ' ', '-') || '/' || lower(p_type) || '/' || (p_partkey // 2 * 2) AS wanted FROM part) SELECT wanted, coalesce(file_id, -1) AS file_id, file_id IS NOT NULL AS found FROM w LEFT JOIN p ON wanted = path")
def path_lookup(t):
    key = (F.floor(F.col("p_partkey") / 2) * 2).cast("string")
    wanted = t.raw("part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), F.lower("p_type"), F.lit("/"), key).alias("wanted"))
    return wanted.join(t.paths(), F.col("wanted") == F.col("path"), "left").select("wanted", F.coalesce("file_id", F.lit(-1)).alias("file_id"), F.col("file_id").isNotNull().alias("found"))


@query(f"WITH p AS (SELECT file_id, min(path) AS path FROM ({PATHS}) GROUP BY 1), w AS (SELECT DISTINCT l_partkey * 2 + 1 AS file_id FROM lineitem) SELECT w.file_id, coalesce(path, '') AS path FROM w LEFT JOIN p ON p.file_id = w.file_id")
def reverse_path_lookup(t):
    wanted = t.raw("lineitem").select((F.col("l_partkey") * 2 + 1).alias("file_id")).distinct()
    first = t.paths().groupBy("file_id").agg(F.min("path").alias("path"))
    return wanted.join(first, "file_id", "left").select("file_id", F.coalesce("path", F.lit("")).alias("path"))


@query("SELECT doc_id + 1 AS file_id, 1 AS version, lang || '/' || source || '/doc-' || doc_id || '.md' AS path, strlen(text) AS size_bytes, md5(text) AS content_md5 FROM documents")
def get_file(t):
    return t.files().select("file_id", "version", "path", "size_bytes", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""
    WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda v: v <> '') AS a,
      list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda v: v <> '') AS b,
      list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-zA-Z0-9]+'), lambda v: v <> '') AS c FROM documents)
    SELECT doc_id, len(a) AS n_terms, len(list_distinct(a)) AS n_distinct, len(list_distinct(b)) AS n_lower, len(c) AS n_shortlist FROM x""")
def term_tokenize(t):
    n_terms, n_distinct, n_lower, n_shortlist = T.term_counts(F.col("text"))
    return t.raw("documents").select("doc_id", n_terms.alias("n_terms"), n_distinct.alias("n_distinct"), n_lower.alias("n_lower"), n_shortlist.alias("n_shortlist"))


@query("""
    WITH x AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda v: v <> '')) AS q,
      regexp_split_to_array(lower(replace(p_name, ' ', '-') || '/' || p_type), '[^a-z0-9]+') AS p FROM part)
    SELECT p_partkey, round(len(list_intersect(q, p)) / len(q), 6) AS score FROM x""")
def term_overlap(t):
    q, p = F.concat_ws(" ", "p_name", "p_brand"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), F.col("p_type"))
    return t.raw("part").select("p_partkey", F.round(T.term_overlap(q, p), 6).alias("score"))


_BM = f"""p AS ({PATHS}), d AS (SELECT file_id, path, list_filter(regexp_split_to_array(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda v: v <> '') AS toks FROM p)"""


@query(f"WITH {_BM}, n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT file_id, unnest(toks) AS term FROM d) GROUP BY term) SELECT term, df, n_docs, round(avg_len, 6) AS avg_len, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, n")
def bm25_corpus_stats(t):
    s = search.corpus_stats(t.paths().select(F.col("file_id").alias("doc_id"), "path"), T.shortlist_tokens(F.col("path")))
    return s.select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


@query(f"""
    WITH {_BM}, pool AS (SELECT *, row_number() OVER (ORDER BY path) AS pos FROM d QUALIFY pos <= 200),
    n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM pool),
    tf AS (SELECT file_id, len(any_value(toks)) AS l, term, count(*) AS tf FROM (SELECT file_id, toks, unnest(toks) AS term FROM pool) GROUP BY file_id, term),
    f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS query_id FROM part),
    qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query_id), '[^a-z0-9]+'), lambda v: v <> '')) AS term FROM q),
    s AS (SELECT query_id, file_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / avg_len))) AS score FROM qt JOIN tf USING (term) JOIN f USING (term), n GROUP BY 1, 2),
    e AS (SELECT query_id, pool.file_id, pos, round(coalesce(score, 0), 6) AS score FROM q CROSS JOIN pool LEFT JOIN s USING (query_id, file_id))
    SELECT query_id, file_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM e QUALIFY rank <= 8""")
def bm25_shortlist(t):
    pool = t.paths().orderBy("path").limit(200)
    from pyspark.sql import Window

    pool = pool.withColumn("pos", F.row_number().over(Window.orderBy("path")))
    return search.shortlist(t.queries().select(F.col("query").alias("query_id"), F.col("query").alias("text")), pool, 8)


@query(f"""
    WITH {_BM}, pool AS (SELECT *, row_number() OVER (ORDER BY path) AS pos FROM d QUALIFY pos <= 200),
    n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM pool),
    tf AS (SELECT file_id, len(any_value(toks)) AS l, term, count(*) AS tf FROM (SELECT file_id, toks, unnest(toks) AS term FROM pool) GROUP BY file_id, term),
    f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda v: v <> '')) AS term FROM documents),
    s AS (SELECT doc_id, file_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / avg_len))) AS score FROM qt JOIN tf USING (term) JOIN f USING (term), n GROUP BY 1, 2),
    e AS (SELECT doc_id, pool.file_id, pos, round(coalesce(score, 0), 6) AS score FROM documents CROSS JOIN pool LEFT JOIN s USING (doc_id, file_id))
    SELECT doc_id, file_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM e QUALIFY rank <= 8""")
def bm25_shortlist_documents(t):
    """bm25_shortlist for the whole text of each document."""
    from pyspark.sql import Window

    pool = t.paths().orderBy("path").limit(200).withColumn("pos", F.row_number().over(Window.orderBy("path")))
    return search.shortlist(t.raw("documents").select(F.col("doc_id").alias("query_id"), "text"), pool, 8).withColumnRenamed("query_id", "doc_id")


@query(f"WITH {FLAGGED} SELECT query, file_id, rank, insufficient FROM flagged")
def insufficient_topics(t):
    return select.flag_insufficient(found(t), WEAK).select("query", "file_id", "rank", "insufficient")


def top(t):
    return found(t).where("rank <= 20")


_STARTS = f"WITH {FLAGGED}, {COMPACTED}, starts AS (SELECT DISTINCT file_id AS start FROM flagged WHERE insufficient)"
_EXPANDED = _STARTS + neighbor_sql(2, 10) + ", expanded AS (SELECT f.query, f.rank, f.file_id, n.file_id AS neighbor, n.hop, n.rank AS npos FROM flagged f JOIN near n ON n.start = f.file_id WHERE insufficient)"


@query(_EXPANDED + " SELECT query, rank, file_id, neighbor, hop, npos FROM expanded")
def expand_topics(t):
    return select.expand(top(t), graph.compact_edges(t.edge_events()), ratio=WEAK)


_COMBINED = (
    _EXPANDED
    + """, c AS (SELECT query, file_id, 0 AS phase, rank AS p, 0 AS n FROM found WHERE rank <= 3 UNION ALL SELECT query, neighbor, 1, rank, npos FROM expanded),
    c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, file_id ORDER BY phase, p, n) = 1),
    combined AS (SELECT query, file_id, row_number() OVER (PARTITION BY query ORDER BY phase, p, n) AS pos FROM c1 QUALIFY pos <= 9)"""
)


def combined(t):
    return select.combine_and_cap(found(t).where("rank <= 3"), select.expand(top(t), graph.compact_edges(t.edge_events()), ratio=WEAK), 3)


@query(_COMBINED + " SELECT query, file_id, pos FROM combined")
def combine_and_cap(t):
    return combined(t)


@query(_COMBINED + " SELECT query, count(*) AS n_files, md5(string_agg('## File: ' || path || chr(10) || 'content of ' || path || chr(10), '' ORDER BY pos)) AS context_md5 FROM combined JOIN paths USING (file_id) GROUP BY query")
def context_assembly(t):
    files = t.paths().withColumn("content", F.concat(F.lit("content of "), "path"))
    return select.assemble(combined(t), files).select("query", "n_files", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("""
    WITH d AS (SELECT doc_id, '# ' || replace(text, chr(10), chr(10) || '## ') AS content FROM documents),
    l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM d),
    o AS (SELECT doc_id, i, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - 1 AS byte_at FROM l),
    h AS (SELECT * FROM o WHERE regexp_matches(line, '^#{1,6}([ \\t]|$)'))
    SELECT doc_id, count(*) AS n_headers, max(byte_at)::BIGINT AS last_offset, md5(string_agg(regexp_replace(line, '[ \\t\\r]+$', '') || '@' || byte_at::BIGINT, '|' ORDER BY i)) AS headers_md5 FROM h GROUP BY doc_id""")
def header_offsets(t):
    content = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    x = t.raw("documents").select("doc_id", T.header_offsets(content).alias("h"))
    flat = F.array_join(F.transform("h", lambda s: F.concat(s["header"], F.lit("@"), s["offset"].cast("string"))), "|")
    return x.select("doc_id", F.size("h").alias("n_headers"), F.element_at("h", -1)["offset"].alias("last_offset"), F.md5(flat.cast("binary")).alias("headers_md5"))


@query(f"""
    WITH p AS ({PATHS}), r AS (SELECT file_id, CASE file_id % 6 WHEN 0 THEN '././' || replace(path, '/', '///') || '//' WHEN 1 THEN replace(path, '/', chr(92)) WHEN 2 THEN '//' WHEN 3 THEN '/' || path || '/' WHEN 4 THEN '.' || chr(92) || path ELSE './.' || path || '/./' END AS raw FROM p),
    s AS (SELECT file_id, raw, regexp_replace(regexp_replace(replace(raw, chr(92), '/'), '^(\\./)+', ''), '/{{2,}}', '/', 'g') AS x FROM r)
    SELECT file_id, raw, CASE WHEN x = '/' THEN x ELSE regexp_replace(x, '/+$', '') END AS path FROM s""")
def normalize_topic_path(t):
    m, p = F.col("file_id") % 6, F.col("path")
    f = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = F.when(m == 0, f("././", F.replace(p, F.lit("/"), F.lit("///")), "//")).when(m == 1, F.replace(p, F.lit("/"), F.lit("\\"))).when(m == 2, "//").when(m == 3, f("/", p, "/")).when(m == 4, f(".\\", p)).otherwise(f("./.", p, "/./"))
    return t.paths().select("file_id", raw.alias("raw")).select("file_id", "raw", T.normalize_topic_path(F.col("raw")).alias("path"))


@query(f"""
    WITH p AS ({PATHS}), h AS (SELECT file_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(path, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS v FROM p)
    SELECT file_id, CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END::BIGINT AS path_hash FROM h""")
def path_hash_fnv1a(t):
    return t.paths().select("file_id", T.path_hash(F.col("path")).alias("path_hash"))


@query(f"SELECT file_id % 256 AS stripe, count(*) AS n FROM ({PATHS}) GROUP BY 1")
def stripe_histogram(t):
    return t.paths().groupBy(T.stripe(F.col("file_id")).alias("stripe")).agg(F.count("*").alias("n"))
