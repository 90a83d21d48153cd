"""Search over path indexes: prefix scans, the prefix join, candidates by term overlap, BM25 shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PER_TERM, MERGED = 500, 2000
#: Fixed values of the BM25 formula.
K1, B = 1.5, 0.75


def prefix_scan(paths: DataFrame, prefix: str) -> DataFrame:
    """Rows whose path starts with the prefix, in byte order; the predicate reaches Parquet."""
    return paths.where(F.col("path").startswith(prefix)).orderBy("path")


def prefix_scans(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix_scan for each row of prefixes (prefix), as one join."""
    return prefix_join(prefixes.select(F.col("prefix").alias("term")).distinct(), paths).withColumnRenamed("term", "prefix")


def prefix_join(terms: DataFrame, paths: DataFrame) -> DataFrame:
    """terms (term) with paths (path, file_id) that start with them.

    A path is sent once for each length that occurs among the terms (and that it has), cut to it, and meets terms that
    equal the cut: a hash join whose rows are all results. The empty term, which meets every path, goes apart, so no key
    holds all paths.
    """
    lengths = terms.where("term <> ''").agg(F.collect_set(F.length("term")).alias("__lengths"))  # one row, of as many numbers as terms have lengths
    fitting = F.filter("__lengths", lambda n: n <= F.length("path"))
    keyed = paths.join(F.broadcast(lengths)).withColumn("__n", F.explode(fitting)).withColumn("__key", F.substr(F.col("path"), F.lit(1), F.col("__n"))).drop("__lengths", "__n")
    found = terms.where("term <> ''").join(keyed, F.col("term") == F.col("__key")).drop("__key")
    every = F.broadcast(terms.where("term = ''").limit(1)) if terms.columns == ["term"] else terms.where("term = ''")
    return found.unionByName(paths.join(every).select(*found.columns))


def candidate_pool(queries: DataFrame, paths: DataFrame, per_term: int = PER_TERM, merged: int = MERGED) -> DataFrame:
    """query, file_id, path, pos: for each distinct term its first per_term paths, merged in term order, first seen, merged at most.

    Terms are joined once whatever number of queries share them. A query without terms gets all paths in order.
    """
    terms = queries.select("query", F.posexplode(T.distinct_terms(F.col("query"))).alias("term_pos", "term"))
    hits = prefix_join(terms.select("term").distinct(), paths)
    first = hits.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy("path", "file_id"))).where(F.col("rn") <= per_term).drop("rn")
    pool = terms.join(first, "term")
    seen = lambda key: F.row_number().over(Window.partitionBy("query", key).orderBy("term_pos", "path", "file_id"))
    pool = pool.withColumn("s", seen("file_id")).where("s = 1").withColumn("s", seen("path")).where("s = 1")
    pool = pool.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("term_pos", "path"))).where(F.col("pos") <= merged)
    return pool.select("query", "file_id", "path", "pos", *[c for c in paths.columns if c not in ("file_id", "path")])


def search_candidates(queries: DataFrame, paths: DataFrame, max_results: int = 20, *, per_term: int = PER_TERM, merged: int = MERGED) -> DataFrame:
    """query, file_id, path, score, rank: the pool by term overlap, ties in pool order; max_results 0 is no limit."""
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    # Terms are cut once a path and once a query, not once a pair.
    asked = queries.select("query", F.array_distinct(T.tokenize_terms(F.col("query"))).alias("q")).distinct()
    cut = paths.select("file_id", "path", T.tokenize_terms(F.col("path")).alias("p"))
    pool = candidate_pool(queries, cut, per_term, merged).join(asked, "query")
    scored = pool.withColumn("score", F.when(F.size("q") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("q", "p")) / F.size("q")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "pos")))
    ranked = ranked.where(F.col("rank") <= max_results) if max_results else ranked
    blank = queries.where(F.size(T.split_terms(F.col("query"))) == 0).select("query").distinct()
    listed = paths.withColumn("rank", F.row_number().over(Window.orderBy("path", "file_id"))) if not max_results else paths.orderBy("path", "file_id").limit(max_results).withColumn("rank", F.row_number().over(Window.orderBy("path", "file_id")))
    everything = blank.withColumn("one", F.lit(1)).join(listed.withColumn("one", F.lit(1)), "one").select("query", "file_id", "path", F.lit(0.0).alias("score"), "rank")
    return ranked.select("query", "file_id", "path", "score", "rank").unionByName(everything)


def corpus_stats(docs: DataFrame, tokens) -> DataFrame:
    """term, df, n_docs, avg_len, idf over docs (doc_id, text)."""
    t = docs.select("doc_id", tokens.alias("tokens"))
    size = t.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))
    df = t.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.join(F.broadcast(size)).withColumn("idf", idf)  # one row is broadcast


def bm25(queries: DataFrame, docs: DataFrame, query_tokens, doc_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score for pairs that share a term; pairs that share none score 0 and are left out."""
    t = docs.select("doc_id", doc_tokens.alias("tokens")).withColumn("len", F.size("tokens"))
    tf = t.select("doc_id", "len", F.explode("tokens").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    stats = corpus_stats(docs, doc_tokens).select("term", "idf", "avg_len")
    q = queries.select("query_id", F.explode(F.array_distinct(query_tokens)).alias("term"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return q.join(tf.join(stats, "term"), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def shortlist(documents: DataFrame, pool: DataFrame, top_k: int = 8) -> DataFrame:
    """query_id, file_id, score, rank: for each document the top_k pool paths by BM25, ties in pool order. pool: pos, file_id, path."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    docs = pool.select(F.col("file_id").alias("doc_id"), F.col("path").alias("p"))
    scored = bm25(documents, docs, T.shortlist_tokens(F.col("text")), T.shortlist_tokens(F.col("p")))
    # Candidates without a shared term score 0 and follow in pool order. The pool's first top_k rows hold enough of them for
    # any document, as at most those that score are missing there.
    scored = scored.withColumnRenamed("doc_id", "file_id").join(pool.select("pos", "file_id"), "file_id").select("query_id", "file_id", "pos", F.round("score", 6).alias("score"))
    first = pool.orderBy("pos").limit(top_k).select("pos", "file_id")
    zeros = documents.select("query_id").join(F.broadcast(first)).select("query_id", "file_id", "pos", F.lit(0.0).alias("score"))  # top_k rows are broadcast
    every = scored.unionByName(zeros).groupBy("query_id", "file_id", "pos").agg(F.max("score").alias("score"))
    return top_k_stable(every, "query_id", top_k).select("query_id", "file_id", "score", "rank")


def top_k_stable(df: DataFrame, by: str, k: int, pos: str = "pos") -> DataFrame:
    """The k rows of largest score of each `by`, ties by position, with rank. k = 0 gives no row."""
    if k < 0:
        raise ValueError("k must not be negative")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), pos))).where(F.col("rank") <= k)
