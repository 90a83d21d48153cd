"""Composite pipelines: answering questions, ingesting segments, and the retrieval arms that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluate, graph, models, search, select, store


def answer(questions: DataFrame, paths: DataFrame, edges: DataFrame, files: DataFrame, *, k: int = 3, pool: int = 20, depth: int = 2, max_nodes: int = 10, empty: str = "error") -> DataFrame:
    """query, answer, citations, unknown for a batch of questions (query): one plan from search to context, and the default model.

    A question for which nothing is selected is an error; with empty="keep" it has a row without answer.
    """
    q = questions.select("query", models.refine_intent(F.col("query")).alias("r")).select("query", F.col("r.intent").alias("intent"))
    found = search.search_candidates(q.select(F.col("intent").alias("query")).distinct(), paths, pool).where(F.col("rank") <= k)
    chosen = select.combine_and_cap(found, select.expand(found, edges, depth=depth, max_nodes=max_nodes), k)
    context = select.assemble(chosen, files)
    x = q.join(context.withColumnRenamed("query", "intent"), "intent", "left")
    if empty != "keep":
        x = x.where(F.when(F.col("context").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("nothing selected for: "), F.col("query"))).cast("boolean")))
    x = x.withColumn("s", F.when(F.col("context").isNotNull(), models.synthesize(F.col("context"))))
    return x.select("query", "s.answer", "s.citations", T.unknown_citations(F.col("s.citations"), T.provided_paths(F.col("context"))).alias("unknown"))


def ingest(documents: DataFrame, paths: DataFrame, mentions: DataFrame, pool_size: int = 200) -> dict[str, DataFrame]:
    """Segments, new entity mentions, co-occurrence edges and the entity index of documents (query_id, file_id, seq, text), against the first paths of the index."""
    pool = paths.orderBy("path").limit(pool_size)
    pool = search.top_k_stable(pool.select(F.lit(1).alias("g"), F.lit(0.0).alias("score"), F.col("path").alias("pos"), "file_id", "path"), "g", pool_size).select(F.col("rank").alias("pos"), "file_id", "path")
    segments = models.segment(documents.select("query_id", "text"), search.shortlist(documents.select("query_id", "text"), pool, 8))
    new = documents.join(segments.select("query_id", "entities"), "query_id").select(F.explode("entities").alias("e"), "file_id", "seq").select(T.canonical_entity(F.col("e")).alias("entity"), "file_id", "seq").distinct()
    return {"segments": segments, "mentions": new, "edges": graph.cooccurrence_of_new(mentions, new), "index": graph.index_entities(mentions, new)}


def execute_segments(segments: DataFrame, paths: DataFrame, catalog: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """What a batch of segments writes: puts, paths, index, edges, and the errors that do not stop it.

    segments: seq, topic_action, target_topic (a path), new_topic_path, content_markdown, entities, related_topics; mentions:
    entity, file_id, seq. A target that is no path is an error of the batch, before anything is written; related topics that
    are none are listed as errors. New files follow the largest id of the catalog in order of seq, and get their path.
    """
    known = paths.groupBy("path").agg(F.min("file_id").alias("known_id"))
    x = segments.join(known, F.col("target_topic") == F.col("path"), "left").drop("path")
    append = F.col("topic_action") == "APPEND_EXISTING"
    found = F.when(~append | F.col("known_id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no topic "), F.col("target_topic"))).cast("boolean"))
    x = x.where(found).withColumn("file_id", F.when(append, F.col("known_id")).otherwise(F.lit(0)).cast("long")).drop("known_id")
    puts = store.put_segments(x, catalog)
    made = puts.where("op = 'create' and new_topic_path <> ''").select(F.col("new_topic_path").alias("path"), "file_id")
    new = puts.select(F.explode("entities").alias("entity"), "file_id", "seq").distinct()
    topics = puts.select(F.col("file_id").alias("source"), F.explode("related_topics").alias("topic")).distinct()
    related = graph.resolve_related(topics, paths.unionByName(made))
    asserted = related.where("resolved").select("source", "target", F.lit("LLM_ASSERTED").alias("edge_type"), F.lit(1).cast("long").alias("weight")).distinct()
    errors = related.where("not resolved").select(F.col("source").alias("file_id"), F.concat(F.lit("no topic "), F.col("topic")).alias("error"))
    return {
        "puts": puts.select("file_id", "seq", "op", F.col("content_markdown").alias("data")),
        "paths": made,
        "index": graph.index_entities(mentions, new),
        "edges": graph.cooccurrence_of_new(mentions, new).unionByName(asserted),
        "errors": errors,
    }


def vector_rag(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: all chunks by cosine, the best chunk of a document counts. questions: query_id, embedding; chunks: vec_id, doc_id, embedding."""
    return evaluate.vector_topk(questions, chunks, k, by="doc_id")


def index_chunks(docs: DataFrame, embed, size: int, overlap: int) -> DataFrame:
    """chunk_id, doc_id, text, embedding of all chunks; embed is a function from a column of text to a column of vectors."""
    c = evaluate.chunks(docs, size, overlap).select("chunk_id", "doc_id", "text")
    return c.withColumn("embedding", embed(F.col("text")))


def final_answer(retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, answer, citations: the one last step of all arms, on the retrieved documents (query_id, doc_id, rank) in order. corpus: doc_id, text; ids without text are left out."""
    block = T.file_block(F.col("doc_id").cast("string"), F.col("text"))
    x = retrieved.join(corpus.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    context = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return x.select("query_id", models.synthesize(context).alias("s")).select("query_id", "s.answer", "s.citations")


def main_arm(retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """Retrieved elsewhere; answers as all arms do."""
    return final_answer(retrieved, corpus)


def vector_arm(questions: DataFrame, chunks: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    return final_answer(vector_rag(questions, chunks, k), corpus)


def entity_arm(questions: DataFrame, mentions: DataFrame, corpus: DataFrame, k: int, max_hops: int = 1) -> DataFrame:
    return final_answer(entity_rag(questions, mentions, k, max_hops), corpus)


def expansion_arms(questions: DataFrame, mentions: DataFrame, k: int, max_hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """The entity arm's lists with expansion and without."""
    return entity_rag(questions, mentions, k, max_hops), entity_rag(questions, mentions, k, 0)


def retrieve_reranked(retrieved: DataFrame, responses: DataFrame, k: int, spare: int = 2) -> DataFrame:
    """Two stages: the first k + spare of a retrieved list, put in the order of a response, cut to k."""
    return rerank(retrieved.where(F.col("rank") <= k + spare), responses, k)


def lexical_rag(questions: DataFrame, docs: DataFrame, k: int, size: int = 150, overlap: int = 22) -> DataFrame:
    """query_id, doc_id, score, rank: chunks by BM25 in place of a model's vectors, the best chunk of a document counts. questions: query_id, text."""
    c = evaluate.chunks(docs, size, overlap).select("doc_id", "chunk_id", "text")
    s = search.bm25(questions, c.select(F.col("chunk_id").alias("doc_id"), F.col("text").alias("t")), T.tokenize_terms(F.col("text")), T.tokenize_terms(F.col("t")))
    return evaluate.best_chunk(s.withColumnRenamed("doc_id", "chunk_id").join(c.select("chunk_id", "doc_id"), "chunk_id"), k)


def rerank(retrieved: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """The first k of each query's pool in the order that its response (query_id, response) names."""
    pool = retrieved.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    x = pool.join(responses, "query_id", "left").withColumn("o", T.rerank_order(F.coalesce("response", F.lit("")), F.size("ids")))
    x = x.select("query_id", F.posexplode(F.transform("o", lambda i: F.element_at("ids", i))).alias("p", "doc_id"))
    return x.select("query_id", "doc_id", (F.col("p") + 1).alias("rank")).where(F.col("rank") <= k)


def entity_rag(questions: DataFrame, mentions: DataFrame, k: int, max_hops: int = 1) -> DataFrame:
    """query_id, doc_id, score, rank by the entity graph. questions: query_id, text; mentions: doc_id, entity, display, seq."""
    nodes, links = graph.entity_graph(mentions)
    names = questions.select("query_id", F.explode(T.heuristic_entities(F.col("text"))).alias("n")).select("query_id", T.canonical_entity(F.col("n")).alias("name"))
    return graph.entity_retrieve(graph.link_entities(names, nodes), links, mentions, k, max_hops)


def benchmark(arms: dict[str, DataFrame], queries: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """arm, mean_recall, mean_precision, num_queries for retrieved lists by arm."""
    out = None
    for arm, retrieved in arms.items():
        x = evaluate.retrieval_scores(queries, retrieved, qrels, k).withColumn("arm", F.lit(arm))
        out = x if out is None else out.unionByName(x)
    return evaluate.arm_scores(out)
