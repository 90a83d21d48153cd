"""Golden cases and properties of search, graph, selection, store, evaluation and pipelines."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import evaluate, graph, models, pipelines, search, select, store

EDGE = "source long, target long, edge_type string, weight long, last_updated long, seq long"


def paths(spark, *names):
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(names)], "file_id long, path string")


def found(spark, ps, q, n=20):
    rows = search.search_candidates(spark.createDataFrame([(q,)], "query string"), ps, n).orderBy("rank").collect()
    return [r.path for r in rows], [r.score for r in rows]


def test_prefix_scan(spark):
    p = paths(spark, "auth/login", "auth/logout", "auth/oauth", "auth/register", "billing/invoice", "billing/receipt", "docs/readme", "zzz/top")
    assert [search.prefix_scan(p, x).count() for x in ("auth/", "billing/", "nonexistent/", "")] == [4, 2, 0, 8]
    terms = spark.createDataFrame([("a",), ("au",), ("auth/lo",), ("",), ("q",)], "term string")
    assert search.prefix_join(terms, p).count() == 4 + 4 + 2 + 8


def test_search(spark):
    p = paths(spark, "graph-database-extra/x", "graph-database/y", "graph-theory/z")
    names, scores = found(spark, p, "graph database extra")
    assert names == ["graph-database-extra/x", "graph-database/y", "graph-theory/z"] and scores == pytest.approx([1, 2 / 3, 1 / 3])
    names, scores = found(spark, paths(spark, "graph/aardvark-only", "graph/full-match", "graph/zzz-only"), "graph full")
    assert names[0] == "graph/full-match" and scores[0] == 1.0 and len(names) == 3
    p = paths(spark, "graph-database/handbook", "graph-theory/intro", "database-design/notes", "unrelated/other")
    names, _ = found(spark, p, "how do I configure the graph database")
    assert names[0] == "graph-database/handbook" and len(names) == 3
    names, scores = found(spark, p, " ?! ")
    assert names == sorted(["graph-database/handbook", "graph-theory/intro", "database-design/notes", "unrelated/other"]) and set(scores) == {0.0}
    assert len(found(spark, p, "graph database", 0)[0]) == 3
    with pytest.raises(ValueError):
        found(spark, p, "x", -1)


def test_shortlist_prefers_matching_paths(spark):
    pool = paths(spark, "billing/invoices", "people/holidays", "billing/InvoiceDisputes").withColumnRenamed("file_id", "pos").selectExpr("pos", "pos as file_id", "path")
    docs = spark.createDataFrame([("d", "an invoice is in disputes over billing")], "query_id string, text string")
    assert [r.file_id for r in search.shortlist(docs, pool, 2).orderBy("rank").collect()] == [3, 1]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, w, 0, i) for i, (a, b, t, w) in enumerate(rows)], EDGE)


def near(spark, rows, **kw):
    e = graph.compact_edges(edges(spark, rows))
    return [(r.file_id, r.hop) for r in graph.neighbors(spark.createDataFrame([(1,)], "start long"), e, **kw).orderBy("rank").collect()]


def test_neighbors(spark):
    c = "LLM_ASSERTED"
    chain = [(1, 2, c, 1), (2, 3, c, 1), (3, 4, c, 1), (2, 1, c, 1)]
    assert near(spark, chain, depth=2) == [(2, 1), (3, 2)]
    assert near(spark, [(1, 2, c, 5), (1, 3, c, 4), (1, 4, c, 3)], depth=1, max_nodes=2) == [(2, 1), (3, 1)]
    assert near(spark, [(1, 2, c, 1), (1, 3, c, 1), (2, 4, c, 1), (3, 4, c, 1)], depth=2) == [(2, 1), (3, 1), (4, 2)]
    assert near(spark, chain, depth=0) == near(spark, chain, max_nodes=0) == []
    assert near(spark, [(1, 2, c, 1), (1, 3, "REDIRECT", 9)], edge_type=c) == [(2, 1)]
    for bad in ({"depth": 3}, {"max_nodes": -1}, {"edge_type": "x"}):
        with pytest.raises(ValueError):
            near(spark, chain, **bad)


def test_compaction(spark):
    rows = [(10, 20, "ENTITY_COOCCUR", 1, 1000 + i, i) for i in range(5)] + [(1, 2, "SPLIT_SIBLING", 7, 200, 5), (1, 2, "SPLIT_SIBLING", 3, 100, 6)]
    got = {(r.source, r.target): (r.weight, r.last_updated) for r in graph.compact_edges(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {(10, 20): (5, 1004), (1, 2): (7, 200)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.sampled_from(graph.EDGE_TYPES), st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=12), st.integers(-1, 12))
def test_incremental_compaction_is_whole_compaction(spark, rows, mark):
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGE)
    whole = sorted(map(tuple, graph.compact_edges(log).collect()))
    snap = graph.compact_edges(log.where(f"seq <= {mark}"))
    step = graph.compact_incremental(snap, log, mark)
    assert sorted(map(tuple, step.collect())) == whole


def test_cooccurrence_and_entity_graph(spark):
    m = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 2, 3), ("x", 2, 4)], "entity string, file_id long, seq long")
    assert [tuple(r) for r in graph.cooccurrence_edges(m).collect()] == [(2, 1, "ENTITY_COOCCUR", 1)]
    d = spark.createDataFrame([("a", "x", "X", 1), ("a", "y", "Y", 2), ("b", "y", "Y", 3), ("b", "z", "Z", 4)], "doc_id string, entity string, display string, seq long")
    nodes, links = graph.entity_graph(d)
    assert {(r.entity, r.other) for r in links.collect()} == {("x", "y"), ("y", "x"), ("y", "z"), ("z", "y")}
    roots = graph.link_entities(spark.createDataFrame([("q", "x")], "query_id string, name string"), nodes)
    got = lambda hops: [r.doc_id for r in graph.entity_retrieve(roots, links, d, 5, hops).orderBy("rank").collect()]
    assert got(0) == ["a"] and got(1) == ["a", "b"]
    loose = graph.link_entities(spark.createDataFrame([("q", "xx")], "query_id string, name string"), nodes)
    assert [r.entity for r in loose.collect()] == ["x"]


def test_selection(spark):
    t = spark.createDataFrame([("q", 1, 1.0, 1), ("q", 2, 0.5, 2), ("q", 3, 0.4, 3), ("z", 4, 0.0, 1)], "query string, file_id long, score double, rank int")
    assert [r.file_id for r in select.flag_insufficient(t).where("insufficient").collect()] == [3]
    x = spark.createDataFrame([("q", 3, 3, n, 1, n - 9) for n in range(10, 22)] + [("q", 3, 3, 2, 1, 99)], "query string, rank int, file_id long, neighbor long, hop int, npos int")
    ids = [r.file_id for r in select.combine_and_cap(t.where("query = 'q'"), x, 3).orderBy("pos").collect()]
    assert ids == [1, 2, 3, 10, 11, 12, 13, 14, 15]


def test_store(spark):
    ev = spark.createDataFrame([(1, 1, "put", "a"), (1, 3, "put", "b"), (2, 2, "put", "c"), (2, 4, "delete", None)], "file_id long, seq long, op string, v string")
    assert [(r.file_id, r.v) for r in store.replay(ev).collect()] == [(1, "b")]
    with pytest.raises(Exception, match="unknown record"):
        store.replay(ev.selectExpr("file_id", "seq", "'odd' as op", "v")).collect()
    app = spark.createDataFrame([(1, i, "x" * 30 if i < 3 else "y" * 20) for i in range(6)], "file_id long, seq long, data string")
    assert [r.new_size for r in store.append_sizes(app, 100).where("crossed").collect()] == [110]
    rng = lambda *rows: store.validate_plan(spark.createDataFrame([(1, p, a, b, 10) for p, a, b in rows], "plan_id long, new_path string, start long, end long, size long")).first().reason
    assert rng(("a", 0, 5), ("b", 4, 9)) == "overlap" and rng(("a", 0, 5), ("b", 5, 9)) == "ok"
    assert rng(("a", 0, 5), ("./a/", 5, 9)) == "duplicate path" and rng(("a", 0, 11)) == "bounds"
    assert rng(("a", 0, 9), ("b", 1, 2), ("c", 3, 4)) == "overlap"


def test_split_keeps_every_byte(spark):
    files = spark.createDataFrame([(7, "t/x", "é# one\n# twö\nend")], "file_id long, path string, content string")
    out = store.execute_split(models.propose_split(files), files, files)
    assert sorted(r.file_id for r in out["files"].collect()) == [8, 9]
    assert store.follow_redirects(out["stubs"], out["files"]).first().content == "é# one\n# twö\nend"
    assert {(r.source, r.target, r.edge_type) for r in out["edges"].collect()} == {(8, 9, "SPLIT_SIBLING"), (9, 8, "SPLIT_SIBLING"), (7, 8, "REDIRECT"), (7, 9, "REDIRECT")}


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "file_id long, version int, epoch long")
    assert store.visible(v, 25).first().version == 2
    gc = lambda *pins: sorted(r.version for r in store.collectable(v, spark.createDataFrame([(p,) for p in pins], "epoch long")).collect())
    assert gc(15) == [] and gc(20) == [1] and gc(40) == [1, 2] and gc() == [1, 2]


def test_costs(spark):
    s = spark.createDataFrame([("a", "final", 1.0, "openrouter", 0.004, 1), ("a", "final", 2.0, "openrouter", 0.006, 2), ("b", "embed", 0.1, "ollama", None, None), ("b", "embed", 0.3, "ollama", None, None)], "arm string, stage string, duration_seconds double, provider string, cost_usd double, query_id long")
    got = {r.arm: (r.query_count, r.cost_per_1000_queries) for r in evaluate.cost_rollup(s).collect()}
    assert got["a"] == (2, pytest.approx(5.0)) and got["b"] == (2, 0.0)
    agg = {r.arm: (r.call_count, r.total_seconds, r.total_cost) for r in evaluate.stage_aggregate(s).collect()}
    assert agg["a"] == (2, 3.0, pytest.approx(0.01)) and agg["b"] == (2, pytest.approx(0.4), 0.0)


def test_checkpoints_and_calibration(spark):
    d = spark.range(32).withColumnRenamed("id", "doc_id")
    n = {r.pct: r["count"] for r in evaluate.checkpoint_corpus(d, [20, 50, 100]).groupBy("pct").count().collect()}
    assert n == {20: 7, 50: 16, 100: 32}
    assert tuple(evaluate.calibration(spark.createDataFrame([], "judge double, human double")).first()) == (0, 0.0, 0.0, 1.0)


def test_models(spark):
    calls = []

    def flaky(prompt, warmth):
        calls.append(warmth)
        return models.Completion("" if len(calls) < 3 else "yes")

    assert models.with_retries(flaky, "p").text == "yes" and calls == [0.0, 0.1, 0.2]
    assert models.price(models.Completion("x", "OpenRouter", "openai/gpt-4o-mini", 1000, 1000)) == pytest.approx(0.00075)
    with pytest.raises(ValueError):
        models.price(models.Completion("x", "paid", "m"))
    p = spark.createDataFrame([(1, "hello")], "query_id long, prompt string")
    r = models.complete(p, lambda: lambda prompt, warmth: models.Completion(prompt.upper()), "main", "final").first()
    assert (r.answer, r.cost_usd, r.stage) == ("HELLO", 0.0, "final")


def test_answer_pipeline(spark):
    ps = paths(spark, "billing/refunds", "billing/invoices", "people/leave")
    files = ps.selectExpr("file_id", "path", "concat('About ', path) as content")
    e = graph.compact_edges(edges(spark, [(1, 3, "LLM_ASSERTED", 1)]))
    r = pipelines.answer(spark.createDataFrame([("billing refunds",)], "query string"), ps, e, files).first()
    assert r.citations[0] == "billing/refunds" and "About billing/refunds [billing/refunds]" in r.answer and r.unknown == []


def test_wal_scan_and_pins(spark):
    import zlib

    rows = [(1, 1, "a", zlib.crc32(b"a")), (1, 2, "b", zlib.crc32(b"b")), (2, 3, "c", 0)]
    kind = "segment int, seq long, payload string, crc long"
    assert [r.payload for r in store.scan_wal(spark.createDataFrame(rows, kind)).orderBy("seq").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="damaged"):
        store.scan_wal(spark.createDataFrame([rows[0], (1, 2, "b", 5), rows[0]], kind).union(spark.createDataFrame([(3, 9, "z", zlib.crc32(b"z"))], kind))).collect()
    ev = lambda *d: store.epoch_pins(spark.createDataFrame([(5, i, x) for i, x in enumerate(d)], "epoch long, seq long, delta int"))
    assert ev(1, 1, -1).first().n == 1 and ev(1, -1).count() == 0
    with pytest.raises(Exception, match="twice"):
        ev(1, -1, -1).collect()


def test_section_ranges(spark):
    f = spark.createDataFrame([(1, "é one\n## B\nx\n## B\ny", ["é", "## B", "## B"])], "file_id long, content string, markers array<string>")
    got = [(r.start, r.end) for r in store.section_ranges(f).first().ranges]
    assert got == [(0, 7), (7, 14), (14, 20)]
    with pytest.raises(Exception, match="no section"):
        store.section_ranges(f.withColumn("markers", F.array(F.lit("nope")))).collect()


def test_numbering_in_ranges(spark):
    from weft.operators import number

    df = spark.range(0, 3000, 3).selectExpr("id % 700 as k", "id as x").repartition(5)
    got = [(r.k, r.x) for r in number.numbered(df, "k", "x").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert [r.n for r in number.numbered(df, "k", "x").orderBy("n").collect()] == list(range(1, 1001))
    sums = {r.x: r.before for r in number.before(df, "x", F.col("x")).collect()}
    assert all(sums[x] == sum(range(0, x, 3)) for x in (0, 3, 1500, 2997))
    assert number.numbered(df.limit(0), "k").count() == 0


def test_split_plans_of_several_ranges(spark):
    kind = "plan_id long, proposal int, new_path string, start long, end long, size long"
    rng = lambda *rows: store.validate_plan(spark.createDataFrame([(1, *r, 10) for r in rows], kind)).first().reason
    assert rng((0, "a", 0, 2), (0, "a", 5, 9), (1, "b", 2, 5)) == "ok"
    assert rng((0, "a", 0, 2), (1, "a", 5, 9)) == "duplicate path" and rng((0, "", 0, 2)) == "empty path" and rng((0, "a", None, None)) == "no ranges"
    files = spark.createDataFrame([(7, "abcdefghi")], "file_id long, content string")
    plan = spark.createDataFrame([(7, "x", 0, 5, 9), (7, "x", 1, 0, 3), (7, "y", 0, 3, 5)], "file_id long, new_path string, pos int, start long, end long")
    out = {r.path: (r.content, r.version, r.path_hash) for r in store.execute_split(plan, files, files)["files"].collect()}
    assert out == {"x": ("fghiabc", 0, 0), "y": ("de", 0, 0)}


def test_catalog_by_id(spark):
    cat = spark.createDataFrame([(1, 3), (2, 5)], "file_id long, version long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id long")
    assert [r.version for r in store.get_records(ids(2), cat).collect()] == [5]
    for bad, word in ((0, "invalid"), (9, "no file")):
        with pytest.raises(Exception, match=word):
            store.get_records(ids(bad), cat).collect()
    with pytest.raises(Exception, match="exists"):
        store.create_files(spark.createDataFrame([(1, "x")], "file_id long, data string"), cat).collect()
    assert store.create_files(spark.createDataFrame([(3, "é")], "file_id long, data string"), cat).first().size_bytes == 2
    assert [h.offset for h in store.read_headers(ids(1), spark.createDataFrame([(1, "x\n# a")], "file_id long, content string")).first().headers] == [2]


def test_execute_segments(spark):
    ps = paths(spark, "billing/refunds", "people/leave")
    cat = ps.select("file_id")
    kind = "seq long, topic_action string, target_topic string, new_topic_path string, content_markdown string, entities array<string>, related_topics array<string>"
    seg = spark.createDataFrame([(1, "APPEND_EXISTING", "billing/refunds", "", "more", ["Ann"], ["people/leave", "nope"]), (2, "CREATE_NEW", "", "tax/rules", "new", ["Ann", "Ann"], ["tax/rules"])], kind)
    old = spark.createDataFrame([("Ann", 2, 0)], "entity string, file_id long, seq long")
    out = {k: v.collect() for k, v in pipelines.execute_segments(seg, ps, cat, old).items()}
    assert sorted((r.file_id, r.op, r.data) for r in out["puts"]) == [(1, "append", "more"), (3, "create", "new")]
    assert [(r.path, r.file_id) for r in out["paths"]] == [("tax/rules", 3)]
    assert {(r.source, r.target, r.edge_type) for r in out["edges"]} == {(1, 2, "ENTITY_COOCCUR"), (3, 1, "ENTITY_COOCCUR"), (3, 2, "ENTITY_COOCCUR"), (1, 2, "LLM_ASSERTED")}
    assert [(r.file_id, r.error) for r in out["errors"]] == [(1, "no topic nope")] and len(out["index"]) == 3
    with pytest.raises(Exception, match="no topic"):
        bad = spark.createDataFrame([(1, "APPEND_EXISTING", "x/y", "", "", [], [])], kind)
        pipelines.execute_segments(bad, ps, cat, old)["puts"].collect()


def test_validators(spark):
    import json

    ask = lambda f, text, *more: spark.range(1).select(f(F.lit(text), *more).alias("x")).first().x
    good = {"refined_intent": "i", "query_type": "factual_lookup", "entities": []}
    assert ask(models.parse_intent, json.dumps(good)).error is None
    assert ask(models.parse_intent, json.dumps(good | {"query_type": "x"})).error == "bad query_type"
    assert ask(models.parse_intent, json.dumps(good | {"refined_intent": 3})).error == "refined_intent must be a string"
    assert ask(models.parse_intent, "[1]").error == "not an object" and ask(models.parse_intent, "{} x").error == "not JSON"
    s = ask(models.parse_synthesis, json.dumps({"answer": "a", "citations": ["b", "c"]}), F.lit("## File: b\nx\n"))
    assert s.error is None and s.unknown == ["c"]
    sec = lambda *p: json.dumps({"sections": [{"new_topic_path": a, "start_marker": b} for a, b in p], "redirect_summary": "r"})
    assert len(ask(models.parse_split, sec(("a", "# A"), ("b", "# B"))).sections) == 2
    for text, word in ((sec(("a", "# A")), "too few"), (sec(("a", "x"), ("a", "y")), "duplicate"), (sec(("a", ""), ("b", "y")), "start_marker"), (sec(("", "x"), ("b", "y")), "new_topic_path"), ("{}", "missing sections")):
        assert word in ask(models.parse_split, text).error


def test_snapshots(spark, tmp_path):
    e = edges(spark, [(1, 2, "REDIRECT", 1), (3, 1, "LLM_ASSERTED", 2)])
    graph.write_snapshot(e, str(tmp_path / "s"))
    mark = graph.write_snapshot(e.where("source = 3"), str(tmp_path / "s")).first()
    assert [r.source for r in graph.read_snapshot(spark, str(tmp_path / "s")).collect()] == [3]
    e.write.mode("overwrite").parquet(mark.folder)
    with pytest.raises(ValueError, match="damaged"):
        graph.read_snapshot(spark, str(tmp_path / "s"))


def test_odd_edges_and_arms(spark):
    assert graph.adjacency(edges(spark, [(1, 2, "REDIRECT", 1)]), spark.createDataFrame([(9,)], "source long")).where("degree = 0").first().source == 9
    with pytest.raises(Exception, match="structural"):
        graph.append_structural(edges(spark, []), edges(spark, [(1, 2, "LLM_ASSERTED", 1)])).collect()
    with pytest.raises(ValueError):
        graph.entity_retrieve(None, None, None, 3, 3)
    with pytest.raises(Exception, match="nothing selected"):
        pipelines.answer(spark.createDataFrame([("zzz",)], "query string"), paths(spark, "a/b"), edges(spark, []), paths(spark, "a/b").withColumn("content", F.lit("x"))).collect()
    corpus = spark.createDataFrame([(i, f"text {i}", [1.0, float(i)]) for i in (1, 2, 3)], "doc_id long, text string, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, embedding array<double>")
    r = pipelines.vector_arm(q, corpus.withColumn("vec_id", F.col("doc_id")), corpus, 2).first()
    assert r.citations == ["3", "2"] and r.answer == "text 3 [3] text 2 [2]"
    got = pipelines.retrieve_reranked(spark.createDataFrame([(0, d, d) for d in (1, 2, 3, 4, 5)], "query_id long, doc_id long, rank int"), spark.createDataFrame([(0, "4, 1")], "query_id long, response string"), 2)
    assert [x.doc_id for x in got.orderBy("rank").collect()] == [4, 1]
    idx = pipelines.index_chunks(corpus, lambda t: F.array(F.length(t).cast("double")), 1, 0)
    assert idx.count() == 6 and idx.first().embedding


def test_vector_blocks_choose_what_all_pairs_do(spark, monkeypatch):
    """Blocks against the join of all pairs: ties, copies, zero, null and unequal vectors, one best vector a document; no pairs are made."""
    import random

    from pyspark.sql import Window

    from weft.operators import evaluate

    monkeypatch.setattr(evaluate, "QUERY_BLOCK", 7)
    monkeypatch.setattr(evaluate, "VECTOR_BLOCK", 20)
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)], i // 3) for i in range(100)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0], 40 + i // 3) for i in range(30)] + [(200, [0.0] * 4, 90), (201, None, 91), (202, [1.0, None, 1.0, 1.0], 92), (203, [1.0], 93)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, doc_id long")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    all_pairs = evaluate.vector_scores(q, v)
    for k in (3, 200):
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        want = all_pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank").collect()
        got = evaluate.vector_topk(q, v, k)
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
        assert sorted(map(repr, got.select("query_id", "vec_id", "score", "rank").collect())) == sorted(map(repr, want))
        best = evaluate.best_chunk(all_pairs, k).select("query_id", "doc_id", "score", "rank").collect()
        assert sorted(map(repr, evaluate.vector_topk(q, v, k, by="doc_id").select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(repr, best))


def test_products_that_say_nothing_bound_nothing(spark):
    """Vectors so small that their scores are coarse are all scored, and no product of theirs keeps another vector out."""
    import random

    r = random.Random(5)
    vector = lambda scale: [r.uniform(-1, 1) * scale for _ in range(3)]
    rows = [(i, vector(2e-161)) for i in range(400)] + [(400 + i, vector(1.0)) for i in range(400)] + [(800, [float("inf"), 1.0, 1.0]), (801, [1e200, 1.0, 1.0]), (802, [float("nan")] * 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = evaluate.vector_scores(q, v).withColumn("rank", first).where("rank <= 3").select("query_id", "vec_id", "score", "rank").collect()
    got = evaluate.vector_topk(q, v, 3).select("query_id", "vec_id", "score", "rank").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    chunks = v.withColumn("doc_id", F.floor(F.col("vec_id") / 4))
    best = evaluate.best_chunk(evaluate.vector_scores(q, chunks), 3).select("query_id", "doc_id", "score", "rank").collect()
    got = pipelines.vector_rag(q, chunks, 3).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, best))


def test_close_scores_are_told_apart(spark):
    """Single precision only chooses: many scores closer than its error have the places and digits of doubles, with a key of one vector or of many."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=48)
    rows = [(i, (base + rng.normal(size=48) * 3e-3).tolist(), i // 2) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, doc_id long")
    q = v.where("vec_id % 500 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    every = evaluate.vector_scores(q, v, 9)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = every.withColumn("rank", first).where("rank <= 20").select("query_id", "vec_id", "score", "rank").collect()
    assert sorted(evaluate.vector_topk(q, v, 20, 9).select("query_id", "vec_id", "score", "rank").collect()) == sorted(want)
    best = evaluate.best_chunk(every, 20).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(evaluate.vector_topk(q, v, 20, 9, by="doc_id").select("query_id", "doc_id", "score", "rank").collect()) == sorted(best)


def test_checkpoints_score_a_vector_once(spark, monkeypatch):
    """The first of nested checkpoints are those of a search in each, and all searches together meet each vector once."""
    from weft.plans.eval_queries import benchmark_checkpoints

    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i * 3 % 200, x.tolist(), i % 4) for i, x in enumerate(rng.integers(-2, 3, size=(200, 3)).astype(float))], "vec_id long, embedding array<double>, label int")
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cp = evaluate.checkpoint_corpus(v.select(F.col("vec_id").alias("doc_id")), [1, 20, 100]).persist()
    want = []
    for pct in (1, 20, 100):
        held = v.join(cp.where(F.col("pct") == pct).select(F.col("doc_id").alias("vec_id")), "vec_id")
        want += [(pct, *r) for r in evaluate.vector_topk(q, held, 4).select("query_id", "vec_id", "score", "rank").collect()]
    got = evaluate.checkpoint_topk(q, v, cp, [1, 20, 100], 4).select("pct", "query_id", "vec_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)

    met, search = [], evaluate.vector_topk
    monkeypatch.setattr(evaluate, "vector_topk", lambda q, v, *rest, **more: met.append(v.count()) or search(q, v, *rest, **more))

    class Held:
        def raw(self, name):
            return v

    Held.spark = spark
    assert benchmark_checkpoints(Held()).count() == 6 and sum(met) == 200


def test_labels_count_as_their_pairs_do(spark):
    from weft.operators import evaluate

    d = spark.createDataFrame([(i, i % 3 if i != 7 else None) for i in range(12)] + [(20, 9)], "doc_id long, label int")
    q = d.where("doc_id % 2 = 0 or doc_id = 7").select(F.col("doc_id").alias("query_id"), "label")
    got = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("doc_id", (F.col("query_id") + F.col("rank") * 3) % 11)
    pairs = d.join(q, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    for k in (0, 4):
        assert sorted(evaluate.labelled_scores(q, got.where("doc_id <> query_id"), d, k).collect()) == sorted(evaluate.retrieval_scores(q, got.where("doc_id <> query_id"), pairs, k).collect())


def test_a_pair_of_blocks_has_a_task(spark, monkeypatch):
    """Blocks meet in tasks of their own: none waits for another that was dealt to the same task."""
    import pyarrow as pa
    from pyspark import TaskContext

    def where(vectors, queries):
        return pa.table({"query_id": pa.array([TaskContext.get().partitionId()], pa.int64()), "vec_id": pa.array([vectors.num_rows], pa.int64()), "score": pa.array([float(queries.num_rows)])})

    monkeypatch.setattr(evaluate, "QUERY_BLOCK", 20)
    monkeypatch.setattr(evaluate, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(evaluate, "_best_of_blocks", lambda *_: where)
    v = spark.createDataFrame([(i, [float(i)]) for i in range(400)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = evaluate.vector_topk(q, v, 1000).collect()
    assert sorted(r.query_id for r in got) == list(range(4 * 10)) and sum(r.vec_id for r in got) == 4 * 400 and sum(r.score for r in got) == 10 * 80


def test_cuts_meet_the_labels_once(spark):
    """Several cuts of one retrieved list cost the joins of one, and are what each is alone; a query may have nothing above a cut."""
    from weft.plans.eval_queries import expansion_delta

    d = spark.createDataFrame([(i, i % 3 if i != 7 else None) for i in range(12)] + [(20, 9)], "doc_id long, label int")
    q = d.where("doc_id % 2 = 0 or doc_id = 7").select(F.col("doc_id").alias("query_id"), "label")
    got = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("doc_id", (F.col("query_id") + F.col("rank") * 3) % 11)
    got = got.where("doc_id <> query_id and (query_id % 3 = 0 or rank > 2) and query_id <> 10")
    pairs = d.join(q, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    cuts = evaluate.labelled_cuts(q, got, d, [0, 4, 2])
    at = {(r.query_id, c.k): (c.recall, c.precision) for r in cuts.collect() for c in r.cuts}
    for k in (0, 2, 4):
        assert at | {(r.query_id, k): (r.recall, r.precision) for r in evaluate.retrieval_scores(q, got, pairs, k).collect()} == at
    assert len(at) == 3 * q.count()

    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(rng.normal(size=(200, 3)))], "vec_id long, embedding array<double>, label int")

    class Held:
        def raw(self, name):
            return v

    Held.spark = spark
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(expansion_delta(Held())) == joins(evaluate.labelled_scores(q, got, d, 4))
    hits = {}
    for r in evaluate.vector_topk(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 10).collect():
        hits.setdefault(r.query_id, {})[r.rank] = r.vec_id % 4 == r.query_id % 4
    want = {i: (0.0, 0.0) for i in range(0, 200, 25)} | {i: (sum(x.values()) / 10, sum(x[j] for j in (1, 2, 3)) / 3) for i, x in hits.items()}
    got = expansion_delta(Held()).collect()
    assert len(got) == 8 and all((r.expanded, r.plain) == tuple(round(x, 6) for x in want[r.query_id]) and r.hurt == (r.expanded < r.plain) for r in got)


def test_only_stretches_that_reach_the_bound_are_looked_through(monkeypatch):
    """Where each vector has a key of its own, a block's products are not all compared with the bound; ties and the last, short turn are found."""
    import pyarrow as pa

    looked, every = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: looked.append(np.size(x)) or every(x))
    rng = np.random.default_rng(6)
    for copies in (1, 9):  # of each vector
        x = np.repeat(rng.normal(size=(1300, 8)), copies, axis=0)[:1300]
        ids = rng.permutation(1300) * 3
        vectors = pa.table({"vec_id": ids, "key": ids, "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))})
        some = np.arange(0, 1300, 13)
        queries = pa.table({"query_id": ids[some], "q": pa.array(x[some].tolist(), pa.list_(pa.float64()))})
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        score = np.round(unit @ unit.T, 6)
        for grouped in (False, True):
            got = evaluate._best_of_blocks(5, 6, "doc_id", grouped)(vectors, queries).to_pylist()
            want = {(ids[i], j) for i in some for j in ids[[o for o in np.lexsort((ids, -score[i])) if o != i][:5]]}
            assert {(r["query_id"], r["doc_id"]) for r in got} == want and len(got) == 5 * len(some)
    assert max(looked, default=0) < len(some) * 1300

    about = rng.integers(0, 40, size=(50, 77)).astype(np.float32)
    for n in (1, 10, 77, 100):
        most = evaluate._largest(about, n)
        assert (most == np.stack([about[:, i::n].max(axis=1) for i in range(min(n, 77))], axis=1)).all()
        least = np.sort(most, axis=1)[:, -min(3, most.shape[1])]
        assert sorted(zip(*evaluate._reaching(about, most, least), strict=True)) == list(zip(*np.nonzero(about >= least[:, None]), strict=True))


def test_documents_of_one_set_are_scored_once(spark):
    """Many documents of a few sets of entities: scores meet sets, not documents, and ties go to the smaller id across sets."""
    d = spark.createDataFrame([(i, e) for i in range(60) for e in (("a",), ("a", "b"), ("b", "a"), ("c",))[i % 4]], "doc_id long, entity string")
    roots = spark.createDataFrame([("q", "a"), ("q", "b"), ("p", "c")], "query_id string, entity string")
    x = graph.entity_retrieve(roots, None, d, 32, 0)
    want = {"q": [i for i in range(60) if i % 4 in (1, 2)] + [0, 4], "p": [i for i in range(60) if i % 4 == 3]}
    for q in "qp":
        assert [r.doc_id for r in x.where(F.col("query_id") == q).orderBy("rank").collect()] == want[q]
    assert "weft-retrieve" in x._jdf.queryExecution().toString()


def test_chunk_grid_in_blocks(spark, monkeypatch):
    """The grid's scores are those of each cell on its own, however texts and queries are dealt; with k only the first leave a block."""
    import random

    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "the", "x-y", "Über", "Kng", "c.d.e", "--", "f", "g7"])
    text = lambda n: "".join(word() + r.choice([" ", "\n", " \t "]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 5, 6, 7, 40, 90]))) for i in range(60)] + [(60, None), (61, "  "), (None, "the a b")]
    asks = [(i, text(r.choice([0, 1, 4, 9]))) for i in range(23)] + [(23, None), (24, "!")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asks, "query_id long, text string")
    cells = [(5, 0), (5, 2), (7, 6), (50, 10)]
    monkeypatch.setattr(evaluate, "GRID_QUERIES", 9)
    monkeypatch.setattr(evaluate, "GRID_BYTES", 900)
    monkeypatch.setattr(evaluate, "ENTRIES_AT_ONCE", 64)
    want = [(s, o, *x) for s, o in cells for x in evaluate.lexical_scores(q, d, s, o).collect()]
    got = evaluate.lexical_grid(q, d, cells)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    first = lambda df: sorted(repr(tuple(x)) for s, o in cells for x in evaluate.best_chunk(df.where(f"size = {s} and overlap = {o}").drop("size", "overlap"), 3).collect())
    few = evaluate.lexical_grid(q, d, cells, 3)
    assert first(few) == first(got) and few.count() < got.count()
    monkeypatch.undo()
    assert evaluate.lexical_grid(q, d, cells, 3).count() <= 3 * len(cells) * len(asks)  # one block sends what is asked for and no more
    assert evaluate.lexical_grid(q.where("false"), d, cells, 3).count() == evaluate.lexical_grid(q, d.where("false"), cells, 3).count() == 0


def test_holders_without_all_pairs(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "xone two threex"), (3, "one  two"), (4, None), (None, "a two b"), (5, ""), (5, "two two")], "doc_id long, text string")
    asks = [(1, "ne two thr"), (2, "e  t"), (3, "two"), (4, ""), (5, None), (6, " two "), (7, "one twoo three"), (8, " ")]
    q = spark.createDataFrame(asks, "query_id long, text string")
    want = d.join(q.withColumnRenamed("text", "asked"), F.col("text").contains(F.col("asked"))).select("query_id", "doc_id")
    assert sorted(map(repr, evaluate.holders(q, d).collect())) == sorted(map(repr, want.collect()))
