"""Walks to any depth, adjacency in segments, pairs in blocks, reads at an epoch, sketches, and names in texts."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import evaluate, graph, store

rng = random.Random(9)


def plain_walk(roots, links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    out = {}
    for q, e in roots:
        out[q, e] = 0
    for q in {q for q, _ in roots}:
        front, hop = {e for p, e in roots if p == q}, 0
        while front:
            hop += 1
            front = {b for a in front for b in near.get(a, ())} - {e for p, e in out if p == q}
            out.update({(q, e): hop for e in front})
    return out


def test_a_chain_of_eight_and_a_cycle(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(8)]
    links = chain + [(b, a) for a, b in chain] + [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x")]
    roots = [(i, rng.choice(["c0", "c4", "x", "nowhere"])) for i in range(130)] + [(3, "c0"), (200, "c0"), (200, "c0"), (200, "z")]
    roots = list(dict.fromkeys(roots)) + roots[:2]
    df = spark.createDataFrame(links, "entity string, other string")
    asked = spark.createDataFrame(roots, "query_no long, entity string")
    got = graph.walk(asked, df)
    want = plain_walk(roots, links)
    assert {(r.query_no, r.entity): r.hop for r in got.collect()} == want and max(want.values()) == 8 and got.count() == len(want)
    assert {(r.query_no, r.entity): r.hop for r in graph.walk(asked, df, 3).collect()} == {k: h for k, h in want.items() if h <= 3}
    assert graph.walk(asked.limit(0), df).count() == 0 and graph.walk(asked, df.limit(0)).count() == len(set(roots))


def test_deep_retrieval_scores_each_distance(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(8)]
    docs = spark.createDataFrame([(i, f"c{i}") for i in range(9)] + [(9, "c8"), (9, "c7"), (10, "far")], "doc_id long, entity string")
    links, roots = spark.createDataFrame(chain, "entity string, other string"), spark.createDataFrame([("q", "c0")], "query_id string, entity string")
    got = [(r.doc_id, r.score) for r in graph.entity_retrieve_deep(roots, links, docs, 20).orderBy("rank").collect()]
    assert got == sorted([(i, 0.5**i) for i in range(9)] + [(9, 0.5**8 + 0.5**7)], key=lambda x: (-x[1], x[0]))
    two = graph.entity_retrieve(roots, links, docs, 20, 2)
    assert sorted(map(tuple, graph.entity_retrieve_deep(roots, links, docs, 20, 2).collect())) == sorted(map(tuple, two.select("query_id", "doc_id", "score", "rank").collect()))
    with pytest.raises(ValueError):
        graph.entity_retrieve_deep(roots, links, docs, 3, -1)


def test_a_hub_is_many_rows_of_one_size(spark):
    pairs = [(7, t) for t in range(5000)] + [(7, 3), (2, 9), (2, 4), (11, 1)]
    got = graph.segmented(spark.createDataFrame(pairs, "source long, target long"), 64, bound=100)
    rows = got.orderBy("source", "segment").collect()
    hub = [r for r in rows if r.source == 7]
    assert len(hub) == 79 and all(len(r.targets) == 64 for r in hub[:-1]) and [t for r in hub for t in r.targets] == list(range(5000))
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.targets)
    asked = spark.createDataFrame([(2,), (2,), (99,)], "source long")
    assert sorted(map(tuple, graph.segment_neighbors(asked, got).collect())) == [(2, 4), (2, 9)]
    assert graph.segmented(spark.createDataFrame([], "source long, target long")).count() == 0


def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_BLOCK", 7)
    rows = [("hot", f, f * 3 % 101) for f in range(60)] + [(f"e{rng.randrange(5)}", rng.randrange(60), rng.randrange(90)) for _ in range(60)]
    m = spark.createDataFrame(rows, "entity string, file_id long, seq long")
    light = sorted(map(tuple, graph.cooccurrence_edges(m).collect()))
    assert sorted(map(tuple, graph.cooccurrence_edges(m, heavy=20).collect())) == light
    first = {}
    for e, f, s in rows:
        first[e, f] = min(s, first.get((e, f), s))
    want = {}
    for (e, f), s in first.items():
        for (d, g), t in first.items():
            if d == e and s > t and f != g:
                want[f, g] = want.get((f, g), 0) + 1
    assert light == sorted((a, b, "ENTITY_COOCCUR", n) for (a, b), n in want.items())
    classes = graph.cooccurrence_classes(m, bound=10).collect()
    assert {(r.entity, r.file_id): r.links for r in classes} == {(e, f): sum(d == e and t < s for (d, _), t in first.items()) for (e, f), s in first.items()}
    d = spark.createDataFrame([(1, f"n{i}", f"N{i}", i) for i in range(40)] + [(2, "n1", "x", 99), (2, "z", "Z", 98)], "doc_id long, entity string, display string, seq long")
    assert sorted(map(tuple, graph.entity_graph(d, heavy=5)[1].collect())) == sorted(map(tuple, graph.entity_graph(d)[1].collect()))
    assert graph.entity_graph(d, heavy=5)[1].count() == 40 * 39 + 2


@pytest.mark.parametrize("bound", [None, 40])
def test_reads_at_an_epoch(spark, bound):
    rows = []
    for f in (1, 2, 3):
        for e in sorted(rng.sample(range(1, 900), 300 if f == 1 else 6)):
            rows.append((f, e, f < 3 and rng.random() < 0.2, rng.choice(["a", "bé", "", None])))
    asked = [(f, e) for f in (1, 2, 3) for e in range(0, 905, 35)] + [(1, 35), (4, 3)]
    want = {}
    for f, e in asked:
        held, version = "", None
        for g, at, full, data in rows:
            if g == f and at <= e:
                held, version = (data or "") if full else held + (data or ""), at
        want[f, e] = (version, held if version is not None else None)
    v, r = spark.createDataFrame(rows, "file_id long, epoch long, full boolean, data string"), spark.createDataFrame(asked, "file_id long, epoch long")
    got = store.content_at(r, v, missing="keep", bound=bound).collect()
    assert {(x.file_id, x.epoch): (x.version, x.content) for x in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="no version of file"):
        store.content_at(r, v, bound=bound).collect()


def test_sketches_merge_and_keep_their_rank_error(spark):
    s = spark.range(20_000).selectExpr("if(id % 3 = 0, 'a', 'b') as method", "timestamp_seconds(id) as ts", "cast(pow(id % 997, 2) as double) as duration")
    table = evaluate.latency_sketches(s)
    assert table.count() == 2 * 334 and table.agg(F.sum("n")).first()[0] == 20_000
    x = evaluate.rank_errors(evaluate.sketched_latencies(table), s).collect()
    assert len(x) == 6 and all(r.rank_error <= evaluate.RANK_ERROR for r in x)
    wrong = evaluate.rank_errors(spark.createDataFrame([("a", 0.5, 1, -5.0)], "method string, q double, n long, estimate double"), s).first()
    assert wrong.rank_error == 0.5
    one = table.where("start < timestamp_seconds(60)")
    assert evaluate.sketched_latencies(one).where("q = 0.5").agg(F.sum("n")).first()[0] == 60
    assert evaluate.sketched_latencies(evaluate.latency_sketches(s.limit(0))).count() == 0


@pytest.mark.parametrize("at_once", [None, 60])
def test_names_in_texts(spark, at_once):
    texts = [(1, "the café on the hill"), (2, ""), (3, None), (4, "hillhill"), (5, "x" * 5000 + "hill")]
    names = ["hill", "the", "é o", "hi", "", None, "hill", "absent", "x" * 4000]
    got = graph.mentioned(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), at_once)
    assert sorted(map(tuple, got.collect())) == sorted({(i, n) for i, t in texts for n in names if t and n and n in t})
    assert graph.mentioned(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_cooccurrence_has_a_partition_for_so_many_rows(spark, monkeypatch):
    """Pairs are dealt to as many tasks as their number asks for, unless the files are so few that their pairs repeat; edges stay the same."""
    r = random.Random(5)
    rows = [(f"e{i}", r.randrange(400), j) for i in range(90) for j in range(r.choice([1, 2, 12]))] + [("all", i, i) for i in range(60)]
    m = spark.createDataFrame(rows, "entity string, file_id long, seq long")
    whole = graph.cooccurrence_edges(m)
    monkeypatch.setattr(graph, "ROWS", 40)
    monkeypatch.setattr(graph, "PAIR_BLOCK", 20)
    dealt = graph.cooccurrence_edges(m, heavy=30)
    assert dealt.rdd.getNumPartitions() > 100
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
    few = m.withColumn("file_id", F.col("file_id") % 5)
    got = graph.cooccurrence_edges(few, heavy=30)
    assert got.rdd.getNumPartitions() <= 4
    monkeypatch.undo()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.cooccurrence_edges(few).collect()))
    assert graph.cooccurrence_edges(m.where("false")).count() == 0
