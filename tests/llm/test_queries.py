"""The registered queries on the smallest tables; SQL where there is some; the pipeline's stages in order."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_names():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing sources", "best-fit packing"]


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_line_dedup", "op12_filter_audit", "op13_phrases"])
def test_same_as_duckdb(spark, name):
    from weft.llm import queries

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rel = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*cols).collect())) == sorted(rel.fetchall())


def test_pipeline_keeps_what_its_stages_decide(spark):
    import corpus_pipeline
    from weft.llm import exact_dedup, mixing, near_dedup, quality
    from weft.llm.common import new_dir, staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    base = new_dir(spark, "test")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        steps.append(docs)
        docs = staged(stage(spark, docs, SF), f"{base}/{i}")
        if i < 4:
            assert docs.columns == columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(steps[1]) == ids(quality.score_quality(steps[0], labels).where("predicted = 1"))
    assert ids(steps[2]) == ids(exact_dedup.exact_dedup(steps[1]).where("kept"))
    assert ids(steps[3]) == ids(near_dedup.near_dedup(steps[2]).where("kept"))
    copies = mixing.mixing_report(steps[3]).selectExpr("doc_id", "explode(shards) as s")
    assert ids(steps[4]) == ids(copies)
    assert ids(docs.where("piece = 0")) == ids(steps[4])


ODD = "doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean, size long, piece int, length long, sequence_id long"


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline_of_odd_tables(spark, tmp_path, odd):
    """Empty tables give no rows; null ids and texts, repeated rows and clashing columns go through every stage."""
    import corpus_pipeline
    from weft.llm.common import new_dir, staged

    words = " ".join(f"w{i}" for i in range(6000))
    texts = [(None, None), (None, "alone without an id"), (1, ""), (2, None), (3, words), (4, words + " last"), (5, "twice the same row"), (5, "twice the same row"), (6, "é" * 9000)]
    rows = [(i, t, None, None if k % 3 else "hot", None, 0.0, False, -1, 7, -1, 3) for k, (i, t) in enumerate(texts)] if odd else []
    sf = str(tmp_path)
    spark.createDataFrame(rows, ODD).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, base, kept = spark.read.parquet(f"{sf}/documents.parquet"), new_dir(spark, "test"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = staged(stage(spark, docs, sf), f"{base}/{i}")
        assert i == 4 or docs.columns == columns
        kept.append(docs)
    if not odd:
        assert all(d.isEmpty() for d in kept)
        return
    body = lambda d: sorted(r[0] or "" for r in d.select("text").collect())
    assert kept[0].count() == len(rows)  # without labels every score is 0.5, which rejects nothing
    assert body(kept[1]) == sorted({t or "" for _, t in texts})  # one row of each text
    assert body(kept[2]) == sorted({t or "" for _, t in texts} - {words + " last"})  # documents 3 and 4 are one component
    assert set(body(kept[3])) <= set(body(kept[2]))
    pieces = kept[4].collect()
    assert sum(r.piece == 0 for r in pieces) == kept[3].count() and all(0 < r.length <= 4096 for r in pieces)
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
