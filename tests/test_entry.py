"""The entry module against DuckDB, on the smallest tables, and its independence of the llm subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SOME = ["search_candidates", "bm25_shortlist", "edge_compaction", "neighbors_2hop", "header_offsets", "path_hash_fnv1a", "split_execute", "ticket_blob", "events_sessions", "entity_graph_retrieve_1hop", "recall_precision_at_k", "version_gc", "chunk_grid_search", "guarded_transitions", "segment_answers", "strip_code_fence", "split_plan_ranges", "benchmark_checkpoints", "content_at_version", "adjacency_segments", "stream_crossings", "mail_messages", "ingest_segments", "running_cost_cap", "path_index_delete"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours = entry.QUERIES[name](spark, SF)
    rel = con.execute(entry.ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(ours.columns)
    rounded = lambda rows: sorted((tuple(round(float(v), 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert rounded(map(tuple, ours.select(*cols).collect())) == rounded(rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["heuristic_entities"])
def test_all_documents(spark, name):
    import __spark_entry__ as entry

    assert entry.QUERIES[name](spark, SF).select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    test_same_as_duckdb(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_document_has_a_shortlist(spark):
    import __spark_entry__ as entry

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert entry.QUERIES["bm25_shortlist_documents"](spark, SF).groupBy("doc_id").count().where("count = 8").count() == n
    test_same_as_duckdb(spark, "bm25_shortlist_documents")


def test_every_query_has_a_name_and_sql():
    import __spark_entry__ as entry

    assert len(entry.QUERIES) > 90 and set(entry.ORACLES) == set(entry.QUERIES)


def test_entry_works_without_the_llm_subpackage(tmp_path):
    for name in ("weft", "__spark_entry__.py"):
        os.symlink(os.path.join(HERE, name), tmp_path / name) if name != "weft" else os.mkdir(tmp_path / name)
    for name in os.listdir(os.path.join(HERE, "weft")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(HERE, "weft", name), tmp_path / "weft" / name)
    code = "import __spark_entry__ as e; assert e.llm_queries is None and 'pipeline' not in e.queries(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) > 90, out.stderr
