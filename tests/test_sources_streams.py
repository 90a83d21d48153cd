"""Readers and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import graph
from weft.sources import readers
from weft.streaming import streams


def test_tickets(spark, tmp_path):
    t = {"ticket_id": "T1", "subject": "S", "description": "a\nb", "comments": [{"author": "x", "body": "[[/COMMENT 1]]"}]}
    (tmp_path / "t.json").write_text(json.dumps(t))
    a = readers.tickets_json(spark, str(tmp_path / "t.json"))
    assert a.first().assignee == "" and a.first().comments[0].author == "x"
    (tmp_path / "t.csv").write_text('ticket_id,subject,description,comments\nT1,S,"a\nb","[{""author"": ""x"", ""body"": ""[[/COMMENT 1]]""}]"\n')
    b = readers.tickets_csv(spark, str(tmp_path / "t.csv"))
    ra, rb = (readers.raw_documents("ticket", x).first() for x in (a, b))
    assert ra.text == rb.text and "[[COMMENT 1 LEN=31]]\nAUTHOR: x\nBODY:\n[[/COMMENT 1]]\n[[/COMMENT 1]]\n" in ra.text
    assert ra.structured_fields["comment_count"] == "1"
    with pytest.raises(ValueError):
        readers.raw_documents("fax", a)


def test_mail(spark, tmp_path):
    (tmp_path / "m2.txt").write_bytes(b"From: Bob <bob@x.org>\nSubject: Re: Hi\nReferences: <r1> <r2>\n\nbody\n")
    (tmp_path / "m1.txt").write_bytes(b"From: nobody\nSubject: Re:  Hi\nContent-Transfer-Encoding: quoted-printable\n\nca=66=C3=A9\n")
    rows = readers.mail(spark, str(tmp_path)).collect()
    assert [(r.id, r.sender, r.thread) for r in rows] == [("m1", "nobody", "subject:hi"), ("m2", "bob@x.org", "<r1>")]
    assert readers.mail(spark, str(tmp_path), 1).count() == 1


def test_chat_and_registry(spark, tmp_path):
    rows = [{"instruction": "how?", "category": "C", "intent": "i", "response": "so"}] * 2
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"rows": rows}))
    for name in ("a", "b"):
        got = readers.load_dataset(spark, "chat", str(tmp_path / f"{name}.json")).collect()
        assert [(r.ticket_id, r.created_at) for r in got] == [("BTX-000000", "2024-01-01T00:00:00+00:00"), ("BTX-000001", "2024-01-01T00:01:00+00:00")]
        assert (got[1].status, got[1].priority, got[1].requester, got[1].assignee) == ("closed", "normal", "customer-1@example.com", "support-bot@example.com")
        assert got[0].comments[0].asDict() == {"author": "support-bot@example.com", "body": "so"}
    with pytest.raises(ValueError, match="mail"):
        readers.load_dataset(spark, "nope", "")


def test_pages(spark):
    df = spark.createDataFrame([("d", 1, "[[/PAGE 1]]"), ("d", 2, ""), ("d", 3, "é\n")], "id string, page int, text string")
    framed = readers.raw_documents("pdf", df)
    pages = [(r.page, r.text) for r in readers.iter_pages(framed).orderBy("page").collect()]
    assert pages == [(1, "[[/PAGE 1]]\n"), (2, ""), (3, "é\n")]
    with pytest.raises(ValueError):
        readers.parse_pages("[[PAGE 1 LEN=3]]\nabcdef")


def test_json_repair(spark):
    assert json.loads(readers.repair_json('{"a": """x "y"\nz""", "b": "1\n2"}')) == {"a": 'x "y"\nz', "b": "1\n2"}
    df = spark.createDataFrame([('```json\n["Ann", "ann ", "Bob"]\n```', ""), ("no json", "Then Ann met Bob")], "r string, s string")
    got = [r.e for r in readers.with_entities(df, F.col("r"), F.col("s"), "e").collect()]
    assert got == [["Ann", "Bob"], ["Then Ann", "Bob"]]


def test_round_trips(spark, tmp_path):
    truth = spark.createDataFrame([("t", "d", "primary")], "topic_id string, doc_id string, label string")
    readers.write_ground_truth(truth, str(tmp_path / "g"))
    assert readers.read_ground_truth(spark, str(tmp_path / "g")).collect() == truth.collect()
    rows = spark.createDataFrame([("a", 0.5)], "arm string, mean_recall double")
    readers.write_results(rows, str(tmp_path / "r"))
    assert readers.read_results(spark, str(tmp_path / "r"), "arm: string, mean_recall: double").collect() == rows.collect()
    with pytest.raises(ValueError):
        readers.topic_seeds(spark, [{"id": 1, "title": "x"}, {"id": 1, "title": "y"}])


def _drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_compaction(spark, tmp_path):
    kind = "source long, target long, edge_type string, weight long, last_updated long, seq long"
    rows = [(1, 2, "ENTITY_COOCCUR", 1, i, i) for i in range(6)] + [(1, 3, "REDIRECT", i, i, 10 + i) for i in range(4)]
    log = spark.createDataFrame(rows, kind)
    for i, part in enumerate((log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))):
        part.coalesce(1).write.parquet(str(tmp_path / "log" / f"p={i}"))
    c = streams.Compactor(str(tmp_path / "snap"))
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log") + "/*")
    q = s.writeStream.foreachBatch(c).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in c.snapshot(spark, 1).select("source", "target", "edge_type", "weight", "last_updated").collect())
    assert got == sorted(tuple(r) for r in graph.compact_edges(log).collect())


def test_stream_crossings_and_entities(spark, tmp_path):
    spark.createDataFrame([(1, i, "x" * 30) for i in range(6)] + [(2, 0, "y")], "file_id long, seq long, data string").write.parquet(str(tmp_path / "a"))
    s = streams.tail_log(spark, str(tmp_path / "a"), "file_id long, seq long, data string")
    assert [(r.file_id, r.seq, r.new_size) for r in _drain(streams.crossings(s, 100), tmp_path, "crossed").collect()] == [(1, 3, 120)]
    spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 2, 3), ("y", 2, 4)], "entity string, file_id long, seq long").write.parquet(str(tmp_path / "m"))
    s = streams.tail_log(spark, str(tmp_path / "m"), "entity string, file_id long, seq long")
    assert [(r.source, r.target, r.entity) for r in _drain(streams.cooccurrences(s), tmp_path, "pairs").collect()] == [(2, 1, "x")]


def test_yaml_seeds_and_live_corpus(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text("topics:\n- id: a\n  title: A\n  key_facts: [x, 1]\n- id: 2\n  title: B\n")
    got = readers.topic_seeds_yaml(spark, str(tmp_path / "t.yaml")).orderBy("idx").collect()
    assert [(r.id, r.title, r.key_facts) for r in got] == [("a", "A", ["x", "1"]), ("2", "B", [])]
    (tmp_path / "bad.yaml").write_text("topics:\n- id: a\n")
    with pytest.raises(ValueError, match="title"):
        readers.topic_seeds_yaml(spark, str(tmp_path / "bad.yaml"))
    docs = spark.createDataFrame([("d", "f.pdf", ("t", "Tax Rules"))], "doc_id string, filename string, primary_topic struct<id:string,title:string>")
    pages = spark.createDataFrame([("f.pdf", 2, "two"), ("f.pdf", 1, "one")], "filename string, page int, text string")
    r = readers.live_corpus(docs, pages).first()
    assert r.title == "Tax Rules" and [p for _, p in readers.parse_pages(r.text)] == ["one\n", "two\n"]


def test_report_round_trip(spark, tmp_path):
    cp = spark.createDataFrame([("20%", 7), ("50%", 16)], "label string, n int")
    rows = spark.createDataFrame([("20%", "main", 0.5)], "label string, arm string, recall double")
    hurt = spark.createDataFrame([("20%", True)], "label string, hurt boolean")
    readers.write_report(str(tmp_path / "r"), cp, rows, hurt)
    assert [tuple(r) for r in readers.read_report(spark, str(tmp_path / "r"), "checkpoints", "label:string,n:int").collect()] == [("20%", 7), ("50%", 16)]
    assert [tuple(r) for r in readers.read_report(spark, str(tmp_path / "r"), "traversal_precision", "label:string,hurt:boolean").collect()] == [("20%", True)]


def test_stream_leases_and_caps(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, owner string").coalesce(1).write.parquet(str(tmp_path / "c"))
    s = streams.tail_log(spark, str(tmp_path / "c"), "file_id long, owner string")
    q = streams.leases(s).writeStream.format("memory").queryName("claims").option("checkpointLocation", str(tmp_path / "cp-claims")).start()
    try:  # timers keep such a query at work, so it is ended here
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("claims").count() == 2:
                break
        assert sorted((r.file_id, r.owner, r.granted) for r in spark.table("claims").collect()) == [(1, "a", True), (2, "b", True)]
    finally:
        q.stop()
    rows = [("x", i, "openrouter", 1.0) for i in range(4)] + [("y", 1, "ollama", 0.0)]
    spark.createDataFrame(rows, "arm string, seq long, provider string, cost_usd double").write.parquet(str(tmp_path / "k"))
    s = streams.tail_log(spark, str(tmp_path / "k"), "arm string, seq long, provider string, cost_usd double")
    got = sorted((r.arm, r.seq, r.refused) for r in _drain(streams.capped_costs(s, 2.0), tmp_path, "capped").collect())
    assert got == [("x", 0, False), ("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 1, False)]


def test_soak_streams_rows(spark):
    x = streams.soak(spark, 10, 4)
    assert x.isStreaming and x.columns == ["file_id", "seq", "data"]


def test_cooccurrences_of_batches(spark, tmp_path):
    """Links of batches of mentions, of which one runs twice, without a call for each entity."""
    rows = [("x", 1, 1), ("x", 2, 2), ("x", 2, 1), ("y", 3, 1)], [("x", 1, 7), ("x", 4, 5), ("y", 5, 6), ("y", 6, 6)]
    target = streams.Cooccurrer(str(tmp_path / "links"))
    for batch in (0, 1, 1):
        target(spark.createDataFrame(rows[batch], "entity string, file_id long, seq long"), batch)
    assert sorted(map(tuple, target.links(spark, 2).collect())) == [(4, 1, "x"), (4, 2, "x"), (5, 3, "y"), (6, 3, "y")]


def test_a_large_log_has_more_files_and_as_many_batches(spark, monkeypatch, tmp_path):
    from weft.plans import stream_queries

    rows = [(i % 7, i % 11, ["REDIRECT", "ENTITY_COOCCUR"][i % 2], i % 5, i % 13, i) for i in range(2000)]
    events = spark.createDataFrame(rows, "source long, target long, edge_type string, weight long, last_updated long, seq long")
    t = type("T", (), {"spark": spark, "edge_events": lambda self: events})()
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    log, _, files = stream_queries._log(t, events, "log")
    assert files == 4 and len(spark.read.parquet(log).inputFiles()) == 24
    done = []
    monkeypatch.setattr(stream_queries.streams, "committed", lambda *a, f=stream_queries.streams.committed: done.append(f(*a)) or done[-1])
    got = stream_queries.stream_compaction(t)
    assert sorted(map(tuple, got.select("source", "target", "edge_type", "weight", "last_updated").collect())) == sorted(map(tuple, graph.compact_edges(events).collect()))
    assert done == [6]
