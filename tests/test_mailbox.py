"""The mail source: stretches of files, filters on names, streams; pages by a table function; compaction in levels."""

import io

import pytest
from pyspark.sql import functions as F

from weft.operators import graph
from weft.sources import mailbox, readers
from weft.streaming import streams

BODIES = ["plain", "", "From here on\n>From there\n>>From x", "é ü\x0bz", "a\r\nb\rc", "x" * 3000, "two\n\nlines"]


def box(rows):
    head = "From -\nMessage-ID: <m{0}>\nFrom: A {0} <a{0}@x>\nSubject: Re: s\nContent-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: 8bit\n\n"
    mark = lambda b: "\n".join(">" + x if x.lstrip(">").startswith("From ") else x for x in b.split("\n"))
    return "".join(head.format(i) + mark(b) + "\n" for i, b in rows).encode()


@pytest.mark.parametrize("size", [1, 37, 500, 10_000])
@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_each_message_lies_in_one_stretch(size, at_once, monkeypatch):
    monkeypatch.setattr(mailbox, "AT_ONCE", at_once)
    data = box(list(enumerate(BODIES * 2)))
    whole = list(mailbox.messages(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 14 and whole[2].endswith(b"\n\nFrom here on\n>From there\n>>From x\n")
    if size > 30 or at_once > 7:
        parts = [m for s in mailbox.planned([("b.mbox", len(data), 0)], size) for _, a, z in s.files for m in mailbox.messages(io.BytesIO(data), a, z)]
        assert parts == whole


def test_files_are_packed_by_bytes():
    files = [(f"{i}.eml", 100, i) for i in range(100)] + [("z.mbox", 50_000, 1)]
    parts = mailbox.planned(files, 10_000)
    names = [n for p in parts for n, _, end in p.files if end is None]
    assert names == [f[0] for f in files[:-1]] and max(len(p.files) for p in parts) <= 10
    ends = [(a, z) for p in parts for n, a, z in p.files if n == "z.mbox"]
    assert ends[0][0] == 0 and ends[-1][1] == 50_000 and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_a_folder_and_filters_on_names(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("b.mbox", box(list(enumerate(BODIES)))), ("one.eml", b"From: q@x\nSubject: Hello\nIn-Reply-To: <z>\n\nbody \n"), ("sub/two.eml", b"Subject: s\n\nx"), ("_SUCCESS", b""), (".hidden", b"From: x")):
        (tmp_path / name).write_bytes(content)
    got = {r.id: r for r in mailbox.mails(spark, str(tmp_path), partitionBytes=400).collect()}
    assert set(got) == {*(f"m{i}" for i in range(len(BODIES))), "one", "two"}
    assert (got["one"].sender, got["one"].thread, got["one"].body) == ("q@x", "<z>", "body") and got["two"].file == "sub/two.eml"
    assert (got["m0"].sender, got["m0"].thread, got["m2"].body) == ("a0@x", "subject:s", BODIES[2])
    few = mailbox.mails(spark, str(tmp_path)).where("file in ('one.eml', 'sub/two.eml') and id <> 'x'")
    assert {r.id for r in few.collect()} == {"one", "two"}
    reader = mailbox.MailReader(str(tmp_path), 400)
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    left = list(reader.pushFilters([StringStartsWith(("file",), "sub/"), IsNotNull(("file",)), EqualTo(("id",), "x")]))
    assert len(left) == 2 and [n for p in reader.partitions() for n, _, _ in p.files] == ["sub/two.eml"]
    (tmp_path / "empty").mkdir()
    assert mailbox.mails(spark, str(tmp_path / "empty")).count() == 0


def test_mail_as_a_stream_goes_on_where_it_was(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def drain():
        streams.drain(mailbox.mail_stream(spark, str(source)).select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))
        return sorted(r.id for r in spark.read.parquet(out).collect())

    (source / "a.mbox").write_bytes(box([(1, "x"), (2, "y")]))
    assert drain() == ["m1", "m2"]
    (source / "c.mbox").write_bytes(box([(3, "z")]))
    assert drain() == ["m1", "m2", "m3"] == drain()


def test_pages_keep_what_stands_beside_them(spark):
    framed = "[[PAGE 1 LEN=3]]\nabc[[/PAGE 1]]\n[[PAGE 2 LEN=0]]\n[[/PAGE 2]]\n"
    df = spark.createDataFrame([(1, framed, 7), (2, None, 8), (3, "", 9)], "id long, text string, beside int")
    x = readers.iter_pages(df, "id", "text", "beside")
    assert sorted(map(tuple, x.collect())) == [(1, 1, "abc", 7), (1, 2, "", 7)]
    with pytest.raises(Exception, match="no page at character"):
        readers.iter_pages(df.withColumn("text", F.lit("[[PAGE x"))).collect()


def test_levels_hold_every_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.LevelledCompactor, "FAN", 3)
    target, every = streams.LevelledCompactor(str(tmp_path / "p")), None
    kinds = ["ENTITY_COOCCUR", "REDIRECT"]
    for b in range(11):
        rows = [(i % 4, (i * b) % 3, kinds[(i + b) % 2], i + b, 100 - (b % 4), b * 100 + i) for i in range(12)]
        batch = spark.createDataFrame(rows, "source long, target long, edge_type string, weight long, last_updated long, seq long")
        every = batch if every is None else every.unionByName(batch)
        for _ in range(2 if b in (2, 8) else 1):  # batches that merge run twice
            target(batch, b)
    assert target.parts(11) == [target.part(0, 9), target.part(0, 10), target.part(2, 0)] and target.parts(9) == [target.part(2, 0)]
    want = graph.compact_edges(every)
    assert sorted(map(tuple, target.snapshot(spark, 11).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
