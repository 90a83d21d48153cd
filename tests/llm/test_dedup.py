"""Exact, line and near dedup against brute force, with odd rows."""

import hashlib
import random
import re
import subprocess
import sys
from collections import defaultdict

import pytest

from weft.llm import exact_dedup, line_dedup, near_dedup

LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "a b "), (6, LONG), (7, LONG.replace(" ", "\n")), (8, " "), (9, " a b"), (10, "same line of twenty!!\nx"), (11, "x\n SAME line of twenty!! \t"), (12, "same line of twenty!!\nsame line of twenty!!"), (13, "é" * 20), (14, "É" * 20), (15, "é" * 20), (16, "é" * 20)]
SCHEMA = "doc_id long, text string, key string, hash string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "k", "h") for i, t in rows], SCHEMA).repartition(parts)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [256, 8])
def test_exact(spark, bits):
    rng = random.Random(1)
    rows = ODD + [(100 + i, rng.choice(["x y", "x  y", "z", f"u{i}"])) for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_bits=bits).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        g = groups[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(norm(texts[r.doc_id]).encode()).hexdigest()


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], 2)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted(r.group_size for r in got) == [1, 1, 3, 3, 3] and sum(r.kept for r in got) == 3
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.keep_distinct(df).collect()) == [("1", "a"), ("2", "c"), ("None", "b")]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_runs_share_files(spark, tmp_path):
    rows = spark.range(400, numPartitions=8).selectExpr("id AS doc_id", "cast(sha2(cast(id % 300 AS string), 256) AS binary) AS key", "monotonically_increasing_id() AS uid")
    digests = rows.selectExpr("*", "struct(doc_id IS NULL AS last, doc_id, uid) AS who")
    got = exact_dedup.flush(digests, str(tmp_path / "level0"))
    files = defaultdict(list)
    for r in got.selectExpr("input_file_name() AS f", "_metadata.row_index AS at", "*").orderBy("f", "at").collect():
        files[r.f].append((r.run, bytes(r.key)))
    assert all(x == sorted(x) for x in files.values())
    assert max(len({run for run, _ in x}) for x in files.values()) == exact_dedup.RUNS
    wanted = {(r.uid >> 33) % exact_dedup.RUNS: set() for r in digests.collect()}
    for r in digests.collect():
        wanted[(r.uid >> 33) % exact_dedup.RUNS].add(bytes(r.key))
    assert sorted(y for x in files.values() for y in x) == sorted((run, k) for run, keys in wanted.items() for k in keys)
    assert got.agg({"n": "sum"}).first()[0] == 400


def lines_wanted(rows, least=20, docs=3):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= least:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), b"\n".join(stay).decode())
    return out


@pytest.mark.parametrize("bits", [1 << 16, 1 << 8])
def test_lines(spark, bits):
    rng = random.Random(2)
    pool = [f"a line that is long enough {i}" for i in range(12)] + ["short", ""]
    rows = ODD + [(100 + i, "\n".join(rng.choice(pool) for _ in range(5))) for i in range(60)]
    got = line_dedup.line_dedup(frame(spark, rows), filter_bits=bits).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == lines_wanted(rows)


def test_lines_repeated_ids_and_empty_table(spark):
    line = "a line of more than twenty"
    got = line_dedup.line_dedup(frame(spark, [(1, line), (1, line), (2, line), (None, "x")]), filter_bits=1 << 12).collect()
    assert sum(r.n_dropped for r in got) == 0 and len(got) == 4
    assert line_dedup.line_dedup(frame(spark, [(1, "x")]).limit(0), filter_bits=1 << 12).count() == 0
    assert line_dedup.digest(line_dedup.line_dedup(frame(spark, [(1, None)]), filter_bits=1 << 12)).first().kept_sha256 == hashlib.sha256(b"").hexdigest()


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block,k", [(256, 4), (3, 4), (256, 5)])
def test_near(spark, block, k):
    rng = random.Random(3)
    rows = [(i, t) for i, t in ODD if i != 6]
    base = [f"v{rng.randrange(999)}" for _ in range(120)]
    for i in range(40):  # copies of one text with few to many words changed: a chain of links and near misses
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, " ".join(base[:60] + [f"o{i}_{j}" for j in range(60)])) for i in range(15)]  # a passage they share, no link
    got = near_dedup.near_dedup(frame(spark, rows), block=block, shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_ids_and_empty_table(spark):
    df = frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, ""), (2, "A B c d\ne")])
    got = sorted(((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_dedup(df).collect()))
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "None", True)]
    assert near_dedup.near_dedup(df.limit(0)).count() == 0
    assert near_dedup.keep_representatives(df.where("doc_id is not null")).columns == df.columns


def rows_of(rows, k=5):
    """doc_id, component_id and kept of each row by the docstring: documents are ids, and texts of rows without one."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] if rows[i][0] is not None else rows[j][0] is None and sets[i] and (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, t) in enumerate(rows):
        mine = [j for j in range(len(rows)) if find(j) == find(i)]
        first = min((rows[j][0] for j in mine if rows[j][0] is not None), default=None)
        sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
        kept = doc == first if doc is not None else len(mine) == 1 or first is None and sha(t) == min(sha(rows[j][1]) for j in mine)
        out.append((str(doc), t, str(first), kept))
    return out


@pytest.mark.parametrize("layout", [0, 1, 2])
def test_near_of_repeated_and_missing_ids(spark, layout):
    """Ids with several texts, near copies of either, and rows without an id, in three orders and partitionings."""
    rng = random.Random(layout)
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda t: t + " more"
    T, U, V, W, X, Y = (text(c) for c in "tuvwxy")
    rows = [(5, T), (7, near(T)), (7, U), (9, near(U)), (11, near(V)), (None, V), (None, W), (None, near(W)), (None, X), (None, X), (20, near(near(near(X)))), (None, Y), (None, near(Y)), (None, near(near(Y))), (30, ""), (30, T + " extra"), (None, ""), (None, None), (40, "alone here"), (50, W.upper() + " x")]
    rows = [r for r in rows if r[0] != 50] if layout == 1 else rows
    rows = rows[::-1] if layout == 2 else rng.sample(rows, len(rows))
    df = frame(spark, rows, (1, 4, 7)[layout])
    want = rows_of(rows)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_dedup(df).collect()) == sorted((a, c, d) for a, _, c, d in want)
    stay = near_dedup.keep_representatives(df)
    assert sorted((str(r.doc_id), r.text or "") for r in stay.collect()) == sorted((a, t or "") for a, t, _, kept in want if kept) and stay.columns == df.columns


def test_least_matches_gives_up_only_unlikely_pairs():
    least = near_dedup.least_matches(80, 1e-5)
    assert least == sorted(least) and 0 < least[0] < 32 * 0.8 and least[-1] < 128 * 0.8


def test_five_words_are_the_default(spark):
    """One word changed in forty: near copies by four words, not by five."""
    w = [f"w{i}" for i in range(39)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:19], "other", *w[20:]]))]
    linked = {k: components(rows, k)[2][1] == 1 for k in (4, 5)}
    assert linked == {4: True, 5: False}
    got = {k: near_dedup.near_dedup(frame(spark, rows), **({"shingle": 4} if k == 4 else {})).where("kept").count() for k in (4, 5)}
    assert got == {4: 1, 5: 2}


def test_near_largest_id_beside_rows_without_one(spark):
    big = (1 << 63) - 1
    df = frame(spark, [(big, "a b c d e f"), (None, "g h i j k l"), (None, ""), (5, "m n o p q r")])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_dedup(df).collect())
    assert got == [("5", "5", True), (str(big), str(big), True), ("None", "None", True), ("None", "None", True)]


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_with_other_columns(spark, parts):
    """One of the rows that repeat an id and its text stays, the same in any layout; other columns go with it."""
    rows = [(1, "a b", "x", "1"), (1, "a  b", "y", "2"), (2, "c", "z", "3"), (3, "c", "w", "4"), (None, "d", "p", "5"), (None, "d", "q", "6"), (4, "e", "r", "7"), (4, "f", "s", "8")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(map(tuple, exact_dedup.keep_distinct(df).collect()), key=repr)
    assert len(got) == 5 and set(got) <= set(rows) and {(r[0], norm(r[1])) for r in got} == {(1, "a b"), (2, "c"), (None, "d"), (4, "e"), (4, "f")}
    again = sorted(map(tuple, exact_dedup.keep_distinct(spark.createDataFrame(rows[::-1], SCHEMA)).collect()), key=repr)
    assert again == got


def test_without(spark, tmp_path):
    from weft.llm.common import staged, without

    docs = spark.range(300).selectExpr("id as doc_id", "cast(id as string) as text", "id as __x").union(spark.createDataFrame([(None, "n", 1)], "doc_id long, text string, __x long"))
    gone = staged(spark.range(0, 300, 7).selectExpr("id as __id"), str(tmp_path / "gone"))
    got = without(docs, gone, "doc_id")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted([(False, i) for i in range(300) if i % 7] + [(True, 0)])
    assert without(docs, gone.limit(0), "doc_id").count() == 301


def test_filters_are_sized_from_the_input(spark, tmp_path):
    df = frame(spark, [(i, f"a line of its own, number {i}\na line that all of them have") for i in range(50)])
    df.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert line_dedup.filter_bits_for(stored) == line_dedup.FEWEST_BITS
    assert sum(r.n_dropped for r in line_dedup.line_dedup(stored).collect()) == 49


def test_cutting_words_takes_little_more_than_the_text():
    import tracemalloc

    import pyarrow as pa

    from weft.llm import words

    texts = pa.array(["internationalisation of documentation\t" * 100] * 1000, pa.large_string())
    size = texts.nbytes
    tracemalloc.start()
    words._words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * size  # 20 times when each byte had an index


def test_workers_get_few_texts_at_once_and_give_memory_back(spark, tmp_path):
    import pyarrow as pa

    from weft.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 5500, 1, 1).mapInArrow(common.lean(count), "n long")
    with common.small_batches(spark):
        got = [r.n for r in common.staged(rows, str(tmp_path / "n")).collect()]
    assert sum(got) == 5500 and max(got) <= common.TEXTS and spark.conf.get(key) == own

    code = """
import re

import pyarrow as pa
from weft.llm import common

def used():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def fill(batches):
    for b in batches:
        kept = [[str(i) + "x" * 100 for i in range(1000)] for _ in range(600)]
        last = kept[-1][-1]
        del kept
        yield b

given = [pa.RecordBatch.from_arrays([pa.array([i])], names=["i"]) for i in range(3)]
before = used()
assert len(list(common.lean(fill)(iter(given)))) == 3
print(used() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) < 20, out.stdout + out.stderr
