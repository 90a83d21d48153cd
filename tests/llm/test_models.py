"""Classifier, neighbours, language model and archives: held-out accuracy, brute force, round trips."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import ann, lm, quality, warc


def labelled(n=400):
    rng = random.Random(7)
    good = [f"{a}{b}ing" for a in ("th", "st", "br", "cl", "pr") for b in "aeiou"]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        w = [rng.choice(good) for _ in range(60)] if y else [rng.choice(["buy", "now", "!!!", "$$$", "click", "HERE"]) for _ in range(60)]
        docs.append((i, " ".join(w) if i % 61 else None))
        labels.append((i, y, 0))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled()
    d = spark.createDataFrame([(i, t, 9.0) for i, t in docs], "doc_id long, text string, score double")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(d, la).collect()}
    truth = {i: y for i, y, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and dict(docs)[i]]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    kept = quality.keep_good(d, la)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_without_usable_labels(spark):
    d = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(d, one).collect()} == {1.0}
    assert quality.score_quality(d.limit(0), one).count() == 0


def brute(rows, k=5, every=50):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in x:
        if q % every == 0:
            s = sorted((-(x[q] @ v) / (np.linalg.norm(x[q]) * np.linalg.norm(v)), i) for i, v in x.items() if i != q)
            out[q] = s[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(40)]  # one vector many times
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [float("nan")] * 8), (3150, [1.0] * 7 + [None]), (3200, []), (None, [1.0] * 8), (3250, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(df, sample=600, leaf=24).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in rs}
        assert [(-round(r.score, 9), r.vec_id) for r in rs] == sorted((-round(r.score, 9), r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & {i for _, i in want[q]})
    assert hits >= 0.9 * 5 * len(want)
    assert [r.vec_id for r in sorted(got[50], key=lambda r: r.rank)] == [2000, 2001, 2002, 2003, 2004]


def test_neighbours_of_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], kind)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0])], kind)).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(2, 1.0), (1, 0.0)]


def test_neighbours_of_very_large_and_very_small_components(spark):
    from fractions import Fraction

    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    base[7] = base[3] * 2
    size = [1e200, 1.0, 1e-200, 1e-310, 5e-324 * 2**20, 1e308 / 4]
    rows = [(i, (base[i] * size[i % 6]).tolist()) for i in range(40)] + [(50, [5e-324] + [0.0] * 5), (51, [1e308] + [0.0] * 5), (100, [1e200, 1e-200] + [0.0] * 4), (150, [1.7e308] * 6), (151, [-1.7e308] * 6)]

    def cosine(a, b):
        x, y = ([Fraction(c) / max(map(abs, map(Fraction, v))) for c in v] for v in (a, b))
        dot, n = sum(p * q for p, q in zip(x, y, strict=True)), sum(p * p for p in x) * sum(q * q for q in y)
        return float(dot) / math.sqrt(n)

    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = dict(rows)
    assert set(got) == {0, 50, 100, 150}
    for q, found in got.items():
        found.sort()
        scores = [s for _, _, s in found]
        assert scores == sorted(scores, reverse=True) and all(math.isfinite(s) for s in scores)
        want = sorted((-round(cosine(vectors[q], v), 9), i) for i, v in rows if i != q)[:5]
        assert [(-round(s, 9), i) for _, i, s in found] == want


@pytest.mark.parametrize("tokens", [1 << 20, 300])
def test_language_model(spark, monkeypatch, tokens):
    if tokens == 300:
        monkeypatch.setattr(lm, "SHARD_KEYS", 500)
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(40)}" for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(200):
        w = ["w0"]
        for _ in range(rng.randrange(1, 60)):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    rows += [(300, None), (301, ""), (302, "never seen words"), (303, "w0 " * 40_000)]
    got = lm.score_texts(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3), block_tokens=tokens).collect()
    texts = {i: [*(t or "").lower().split(), "\0"] for i, t in rows}
    c = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) and r.score < 0
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)  # a Markov chain is what pairs can learn


def test_language_model_odd_tables(spark):
    kind = "doc_id long, text string"
    assert lm.score_texts(spark.createDataFrame([], kind)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score_texts(spark.createDataFrame([(held, "a b")], kind)).first()
    assert (r.train_tokens, r.base_score, r.score, r.n_known) == (0, 0.0, 0.0, 0)
    two = lm.score_texts(spark.createDataFrame([(None, "a"), (None, "b"), (7, "a"), (7, "a")], kind)).collect()
    assert len(two) == 4


def test_seatings_follow_the_restaurant_process():
    """Tables of c customers of one dish that is certain: their mean is known for a process of one dish."""
    rng = np.random.default_rng(0)
    c, n, d, s = 12, 4000, 0.5, 1.0
    t, _ = lm.seat(np.full(n, c), np.ones(n), np.zeros(n), d, s, rng)
    mean = 1.0
    for i in range(1, c):
        mean += (s + d * mean) / (s + i)
    assert abs(t.mean() - mean) < 0.1
    big, _ = lm.seat(np.array([100_000]), np.ones(1), np.zeros(1), d, s, rng)
    assert 100 < big[0] < 3000


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_warc(spark, tmp_path, chunk):
    pages = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/\r\n3", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "x" * 200_000), (7, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id long, url string, html string, record_type string").repartition(3)
    m = warc.write_warc(df, str(tmp_path / "w"), chunk=chunk)
    got = {r.page_id: r for r in warc.read_chunks(m, chunk).where("is_last").collect()}
    body = {i: (h or "").encode() for i, _, h in pages}
    for i, r in got.items():
        same = [j for j in body if body[j] == body[i]]
        last = max(same, key=lambda j: (j is not None, j or 0))
        assert r.bytes_so_far == len(body[i]) and r.sha1_so_far == base64.b32encode(hashlib.sha1(body[i]).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
    chunks = warc.read_chunks(m, chunk).where("record_type = 'response'").orderBy("page_id", "chunk_no").collect()
    for i in (5, 6, 7):
        mine = [r for r in chunks if r.page_id == i]
        assert b"".join(bytes(r.chunk) for r in mine) == body[i] and [r.chunk_no for r in mine] == list(range(len(mine)))
        so_far = hashlib.sha1()
        for r in mine:
            so_far.update(bytes(r.chunk))
            assert r.sha1_so_far == base64.b32encode(so_far.digest()).decode() and len(r.chunk) <= chunk
    with gzip.open(m.first().file.removeprefix("file://")) as f:
        assert f.read(8) == b"WARC/1.1"
    assert warc.archive_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_warc_repeated_ids(spark, parts):
    """Records are decided one by one: ids that repeat, with equal and with other payloads, in short and long records."""
    long = "y" * 50_000
    pages = [(5, "same"), (5, "other"), (7, "same"), (8, "other"), (9, "z"), (9, "z"), (9, "z"), (3, long), (3, long), (4, long), (None, "z"), (None, "lone"), (None, "lone"), (2, None), (2, "")]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(parts)
    got = warc.archive_and_read(df, chunk=1000).collect()
    assert len(got) == len(pages)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == Counter((i, digest(h), len(h or "")) for i, h in pages)
    for h in {h or "" for _, h in pages}:
        mine = [r for r in got if r.payload_digest == digest(h)]
        top = max((r.page_id for r in mine), key=lambda i: (i is not None, i or 0))
        whole = [r for r in mine if r.record_type == "response"]
        assert [r.page_id for r in whole] == [top] and whole[0].refers_to is None
        assert all(r.refers_to == top for r in mine if r.record_type == "revisit")
    least = warc.archive_and_read(df, chunk=1000, least_bytes=5).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes < 5) and sum(r.record_type == "revisit" for r in least) == 3


def test_warc_chunk_table_streams(spark, tmp_path):
    """No chunk row is longer than a chunk; digests are those of all chunks so far."""
    body = "".join(chr(97 + i % 26) for i in range(10_001))
    df = spark.createDataFrame([(1, "u", body), (2, "v", body[:1000])], "page_id long, url string, html string").coalesce(1)
    rows = warc.chunk_table(df, str(tmp_path / "c"), chunk=1000).orderBy("rid", "chunk_no").collect()
    mine = [r for r in rows if r.page_id == 1]
    assert [r.chunk_no for r in mine] == list(range(11)) and [r.is_last for r in mine] == [False] * 10 + [True]
    assert b"".join(bytes(r.chunk) for r in mine) == body.encode() and max(len(r.chunk) for r in rows) == 1000
    assert bytes(mine[4].sha1_so_far) == hashlib.sha1(body[:5000].encode()).digest() and mine[4].bytes_so_far == 5000
    assert [(r.url, bytes(r.sha256)) for r in rows if r.page_id == 2] == [("v", hashlib.sha256(body[:1000].encode()).digest())]


def test_quality_does_not_depend_on_the_layout(spark):
    docs, labels = labelled(200)
    docs = [*docs, (3, "a text that repeats an id"), (4, "x " * 100_000)]
    labels = [*labels, *((i, 1 - y, 0) for i, y, _ in labels[:20])]  # clashing labels: the smaller counts
    d = spark.createDataFrame(docs, "doc_id long, text string")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [sorted((r.doc_id, r.score) for r in quality.score_quality(x, y).collect()) for x, y in ((d.repartition(1), la), (d.repartition(5), la.orderBy(F.desc("doc_id"))))]
    assert got[0] == got[1] and len(got[0]) == len(docs)


def test_the_difference_alone_scores():
    """Text like the good dictionary's packs smaller with it, so its difference and its score are larger."""
    docs, labels = labelled(300)
    texts = [(t or "").encode() for _, t in docs]
    m = quality.fit(texts, [y for _, y, _ in labels], 0.7)
    assert len(m.weights) == 2 and m.weights[1] > 0
    measure, score = quality._measure(m.good, m.bad), m.scorer()
    x = [measure(t) for t in texts]
    order = np.argsort(x)
    assert (np.diff(score([texts[i] for i in order])) >= 0).all() and measure(b"") == 0.0


def test_neighbours_that_tie(spark):
    """Multiples of one vector all tie, and the smallest ids come, whatever the order of the rows."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=6).astype(np.float32)
    rows = [(i, (base * f).tolist()) for i, f in zip(range(60), rng.permutation([0.5 + 0.25 * j for j in range(60)]), strict=True)]
    rows += [(60 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").coalesce(2)
        got = {}
        for r in ann.nearest(df, sample=100, leaf=20).collect():
            got.setdefault(r.query_id, []).append(r)
        assert [r.vec_id for r in sorted(got[0], key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
        assert [r.vec_id for r in sorted(got[50], key=lambda r: r.rank)] == [0, 1, 2, 3, 4]
        assert all(0.9 <= r.calibrated_recall <= 1 for x in got.values() for r in x)


def test_gaps_are_drawn_as_single_customers_are(monkeypatch):
    """Tables of many equal dishes have the same mean and spread whether customers sit down one by one or by gaps."""
    n, c = 3000, 400
    args = (np.full(n, c), np.full(n, 0.3), np.full(n, 20.0), 0.6, 1.0)
    monkeypatch.setattr(lm, "SINGLY", 1000)
    one, z1 = lm.seat(*args, np.random.default_rng(5))
    monkeypatch.setattr(lm, "SINGLY", 32)
    gaps, z2 = lm.seat(*args, np.random.default_rng(6))
    assert abs(one.mean() - gaps.mean()) < 5 * one.std() / math.sqrt(n / 2) and abs(one.std() / gaps.std() - 1) < 0.1
    assert abs(z1.mean() - z2.mean()) < 5 * z1.std() / math.sqrt(n / 2) + 1e-6
    assert abs(float(lm._log_gamma(np.array(30.5))) - math.lgamma(30.5)) < 1e-9


@pytest.mark.parametrize("direct", [64, 2])
def test_gibbs_follows_the_exact_posterior(monkeypatch, direct):
    """Joint numbers of tables of a restaurant's dishes against the enumerated posterior; seatings of large dishes as well."""
    monkeypatch.setattr(lm, "DIRECT", direct)
    c, p, d, s, n = np.array([3, 9, 1, 5]), np.array([0.2, 0.05, 0.5, 0.25]), 0.6, 1.5, 1500
    log_s = lm._stirling(d, 64)
    weight = {}
    for t in itertools.product(*(range(1, x + 1) for x in c)):
        seats = sum(math.log(s + d * i) for i in range(1, sum(t)))
        weight[t] = math.exp(seats + sum(k * math.log(q) + log_s[x, k] for k, q, x in zip(t, p, c, strict=True)))
    total = sum(weight.values())
    # n restaurants alike, in one call: dish by dish and jointly
    got = lm.gibbs(np.tile(c, n), np.tile(p, n), np.repeat(np.arange(n), 4), n, d, s, np.random.default_rng(3), burn_in=30, samples=20)
    t = np.concatenate([x.reshape(n, 4) for x in got])
    keys = np.array(list(weight))
    w = np.array(list(weight.values())) / total
    assert np.allclose(t.mean(axis=0), w @ keys, rtol=0.03)
    assert np.allclose(np.cov(t.T), np.cov(keys.T, aweights=w, ddof=0), atol=0.06)


def test_burn_in_leaves_the_start():
    """The first sample kept is no nearer to the start, one table a dish, than those of a long run."""
    c, p, where = np.full(300 * 40, 60), np.full(300 * 40, 0.3), np.repeat(np.arange(300), 40)
    first = lm.gibbs(c, p, where, 300, 0.75, 1.0, np.random.default_rng(1))
    long = lm.gibbs(c, p, where, 300, 0.75, 1.0, np.random.default_rng(2), burn_in=30, samples=10)
    assert len(first) == lm.SAMPLES
    assert all(abs(x.mean() / np.mean(long) - 1) < 2e-3 for x in first)


def test_stirling_numbers_and_normalisers():
    """Numbers against all seatings of four customers; normalisers of a seating recomputed from its openings."""
    d, s = 0.3, lm._stirling(0.3, 64)
    w = Counter()
    for opens in itertools.product([0, 1], repeat=3):
        t, x = 1, 1.0
        for i, o in enumerate(opens, 1):
            x *= 1 if o else i - d * t
            t += o
        w[t] += x
    assert np.allclose(np.exp(s[4, 1:5]), [w[t] for t in range(1, 5)])
    c, new, opened = np.array([50_000, 700, 90]), np.array([3.0, 40.0, 1e-3]), []
    t, z = lm.seat(c, np.ones(3), np.zeros(3), 0.75, new, np.random.default_rng(1), step=0.0, opened=opened)
    opened = tuple(np.concatenate(x) for x in zip(*opened, strict=True))
    assert (np.bincount(opened[0], minlength=3) + 1 == t).all()
    assert np.allclose(lm._normalisers(opened, c, new, 0.75), z)


def test_words_that_share_half_a_hash():
    from weft.llm.words import distinct

    high, low = np.array([1, 2, 1, 3, 1], np.uint64), np.array([7, 7, 7, 5, 9], np.uint64)
    h, w, back = distinct(high, low)
    assert (h[back] == high).all() and (w[back] == low).all() and len(h) == 4
