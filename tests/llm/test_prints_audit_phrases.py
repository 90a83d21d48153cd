"""Order MinHash, the filter audit and phrases against plain versions, and on odd tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, n int, mask int, place int, phrase string, rank string"
rng = random.Random(5)
VOCABULARY = ["Alpha", "beta", "ÉTÉ", "été", "gamma", "DELTA", "x", "", "naïve", "日本", "a&b", "omega"]


def sentence(n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", "\t", "\n", ". ", ", ", " ", "\x0b", "!"]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 2, 3, "z", "y") for i, t, g in rows], DOCS)


def odd_rows():
    texts = [None, "", "a", "tiny", "ab" * 3000, sentence(900)] + [sentence(rng.randrange(60)) for _ in range(60)]
    rows = [(i * 3, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]
    return rows + [(0, "x", "en"), (6, texts[9], "en"), (200, texts[9], "de"), (201, texts[9], "en"), (None, texts[9], "en"), (None, None, None), rows[5], rows[5]]


# order MinHash


def plain_print(text, k, least):
    from weft.llm import order_minhash as M

    size, seen, members = min(k, len(text)), Counter(), []
    for i in range(len(text) - size + 1 if text else 0):
        h = int(M.kmers(M.code_points(text[i : i + size]), size)[0])
        members.append(int(M.mixed(np.array([h], np.uint64) + M.mixed(np.array([seen[h] + 1], np.uint64)))[0]))
        seen[h] += 1
    out = []
    for f in M._FACTOR.tolist():
        chosen = sorted(sorted(range(len(members)), key=lambda i: ((members[i] >> 32) * f % 2**32, i))[:least])
        t = np.array([least], np.uint64)
        for i in chosen:
            t = M.mixed(t * np.uint64(5) + np.uint64(members[i]))
        out.append(int(t[0]) >> 48)
    return out


@pytest.mark.parametrize("k,least", [(10, 2), (3, 3)])
def test_fingerprints_are_those_of_a_plain_version(k, least, monkeypatch):
    from weft.llm import order_minhash as M

    monkeypatch.setattr(M, "COLUMNS", 64)
    monkeypatch.setattr(M, "AT_ONCE", 300)
    texts = ["", "a", "ab", "abc" * 70, "x" * 200] + [sentence(rng.randrange(40)) for _ in range(12)]
    assert M.text_fingerprints(texts, k, least).tolist() == [plain_print(t, k, least) for t in texts]


def test_likeness_falls_with_edits_and_with_order():
    from weft.llm import order_minhash as M

    near = lambda a, b: float((M.text_fingerprints([a]) == M.text_fingerprints([b])).mean())
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
    one, half = text[:900] + "#" + text[901:], text[:1000] + "".join(rng.choice("klmno") for _ in range(1099))
    swapped = text[1050:] + text[:1050]
    assert near(text, text) == 1 and near("", "") == 1 and near("", text) == 0
    assert near(text, one) > 0.9 > 0.75 > near(text, swapped) > near(text, half) > 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_each_document_meets_the_next(spark, partitions):
    from weft.llm import order_minhash as M

    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.doc_id: r for r in M.fingerprints(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort(reverse=True)
    assert len(got) == len(rows)
    for (i, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        prints = [x.astype("<u2").tobytes().hex() for x in M.text_fingerprints([text, changed, after])]
        share = lambda a, b: sum(a[j : j + 4] == b[j : j + 4] for j in range(0, len(a), 4)) / (len(a) // 4)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), *prints[:2])
        assert (r.near_edited, r.near_next) == (share(prints[0], prints[1]), share(prints[0], prints[2]))


def test_fingerprints_of_odd_tables(spark):
    from weft.llm import order_minhash as M

    assert M.fingerprints(frame(spark, [])).count() == 0
    alone = M.fingerprints(frame(spark, [(4, "a single document", "en")])).first()
    assert alone.near_edited < 1 == alone.near_next
    rows = odd_rows()
    got = M.fingerprints(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.n_chars), r.fingerprint)
    assert of[200, len(rows[9][1])] == of[201, len(rows[9][1])] == of[None, len(rows[9][1])]


# filter audit


def plain_audit(rows, labels):
    said = {}
    for i, q, t in labels:
        if i is not None:
            a, b = said.get(i, (0, 0))
            said[i] = max(a, int(q == 1)), max(b, int(t == 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, g in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(w) < 100 else "") + ("B" if 100 * len(set(w)) < 80 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else "") + ("D" if re.search("[#$%&*|]", t) else "")
        fails.append((g or "", f + ("E" if i is not None and first[t] < i else ""), *said.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in mine if f in x[0] and not before & set(x[0])]
                out[part, order, step] = (sum(not set(order[:step]) & set(x[0]) for x in mine), len(here), sum(f in x[0] and bool(before & set(x[0])) for x in mine), sum(x[0] == f for x in mine), sum(x[1] for x in here), sum(x[2] for x in here))
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_that_of_a_plain_version(spark):
    from weft.llm.filter_audit import filter_audit

    rows = odd_rows() + [(300 + i, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(400)) for _ in range(rng.randrange(90, 140))), "en") for i in range(30)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 330, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (None, 1, 1)]
    got = filter_audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(frame(spark, []), none).count() == 0
    assert filter_audit(frame(spark, [(1, None, None)]), none).agg({"removed": "sum"}).first()[0] == 120


def test_words_that_share_a_hash_are_verified(monkeypatch):
    from weft.llm import filter_audit as A

    texts = ["ab cd ab ef cd abcdefghi abcdefghj abcdefghi", "", " one ", "a\x00 a a\x00 a", "long" * 9 + " " + "long" * 9 + " " + "lonG" * 9]
    want = [len(set(re.findall(r"[^\x20\x09-\x0D]+", t))) for t in texts]
    assert A.scan(pa.array(texts, pa.large_string()))["n_distinct"].tolist() == want
    monkeypatch.setattr(A, "mixed", lambda x: x & np.uint64(1))
    assert A.scan(pa.array(texts, pa.large_string()))["n_distinct"].tolist() == want


# phrases


def plain_counts(rows):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return n, f


def plain_phrases(rows, least, most):
    n, f = plain_counts(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(len(v) > len(w) and other == lang and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (other, v), b in cand.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranked = []
    for lang in {x[0] for x in out}:
        for rank, x in enumerate(sorted(x for x in out if x[0] == lang)[:most], 1):
            ranked.append((lang, rank, x[3].decode(), -x[2], x[4], x[5], n[lang], -x[1]))
    return sorted(ranked)


@pytest.mark.parametrize("bits,shard,rows_at_once", [(None, None, None), (64, 300, 5)])
def test_phrases_are_those_of_a_plain_version(spark, monkeypatch, bits, shard, rows_at_once):
    """With small bounds too: shards of a text, a filter that lets all through, runs of a few words."""
    from weft.llm import phrases as P

    rows = odd_rows() + [(i, rng.choice(["so it GOES on and on", "So it goes. On", "it goes on;on"]), rng.choice(["en", "de"])) for i in range(400, 480)]
    if bits:  # in this process: workers do not see what is set here
        for name, v in (("SHARD", shard), ("AT_ONCE", rows_at_once)):
            monkeypatch.setattr(P, name, v)
        batch = pa.RecordBatch.from_arrays([pa.array(["und" if g is None else g for _, _, g in rows]), pa.array([t or "" for _, t, _ in rows])], names=["lang", "text"])
        every, some = P.Filter(bits, np.full(1, ~np.uint64(0))), Counter()
        for s in P.shards([batch]):
            h = s.hashes()
            s.build(every.holds(h))
            for found in (s.phrases(h, None, 2), s.phrases(h, every, 4)):
                for phrases, n in found:
                    for lang, phrase, k in zip(*[x.to_pylist() for x in s.spelled(phrases)], n.tolist(), strict=True):
                        some[lang, tuple(phrase.split(" "))] += k
        assert some == Counter({p: a for p, a in plain_counts(rows)[1].items() if len(p[1]) > 1})
        return
    got = P.collocations(frame(spark, rows), least=6, most=9).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 6, 9)
    assert P.collocations(frame(spark, [])).count() == 0 and P.collocations(frame(spark, rows[:4])).count() == 0


def test_bits_carry_over_blocks():
    from weft.llm import phrases as P

    text = " ".join(["a b"] * 100 + ["a"] * 70)
    s = P.Shard(pa.array(["en"]), pa.array([text], pa.large_string()))
    s.build(np.ones(2, bool))
    found = Counter()
    for phrases, n in s.phrases(np.zeros(2, np.uint64), None, 4):
        found.update(dict(zip(s.spelled(phrases)[1].to_pylist(), n.tolist(), strict=True)))
    w = text.split()
    assert found == Counter(" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
