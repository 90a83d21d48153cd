"""Token files, packing and mixing: round trips, exact counts, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weft.llm import mixing, packing, token_store, tokens

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, " ", "  a  b ", "a\n \nb   c", "it's DON'T x's", "<|endoftext|> hi", "日本語 テキスト　x", "é É x, y.", "\t\tx\r\n y 12 3,4", "ẞ ß İ Σς", "a\x1cb \x1d c", "word.\nNext  line", "...", " .", "\n", "x\n\n  y", "é a", "word, " * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    e, fresh = tokens.Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    for _ in range(2):  # the second time from memory
        ids, at = e.encode(pa.array(TEXTS))
        want = [fresh.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    e.kind = "plain"
    assert e.encode(pa.array(TEXTS))[0].tolist() == ids.tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("lean", [False, True])
def test_encoder_equals_the_library_on_added_tokens_and_random_unicode(name, lean):
    rng = random.Random(len(name))
    path = P.path(name)
    fresh, e = Tokenizer.from_file(path), tokens.Encoder(path, lean)
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    texts = [f"{a}{t}{b}" for t in [*added, "<|EndOfText|>", "<|endoftext", "|>"] for a in ("", "a ", "a", "x.\n", " ") for b in ("", " b", "b", "  ", t)]
    ranges = [(32, 127), (9, 14), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F650), (0, 0xD800)]
    for _ in range(1500):
        kinds = rng.choices(ranges, k=rng.randrange(1, 4))
        texts.append("".join(chr(rng.randrange(*rng.choice(kinds))) if rng.random() < 0.8 else " " for _ in range(rng.randrange(40))))
    texts += ["".join(rng.sample(texts, 5)) for _ in range(40)]
    ids, at = e.encode(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)


def test_token_files(spark, tmp_path):
    rows = [(3 * i + 1, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (4, "again")]
    m = token_store.write_tokens(frame(spark, rows), P.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    got = token_store.read_tokens(m, with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        options = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows if i == r.doc_id]
        assert bytes(r.ids) in options and (r.start, r.ids_crc32) == (at, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    file = next(r.file for r in m.collect() if r.first_id == 1 or r.first_null)
    some = token_store.read_documents(file, [1])
    assert some[1].tolist() == [2]
    assert token_store.read_tokens(token_store.write_tokens(frame(spark, rows).limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "e"))).count() == 0


def test_damaged_frame_is_noticed(tmp_path):
    path = tmp_path / "x.tok"
    with open(path, "wb") as f:
        w = token_store.Writer(f, False)
        for i in range(3):
            w.add(i, np.arange(500, dtype=np.uint32) * (i + 1) % 999)
        w.close()
    raw = bytearray(path.read_bytes())
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert len(whole) == 3000  # any reader can decompress the file
    assert token_store.read_documents(str(path), [2])[2][1] == 3
    raw[len(raw) - 9 - 12 + 8] ^= 1  # the last frame's checksum
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        token_store.read_documents(str(path), [2])
    assert len(token_store.read_documents(str(path), [0, 1])) == 2


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 40), (3, 3000)])
def test_solve_covers_the_histogram(seed, n):
    rng = random.Random(seed)
    h = Counter(min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(n))
    plan = packing.solve(h, 256, 200)
    used = Counter()
    for config, k in plan:
        assert sum(config) <= 256 and k > 0
        for x in config:
            used[x] += k
    assert used == +h
    least = math.ceil(sum(a * b for a, b in h.items()) / 256)
    ffd = []
    for x in sorted(h.elements(), reverse=True):
        i = next((i for i, r in enumerate(ffd) if r >= x), None)
        ffd.append(256 - x) if i is None else ffd.__setitem__(i, ffd[i] - x)
    assert least <= sum(k for _, k in plan) <= len(ffd) + 2


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "x"), (50, "one two three " * 60)]
    got = packing.pack(frame(spark, rows), P.path("word_bpe_49k.json"), capacity=64, with_ids=True).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = Counter(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 <= 64 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start == 64 * r.piece
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    parts = Counter()
    for doc_id, ps in by_doc.items():
        if doc_id != 7:
            parts[b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.piece))] += 1
    parts[np.array([*tok.encode(TEXTS[7], add_special_tokens=False).ids, 1], "<u4").tobytes()] += 2
    assert parts == whole
    assert packing.pack(frame(spark, rows).limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [10_000, 400_000])
def test_the_program_places_nearly_all_pieces(monkeypatch, n):
    rng = np.random.Generator(np.random.PCG64(n))
    lengths = np.minimum(4096, rng.lognormal(6, 1.3, n).astype(np.int64) + 1)
    rest, best_fit = [], packing._best_fit

    def seen(left, capacity):
        rest.append(int(left.sum()))
        return best_fit(left, capacity)

    monkeypatch.setattr(packing, "_best_fit", seen)
    plan = packing.solve(dict(Counter(lengths.tolist())))
    used = Counter()
    for config, k in plan:
        assert sum(config) <= 4096
        for x in config:
            used[x] += k
    assert used == Counter(lengths.tolist())
    assert rest[0] <= 0.02 * n
    assert sum(k for _, k in plan) <= 1.005 * lengths.sum() / 4096 + 1


def _fewest(pieces, capacity):
    """The fewest sequences, by trying all ways."""
    best = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[i]}:
            j = rooms.index(room)
            place(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_small_histograms_against_brute_force(seed):
    rng = random.Random(seed)
    pieces = [rng.randrange(5, 16) for _ in range(9)] if seed % 2 else [x for _ in range(3) for a in [rng.randrange(6, 9)] for b in [rng.randrange(6, 9)] for x in (a, b, 20 - a - b)]
    plan, report = packing.solve_with_report(Counter(pieces), 20)
    fewest = _fewest(pieces, 20)
    assert report["least"] <= fewest <= report["sequences"] <= fewest + 1
    assert Counter(x for config, k in plan for x in config for _ in range(k)) == Counter(pieces)


def test_rounding_needs_no_more_than_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(25):
        capacity = int(rng.integers(20, 300))
        h = {int(n): int(k) for n, k in zip(rng.integers(1, capacity + 1, 30), rng.integers(1, 60, 30), strict=True)}
        left = np.zeros(capacity + 1, np.int64)
        for n, k in h.items():
            left[n] = k
        plan, report = packing.solve_with_report(h, capacity)
        used = Counter()
        for config, k in plan:
            assert sum(config) <= capacity and k > 0
            for n in config:
                used[n] += k
        assert used == Counter(h) and report["least"] <= report["sequences"] <= sum(packing._best_fit(left, capacity).values())


@pytest.mark.parametrize("capacity,n", [(256, 500), (1000, 2000)])
def test_the_program_beats_best_fit_on_triples(capacity, n):
    """Pieces that fill sequences in threes only: longest-first best fit wastes a tenth, the program all but nothing."""
    rng = random.Random(capacity)
    h = Counter()
    for _ in range(n):
        a, b = (rng.randrange(capacity // 4 + 1, capacity // 2) for _ in "ab")
        if capacity // 4 < capacity - a - b < capacity // 2:
            h.update((a, b, capacity - a - b))
    least = sum(a * k for a, k in h.items()) // capacity
    left = np.zeros(capacity + 1, np.int64)
    for x, k in h.items():
        left[x] = k
    assert sum(packing._best_fit(left, capacity).values()) > 1.08 * least
    report = packing.solve_with_report(h, capacity)[1]
    assert report["least"] == least and report["sequences"] <= 1.01 * least + 1 and report["by_program"] > 0.95


def test_prices_prove_more_than_volume():
    """Pieces just over half fill a sequence each, whatever their volume."""
    report = packing.solve_with_report({51: 70}, 100)[1]
    assert report["sequences"] == report["least"] == 70 and report["gap"] == 0


def source_rows(n=900):
    rng = random.Random(5)
    out = []
    for i in range(n):
        s = rng.choice(["hot", "hot", "hot", "b", "c", "é", None])
        out.append((i, None if i % 97 == 0 else " ".join(["w"] * rng.randrange(60)), s))
    return out


def waterfill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        weight = sum(w[s] for s in open_)
        target = {s: 2.0 * sizes[s] if s in full else rest * w[s] / weight for s in names}
        new = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not new:
            return target
        full |= new


def test_mixing(spark):
    rows = source_rows()
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mixing_report(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixing_report(df.repartition(2)).collect()))  # reruns agree
    sizes, words, src = Counter(), {}, {i: s for i, _, s in rows}
    for i, t, s in rows:
        words[i] = len((t or "").split())
        sizes[s] += words[i]
    target, taken = waterfill(sizes), Counter()
    shards = Counter()
    for r in got:
        s = src[r.doc_id]
        assert (r["size"], r.source_size) == (words[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s])
        assert r.taken == r["size"] * len(r.shards) <= 2 * r["size"]
        taken[s] += r.taken
        shards.update(r.shards)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 30
    assert len(shards) == 16
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: len(r.shards) for r in got if r.shards})


def test_mixing_odd_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mixing_report(spark.createDataFrame([], kind)).count() == 0
    got = mixing.mixing_report(spark.createDataFrame([(1, None, None), (2, "", "a")], kind)).collect()
    assert all((r["size"], r.target, r.taken) == (0, 0.0, 0) for r in got)
    got = mixing.mixing_report(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], kind)).collect()
    assert len(got) == 3


def test_hypergeometric_draws_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(x).cast("long")
    df = spark.range(4000).select(mixing._hypergeometric(lit(30), lit(50), lit(20), mixing._uniform(F.col("id"))).alias("k"))
    seen = Counter(r.k for r in df.collect())
    for k in range(21):
        p = math.comb(30, k) * math.comb(50, 20 - k) / math.comb(80, 20)
        assert abs(seen[k] - 4000 * p) < 5 * math.sqrt(4000 * p * (1 - p)) + 3


def test_tree_splits_exactly(spark, tmp_path):
    q = [100, 0, 7, 33]
    df = spark.createDataFrame([(0, q)], "node long, q array<long>")
    leaves = mixing.split_tree(df, 3, str(tmp_path / "tree")).collect()
    assert len(leaves) == 8 and [sum(x) for x in zip(*(r.q for r in leaves), strict=True)] == q
    assert {sum(r.q) for r in leaves} <= {17, 18}


def test_mixing_with_many_shards(spark):
    """More shards than blocks: blocks are cut into cells, quotas stay those of the blocks, and every shard gets its part."""
    rows = [(i, "w " * (i % 9), "ab"[i % 7 > 4]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few, many = (mixing.mixing_report(df, n_shards=n).collect() for n in (16, 64))
    for got, n in ((few, 16), (many, 64)):
        assert len(got) == len(rows) and max(s for r in got for s in r.shards) == n - 1
        taken = Counter()
        for r in got:
            taken["ab"[r.doc_id % 7 > 4]] += r.taken
        assert all(abs(taken["ab"[r.doc_id % 7 > 4]] - r.target) <= 60 for r in got)
    assert {(r.doc_id, r.target) for r in few} == {(r.doc_id, r.target) for r in many}
