"""Phrase collocation mining with position bitmaps.

Texts are cut in pieces and words, and the words of a shard (some megabytes of text of a task) get consecutive positions, one
of which stays empty between pieces. A word's positions are a compressed bitmap: the 64-bit blocks that hold any, and
their masks. A phrase's bitmap has its last word's positions. To extend phrases, their bitmaps are shifted by one place
(the highest bit carries into the next block) and met with the bitmaps of the words that stand there: the AND of the masks
is the longer phrase's bitmap, its popcount the occurrences. No bit reaches over a piece's end, as the empty position is
in no bitmap. Popcounts are summed over shards.

Whether a phrase is frequent is known only over all shards, so there are three passes: words, pairs, and from the pairs
depth-first, a run of first words at a time, phrases of three and four. Each pass keeps to what the pass before found
frequent, by a filter of bits: what it lets through too much is counted and falls at the sums, and what is frequent always
gets through, so counts are exact. Phrases are compared as texts, never by hash.

Scale. A shard sends each phrase once; sums are partial before they are shuffled. The filters are broadcast, FILTER_BITS bits
for each frequent phrase and MOST_BITS (16 MB) at most: beyond some 8 million frequent phrases more rows are shuffled, and
the sums stay exact. Ranks are taken in PARTS parts a language first, so no task orders a language's candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, new_dir, small_batches, staged
from .tokens import _flat
from .words import mixed

LEAST, LONGEST, MOST = 30, 4, 2000
INSIDE_PERCENT = 80
SCALE = 2_000_000
#: Bytes of text of a shard, and rows of bitmaps that are extended at once.
SHARD, AT_ONCE = 4 << 20, 1 << 17
FILTER_BITS, FEWEST_BITS, MOST_BITS, PROBES = 16, 1 << 16, 1 << 27, 3
PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class Filter:
    """Packed bits of a Bloom filter."""

    def __init__(self, bits: int, raw: np.ndarray):
        self.bits, self.raw = bits, raw

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in places(hashes, self.bits):
            out &= (self.raw[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]


def word_hash(lang: bytes, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a + np.uint64(1)) + b)


class Shard:
    """The words of some texts at their positions, and the words' bitmaps."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        at, data = _flat(texts)
        data = _LOWER[data]
        stop = _STOP[data]
        solid = ~(stop | _BLANK[data])
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        heads, tails = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
        begins[heads], ends[tails] = solid[heads], solid[tails]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        own = np.searchsorted(at, first, "right") - 1
        stops = np.cumsum(stop, dtype=np.int32)
        new = np.zeros(len(first), bool)  # words that begin a piece
        if len(first):
            new[0] = True
            new[1:] = (stops[first[1:]] > stops[last[:-1] - 1]) | (own[1:] != own[:-1])
        offsets = np.append(0, np.cumsum(last - first))
        body = data[solid]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        tongue = langs.dictionary_encode()
        self.langs, by = tongue.dictionary, np.asarray(tongue.indices).astype(np.int64)
        pairs = by[own] * max(1, len(coded.dictionary)) + np.asarray(coded.indices)
        kinds, word = np.unique(pairs, return_inverse=True)
        self.lang_of, spelling = np.divmod(kinds, max(1, len(coded.dictionary)))
        self.words = coded.dictionary.take(pa.array(spelling))
        self.n = np.bincount(self.lang_of[word], minlength=len(self.langs))
        self.position = np.arange(len(first)) + np.cumsum(new)
        self.word = word

    def counts(self) -> np.ndarray:
        return np.bincount(self.word, minlength=len(self.words))

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.words), np.uint64)
        for i, lang in enumerate(self.langs.to_pylist()):
            mine = np.flatnonzero(self.lang_of == i)
            out[mine] = word_hash(lang.encode(), self.words.take(pa.array(mine)).to_pylist())
        return out

    def build(self, frequent: np.ndarray) -> None:
        """Bitmaps of the words that may be frequent, in order of word and block."""
        keep = frequent[self.word]
        word, position = self.word[keep], self.position[keep]
        order = np.argsort(word, kind="stable")
        word, position = word[order], position[order]
        block = position >> 6
        cut = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))) if len(word) else np.zeros(0, np.int64)
        self.map_word, self.map_block = word[cut], block[cut]
        self.map_mask = np.bitwise_or.reduceat(np.uint64(1) << (position & 63).astype(np.uint64), cut) if len(cut) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(word))))
        self.row_at = np.full((int(self.position[-1]) >> 6) + 2 << 6 if len(self.position) else 128, -1, np.int32)
        self.row_at[position] = row  # the bitmap that has each position

    def extend(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """From bitmaps (phrase, block, mask) in order: phrase, word, block, mask of all their extensions, in order too."""
        carry = np.flatnonzero(mask >> np.uint64(63))
        mask = mask << np.uint64(1)
        if len(carry):
            phrase, block, mask = np.append(phrase, phrase[carry]), np.append(block, block[carry] + 1), np.append(mask, np.ones(len(carry), np.uint64))
        # the words that stand at the shifted bits, and their bitmaps' masks
        some = np.flatnonzero(mask)
        phrase, block, mask = phrase[some], block[some], mask[some]
        rows, rest, found = np.arange(len(mask)), mask.copy(), []
        while len(rows):
            low = rest & (~rest + np.uint64(1))
            at = self.row_at[(block[rows] << 6) + np.bitwise_count(low - np.uint64(1))]
            both = np.where(at >= 0, mask[rows] & self.map_mask[at], low)
            good = at >= 0
            found.append((rows[good], at[good], both[good]))
            rest = rest & ~both  # what this word's bitmap has is done
            live = np.flatnonzero(rest)
            rows, rest = rows[live], rest[live]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
        rows, at, both = (np.concatenate(x) for x in zip(*found, strict=True))
        phrase, block, word = phrase[rows], block[rows], self.map_word[at]
        order = np.lexsort((block, word, phrase))
        phrase, word, block, both = phrase[order], word[order], block[order], both[order]
        if len(carry):  # bits that a carry and a mask of its block share a row for
            cut = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1]) | (block[1:] != block[:-1]))) if len(phrase) else np.zeros(0, np.int64)
            both = np.bitwise_or.reduceat(both, cut) if len(cut) else both
            phrase, word, block = phrase[cut], word[cut], block[cut]
        return phrase, word, block, both

    def runs(self):
        """Rows of bitmaps of first words, some at a time."""
        n, a = len(self.map_word), 0
        while a < n:
            b = min(n, a + AT_ONCE)
            while b < n and self.map_word[b] == self.map_word[b - 1]:
                b += 1
            yield slice(a, b)
            a = b

    def phrases(self, h: np.ndarray, pairs: Filter | None, longest: int):
        """Word numbers (a column a word) and occurrences of phrases of 2 to longest words, depth-first; with a filter of pairs
        only of three words and more, all of whose pairs it holds."""
        for run in self.runs():
            words, to = np.unique(self.map_word[run], return_inverse=True)
            yield from self._deeper(words[:, None], to, self.map_block[run], self.map_mask[run], h, pairs, longest)

    def _deeper(self, words, phrase, block, mask, h, pairs, longest):
        phrase, word, block, mask = self.extend(phrase, block, mask)
        if not len(phrase):
            return
        cut = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])))
        longer = np.column_stack([words[phrase[cut]], word[cut]])
        n = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), cut)
        size = np.diff(np.append(cut, len(mask)))
        if pairs is not None:
            good = pairs.holds(pair_hash(h[longer[:, -2]], h[longer[:, -1]]))
            rows = np.repeat(good, size)
            longer, n, size, block, mask = longer[good], n[good], size[good], block[rows], mask[rows]
        if not len(n):
            return
        if pairs is None or longer.shape[1] > 2:
            yield longer, n
        if longer.shape[1] < longest:
            yield from self._deeper(longer, np.repeat(np.arange(len(n)), size), block, mask, h, pairs, longest)

    def spelled(self, phrases: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases."""
        words = [self.words.take(pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
        return self.langs.take(pa.array(self.lang_of[phrases[:, 0]])), pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())


def shards(batches):
    """Shards of batches (lang, text) of some SHARD bytes; a longer text is a shard of its own."""
    held, size = [], 0
    for b in batches:
        texts = b.column(1).cast(pa.large_string())
        ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(ends, SHARD - size + (ends[a - 1] if a else 0), "right")))
            held.append((b.column(0).slice(a, z - a), texts.slice(a, z - a)))
            size += int(ends[z - 1] - (ends[a - 1] if a else 0))
            a = z
            if size >= SHARD or a < len(texts):
                yield _shard(held)
                held, size = [], 0
    if held:
        yield _shard(held)


def _shard(held: list) -> Shard:
    langs, texts = zip(*held, strict=True)
    return Shard(pa.concat_arrays(langs), pa.concat_arrays(texts))


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _batch(langs, phrases, n):
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()) if not isinstance(langs, pa.Array) else langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], schema=_COUNTED)


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def filter_of(frequent: DataFrame, length: int) -> Filter:
    """The filter of the frequent phrases (lang, phrase) of one or two words. Its bits are merged by aggregates, as longs; the
    driver gets MOST_BITS / 64 of them at most."""
    n = frequent.count()
    bits = max(FEWEST_BITS, min(MOST_BITS, 1 << max(1, n * FILTER_BITS).bit_length()))

    def make(batches):
        for b in batches:
            if not b.num_rows:
                continue
            hashes = np.empty(b.num_rows, np.uint64)
            tongue = b.column(0).dictionary_encode()
            for i, lang in enumerate(tongue.dictionary.to_pylist()):
                mine = np.flatnonzero(np.asarray(tongue.indices) == i)
                words = [p.encode().split(b" ") for p in b.column(1).take(pa.array(mine)).to_pylist()]
                h = [word_hash(lang.encode(), [w[j] for w in words]) for j in range(length)]
                hashes[mine] = h[0] if length == 1 else pair_hash(*h)
            at = np.unique(np.concatenate(places(hashes, bits)))
            cut = np.flatnonzero(np.append(True, at[1:] >> np.uint64(6) != at[:-1] >> np.uint64(6)))
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), cut)
            yield pa.RecordBatch.from_arrays([pa.array((at[cut] >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))], names=["place", "bits"])

    merged = frequent.select("lang", "phrase").mapInArrow(make, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    raw = np.zeros(bits >> 6, np.uint64)
    raw[np.asarray(merged["place"])] = np.asarray(merged["bits"]).view(np.uint64)
    return Filter(bits, raw)


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, n) of all phrases of 1 to longest words that occur at least so often, and (lang, n) of all words."""
    spark = docs.sparkSession
    base = new_dir(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def words(batches):
        for s in shards(batches):
            yield _batch(s.langs.take(pa.array(s.lang_of)), s.words.cast(pa.large_string()), s.counts())

    with small_batches(spark):
        single = staged(_summed(rows.mapInArrow(lean(words), "lang string, phrase string, n long")), f"{base}/words")
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    single = single.where(F.col("n") >= least)
    known = spark.sparkContext.broadcast(filter_of(single, 1))

    def pairs(batches):
        for s in shards(batches):
            s.build(known.value.holds(s.hashes()))
            for phrases, n in s.phrases(np.zeros(0, np.uint64), None, 2):
                yield _batch(*s.spelled(phrases), n)

    with small_batches(spark):
        double = staged(_summed(rows.mapInArrow(lean(pairs), "lang string, phrase string, n long")).where(F.col("n") >= least), f"{base}/pairs")
    joined = spark.sparkContext.broadcast(filter_of(double, 2))

    def longer(batches):
        for s in shards(batches):
            h = s.hashes()
            s.build(known.value.holds(h))
            for phrases, n in s.phrases(h, joined.value, longest):
                yield _batch(*s.spelled(phrases), n)

    with small_batches(spark):
        more = staged(_summed(rows.mapInArrow(lean(longer), "lang string, phrase string, n long")).where(F.col("n") >= least), f"{base}/longer")
    every = single.unionByName(double).unionByName(more)
    return every.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "n"), totals


def _joined(words, a, b):
    return F.array_join(F.slice(words, a, b), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, most: int = MOST, inside: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases.

    Null languages are und, null texts are empty. Repeated rows count as often as they occur; an empty table, or one without
    a phrase that is frequent enough, gives no rows; further columns play no part. Equal scores go by a, then by the
    phrase's bytes.
    """
    counted, totals = count_phrases(docs, lang_col, text_col, least=least, longest=longest)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cand = counted.where("n_words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), "n_words")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("w"), F.col("k") + 1, F.col("n_words")).alias("right"))
    part = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("n_words") - k + 1), lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))))
    covers = cand.where("n_words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (big("cover") * 100 < big("a") * inside))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    x = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return x.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
