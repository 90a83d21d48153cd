"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of its own; all of them share one parent, the root restaurant, whose base is
uniform over the known words and one unknown. A training token is a customer of its context's restaurant; each table there
sends a customer to the root. Seatings are sampled by Gibbs. The tables of a restaurant's dishes depend on each other through
their number only, by a ratio of gamma functions. A gamma variate for each restaurant stands in for it; given that, dishes are
independent and all move at once, exactly. A dish of up to DIRECT customers draws its number of tables from its distribution
(generalised Stirling numbers). A larger one draws a seating of its customers, in which those between two new tables are seated
by one exact draw of their number, and takes it by the ratio of the normalisers that the sequential draw leaves out
(Metropolis within Gibbs). Restaurants of contexts are sampled first, with the root's prediction at its estimate from the
counts; then the root, given the tables they send, a seating for each sample. The predictive probabilities of the samples are
averaged.

Words are told apart by 128 bits of hash, pairs by the numbers that the words' shards give out, so no two are taken for one.

Scale. Texts are read once into block files of word numbers in the shared folder. Blocks then exchange distinct keys with
shards, as packed arrays: words with shards of words (counts, then root predictions), word pairs with shards of contexts
(customers and tables). The number of shards follows the number of keys, so a task holds about SHARD_KEYS keys. A pair is
sent once a block however often it occurs, so a pair that a third of all tokens form is no hot key. Counts cover all training documents; nothing is cut off.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, staged
from .token_store import file_system

FOLDS, HELD_OUT = 5, 1
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 8, 3
#: Tokens of a block, and keys that a shard should get.
BLOCK_TOKENS, SHARD_KEYS = 3 << 20, 1_200_000
#: Customers of a dish up to which its number of tables is drawn from its distribution, without a seating.
DIRECT = 64
#: Customers of a dish after which the gaps between new tables are drawn, which is quicker than one draw a customer and the same in distribution.
SINGLY = 64
#: Customers a new table from which on gaps are drawn; customers of a dish that are looked at at once where tables are more
#: frequent, at least and at most, and of all dishes together.
RARE, WINDOW, WIDEST, AT_ONCE = 1000, 128, 4096, 1 << 18
#: The end of a text as a word (high and low half), and the number of the context before a text's first word.
END, START = np.uint64(0x1D5E0F), np.uint64((1 << 48) - 1)
TO_WORDS, TO_CONTEXTS, COUNTS, TABLES, PARENTS, ROOT = range(6)


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all items, then the second ones and so on: high bytes, mostly zero, then pack to nothing."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize if x.dtype.itemsize > 1 else x.shape[-1] if x.ndim > 1 else 1
    return np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, max(1, width)).T)


def _from_planes(x: np.ndarray, dtype: str, shape: str) -> np.ndarray:
    return np.ascontiguousarray(x.T).reshape(-1).view(dtype).reshape([int(n) for n in shape.split(",")])


def _dump(**arrays) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, **{f"{k} {x.dtype.str} {','.join(map(str, x.shape))}": _planes(x) for k, x in arrays.items()})
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _load(blob: bytes) -> dict:
    import zstandard

    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))) as z:
        return {k.split(" ")[0]: _from_planes(z[k], *k.split(" ")[1:]) for k in z.files}


def _six(x: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].copy()


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.reshape(-1).view("<u8")


def _shard(x: np.ndarray, n: int) -> np.ndarray:
    """The shard of words by the low half of their hash."""
    return ((x >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def _by_shard(to: np.ndarray):
    """Each shard with the places of its items, by one sort however many shards there are."""
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.diff(to[order], prepend=-1))
    yield from zip(to[order[first]].tolist(), np.split(order, first[1:]), strict=False)


def _context_shard(ids: np.ndarray, n: int) -> np.ndarray:
    from .words import mixed

    return (mixed(ids) % np.uint64(n)).astype(np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, of x + 8 where x is below 8 (error below 1e-10)."""
    if np.any(low := x < 8):
        return _log_gamma(np.where(low, x + 8, x)) - np.where(low, sum(np.log(x + k) for k in range(8)), 0.0)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _gap(i: np.ndarray, c: np.ndarray, out: np.ndarray, new: np.ndarray, rng) -> np.ndarray:
    """How many customers are seated when the next one opens a table, c if none does: i sit, `out` of them weigh nothing (a
    discount a table), a new table weighs `new`. The chance that customers i .. j - 1 open none is a ratio of gamma
    functions, which is inverted by bisection."""
    mark = np.log(rng.random(len(i)))
    log_none = lambda j: _log_gamma(j - out) - _log_gamma(i - out) + _log_gamma(i - out + new) - _log_gamma(j - out + new)
    low, high = i.astype(float), c.astype(float)  # none opened up to low; one has up to high, or high is c
    never = log_none(high) >= mark
    for _ in range(int(np.ceil(np.log2((high - low).max() + 1))) + 1):
        mid = np.floor((low + high) / 2)
        none = log_none(np.maximum(mid, i)) >= mark
        move = (mid > low) & (mid < high)
        low, high = np.where(move & none, mid, low), np.where(move & ~none, mid, high)
    return np.where(never, c, low)


def _window(c, p, others, t, seated, d, strength, step, rng) -> tuple[np.ndarray, np.ndarray]:
    """Which of the next customers of each dish open tables, and the log of their normalisers. Whether one does depends on the
    tables opened before it, so all are decided anew from the last decisions until none changes: that is the sequential draw."""
    k = seated[:, None] + np.arange(max(WINDOW, min(WIDEST, AT_ONCE // len(c))))
    inside, u = k < c[:, None], rng.random(k.shape)
    hit = np.zeros(k.shape, bool)
    while True:
        tables = t[:, None] + np.cumsum(hit, axis=1) - hit
        new = (strength[:, None] + step * (others[:, None] + tables)) * p[:, None]
        both = new + k - d * tables
        now = (u * both < new) & inside
        if (now == hit).all():
            return hit, np.log(both, where=inside, out=np.zeros(k.shape)).sum(axis=1)
        hit = now


def seat(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, strength: float | np.ndarray, rng, step: float | None = None, opened: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of a fresh seating of c customers of each dish (base probability p, tables of other dishes `others`), and the log
    of its normalisers. c descends. step: what a table adds to the weight of new ones (the discount). opened: gets pairs of
    arrays, dishes that open a table and the customers seated then."""
    step = d if step is None else step
    strength = np.broadcast_to(np.asarray(strength, float), len(c))
    t, z = np.ones(len(c)), np.zeros(len(c))
    i, live = 1, int(np.searchsorted(-c, -1, "left"))
    while i < SINGLY and (live := int(np.searchsorted(-c[:live], -i, "left"))):  # dishes with more than i customers
        new = (strength[:live] + step * (others[:live] + t[:live])) * p[:live]
        both = new + i - d * t[:live]
        opens = rng.random(live) < new / both
        t[:live] += opens
        if opened is not None:
            opened.append((np.flatnonzero(opens), np.full(int(opens.sum()), i + 1.0)))
        z[:live] += np.log(both)
        i += 1
    on = np.arange(int(np.searchsorted(-c, -i, "left")) if i >= SINGLY else 0)
    seated = np.full(len(on), float(i))
    while len(on):
        new, out = (strength[on] + step * (others[on] + t[on])) * p[on], d * t[on]
        upto, far = c[on].astype(float), seated - out > RARE * new
        if far.any():  # new tables are rare: the gap to the next is drawn
            some, sit = on[far], seated[far]
            at = _gap(sit, upto[far], out[far], new[far], rng)
            opens = at < c[some]
            upto[far] = at = np.where(opens, at + 1, at)
            z[some] += _log_gamma(at - out[far] + new[far]) - _log_gamma(sit - out[far] + new[far])
            t[some] += opens
            if opened is not None:
                opened.append((some[opens], at[opens]))
        if not far.all():
            near = ~far
            hit, logs = _window(c[on[near]], p[on[near]], others[on[near]], t[on[near]], seated[near], d, strength[on[near]], step, rng)
            z[on[near]] += logs
            t[on[near]] += hit.sum(axis=1)
            if opened is not None:
                row, at = np.nonzero(hit)
                opened.append((on[near][row], seated[near][row] + at + 1))
            upto[near] = np.minimum(seated[near] + hit.shape[1], c[on[near]])
        on, seated = on[upto < c[on]], upto[upto < c[on]]
    return t, z


def _normalisers(opened: tuple[np.ndarray, np.ndarray], c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """The log of the normalisers of given seatings, had a new table weighed `new` throughout. opened: dishes, customers seated."""
    dish, upto = opened
    every = np.arange(len(c))
    of = np.concatenate([every, dish])
    order = np.argsort(of, kind="stable")
    low = np.concatenate([np.ones(len(c)), upto])[order]
    to = np.concatenate([dish, every])
    high = np.concatenate([upto, c])[np.argsort(to, kind="stable")]
    of = of[order]
    tables = np.arange(len(of)) - np.searchsorted(of, every)[of] + 1
    shift = new[of] - d * tables
    return np.bincount(of, _log_gamma(high + shift) - _log_gamma(low + shift), len(c))


@lru_cache(4)
def _stirling(d: float, most: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers: [c, t] for the weight of all seatings of c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        s[c + 1, 1 : c + 1] = s[c, 1 : c + 1] + np.log(c - d * t)
        s[c + 1, 2 : c + 2] = np.logaddexp(s[c + 1, 2 : c + 2], s[c, 1 : c + 1])
    return s


def _tables(c: np.ndarray, new: np.ndarray, d: float, rng) -> np.ndarray:
    """Numbers of tables of dishes with at most DIRECT customers, where a new table weighs `new`. c descends."""
    t, weights = np.ones(len(c)), _stirling(d, DIRECT)
    first = np.flatnonzero(np.diff(c, prepend=-1))
    for lo, hi in zip(first, np.append(first[1:], len(c)), strict=False):
        if (n := int(c[lo])) > 1:
            w = np.log(new[lo:hi, None]) * np.arange(n) + weights[n, 1 : n + 1]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[lo:hi] += (w[:, :-1] <= rng.random((hi - lo, 1)) * w[:, -1:]).sum(axis=1)
    return t


def gibbs(c: np.ndarray, p: np.ndarray, where: np.ndarray, n: int, d: float, strength: float, rng, burn_in: int = BURN_IN, samples: int = SAMPLES, part: float = 1.0):
    """Samples of the tables of each dish. where: the restaurant of each, one of n. part: the share of their restaurants' dishes
    that these are; the others' tables are then taken to be as many a dish."""
    order = np.argsort(-c, kind="stable")
    order, single = np.split(order, [int(np.searchsorted(-c[order], -1, "left"))])  # a lone customer has a table, whatever else there is
    own, at = np.unique(where[order], return_inverse=True)  # restaurants in which there is something to draw
    alone = np.bincount(where[single], minlength=n)[own]
    c, p = c[order].astype(np.int64), p[order]
    big = int(np.searchsorted(-c, -DIRECT, "left"))
    t, opened, kept = np.ones(len(c)), None, []
    for turn in range(burn_in + samples):
        stand_in = rng.gamma(strength / d + (alone + np.bincount(at, t, len(own))) / part)
        new = d * stand_in[at] * p
        t[big:] = _tables(c[big:], new[big:], d, rng)
        if big:
            fresh = []
            t2, z2 = seat(c[:big], np.ones(big), np.zeros(big), d, new[:big], rng, step=0.0, opened=fresh)
            fresh = tuple(np.concatenate(x) for x in zip(*fresh, strict=True))
            if opened is None:
                t[:big], opened = t2, fresh
            else:
                yes = np.log(rng.random(big)) < z2 - _normalisers(opened, c[:big], new[:big], d)
                t[:big] = np.where(yes, t2, t[:big])
                old, now = ~yes[opened[0]], yes[fresh[0]]
                opened = tuple(np.concatenate([x[old], y[now]]) for x, y in zip(opened, fresh, strict=True))
        if turn >= burn_in:
            back = np.ones(len(where))
            back[order] = t
            kept.append(back)
    return kept


_KIND = "dst long, kind int, src long, blob binary"
_SCHEMA = pa.schema([("dst", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), ("blob", pa.binary())])


def _grouped(df: DataFrame, handle, kind: str = _KIND, schema: pa.Schema = _SCHEMA, tasks: int = 1) -> DataFrame:
    """handle(dst, rows) for all rows (kind, src, blob) of each dst; it yields rows of the result as tuples."""

    def run(batches):
        at, items = None, []
        for b in batches:
            for dst, k, src, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is not None and dst != at:
                    yield from out(at, items)
                    items = []
                at = dst
                items.append((k, src, blob))
        if at is not None:
            yield from out(at, items)

    def out(at, items):
        for rows in handle(at, items):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select("dst", "kind", "src", "blob").repartition(max(1, tasks), "dst").sortWithinPartitions("dst", "kind", "src").mapInArrow(run, kind)


class _Block:
    """A block's file: documents, and their tokens as places in the block's words."""

    def __init__(self, path: str):
        fs, local = file_system(path)
        with fs.open_input_file(local) as f:
            x = _load(f.read())
        self.high, self.words, self.train, self.docs, self.null, self.held, self.starts = (x[k] for k in ("upper", "words", "train", "docs", "null", "held", "starts"))
        self.tokens = x["low"].astype(np.uint32) | (x["high"].astype(np.uint32) << np.uint32(8)) | (x["top"].astype(np.uint32) << np.uint32(16))

    def pairs(self):
        """Context and word of each token, as places in `words`; START stands at len(words)."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts[:-1]] = len(self.words)
        return before, self.tokens

    def distinct(self):
        """The distinct pairs in order of context shard, context, word: places of context and word, and each token's pair."""
        u, w = self.pairs()
        key = u.astype(np.uint64) << np.uint64(32) | w
        key, back = np.unique(key, return_inverse=True)
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), back


def write_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """One row per block: block, file, n_tokens, n_words."""

    def make(batches):
        from pyspark import TaskContext

        from .words import chunks, word_digests

        task, seq, held = TaskContext.get(), 0, []
        size = 0
        for b in batches:
            ids, out = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, part in chunks(b.column(2)):
                high, low, starts = word_digests(part)
                for i in range(len(part)):
                    own = slice(starts[i], starts[i + 1])
                    held.append((ids[at + i], out[at + i], np.append(low[own], END), np.append(high[own], END)))
                    size += len(held[-1][2])
                if size >= block_tokens:
                    yield flush(held, path, task.partitionId(), task.taskAttemptId(), seq)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush(held, path, task.partitionId(), task.taskAttemptId(), seq)

    def flush(held, path, part, attempt, seq):
        from .words import distinct

        high, words, place = distinct(np.concatenate([x for *_, x in held]), np.concatenate([x for _, _, x, _ in held]))
        n = np.array([len(x) for *_, x in held])
        out = np.array([x for _, x, _, _ in held], bool)
        often = np.bincount(place)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place, words, high = rank[place].astype(np.uint32), words[order], high[order]
        train = np.bincount(place[~np.repeat(out, n)], minlength=len(words))
        name = f"{path}/blocks/block-{part:06d}-{attempt}-{seq:04d}"
        fs, local = file_system(name)
        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
        blob = _dump(upper=high, words=words, train=train.astype(np.uint32), docs=np.array([i or 0 for i, *_ in held], np.int64), null=np.array([i is None for i, *_ in held]), held=out, starts=np.append(0, np.cumsum(n)), low=(place & 255).astype(np.uint8), high=(place >> 8 & 255).astype(np.uint8), top=(place >> 16).astype(np.uint16))
        with fs.open_output_stream(local) as f:
            f.write(blob)
        return pa.RecordBatch.from_pylist([{"block": part << 20 | seq, "file": name, "n_tokens": int(n.sum()), "n_words": len(words)}])

    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(make, "block long, file string, n_tokens long, n_words long"), f"{path}/manifest")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_tokens: int = BLOCK_TOKENS, seed: int = 11, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Null texts are empty: their end alone is scored. Null ids are in training. Rows that repeat an id are texts of their
    own. Without training documents every word is the one unknown, and all scores are 0. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    base = new_dir(spark, "lm")
    blocks = write_blocks(docs, base, id_col, text_col, block_tokens)
    totals = blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.count("*")).first()
    n_context = max(1, -(-(totals[0] or 0) // SHARD_KEYS))
    n_word = max(1, -(-(totals[1] or 0) // SHARD_KEYS))
    n_block = min(10_000, max(1, totals[2]))
    files = blocks.select(F.col("block").alias("dst"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("src"), F.col("file").cast("binary").alias("blob"))

    # Words to their shards, for their counts in all training documents.
    def ask_words(block, items):
        x = _Block(items[0][2].decode())
        for s, mine in _by_shard(_shard(x.words, n_word)):
            yield [(s, TO_WORDS, block, _dump(w=x.words[mine], h=x.high[mine], c=x.train[mine]))]

    asked = staged(_grouped(files, ask_words, tasks=n_block), f"{base}/words")

    def count_words(shard, items):
        from .words import distinct

        got = [(src, _load(b)) for _, src, b in items]
        _, _, back = distinct(np.concatenate([x["h"] for _, x in got]), np.concatenate([x["w"] for _, x in got]))
        c = np.bincount(back, np.concatenate([x["c"] for _, x in got])).astype(np.int64)
        at = 0
        for src, x in got:
            n = len(x["w"])
            yield [(src, COUNTS, shard, _dump(c=c[back[at : at + n]].astype(np.uint32), i=back[at : at + n].astype(np.uint32)))]
            at += n
        yield [(-1, COUNTS, shard, _dump(c=np.array([c.sum(), (c > 0).sum()])))]

    counted = staged(_grouped(asked, count_words, tasks=n_word), f"{base}/counts")
    sums = sum((_load(r["blob"])["c"] for r in counted.where("dst = -1").toLocalIterator()), np.zeros(2, np.int64))  # two numbers a shard
    n_train, n_known = int(sums[0]), int(sums[1])
    counts = counted.where("dst >= 0")

    def block_counts(x: _Block, items) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of a block's words: a word's number is its place in its shard, times the shards, plus the shard."""
        places, c, ids = dict(_by_shard(_shard(x.words, n_word))), np.zeros(len(x.words), np.int64), np.zeros(len(x.words), np.uint64)
        for kind, src, blob in items:
            if kind == COUNTS:
                y, mine = _load(blob), places[src]
                c[mine], ids[mine] = y["c"], y["i"].astype(np.uint64) * np.uint64(n_word) + np.uint64(src)
        return c, ids

    # Pairs to the shards of their contexts; with each word goes the logarithm of its count, in quarters.
    def context_of(ids: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.append(ids, START)[u]

    def ask_contexts(block, items):
        x = _Block(items[0][2].decode())
        c, ids = block_counts(x, items)
        u, w, back = x.distinct()
        train = np.bincount(back[np.repeat(~x.held, np.diff(x.starts))], minlength=len(u)).astype(np.uint32)
        grade = np.round(4 * np.log2(np.maximum(c, 1))).astype(np.uint8)
        for s, mine in _by_shard(_context_shard(context_of(ids, u), n_context)):
            first = np.flatnonzero(np.diff(u[mine], prepend=-1))
            yield [(s, TO_CONTEXTS, block, _dump(u=_six(context_of(ids, u[mine[first]])), n=np.diff(np.append(first, len(mine))).astype(np.uint32), w=_six(ids[w[mine]]), c=train[mine], g=grade[w[mine]]))]

    pairs = _grouped(files.unionByName(counts), ask_contexts, tasks=n_block)

    def seat_contexts(shard, items):
        rng = np.random.Generator(np.random.PCG64([seed, shard]))
        got = [(src, _load(b)) for _, src, b in items]
        contexts, cu = np.unique(np.concatenate([_from_six(x["u"]) for _, x in got]), return_inverse=True)
        n_pairs = np.concatenate([x["n"] for _, x in got])
        own = np.repeat(cu, n_pairs)
        w = np.concatenate([_from_six(x["w"]) for _, x in got])
        known, place = np.unique(w, return_inverse=True)
        key, first, back = np.unique(own.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64), return_index=True, return_inverse=True)
        c = np.bincount(back, np.concatenate([x["c"] for _, x in got])).astype(np.int64)
        grade = np.concatenate([x["g"] for _, x in got])[first]
        live = np.flatnonzero(c)
        p = 2.0 ** (grade[live] / 4) / max(1, n_train)
        where = own[first]
        drawn = gibbs(c[live], p, where[live], len(contexts), DISCOUNT, STRENGTH, rng, burn_in, samples)
        t = np.zeros((samples, len(key)), np.int64)  # tables in each sample
        t[:, live] = drawn
        cu_all = np.bincount(where, c, len(contexts)).astype(np.int64)
        tu_all = np.array([np.bincount(where, x, len(contexts)) for x in t]).astype(np.int64).reshape(samples, -1)
        at = ut = 0
        for src, x in got:
            n, k = len(x["w"]), len(x["u"])
            mine, of = back[at : at + n], cu[ut : ut + k]
            yield [(src, TABLES, shard, _dump(c=c[mine].astype(np.uint32), t=t[:, mine].astype(np.uint32), cu=cu_all[of], tu=tu_all[:, of], n=x["n"]))]
            at, ut = at + n, ut + k
        of_word = place[first][live]
        sent = np.array([np.bincount(of_word, x, len(known)) for x in t[:, live]]).astype(np.int64).reshape(samples, -1)
        to = (known % np.uint64(n_word)).astype(np.int64)
        some = np.flatnonzero((sent > 0).any(axis=0))
        for s, mine in _by_shard(to[some]):
            mine = some[mine]
            yield [(s, PARENTS, shard, _dump(i=(known[mine] // np.uint64(n_word)).astype(np.uint32), t=sent[:, mine].astype(np.uint32)))]

    seated = staged(_grouped(pairs, seat_contexts, tasks=n_context), f"{base}/tables")
    tables, parents = seated.where(F.col("kind") == TABLES), seated.where(F.col("kind") == PARENTS)

    # The root: customers are the tables of all contexts.
    uniform = 1 / (n_known + 1)

    def seat_root(shard, items):
        rng = np.random.Generator(np.random.PCG64([seed, 1 << 40, shard]))
        asks, sent = [(src, _load(b)["i"]) for k, src, b in items if k == COUNTS], [_load(b) for k, _, b in items if k == PARENTS]
        n_words = 1 + max(int(i.max()) for _, i in asks)
        m, sums = [], []
        for sample in range(samples):  # a seating of the root for each sample of the contexts
            c = np.zeros(n_words, np.int64)
            for x in sent:
                c[x["i"]] += x["t"][sample]
            live = np.flatnonzero(c)
            t = np.zeros(n_words)
            if len(live):  # words are dealt by a hash, so those of other shards have as many tables a word
                t[live] = gibbs(c[live], np.full(len(live), uniform), np.zeros(len(live), np.int64), 1, ROOT_DISCOUNT, ROOT_STRENGTH, rng, burn_in, 1, len(live) / n_known)[0]
            m.append(np.maximum(c - ROOT_DISCOUNT * t, 0).astype(np.float32))
            sums += [c.sum(), t.sum()]
        m = np.array(m)
        for src, i in asks:
            yield [(src, ROOT, shard, _dump(m=m[:, i]))]
        yield [(-1, ROOT, shard, _dump(m=np.array(sums, float)))]

    rooted = staged(_grouped(counts.select(F.col("src").alias("dst"), "kind", F.col("dst").alias("src"), "blob").unionByName(parents), seat_root, tasks=n_word), f"{base}/root")
    root_sums = sum((_load(r["blob"])["m"] for r in rooted.where("dst = -1").toLocalIterator()), np.zeros(2 * samples))  # two numbers a sample

    def score(block, items):
        x = _Block(items[0][2].decode())
        c, ids = block_counts(x, items)
        m, places = np.zeros((samples, len(x.words))), dict(_by_shard(_shard(x.words, n_word)))
        u, w, back = x.distinct()
        cw, cu = np.zeros(len(u)), np.zeros(len(u))
        tw, tu = np.zeros((samples, len(u)), np.uint32), np.zeros((samples, len(u)), np.uint32)
        pairs_of = dict(_by_shard(_context_shard(context_of(ids, u), n_context)))
        for kind, src, blob in items:
            if kind == ROOT:
                m[:, places[src]] = _load(blob)["m"]
            elif kind == TABLES:
                y, mine = _load(blob), pairs_of[src]
                cw[mine], tw[:, mine] = y["c"], y["t"]
                cu[mine], tu[:, mine] = np.repeat(y["cu"], y["n"]), np.repeat(y["tu"], y["n"], axis=1)
        p = np.zeros(len(u))  # the samples' predictive probabilities, averaged
        for sample in range(samples):
            customers, root_tables = root_sums[2 * sample : 2 * sample + 2]
            root = ((m[sample] + (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) * uniform) / (ROOT_STRENGTH + customers))[w]
            p += np.where(cu > 0, (np.maximum(cw - DISCOUNT * tw[sample], 0) + (STRENGTH + DISCOUNT * tu[sample]) * root) / (STRENGTH + cu), root) / samples
        flat = np.log10((c + 0.5) / (n_train + 0.5 * (n_known + 1)))
        cut = x.starts[:-1]
        sums = [np.add.reduceat(v, cut) for v in (np.log10(p)[back], flat[x.tokens], (c > 0)[x.tokens].astype(np.int64))]
        n = np.diff(x.starts)
        doc_ids = [None if null else int(i) for i, null in zip(x.docs, x.null, strict=True)]
        yield list(zip(doc_ids, x.held.tolist(), n.tolist(), sums[2].tolist(), [n_train] * len(n), sums[1].tolist(), sums[0].tolist(), strict=True))

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    everything = files.unionByName(counts).unionByName(tables).unionByName(rooted.where("dst >= 0"))
    return _grouped(everything, score, kind, schema, n_block)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity a token of held-out and of training texts, by the model and by the base."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(mean("score").alias("model"), mean("base_score").alias("base"), F.count("*").alias("n_docs"))


