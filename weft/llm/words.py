"""Words of whole texts as 64-bit hashes, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .tokens import _FOLD, _flat

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are cut at once.
AT_ONCE = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array):
    """Slices of an array of texts (null: empty) of bounded size, with where each starts."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    cuts = np.flatnonzero(np.diff((at[1:] - at[0]) // AT_ONCE)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if b > a:
            yield int(a), texts.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space, A-Z lower-cased) of all texts, and where each text's words start."""
    coded, starts = _words(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[np.asarray(coded.indices)], starts


def word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes in 128 bits: the high halves, the low halves, and the starts."""
    coded, starts = _words(texts)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
    at = np.asarray(coded.indices)
    return both[at, 0], both[at, 1], starts


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order of low, then high, and the place of each row among them."""
    u, first, back = np.unique(low, return_index=True, return_inverse=True)
    if (high[first][back] == high).all():
        return high[first], u, back
    order = np.lexsort((high, low))  # low halves that different words share
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return high[order][new], low[order][new], back


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    at, data = _flat(texts)
    data = _FOLD[data]
    solid = data != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] = solid[heads]
    where = np.flatnonzero(begins)
    starts = np.searchsorted(where, at)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - where))  # places of words once white space is gone; an index of each byte would take eight times the text
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return words.dictionary_encode(), starts


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of shorter texts the whole sequence is one."""
    n = len(words)
    out = []
    run = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        run = mixed(run + words[i : n - k + 1 + i] + np.uint64(i + 1)) if len(run) else run
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = mixed(h + words[i] + np.uint64(i - a + 1))
            out.append(mixed(h + np.uint64(k + 1000 + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
