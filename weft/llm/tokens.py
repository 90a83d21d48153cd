"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A piece is what white space cuts off such that the pieces of a text encode independently of each other; equal pieces of a
batch are found by Arrow's dictionary encoding, new ones go to the library, and ids are put together in numpy. For
vocabularies whose rules are not one of the two known kinds, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by a worker process; when full, the memory starts anew.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once.
AT_ONCE = 6 << 20
#: The same two for an encoder that takes less memory and more time, and the pieces or texts that the library then gets at
#: once; its encodings take far more memory than their ids.
LEAN_REMEMBERED, LEAN_AT_ONCE, LEAN_BATCH = 150_000, 1 << 20, 1024

_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_STOPS = re.compile(r"[.,;:!?]+")
_encoders: dict = {}


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = 32
_FOLD[65:91] += 32
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, with the end as last entry, and all bytes."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)


class Encoder:
    def __init__(self, path: str, lean: bool = False):
        from tokenizers import Tokenizer

        self.remembered, self.at_once, self.batch = (LEAN_REMEMBERED, LEAN_AT_ONCE, LEAN_BATCH) if lean else (REMEMBERED, AT_ONCE, 1 << 30)
        self.tok = Tokenizer.from_file(path)
        rules = json.loads(self.tok.to_str())
        self.marks = [t["content"] for t in rules.get("added_tokens") or []]  # strings that the library takes for one token each
        norm, pre = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
        self.kind = "plain"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "bytes"
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed":
            self.kind = "words"
        chars = byte_characters()
        self.map = {chr(i): chars[i] for i in range(128)} | {chr(i): "".join(chars[b] for b in chr(i).encode()) for i in range(128, 256)}
        self.table = str.maketrans(self.map)
        self.marks = [(m.lower() if self.kind == "words" else m).encode() for m in self.marks]
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first, self.count, self.edge = (np.zeros(1 << 15, t) for t in (np.int64, np.int64, np.int8))

    def _known_shape(self, piece: str, lead: str) -> list[int] | None:
        """Letters alone or stops alone are one piece of the vocabulary's own rules, so the model itself encodes them."""
        if piece.isascii() and piece.isalpha():
            return [t.id for t in self.tok.model.tokenize(lead + (piece.lower() if self.kind == "words" else piece))]
        if _WORD.fullmatch(piece):
            return [t.id for t in self.tok.model.tokenize(lead + (piece.lower() if self.kind == "words" else piece).translate(self.table))]
        return [t.id for t in self.tok.model.tokenize(lead + piece)] if _STOPS.fullmatch(piece) else None

    def _learn(self, new: list[bytes]) -> None:
        hard, found = [], {}
        gap = self.map[" "] if self.kind == "bytes" else ""
        for key in new:
            p = key.decode()
            blank = p[:1] == " "
            ids = self._known_shape(p[1:], gap) if blank else self._known_shape(p, "")
            found[key] = ids
            if ids is None:
                hard.append(key)
        for i in range(0, len(hard), self.batch):
            some = hard[i : i + self.batch]
            for key, e in zip(some, self.tok.encode_batch_fast([k.decode() for k in some], add_special_tokens=False), strict=True):
                found[key] = e.ids
        n = len(self.seen)
        while n + len(found) > len(self.first):
            self.first, self.count, self.edge = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.edge))
        flat = np.fromiter((i for x in found.values() for i in x), np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        counts = np.fromiter(map(len, found.values()), np.int64, len(found))
        at = slice(n, n + len(found))
        self.count[at] = counts
        self.first[at] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        if self.kind == "bytes":  # bit 1: white space follows the piece's own blank, or nothing; bit 2: the piece ends with white space
            self.edge[at] = [(k == b" " or k[1:].decode()[:1].isspace()) | 2 * k.decode()[-1:].isspace() if k[:1] == b" " else 2 * k.decode()[-1:].isspace() for k in found]
        self.seen.update(zip(found, range(n, n + len(found)), strict=True))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        if new := [p for p in pieces if p not in self.seen]:
            self._learn(new)
        return np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and where each text starts, with the end as last entry."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, x, at in self.parts(texts):
            ids.append(x)
            counts.append(np.diff(at))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def parts(self, texts: pa.Array):
        """Runs of texts of bounded size: the place of the first, and ids and starts as encode returns them."""
        n = len(texts)
        if not n:
            return
        texts = texts.fill_null("").cast(pa.large_string())
        size = np.asarray(pc.binary_length(texts)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // self.at_once)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            ids, counts = self._some(texts.slice(a, b - a))
            yield int(a), ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        parts = (texts[i : i + self.batch] for i in range(0, len(texts), self.batch))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "plain":
            parts = self._whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)
        if len(self.seen) > self.remembered:
            self._forget()
        at, data = _flat(texts)
        if self.kind == "words":
            data = _FOLD[data]
        redo = np.zeros(len(texts), bool)
        raw = data.tobytes()
        for mark in self.marks:  # texts with an added token's string go to the library whole
            found = raw.find(mark)
            while found >= 0:
                i = int(np.searchsorted(at, found, "right")) - 1
                redo[i] = True
                found = raw.find(mark, int(at[i + 1]))
        del raw
        is_cut = data == 32
        is_cut[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]  # a stop after a letter begins a piece by either kind's rules
        is_cut[at[:-1][at[:-1] < len(data)]] = True
        cuts = np.flatnonzero(is_cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        at = np.searchsorted(cuts, at)
        if self.kind == "bytes" and len(number):
            edge = self.edge[number]
            bad = ((edge[:-1] & 2) > 0) & ((edge[1:] & 1) > 0)
            heads = at[(at > 0) & (at < len(number))]
            bad[heads - 1] = False  # the next piece is another text's first
            redo[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
        count = self.count[number]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.first[number] - total[:-1], count) + np.arange(total[-1])]
        ends_at = total[at]
        counts = np.diff(ends_at)
        if redo.any():
            again = np.flatnonzero(redo)
            whole = dict(zip(again.tolist(), self._whole(texts.take(pa.array(again)).to_pylist()), strict=True))
            flat = np.concatenate([np.zeros(0, np.uint32), *(whole[i] if redo[i] else flat[ends_at[i] : ends_at[i + 1]] for i in range(len(texts)))])
            counts = counts.copy()
            counts[again] = [len(whole[i]) for i in again.tolist()]
        return flat, counts


def encoder(path: str, lean: bool = False) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if (path, lean) not in _encoders:
        _encoders[path, lean] = Encoder(path, lean)
    return _encoders[path, lean]
