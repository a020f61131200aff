"""Token ids of whole texts with the public tokenizers, many times faster than text by text.

Both vocabularies cut a text into pre-tokens and merge within each of them only. So a worker cuts texts with numpy
on their UTF-8 bytes, asks the merging model of the tokenizers library once for each distinct pre-token, and keeps those answers in a
bounded cache, sorted by a 64-bit hash of bytes and length. Texts with characters outside printable ASCII, tab, newline, return and the Latin
letters U+00C0-U+024F, with an apostrophe (contractions) or with '<|' (special tokens) go whole to the library.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd

from .common import CHUNK, SpanHash, runs

#: Bytes of text in one pass: repeated words are looked up once in it.
PASS = CHUNK

SPACE, LETTER, DIGIT, OTHER, ALIEN = range(5)
#: Distinct pre-tokens that a worker remembers.
CACHE = 400_000


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


BYTE_LETTERS = _byte_letters()


def _classes() -> np.ndarray:
    c = np.full(256, ALIEN, np.uint8)
    c[[32, 9, 10, 13]] = SPACE
    c[33:127] = OTHER
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = LETTER
    c[0xC3:0xCA] = c[0x80:0xC0] = LETTER
    c[39] = ALIEN
    return c


CLASSES = _classes()


class Encoder:
    """Encodes chunks of texts. kind: 'byte' keeps white space and joins a space to what follows; 'word' drops it and cuts digits."""

    def __init__(self, path: str, kind: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.limit = Tokenizer.from_file(path), kind, cache
        self.hash = SpanHash(fold_case=kind == "word")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in ascending order, and the row of each in at and size
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has. The words are pre-tokens already: only the model is asked."""
        text = b" ".join(words) if self.kind == "word" else b"\n".join(words)
        if self.kind == "word":
            text = self.tokenizer.normalizer.normalize_str(text.decode()).encode()
        letters = text.decode("latin-1").translate(BYTE_LETTERS)
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(w)] for w in letters.split(BYTE_LETTERS[32 if self.kind == "word" else 10])]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.rows[i], -1)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        blank = [i for i, w in enumerate(words) if not w.strip()]
        full = [i for i, w in enumerate(words) if w.strip()]
        flats, sizes = [], []
        for k in range(0, len(full), 2000):
            ids, size = self._ids_of([words[i] for i in full[k : k + 2000]])
            flats.append(ids)
            sizes.append(size)
        for i in blank:
            ids = np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            flats.append(ids)
            sizes.append([len(ids)])
        ids, size = np.concatenate(flats), np.concatenate(sizes)
        n, m = len(self.keys), len(size)
        assert m == len(words) and size.sum() == len(ids), "pre-tokens and ids don't agree"
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        while n + m > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + m] = size
        self.at[n : n + m] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        new = keys[full + blank]
        order = np.argsort(new)
        into = np.searchsorted(self.keys, new[order])
        self.keys, self.rows = np.insert(self.keys, into, new[order]), np.insert(self.rows, into, n + order)

    def _starts(self, data: np.ndarray, cls: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of pre-tokens; edge marks the first byte of each text."""
        n = len(data)
        space = cls == SPACE
        was = np.empty(n, np.uint8)
        was[0], was[1:] = ALIEN, cls[:-1]
        changes = (cls != was) | edge[:n]
        if self.kind == "word":
            starts = np.flatnonzero((changes | (cls == DIGIT)) & ~space)
            stops = np.ones(n + 1, bool)
            stops[:n] = changes | (cls == DIGIT)
            following = np.flatnonzero(stops)
            return starts, following[np.searchsorted(following, starts, "right")]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = data[:-1] == 32
        last = np.zeros(n, bool)  # the last white space of a run before something in the same text
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        start = np.where(space, changes | last, changes & ~(after_blank & ~edge[:n]))
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts data[offsets[i]:offsets[i+1]] one after another, and n + 1 offsets into them."""
        flats, sizes = [], []
        for i, j in runs(offsets, PASS):
            ids, n = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flats.append(ids)
            sizes.append(n)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return (np.concatenate(flats) if flats else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(sizes)])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(offsets) - 1, len(data)
        if not m:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(self.keys) > self.limit:
            self._forget()
        cls = CLASSES[data]
        bad = cls == ALIEN
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        bad[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair == 0x3C7C)
        text_of = np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1
        slow = np.unique(text_of)
        if len(slow):
            keep = np.ones(n, bool)
            keep[slow] = False
            sizes = np.where(keep, np.diff(offsets), 0)
            sub = np.concatenate([[0], np.cumsum(sizes)])
            fast, lengths = self._fast(data[np.repeat(keep, np.diff(offsets))], sub)
            whole = self._whole([data[offsets[i] : offsets[i + 1]].tobytes() for i in slow])
            cut = np.concatenate([[0], np.cumsum(lengths)])
            lengths[slow] = [len(x) for x in whole]
            by = dict(zip(slow.tolist(), whole, strict=True))
            return np.concatenate([by[i] if i in by else fast[cut[i] : cut[i + 1]] for i in range(n)]), lengths
        return self._fast(data, offsets)

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts, ends = self._starts(data, CLASSES[data], edge)
        codes, found = pd.factorize(self.hash(data, starts, ends))
        row = self._rows_of(found)
        if len(missing := np.flatnonzero(row < 0)):
            first = np.zeros(len(found), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at, text = first[missing], data.tobytes()
            self._learn(found[missing], [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            row[missing] = self._rows_of(found[missing])
        row = row[codes]
        size = self.size[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.at[row] - total[:-1], size)]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
