"""Operator 9, language ID: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, anything but letters becomes one blank, and its byte 2-, 3- and 4-grams are hashed into BUCKETS
embeddings; their mean goes through a linear softmax. Both are trained by stochastic gradient descent on about per_class texts
of each language (at most max_chars characters), and on short cuts of them. A temperature and the score below which a text is
rejected are calibrated on a fifth of the sample that training doesn't see: the floor keeps all but MISSED of the texts that
are told rightly, and is never over CEILING. As mean and softmax input are linear, scoring adds rows of the product of
embeddings and weights, over whole texts. Every lang value is learned; where there are many, each has fewer texts in the sample.

A text of over twice SCORED bytes is cut at blanks, and the sums of its pieces are added: its memory is that of a piece, and the grams
across a cut, a handful in 100,000, don't count.

Nulls and ties: a null text or one without a letter is 'und' with score 0 and rejected. Rows with null, equal or unknown ids are
predicted each for itself. Without labelled texts all are 'und'. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, documents, runs, small_batches, text_bytes, tidy
from .sampling import labelled_texts

FOLDS, FOLD, PER_CLASS, MAX_CHARS = 3, 1, 900, 50_000
BITS, WIDTH, EPOCHS, RATE, MISSED, CEILING = 15, 8, 4, 2.0, 0.001, 0.5
ORDERS = (2, 3, 4)
#: Bytes of text whose grams are scored at once: each byte takes about 170 bytes meanwhile.
SCORED = 1 << 17


def _folded() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLDED = _folded()
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams of all texts, text after text, and n + 1 offsets."""
    b = FOLDED[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    b[latin] += np.where((data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97), 32, 0).astype(np.uint8)
    # one blank around and between words: a blank of a run goes unless it is the first of it
    edges = np.zeros(len(b) + 1, bool)
    edges[offsets] = True
    drop = np.zeros(len(b), bool)
    drop[1:] = (b[1:] == 32) & (b[:-1] == 32)
    drop &= ~edges[:-1]
    kept = np.concatenate([[0], np.cumsum(~drop)])[offsets]
    b = b[~drop]
    # texts get a blank on either side
    n = len(offsets) - 1
    at = kept + 2 * np.arange(n + 1)
    full = np.full(at[-1], 32, np.uint8)
    full[np.arange(len(b)) + np.repeat(2 * np.arange(n) + 1, np.diff(kept))] = b
    w = full.astype(np.uint32)
    code = w.copy()
    out = np.zeros((len(w), len(ORDERS)), np.int32)
    for k in range(2, max(ORDERS) + 1):
        code[: -(k - 1)] |= w[k - 1 :] << np.uint32(8 * (k - 1))
        if k in ORDERS:
            out[:, ORDERS.index(k)] = (code * np.uint32(2654435761) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    # grams that would pass a text's end start in its last bytes; these give no gram at all
    live = np.ones(len(w), bool)
    for k in range(1, max(ORDERS)):
        live[np.maximum(at[1:] - k, at[:-1])] = False
    return out[live].ravel(), np.concatenate([[0], np.cumsum(live)])[at] * len(ORDERS)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # embeddings times weights, times the temperature
    bias: np.ndarray
    floor: float

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum over a text's grams, and their number. A text beyond SCORED is cut at blanks into pieces, whose sums add up."""
        if len(data) > 2 * SCORED and len(offsets) == 2:
            total, n, at = np.zeros((1, len(self.langs))), np.zeros(1, np.int64), 0
            while at < len(data):
                end = min(len(data), at + SCORED)
                blank = np.flatnonzero(data[end - min(SCORED // 2, end - at) : end] == 32) if end < len(data) else ()
                end = end - min(SCORED // 2, end - at) + int(blank[-1]) + 1 if len(blank) else end
                part, m = self.sums(data[at:end], np.array([0, end - at]))
                total, n, at = total + part, n + m, end
            return total, n
        g, at = grams(data, offsets)
        n = np.diff(at)
        sums = np.zeros((len(n), len(self.langs)))
        if len(g):
            has = np.flatnonzero(n)
            sums[has] = np.add.reduceat(self.table[g], at[:-1][has], axis=0, dtype=np.float64)
        return sums, n

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums, n = self.sums(data, offsets)
        z = sums / np.maximum(1, n)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def trained(texts: list[str], y: np.ndarray, langs: tuple[str, ...], seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    raw = [t.encode() for t in texts]
    cuts = []
    for t, label, h in zip(raw, y, held, strict=True):
        if not h:
            cuts.append((t, label))
            i, size = int(rng.integers(0, max(1, len(t) - 10))), int(rng.integers(10, 120))
            cuts.append((t[i : i + size], label))
    bags = []
    data, offsets = text_bytes(pa.array([t for t, _ in cuts], pa.binary()))
    for i, j in runs(offsets):
        g, at = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            u, c = np.unique(g[at[k] : at[k + 1]], return_counts=True)
            if len(u):
                bags.append((u, (c / c.sum()).astype(np.float32), cuts[i + k][1]))
    table = (rng.uniform(-1, 1, (1 << BITS, WIDTH)) / WIDTH).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            u, c, label = bags[k]
            rows = table[u]
            v = c @ rows
            z = v @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            table[u] = rows - (rate * c)[:, None] * (weights @ p)
            weights -= rate * np.outer(v, p)
            bias -= np.float32(0.1) * rate * p
            step += 1
    model = Model(langs, table @ weights, bias.astype(float), 0.0)
    data, offsets = text_bytes(pa.array([t for t, h in zip(raw, held, strict=True) if h], pa.binary()))
    truth = y[held]
    p = np.concatenate([model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in runs(offsets)]) if held.any() else np.full((1, len(langs)), 1 / len(langs))
    truth = truth if held.any() else np.zeros(1, int)
    z = np.log(np.maximum(p, 1e-30))

    def tempered(t: float) -> np.ndarray:
        e = np.exp(t * (z - z.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    t = min(grid, key=lambda t: -np.log(np.maximum(tempered(t)[np.arange(len(truth)), truth], 1e-6)).mean())
    q = tempered(t)
    right = q.max(1)[q.argmax(1) == truth]
    floor = min(CEILING, float(np.quantile(right, MISSED))) if len(right) else 0.0
    return Model(langs, (t * model.table).astype(np.float32), t * model.bias, floor)


def fitted(docs: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model | None:
    """Learns from documents outside the fold alone."""
    own = docs.where((bucket_of(F.col("doc_id"), FOLDS) != FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = [(t, lang) for _, t, lang in labelled_texts(docs, own.select("doc_id", "lang"), "lang", per_class, max_chars, seed=9) if any(c.isalpha() for c in t)]
    langs = tuple(sorted({lang for _, lang in rows}))
    if not langs:
        return None
    return trained([t for t, _ in rows], np.array([langs.index(lang) for _, lang in rows]), langs)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    def any_of(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]) > 0

    ascii_, high = any_of(IS_LETTER[data]), any_of(data >= 0x80)
    for i in np.flatnonzero(~ascii_ & high):
        ascii_[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return ascii_


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the columns lang_pred, score and rejected; those three replace columns of these names."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    plain = docs.select(*names)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            pred, score, out = [], [], []
            for i, j in runs(offsets, SCORED) if model else ():
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                p, known = model.scores(d, o), _lettered(d, o)
                pred += [model.langs[k] if x else "und" for k, x in zip(p.argmax(1), known, strict=True)]
                best = np.where(known, p.max(1), 0.0)
                score.append(best)
                out.append(~known | (best < model.floor))
            n = len(b)
            yield pa.record_batch([*b.columns, pa.array(pred if model else ["und"] * n, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(n)), pa.array(np.concatenate(out) if out else np.ones(n, bool))], [*b.schema.names, "lang_pred", "score", "rejected"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema) + "lang_pred string, score double, rejected boolean"
    return plain.mapInArrow(tidy(predict), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == FOLD, F.lit(False))
    return languages(docs.select("doc_id", "text"), fitted(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
