"""Operator 8, quality rules: boosted trees over document statistics.

Statistics come from one pass with numpy over the UTF-8 bytes of whole texts. Trees are grown on binned statistics of about
per_class labelled texts of each class (at most max_chars characters each), with the logistic loss; on the statistics in
MONOTONE a split may only lower (-1) or raise (1) the score from left to right. The trees are then flattened into arrays
of features, thresholds, children and values, and all documents of a batch walk down a tree at once.

Nulls and ties: a null text is an empty one; it has no words and fails the base rules. Repeated or null ids are judged each for
itself. Without labels of both classes the base rules alone decide. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, SpanHash, bucket_of, documents, mix64, runs, text_bytes, words_of
from .sampling import labelled_texts

SYMBOLS = b"#*$%&|<>"
PER_CLASS, MAX_CHARS, TREES, DEPTH, BINS, RATE, THRESHOLD, SPAN = 2500, 50_000, 60, 3, 32, 0.2, 0.3, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, with the direction that a constraint allows.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bang_share", "line_words", "alien_share")
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


IS_SYMBOL, IS_UPPER, IS_DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
IS_MARK, IS_BANG = _table(b".,;:!?'\"()-"), _table(b"!?")
HASH = SpanHash(seed=8)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, has = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(has):
        out[has] = np.add.reduceat(flags, offsets[:-1][has], dtype=np.int64)
    return out


def _repeated(texts: np.ndarray, keys: np.ndarray, keep: str | bool) -> np.ndarray:
    """Where (text, key) occurs again in the same text."""
    return pd.Series(mix64(keys + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated(keep=keep).to_numpy()


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of texts data[offsets[i]:offsets[i+1]]; offsets[0] is 0."""
    n = len(offsets) - 1
    starts, ends, cut = words_of(data, offsets)
    words = np.diff(cut)
    heads = (data & 0xC0) != 0x80
    chars = _sums(heads & ~IS_SPACE[data], offsets)
    symbols = _sums(IS_SYMBOL[data], offsets)
    # lines: between newlines and the edges of texts
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([breaks + 1, offsets[:-1]])  # a line after a text's last newline comes before the next text's first
    order = np.argsort(first, kind="stable")
    first, text = first[order], np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])[order]
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, first)
    first, line_end, text = first[worded], line_end[worded], text[worded]
    n_lines = np.bincount(text, minlength=n)
    dup = np.bincount(text[_repeated(text, HASH(data, first, line_end), "first")], minlength=n)
    # words in windows that occur again
    of = np.repeat(np.arange(n), words)
    key = HASH(data, starts, ends)
    covered = np.zeros(len(key) + 1, np.int64)
    if len(key) >= SPAN:
        m = len(key) - SPAN + 1
        window = np.zeros(m, np.uint64)
        for j in range(SPAN):
            window += key[j : j + m] * np.uint64(2 * j + 1 + (j << 40))
            window = mix64(window)
        inside = np.flatnonzero(of[:m] == of[SPAN - 1 :])
        again = inside[_repeated(of[inside], window[inside], False)]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + SPAN, 1)
    repeat = np.bincount(of[np.cumsum(covered[:-1]) > 0], minlength=n)
    size = np.maximum(1, np.diff(offsets))
    w = np.maximum(1, words)
    out = {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    out |= {"mean_word": chars / w, "symbols_per_word": symbols / w, "dup_line_share": dup / np.maximum(1, n_lines), "repeat_share": repeat / w, "line_words": words / np.maximum(1, n_lines)}
    for name, table in (("upper_share", IS_UPPER), ("digit_share", IS_DIGIT), ("mark_share", IS_MARK), ("bang_share", IS_BANG)):
        out[name] = _sums(table[data], offsets) / size
    out["alien_share"] = _sums(data >= 0x80, offsets) / size
    return out


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays. A leaf is its own child; roots has each tree's first node."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Boosted trees with the logistic loss. signs: a constraint for each feature; children keep to bounds from their ancestors' splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    base = 0.0
    z = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def node(rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), lo, hi))
        best = (1e-6, None, None, 0.0, 0.0)
        if level < depth and len(rows) >= 20:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = (np.clip(-a / (b + ridge), lo, hi) for a, b in ((gs, hs), (total_g - gs, total_h - hs)))
                loss = lambda v, a, b: a * v + 0.5 * (b + ridge) * v * v
                gain = loss(value, total_g, total_h) - loss(vl, gs, hs) - loss(vr, total_g - gs, total_h - hs)
                ok = (ns >= 8) & (len(rows) - ns >= 8) & ((vr - vl) * signs[f] >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k, vl[k], vr[k])
        if best[1] is None:
            return leaf(rate * value)
        _, f, k, vl, vr = best
        at = len(nodes)
        nodes.append([f, edges[f][k], at, at, 0.0])
        goes_left, middle = bins[rows, f] <= k, (vl + vr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[int(signs[f])]
        nodes[at][2] = node(rows[goes_left], level + 1, *bounds[0], g, h)
        nodes[at][3] = node(rows[~goes_left], level + 1, *bounds[1], g, h)
        return at

    def predict(root: int) -> np.ndarray:
        at = np.full(len(y), root)
        flat = [np.array(c) for c in zip(*nodes, strict=True)]
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), flat[0][at].astype(int)] <= flat[1][at], flat[2][at], flat[3][at]).astype(int)
        return flat[4][at]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(node(np.arange(len(y)), 0, -4.0, 4.0, g, h))
        z = z + predict(roots[-1])
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), f.astype(int), t.astype(float), left.astype(int), right.astype(int), v.astype(float), base, depth)


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[f].astype(float) for f in FEATURES], 1)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Trees | None:
    own = labels.where(bucket_of(F.col("doc_id"), 5) != 0)
    rows = labelled_texts(docs, own, label, per_class, max_chars, seed=8, values=(0, 1))
    y = np.array([int(v) for _, _, v in rows])
    if not len(y) or min(y.sum(), len(y) - y.sum()) < 8:
        return None
    data, offsets = text_bytes(pa.array([t for _, t, _ in rows], pa.string()))
    x = np.concatenate([matrix(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in runs(offsets)])
    weight = np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum())) * len(y) / 2
    return grown(x, y, weight, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def quality_verdicts(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the COUNTS, base_failed, score, kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in runs(offsets):
                stats = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = model.scores(matrix(stats)) if model else np.ones(j - i)
                failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), *(pa.array(stats[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_verdicts(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("score")
