"""Operator 2, quality classifier by compression.

Two zstandard dictionaries are trained on good and on bad labelled texts. Every whole text is compressed with either, in
independent blocks of BLOCK bytes (in longer ones a text's own beginning would outweigh the dictionary). The difference of the
sizes over their sum (plus STEADY bytes, so that a few words decide little) goes through a logistic curve that is fitted on labelled texts the dictionaries haven't seen
and on short cuts of them.

Fitting takes about per_class texts of each class of at most max_chars characters, with a hash of doc_id that isn't 0 modulo
FOLDS; all else is a single pass over the documents in bounded memory.

Nulls and ties: a null or empty text has no sizes and gets the score of a zero difference. Documents without labels, repeated
ids and null ids are scored like any other. Without labels of both classes every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, documents
from .sampling import labelled_texts

FOLDS, PER_CLASS, MAX_CHARS, DICTIONARY, LEVEL, BLOCK, STEADY, THRESHOLD = 5, 1500, 50_000, 112_640, 3, 4096, 100, 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model, self.pair = model, []
        for d in (model.good, model.bad) if model.good else ():
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        good = bad = 0
        if self.pair and text:
            g, b = self.pair
            for i in range(0, len(text), BLOCK):
                part = text[i : i + BLOCK]
                good += len(g.compress(part))
                bad += len(b.compress(part))
        return (bad - good) / (bad + good + STEADY) if good else 0.0

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * differences + self.model.offset, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton's method on the standardised input."""
    mean, sd = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    a = np.stack([(x - mean) / sd, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    import zstandard

    own = labels.where(bucket_of(F.col("doc_id"), FOLDS) != 0)
    rows = [(t.encode(), int(y)) for _, t, y in labelled_texts(docs, own, label, per_class, max_chars, values=(0, 1)) if t.strip()]
    by = {y: [t for t, z in rows if z == y] for y in (1, 0)}
    if min(map(len, by.values())) < 8:
        return Model(b"", b"", 0.0, 0.0)
    dictionaries = []
    for texts in by.values():
        seen = [t[i : i + BLOCK] for t in texts[: len(texts) * 3 // 4] for i in range(0, len(t), BLOCK)]
        size = min(DICTIONARY, max(1024, sum(map(len, seen)) // 8))
        try:
            dictionaries.append(zstandard.train_dictionary(size, seen, k=200, d=8, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little to find common parts in: the texts themselves are the dictionary
            dictionaries.append(zstandard.ZstdCompressionDict(b"\n".join(seen)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes())
    scorer = Scorer(Model(*dictionaries, 1.0, 0.0))
    rng = np.random.default_rng(2)
    unseen = []
    for y, texts in by.items():
        for t in texts[len(texts) * 3 // 4 :]:  # the whole text, and a short cut of it: short texts count as much in the fit
            at, size = int(rng.integers(0, max(1, len(t) - 20))), int(rng.integers(10, 300))
            unseen += [(scorer.difference(t), y), (scorer.difference(t[at : at + size]), y)]
    x, y = (np.array(v, float) for v in zip(*unseen, strict=True))
    weight = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * len(y) / 2
    return Model(*dictionaries, *logistic(x, y, weight))


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, difference, score, predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            x = np.array([scorer.difference(texts[i].as_py() or b"") for i in range(len(texts))])
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.float64()), pa.array(scorer.scores(x), pa.float64())], ["doc_id", "difference", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, difference double, score double")
    held = F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "difference", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model).select("doc_id", "held_out", "score", "predicted")
