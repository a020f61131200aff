"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash space of the sampling rule.
SPACE = 1 << 30


#: Rows of all classes together: where there are many classes, each has fewer.
TOTAL = 60_000


def spread(ids: DataFrame, label: str, per_class: int, seed: int, total: int = TOTAL) -> DataFrame:
    """Of rows (doc_id, label): about per_class of each label, by a hash of doc_id; less (one at least) where all labels together had more than total."""
    counts = ids.groupBy(label).agg(F.count("*").alias("__n"))
    classes = counts.count()
    each = max(1, min(per_class, total // max(1, classes)))
    share = F.least(F.lit(SPACE).cast("double"), F.floor(F.lit(float(SPACE * each)) / F.col("__n")))
    chosen = ids.join(counts, label).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SPACE)) < share)
    return chosen.drop("__n")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, seed: int = 11, values: tuple | None = None) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of about per_class documents of each class with at most max_chars characters, in order of a hash. values: the labels that count.

    The ids are drawn from the narrow table of labels first; only they are broadcast, and only their texts move.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    ids = ids if values is None else ids.where(F.col("label").isin(list(values)))
    drawn = spread(ids, "label", per_class, seed).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label", F.xxhash64("doc_id", F.lit(seed + 1)).alias("at")).collect()  # about TOTAL rows at most
    return [(r["doc_id"], r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["at"], r["doc_id"], r["text"]))]
