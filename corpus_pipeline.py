"""A corpus pipeline over documents: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again as the next
stage's docs. All but the last return the columns of documents, whatever their names.

Nulls, ties and odd tables, by stage: a null text, an empty one or one without a letter is rejected by `language`, so later stages see none
of them (given docs of their own, they leave a null or empty text as it is, and packing gives it its end id alone). Rows with a null
doc_id keep their lines, are near duplicates of nothing, and are mixed and packed like others. Equal rows lose the same lines, stay or
go together, and are packed each for itself. Very long texts are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import langid, line_dedup, mixing, ngram_join, packing
from glyphloom.llm.common import BROADCAST_BYTES, documents, heap_returned, removed, written
from glyphloom.llm.tokens import vocabulary

#: Epochs that the mix may repeat a document.
EPOCHS = 2


def _of(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """The columns of docs from stage(docs), with docs' own values in columns of names that the stage makes."""
    own = {c: f"__own_{c}" for c in docs.columns if c in made}
    return stage(docs.withColumnsRenamed(own)).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or a score below the calibrated floor."""
    return _of(docs, lambda d: langid.languages(d, langid.fitted(d)).where(~F.col("rejected")), "lang_pred", "score", "rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; a document that loses all its words goes."""

    def stage(d: DataFrame) -> DataFrame:
        out = line_dedup.deduplicated_lines(d)
        out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))

    return _of(docs, stage, "n_lines", "n_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity connect, the one with the smallest doc_id stays. Rows of one doc_id go only if all of them would."""
    found = ngram_join.similar_documents(docs, count_links=False)
    gone = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__gone")).agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("__all"))
    gone, _ = written(gone.where("__all = 1").select("__gone"), "gone")
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""

    def stage(d: DataFrame) -> DataFrame:
        return mixing.mixed(d, max_epochs=EPOCHS).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    return _of(docs, stage, "domain", "n_tokens", "copies")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows."""
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _light(stage: Stage) -> Stage:
    """stage, which starts without the heap that the stages before it have left to the executors."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        heap_returned(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [(stage.__name__, _light(stage)) for stage in (language, lines, near_duplicates, mix, packed)]

#: SQL can't express the classifier, the alignment or the packing; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES:
        out, new = written(stage(spark, docs, sf_dir), name)
        if path:
            removed(spark, path)
        docs, path = out, new
    return docs
