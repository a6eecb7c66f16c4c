"""The corpus pipeline: toxicity, language, lines, near duplicates, packing.

Every stage takes all documents its predecessor kept and returns documents with the
same columns; the last one returns the packed pieces.  ``run`` writes the result of
each stage as Parquet in the shared folder and reads it back, so a lost executor costs
tasks of the stage at hand only.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import table
from rankwell.llm.langid import keep_identified
from rankwell.llm.line_dedup import dedup_lines
from rankwell.llm.ngram_join import near_duplicates
from rankwell.llm.packing import pack_documents
from rankwell.llm.toxicity import drop_toxic
from rankwell.session import written

#: Rows in one transfer to a Python worker.  Texts are long, and the JVM keeps the largest
#: buffers it ever needed, so all stages together must get along with small ones.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    NULL and empty texts stay; repeated rows are judged alike; without labels or documents
    nothing goes; very long texts are read whole; all columns stay, whatever their names.
    """
    _small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or between languages, go.

    So NULL, empty and blank texts go; repeated rows are judged alike; without documents
    nothing is learned and nothing stays; very long texts are read whole; all columns stay,
    whatever their names.
    """
    _small_batches(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood in an earlier place go, and documents that lose all their words.

    NULL, empty and blank texts lose nothing and stay; of equal rows the lines of one stay;
    very long texts are read whole; an empty table gives an empty table; a column with the
    name of the report is kept, as the report takes another name.
    """
    _small_batches(spark)
    report = "line report"
    while report in docs.columns:
        report += "_"
    out = dedup_lines(docs, report=report)
    emptied = (F.col(f"`{report}`")["n_removed"] > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    left = out.filter(~emptied)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; equal rows are one.

    NULL and empty texts are linked with nothing and stay; rows of one id and text are one;
    very long texts are compared whole; an empty table gives an empty table; columns with
    the names used here are kept, as those take other names.
    """
    _small_batches(spark)
    component, key = "component of id", "component key"
    while {component, key} & set(docs.columns):
        component, key = component + "_", key + "_"
    linked = near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(linked, docs["doc_id"] == F.col(f"`{key}`"), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their place in sequences of 2048 tokens.

    NULL and empty texts are one token; every repeated row is packed; texts of any length
    are cut into pieces; an empty table gives an empty table; other columns are not read.
    """
    _small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
