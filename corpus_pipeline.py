"""From documents to packed training sequences, in five stages.

Each stage takes the rows its predecessor kept and returns documents with the same columns; the last one returns the pieces
of the packed sequences. ``run`` writes what each stage returns as Parquet in the shared checkpoint folder and reads it back,
so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import decontamination, lines, near_duplicates, packing, toxicity
from voxelloom.llm.common import prepared, scratch_folder, shielded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; it learns from the labelled ones among ``docs``."""
    rows, restored = shielded(docs, "doc_id", "text")
    rated = toxicity.severity(rows, table(spark, sf_dir, "labels"))
    return restored(rated.filter(~F.col("toxic")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat; n_chars follows the text. A null text stays null."""
    prepared(spark)
    rows, restored = shielded(docs, "doc_id", "text")
    kept = restored(lines.dedup_lines(rows))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id."""
    prepared(spark)
    return near_duplicates.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark, or a whole shorter item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    prepared(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learned model and a tokenizer file have no form in SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        where = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return STAGES[-1][1](spark, docs, sf_dir)
