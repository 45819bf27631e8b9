"""Keyed counts: requests per key and the word count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[ \t\n\r\f\x0B]+"


def keyed_count(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Sum of one per row for each key; partial sums are taken before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(F.lit(1).cast("long")).alias(name))


def word_count(df: DataFrame, text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """Occurrences of each whitespace-separated word."""
    content = F.col(text) if case_sensitive else F.lower(F.col(text))
    words = df.select(F.explode(F.split(content, WHITESPACE)).alias("word")).where(F.col("word") != "")
    return keyed_count(words, "word")


def word_count_file(spark: SparkSession, source: str, target: str, case_sensitive: bool = True) -> None:
    """Count the words of text files and write ``word<TAB>n`` lines."""
    counts = word_count(spark.read.text(source), "value", case_sensitive)
    counts.select("word", "n").write.mode("errorifexists").option("sep", "\t").csv(target)
