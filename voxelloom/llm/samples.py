"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, label and text of at most ``per_class`` labelled documents with label 0 and as many with label 1.

    The documents are those whose keys hash lowest, so the sample is the same in every run. Null keys and labels are left out;
    of several labels of a key the greatest holds, of several texts the smallest.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"))
    there = known.join(docs.select(key).distinct(), key, "left_semi")
    order = (F.xxhash64(key), F.col(key))
    zero, one = (there.filter(F.col("_label") == value).orderBy(*order).limit(per_class) for value in (0, 1))
    chosen = F.broadcast(zero.unionByName(one))  # at most 2 * per_class rows
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(chosen, key)
    return rows.groupBy(key, "_label").agg(F.min("_text").alias(text)).withColumnRenamed("_label", label)
