"""The pipeline: stages chained over the test tables, each against its operator's brute force where it has one, odd input."""

import corpus_pipeline  # noqa: I001
from pyspark.sql import functions as F

from voxelloom.llm.common import words

BASE = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_test_tables(spark, medium, tmp_path):
    small = medium
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    item_words = [words(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    passages = {tuple(w[at : at + 10]) for w in item_words for at in range(max(1, len(w) - 9)) if w}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == BASE
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            assert all(after[i] == before[i] for i in after) and sum(labels.get(i) == 0 for i in gone) <= 1
            assert sum(labels.get(i) == 1 for i in gone) >= 0.6 * sum(labels.get(i) == 1 for i in before)
        elif name == "line_dedup":
            assert not gone and all(set(after[i].split("\n")) <= {*before[i].split("\n"), ""} for i in after)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "near_dedup":
            kept = {tuple(words(t)) for t in after.values()}
            assert len(kept) >= len(after) - sum(not words(t) for t in after.values()) and all(after[i] == before[i] for i in after)
        else:
            hit = {i for i, t in before.items() if any(tuple(words(t)[at : at + 10]) in passages for at in range(len(words(t))))}
            short = {p for p in passages if len(p) < 10}
            assert gone >= hit and (short or gone == hit)
        docs = out


def test_run_equals_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert per and all(r["n"] == r["end"] <= 2048 for r in per)


def test_odd_rows(spark, small, odd, empty):
    for table in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            assert out.count() <= (table.count() if name != "packing" else 10**6)
            if name != "packing":
                assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema]


def test_stages_name_five_of_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
