import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.session import ship_package
from voxelloom.sources import seqfile, sequence

RNG = np.random.default_rng(12)
HADOOP_WRITER = "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat"


def rows_of(df):
    return sorted((r["path"], bytes(r["content"])) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Payloads from none to far beyond the distance of two sync markers, one made of escapes only."""
    sizes = [0, 1, 127, 128, 70_000, 400_000, *RNG.integers(0, 30_000, 60).tolist()]
    made = [(f"key {i} é", RNG.bytes(n)) for i, n in enumerate(sizes)]
    return sorted([*made, ("e", b"\xff" * 5000), ("k" * 300, b"long key"), ("", b"no key"), ("e", b"\xff" * 5000)])


@pytest.fixture(scope="module")
def frame_of(spark, rows):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "name string, pixels binary").repartition(3)


@pytest.fixture(scope="module")
def ours(frame_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seq") / "ours")
    sequence.write_sequence(frame_of, path)
    return path


def test_round_trip_through_the_format(spark, ours, rows):
    assert rows_of(sequence.read_sequence(spark, ours)) == rows
    assert rows_of(spark.read.format(seqfile.FORMAT).load(f"file://{ours}")) == rows
    assert rows_of(spark.read.format(seqfile.FORMAT).load(f"file:{ours}")) == rows


@pytest.mark.parametrize("split", [1000, 50_000, 150_000, 10**9])
def test_every_record_lies_in_one_split(spark, ours, rows, split):
    df = spark.read.format(seqfile.FORMAT).option("splitBytes", split).load(ours)
    if split > 1000:
        assert rows_of(df) == rows
        return
    reader = seqfile.Reader(ours, split)
    found = [(k, v) for part in reader.partitions() for b in reader.read(part) for k, v in zip(b["path"].to_pylist(), b["content"].to_pylist())]
    assert sorted(found) == rows and len(reader.partitions()) > 100


def test_other_writers_and_readers_agree(spark, ours, frame_of, rows, tmp_path):
    theirs, packed = str(tmp_path / "theirs"), str(tmp_path / "packed")
    pairs = frame_of.rdd.map(lambda r: (r[0], r[1]))
    pairs.saveAsNewAPIHadoopFile(theirs, HADOOP_WRITER, keyClass=seqfile.TEXT, valueClass=seqfile.BYTES)
    for split in (20_000, 10**9):
        assert rows_of(spark.read.format(seqfile.FORMAT).option("splitBytes", split).load(theirs)) == rows
    assert rows_of(sequence.read_sequence(spark, ours, compressed=True)) == rows
    conf = {"mapreduce.output.fileoutputformat.compress": "true"}
    pairs.saveAsNewAPIHadoopFile(packed, HADOOP_WRITER, keyClass=seqfile.TEXT, valueClass=seqfile.BYTES, conf=conf)
    assert rows_of(sequence.read_sequence(spark, packed, compressed=True)) == rows
    with pytest.raises(Exception, match="compressed"):
        sequence.read_sequence(spark, packed).collect()


def test_small_files_share_a_task_and_hidden_ones_are_passed_over(spark, ours, tmp_path):
    files = sorted(p for p in __import__("pathlib").Path(ours).iterdir() if p.name.startswith("part-"))
    for n in range(20):
        (tmp_path / f"part-{n}").write_bytes(files[n % 3].read_bytes())
    (tmp_path / "_log").write_text("no records")
    (tmp_path / "part-empty").write_bytes(b"")
    df = sequence.read_sequence(spark, str(tmp_path))
    assert df.select(F.spark_partition_id()).distinct().count() == 1
    assert df.count() >= 6 * sequence.read_sequence(spark, ours).count()


def test_what_cannot_be_read_or_written_is_named(spark, ours, tmp_path):
    whole = next(p for p in __import__("pathlib").Path(ours).iterdir() if p.name.startswith("part-")).read_bytes()
    for name, content, why in (("cut", whole[:-1], "ends within a record"), ("text", b"hello world", "not a sequence file")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match=why):
            sequence.read_sequence(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sequence.read_sequence(spark, str(tmp_path / "missing")).collect()
    with pytest.raises(FileExistsError, match="already exists"):
        sequence.write_sequence(spark.createDataFrame([("a", b"b")], "name string, pixels binary"), ours)
    with pytest.raises(Exception, match="needs a key and a payload"):
        sequence.write_sequence(spark.createDataFrame([("a", None)], "name string, pixels binary"), str(tmp_path / "null"))
    assert not [p for p in tmp_path.glob("null/*") if not p.name.startswith(("_", "."))]


def test_nothing_is_written_of_an_empty_table(spark, tmp_path):
    sequence.write_sequence(spark.createDataFrame([], "name string, pixels binary"), str(tmp_path / "none"))
    assert sequence.read_sequence(spark, str(tmp_path / "none")).count() == 0


def test_lengths():
    for n in (0, 127, 128, 255, 256, 65_535, 65_536, 2**31 - 1):
        assert seqfile.read_length(io.BytesIO(seqfile.packed_length(n))) == n
    with pytest.raises(ValueError):
        seqfile.read_length(io.BytesIO(struct.pack("b", -121)))


def test_a_new_session_knows_the_format(spark, ours):
    other = spark.newSession()
    ship_package(other)
    assert sequence.read_sequence(other, ours).count() == sequence.read_sequence(spark, ours).count()
