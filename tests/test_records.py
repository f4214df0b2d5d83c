"""CSV records across splits, against the csv module."""

import csv
import random

import pytest
from pyspark.sql import types as T

from tallyshelf.sources import files, records

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def written(path, rows, header=("a", "b", "c"), end="\n"):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_csv_module(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for number in range(3):
        marks = ["x", '"', ",", "\n", "\r\n", " ", "é", "word "]
        texts = ["".join(rng.choice(marks) for _ in range(rng.choice([1, 3, 20, 500]))) for _ in range(rng.choice([0, 1, 30]))]
        rows = [(number * 100 + i, f"<{text}>", "z") for i, text in enumerate(texts)]
        header = ("a", "b", "c" if rng.random() < 0.5 else 'c\nx "y" ' * 60)  # a header longer than a split
        written(f"{tmp_path}/{number}.csv", rows, header, rng.choice(["\n", "\r\n"]))
        want += rows
    got = files.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert records.split_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3


def test_a_record_of_many_splits_in_one_file(spark, small_splits, tmp_path):
    rows = [(1, "a\n" * 2000, "z"), (2, '"\n"', "y"), (3, "plain", "x\n\ny")]
    written(f"{tmp_path}/one.csv", rows)
    frame = files.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert records.split_lines(spark, str(tmp_path)).select("block").distinct().count() > 8
    assert sorted(map(tuple, frame.collect())) == rows


def test_ragged_rows_and_empty_lines(spark, small_splits, tmp_path):
    (tmp_path / "ragged.csv").write_text('a,b,c\n1,x,2\n\n2,y\n3,z,4,5\n4,"multi\nline ""q"", x",6\r\n\r\n7,w,8,\n')
    kept = files.read_csv_skip_long_rows(spark, str(tmp_path), SCHEMA, multi_line=True).collect()
    assert sorted(map(tuple, kept)) == [(1, "x", "2"), (2, "y", None), (4, 'multi\nline "q", x', "6")]
    long = files.read_csv_long_rows(spark, str(tmp_path), SCHEMA, multi_line=True).collect()
    assert sorted(r["row"] for r in long) == ["3,z,4,5", "7,w,8,"]


def test_quotes_without_an_end_are_refused(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b,c\n1,"x,2\n2,y,3\n')
    with pytest.raises(ValueError, match="open.csv"):
        files.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)


def test_a_header_alone_and_an_empty_file(spark, tmp_path):
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "none.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True).collect() == []
