"""What several operators share: written intermediate tables, white space, batches of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyshelf.session import fresh_path

#: runs of white space that one blank does not already stand for
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once below the shared folder and read back; cuts lineage, outlives executors.

    Nothing reads the shuffles of the writing job again, so Spark drops their files when it ends.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def side(df: DataFrame) -> DataFrame:
    """A grouped table, written so that a join with what it was grouped from is one of two shuffles.

    Joined at once, it would bring its own partitioning, and a key that holds a large part of the rows could not be split.
    """
    return stored(df, "side")


def normalized(text: Column) -> Column:
    """Text with every run of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part` modulo `parts`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def byte_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each value begins (one more than values). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in pieces of about `most` bytes of a text column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        yield batch.slice(begin)


def kept_rows(docs: DataFrame, decisions: DataFrame, key: dict[str, Column]) -> DataFrame:
    """The rows of `docs` that `decisions` keeps (doc_id, further columns as in `key`, kept), one of equal rows.

    key: names of columns of `decisions`, with what gives them for a row of `docs`.
    """
    decisions = stored(decisions.select("doc_id", *key, "kept"), "decisions")
    rows = docs.withColumns({f"_{name}_of_row": value for name, value in key.items()})
    same = [rows["doc_id"].eqNullSafe(F.col("k.doc_id")), *(F.col(f"_{name}_of_row") == F.col(f"k.{name}") for name in key)]
    kept = rows.join(decisions.filter("kept").alias("k"), same, "left_semi")
    if not decisions.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", *(f"_{name}_of_row" for name in key)])
    return kept.select(*docs.columns)
