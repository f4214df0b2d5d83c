"""CSV records that may hold line breaks in quotes, cut by many tasks from the splits of a file.

A line break ends a record only outside quotes, and whether a split begins inside quotes depends on all before it. Two
passes settle that: the first counts the quotes of each split, whose parities, summed up in file order, tell how each
split begins; the second cuts the lines of a split into records from there on. What a split's edges cut apart, two pieces
at most, is put together by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.session import fresh_path

WHOLE, HEAD, MIDDLE, TAIL = range(4)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins) and value of each line; the lines of a split follow each other."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def quote_counts(lines: DataFrame) -> DataFrame:
    """file, block, odd: whether the quotes of a split are odd in number."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file", "block").agg((F.sum(quotes) % 2 == 1).alias("odd"))


def split_states(counts: DataFrame) -> DataFrame:
    """file, block, inside and ends_inside: whether a split begins, and ends, inside quotes; and whether it is the last."""
    order = Window.partitionBy("file").orderBy("block")
    upto = F.sum(F.col("odd").cast("int")).over(order) % 2 == 1
    return counts.select("file", "block", (upto != F.col("odd")).alias("inside"), upto.alias("ends_inside"), F.lead("block").over(order).isNull().alias("last"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of records at the edges of splits, of a task's lines, one split after the other."""
    split, inside, kind, fresh = None, False, WHOLE, False
    held = pa.array([], pa.string())  # lines of the record that is open

    def piece(records: pa.Array, first_kind: int) -> pa.RecordBatch:
        nonlocal fresh
        n = len(records)
        kinds, header = np.full(n, WHOLE, np.int32), np.zeros(n, bool)
        kinds[0], header[0], fresh = first_kind, fresh, False
        columns = [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array(kinds), pa.array(header), records]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "header", "record"])

    def joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lines), "\n")

    def remainder() -> Iterator[pa.RecordBatch]:
        if len(held):
            yield piece(joined(held, np.array([len(held)])), MIDDLE if kind == HEAD else TAIL)

    for batch in batches:
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        edges = (np.flatnonzero((np.diff(file.indices.to_numpy()) != 0) | (np.diff(block) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
            if a == b:
                continue
            here = (file[a].as_py(), int(block[a]))
            if here != split:
                yield from remainder()
                split, inside, held, fresh = here, batch.column("inside")[a].as_py(), held.slice(0, 0), here[1] == 0
                kind = HEAD if inside else WHOLE
            part = batch.column("value").slice(a, b - a)
            odd = (np.cumsum(pc.count_substring(part, '"').to_numpy() % 2) + inside) % 2 == 1
            ends = np.flatnonzero(~odd) + 1 + len(held)
            inside = bool(odd[-1])
            lines = pa.concat_arrays([held, part])
            upto = int(ends[-1]) if len(ends) else 0
            if upto:
                yield piece(joined(lines.slice(0, upto), ends), kind)
                kind = WHOLE
            held = lines.slice(upto)
    yield from remainder()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record: the text of every CSV record, without the first of each file, its header, and without empty lines.

    Quotes are doubled within quoted fields, and a field that holds one is quoted; a file whose quotes do not end is refused.
    Line breaks are kept as they are in quotes; outside them a record ends with a line feed, or a carriage return before it.
    The states of the splits are found at once and written; two numbers for each split that begins or ends inside
    quotes, of some 128 MB, go to all tasks.
    """
    lines = split_lines(spark, path)
    states = fresh_path(spark, "splits")
    split_states(quote_counts(lines)).write.parquet(states)
    states = spark.read.parquet(states)
    if unended := states.where("last and ends_inside").select("file").head():
        raise ValueError(f"quotes without an end: {unended['file']}")
    marked = states.where("inside or ends_inside").select(F.xxhash64("file").alias("_file"), F.col("block").alias("_block"), "inside")
    same = (F.xxhash64("file") == F.col("_file")) & (F.col("block") == F.col("_block"))

    def cut(how: str) -> DataFrame:
        of_split = lines.join(F.broadcast(marked), same, how).select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
        return of_split.mapInArrow(_pieces, "file string, block long, kind int, header boolean, record string")

    records = cut("left").where((F.col("kind") == WHOLE) & ~F.col("header")).select("record")
    if not marked.isEmpty():
        edges = cut("inner").where(F.col("kind") != WHOLE)
        chain = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
        pieces = F.sort_array(F.collect_list(F.struct("block", "kind", "record")))
        whole = edges.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"), F.max("header").alias("header"))
        records = records.unionByName(whole.where(~F.col("header")).select("record"))
    records = records.select(F.regexp_replace("record", r"\r\z", "").alias("record"))
    return records.where("record <> ''")
