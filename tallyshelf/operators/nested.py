"""Lists of records and lists of genres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import list_items


def explode_records(df: DataFrame, records: str) -> DataFrame:
    """One row per list element; an empty or missing list keeps one row with a null element."""
    return df.withColumn(records, F.explode_outer(records))


def flatten_struct(df: DataFrame, record: str) -> DataFrame:
    """Fields of a record as columns beside the others."""
    others = [name for name in df.columns if name != record]
    return df.select(*others, f"{record}.*")


def flatten_records(df: DataFrame, records: str) -> DataFrame:
    return flatten_struct(explode_records(df, records), records)


def explode_genres(df: DataFrame, genres: str = "genres") -> DataFrame:
    """One row per genre; takes an array or a list kept as text."""
    column = F.col(genres)
    if df.schema[genres].dataType.typeName() == "string":
        items = list_items(column)
    else:
        items = F.transform(column, lambda genre: F.trim(genre))
    return df.withColumn(genres, F.explode(items))
