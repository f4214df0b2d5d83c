"""Duplicates, nulls and typed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.values import map_price_text, nan_to_null, to_date, to_number
from tallyshelf.session import fresh_path


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct; nulls are equal to each other."""
    return df.dropDuplicates()


def count_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row. Copies collapse before they are shuffled."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def _by_digest(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose digest no other row has, and the others.

    The digests are two 64-bit hashes of all columns; only they are shuffled. Those that repeat are written, so that the
    planner knows their size and broadcasts them while they are few; rows then stay where they are.
    """
    names = ["_digest", "_other_digest"]
    rows = df.withColumns({name: F.xxhash64(F.lit(i), *df.columns) for i, name in enumerate(names)})
    path = fresh_path(df.sparkSession, "digests")
    rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names).write.parquet(path)
    repeated = df.sparkSession.read.parquet(path)
    alone, others = (rows.join(repeated, names, how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return alone, others


def drop_duplicates_by_digest(df: DataFrame) -> DataFrame:
    """The same rows as `drop_duplicates`, for wide rows of which few are repeated.

    Whole rows are moved and compared only where a digest repeats. The rows are read three times, so they should be stored.
    """
    alone, others = _by_digest(df)
    return alone.unionByName(others.dropDuplicates())


def count_duplicates_by_digest(df: DataFrame) -> DataFrame:
    """The same number as `count_duplicates`; rows whose digest occurs once are not moved."""
    return count_duplicates(_by_digest(df)[1])


def drop_null_any(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_null_all(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_null_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("any", subset=columns)


def fill_nulls(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Constant per column; a list fills an array column."""
    filled = {
        name: F.coalesce(F.col(name), F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value))
        for name, value in values.items()
    }
    return df.withColumns(filled)


def cross_fill(df: DataFrame, left: str, right: str) -> DataFrame:
    """Each of two columns takes the other's value where its own is null."""
    return df.withColumns(
        {left: F.coalesce(F.col(left), F.col(right)), right: F.coalesce(F.col(right), F.col(left))}
    )


def map_price(df: DataFrame, price: str = "price") -> DataFrame:
    return df.withColumn(price, map_price_text(F.col(price)))


def number_or_null(df: DataFrame, column: str) -> DataFrame:
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return df.withColumn(column, to_number(F.col(column)))
    return df.withColumn(column, nan_to_null(F.col(column).cast("double")))


def date_or_null(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, to_date(F.col(column)))
