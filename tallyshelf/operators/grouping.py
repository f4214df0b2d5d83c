"""Grouped counts and sums. Every one of them combines on the map side before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.values import share_percent, total


def count_and_zero_count(df: DataFrame, keys: list[str], counted: str, amount: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(counted).alias("total_items"), F.count_if(F.col(amount) == 0).alias("free_items")
    )


def add_percentage(df: DataFrame, part: str, whole: str, name: str) -> DataFrame:
    return df.withColumn(name, share_percent(F.col(part), F.col(whole)))


def spend_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Money, items, and given and positive recommendations per key; no key gives one row."""
    return df.groupBy(*keys).agg(
        total(F.col("price")).alias("money"),
        F.count("item_id").alias("items"),
        F.count("recommend").alias("rated"),
        F.count_if("recommend").alias("recommended"),
    )


def sum_minutes(df: DataFrame, keys: list[str], minutes: str = "playtime_forever") -> DataFrame:
    """Minutes per key; rows with a null key are left out."""
    return df.na.drop("any", subset=keys).groupBy(*keys).agg(total(F.col(minutes)).alias("minutes"))


def largest_per_group(df: DataFrame, group: list[str], amount: str, tie: str) -> DataFrame:
    """The row with the greatest amount of each group; the smaller `tie` wins."""
    order = Window.partitionBy(*group).orderBy(F.desc(amount), tie)
    return df.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Frequency of the non-null values, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), column)


def sentiment_counts(reviews: DataFrame, keys: list[str]) -> DataFrame:
    return reviews.groupBy(*keys).agg(
        F.count_if(F.col("sentiment_analysis") == 0).alias("negative"),
        F.count_if(F.col("sentiment_analysis") == 2).alias("positive"),
    )


def group_size(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.na.drop("any", subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of different non-null values, counted exactly."""
    return df.agg(F.count_distinct(column).alias("distinct_values"))


def approx_distinct_count(df: DataFrame, column: str, error: float = 0.01) -> DataFrame:
    """Estimated number of different non-null values: a fixed-size sketch per task instead of a shuffle."""
    return df.agg(F.approx_count_distinct(column, error).alias("distinct_values"))
