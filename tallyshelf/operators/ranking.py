"""Orders, first rows and top lists. Every order ends in a key, so that ties have one outcome.

A limit per group is applied by each task to its own rows first, so a large group sends only k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], amount: str, tie: str, k: int, place: str = "place") -> DataFrame:
    """The k rows with the greatest amount of each group, with their place."""
    order = Window.partitionBy(*group).orderBy(F.desc(amount), tie)
    return df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def first_per_group(df: DataFrame, group: list[str], amount: str, tie: str) -> DataFrame:
    return top_per_group(df, group, amount, tie, 1, "_place").drop("_place")


def sort_multi_key(df: DataFrame, up: str, down: str, tie: str) -> DataFrame:
    return df.orderBy(up, F.desc(down), tie)


def top_k(df: DataFrame, amount: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(amount), tie).limit(k)


def position_label(df: DataFrame, place: str = "place", word: str = "Puesto") -> DataFrame:
    """The place as text, such as "Puesto 1"."""
    return df.withColumn("position", F.concat(F.lit(f"{word} "), F.col(place).cast("string")))


def resort_result(df: DataFrame, amount: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(amount), tie)
