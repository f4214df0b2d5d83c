"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import list_literal, normalize_title


def prune_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """New names by position."""
    return df.toDF(*names)


def add_release_year(df: DataFrame, date: str = "release_date") -> DataFrame:
    return df.withColumn("year", F.year(date))


def add_normalized_title(df: DataFrame, title: str = "title") -> DataFrame:
    return df.withColumn("normalized_title", normalize_title(F.col(title)))


def add_description(games: DataFrame, legacy_concat: bool = False) -> DataFrame:
    """Genres, specs, tags and title as one text; null if one of them is null.

    `legacy_concat` leaves out the blank before the title, which fuses it with the last tag.
    """
    gap = "" if legacy_concat else " "
    parts = [list_literal(F.col(name)) for name in ("genres", "specs", "tags")]
    return games.withColumn(
        "description", F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(gap), F.col("title"))
    )


def key_equals(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def genre_tokens(genres: Column) -> Column:
    """Genres without outer blanks, in lower case."""
    return F.transform(genres, lambda genre: F.lower(F.trim(genre)))


def genre_token_match(df: DataFrame, genre: str, genres: str = "genres") -> DataFrame:
    """Rows whose genre list holds this genre, whatever its case."""
    return df.where(F.array_contains(genre_tokens(F.col(genres)), genre.strip().lower()))


def genre_regex_match(df: DataFrame, pattern: str, genres: str = "genres") -> DataFrame:
    """Rows whose genre list, as text, has a part that fits the pattern, whatever its case."""
    return df.where(F.coalesce(list_literal(F.col(genres)).rlike(f"(?i){pattern}"), F.lit(False)))


def recommended_only(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("recommend"))


def recommended_positive(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("recommend") & (F.col("sentiment_analysis") == 2))


def positive_playtime(df: DataFrame, amount: str = "playtime_forever") -> DataFrame:
    return df.where(F.col(amount) > 0)


def rows_missing_key(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def drop_rows_without_item(items: DataFrame) -> DataFrame:
    """Drops rows that have neither an item id nor an item name."""
    return items.where(F.col("item_id").isNotNull() | F.col("item_name").isNotNull())


def key_exists(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The wanted keys that occur in a table; `wanted` has the key under the same name.

    The table's keys are made distinct first, so that a frequent key is one row in the join.
    """
    return wanted.join(df.select(column).distinct(), column, "left_semi")
