"""From raw lines to the clean tables and the table of the recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf import schemas
from tallyshelf.functions.values import to_number, to_whole
from tallyshelf.operators import cleaning, nested, shape
from tallyshelf.operators.sentiment import label_reviews
from tallyshelf.sources.literals import good_records, parse_literal_records, parse_patched_records


def flat_reviews(lines: DataFrame, line: str = "value") -> DataFrame:
    """Raw review lines to one row per review, all fields as text."""
    return nested.flatten_records(good_records(parse_literal_records(lines, schemas.RAW_REVIEWS, line)), "reviews")


def flat_items(lines: DataFrame, line: str = "value") -> DataFrame:
    """Raw library lines to one row per user and item, all fields as text."""
    return nested.flatten_records(good_records(parse_literal_records(lines, schemas.RAW_ITEMS, line)), "items")


def raw_games(lines: DataFrame, line: str = "value") -> DataFrame:
    return good_records(parse_patched_records(lines, schemas.RAW_GAMES, line))


def clean_reviews(reviews: DataFrame, lexicon: DataFrame, sentinel_first: bool = False, phrases: DataFrame | None = None) -> DataFrame:
    """Reviews (all fields as text) to user_id, item_id, recommend, review, sentiment_analysis; `phrases` as in `lexicon_polarity`.

    Reviews without an item id go; `with_unreadable_id` gives those whose id is there but no whole number.
    """
    rows = cleaning.drop_duplicates(reviews)
    rows = rows.withColumns({"item_id": to_whole(F.col("item_id")), "recommend": F.col("recommend").try_cast("boolean")})
    rows = cleaning.drop_null_subset(rows, ["item_id"]).select("user_id", "item_id", "recommend", "review")
    return cleaning.fill_nulls(label_reviews(rows, lexicon, sentinel_first, phrases=phrases), {"review": "no data"})


def clean_items(items: DataFrame) -> DataFrame:
    """Library rows (all fields as text) to user_id, item_id, item_name, playtime_forever.

    A missing item id stays null, so that it never meets another one in a join; a missing name is "no data". Minutes are
    rounded to whole ones; what is no number is null, and `unreadable_minutes` gives these rows.
    """
    rows = cleaning.fill_nulls(items, {"playtime_forever": "0"})
    rows = cleaning.drop_duplicates(shape.drop_columns(rows, ["user_url", "playtime_2weeks"]))
    rows = shape.drop_rows_without_item(cleaning.drop_null_all(rows))
    rows = rows.withColumns(
        {
            "item_id": to_whole(F.col("item_id")),
            "playtime_forever": F.coalesce(to_whole(F.col("playtime_forever")), F.round(to_number(F.col("playtime_forever"))).try_cast("bigint")),
        }
    )
    rows = cleaning.fill_nulls(rows, {"item_name": "no data"})
    return rows.select("user_id", "item_id", "item_name", "playtime_forever")


def typed_games(games: DataFrame) -> DataFrame:
    """Catalogue rows before the rows without a release date go: unknown prices are 0."""
    rows = cleaning.cross_fill(cleaning.drop_null_all(games), "app_name", "title")
    rows = cleaning.map_price(cleaning.drop_null_subset(rows, ["title"]))
    unknown = {"developer": "unknown", "publisher": "unknown"}
    unlisted = {name: ["not specified"] for name in ("specs", "tags", "genres")}
    rows = cleaning.fill_nulls(rows, {**unknown, **unlisted})
    rows = shape.drop_columns(rows, ["app_name", "url", "reviews_url"])
    rows = cleaning.number_or_null(rows, "price")
    rows = cleaning.fill_nulls(cleaning.date_or_null(rows, "release_date"), {"price": 0.0})
    return rows.withColumns(
        {"id": to_whole(F.col("id")), "early_access": F.col("early_access").try_cast("boolean")}
    )


def clean_games(games: DataFrame) -> DataFrame:
    """Catalogue rows (scalars as text) to the clean table; rows without a readable date are left out."""
    return dated_games(typed_games(games))


def dated_games(typed: DataFrame) -> DataFrame:
    """The clean table of typed catalogue rows."""
    rows = cleaning.drop_null_subset(typed, ["release_date"])
    return shape.add_release_year(rows).select(*schemas.GAMES.fieldNames())


def undated_games(games: DataFrame) -> DataFrame:
    """The rows that clean_games leaves out for want of a readable date."""
    return shape.rows_missing_key(typed_games(games), "release_date")


def with_unreadable_id(rows: DataFrame, column: str) -> DataFrame:
    """Rows (fields as text) whose id is there but is no whole number: the clean tables leave them out or have no id there."""
    return rows.where(F.col(column).isNotNull() & to_whole(F.col(column)).isNull())


def unreadable_minutes(items: DataFrame) -> DataFrame:
    """Library rows (fields as text) whose playtime is there but is no number."""
    return items.where(F.col("playtime_forever").isNotNull() & to_number(F.col("playtime_forever")).isNull())


def repeated_ids(games: DataFrame) -> DataFrame:
    """Ids that occur more than once; each of them would multiply its reviews in a join."""
    return games.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def model_table(games: DataFrame, legacy_concat: bool = False) -> DataFrame:
    """id, title, normalized_title and description of the games, as the recommender reads them."""
    rows = shape.add_normalized_title(shape.add_description(games, legacy_concat))
    return rows.select("id", "title", "normalized_title", "description")
