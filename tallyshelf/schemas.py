"""Declared schemas. Raw records keep scalars as text; the clean tables are typed."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.ArrayType(T.StringType())) for name in names]


RAW_GAMES = T.StructType(
    _text("id", "app_name", "title", "url", "reviews_url", "price", "release_date", "developer", "publisher")
    + _texts("genres", "tags", "specs")
    + _text("early_access")
)

RAW_REVIEWS = T.StructType(
    _text("user_id", "user_url")
    + [
        T.StructField(
            "reviews",
            T.ArrayType(T.StructType(_text("funny", "posted", "last_edited", "item_id", "recommend", "review"))),
        )
    ]
)

RAW_ITEMS = T.StructType(
    _text("user_id", "user_url")
    + [
        T.StructField(
            "items",
            T.ArrayType(T.StructType(_text("item_id", "item_name", "playtime_forever", "playtime_2weeks"))),
        )
    ]
)

GAMES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("developer", T.StringType()),
        T.StructField("publisher", T.StringType()),
        *_texts("genres", "tags", "specs"),
        T.StructField("early_access", T.BooleanType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("recommend", T.BooleanType()),
        T.StructField("review", T.StringType()),
        T.StructField("sentiment_analysis", T.IntegerType()),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("playtime_forever", T.LongType()),
    ]
)

LEXICON = T.StructType([T.StructField("token", T.StringType()), T.StructField("valence", T.DoubleType())])
