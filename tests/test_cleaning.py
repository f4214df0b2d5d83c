import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.text import list_items, normalize_title
from tallyshelf.functions.values import FREE_TEXTS, share_percent, to_date, to_number
from tallyshelf.operators import cleaning, grouping, nested, shape
from tallyshelf.plans import tables

RAW = "id string, app_name string, title string, url string, reviews_url string, price string, release_date string, " \
    "developer string, publisher string, genres array<string>, tags array<string>, specs array<string>, early_access string"  # fmt: skip


def values(df, column):
    return [r[column] for r in df.collect()]


def game(spark, **fields):
    row = dict.fromkeys([part.split()[0] for part in RAW.split(", ")])
    return {**row, "id": "1", "title": "t", "release_date": "2018-01-04", **fields}


def games(spark, *rows):
    return spark.createDataFrame([game(spark, **r) for r in rows], RAW)


@pytest.mark.parametrize(
    "text, price",
    [("Free", 0), ("Free to Play", 0), ("Starting at $499.00", 499), ("Starting at $449.00", 449), ("4.99", 4.99),
     ("1d", 0), (None, 0), (" 5 ", 5), ("Free stuff", 0), ("1e2", 100)],
)
def test_price(spark, text, price):
    assert values(tables.clean_games(games(spark, {"price": text})), "price") == [price]


def test_free_texts_become_zero(spark):
    df = spark.createDataFrame([(t,) for t in FREE_TEXTS], "price string")
    assert set(values(cleaning.map_price(df), "price")) == {"0"} and len(FREE_TEXTS) == 16


def test_numbers(spark):
    texts = ["1", "-2.5", ".5", "5.", "1e3", "1f", "0x10", "", "nan", "1,000", "1.2.3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t")).alias("n"))
    assert values(df, "n") == [1, -2.5, 0.5, 5, 1000] + [None] * 7


def test_dates(spark):
    texts = ["2018-01-04", "Jan 2018", "1/2/2018", "Jan 4, 2018", "4 Jan, 2018", "2018", "Soon..", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(to_date(F.col("t")).alias("d"))
    day = datetime.date
    assert values(df, "d") == [
        day(2018, 1, 4), day(2018, 1, 1), day(2018, 1, 2), day(2018, 1, 4), day(2018, 1, 4), day(2018, 1, 1), None, None,
    ]


def test_titles_fill_each_other(spark):
    df = games(
        spark,
        {"id": "1", "title": None, "app_name": "a"},
        {"id": "2", "title": "b", "app_name": None},
        {"id": "3", "title": None, "app_name": None},
    )
    assert sorted(values(tables.clean_games(df), "title")) == ["a", "b"]
    filled = cleaning.cross_fill(df, "app_name", "title").collect()
    assert [(r["app_name"], r["title"]) for r in filled] == [("a", "a"), ("b", "b"), (None, None)]


def test_games_defaults(spark):
    (row,) = tables.clean_games(games(spark, {})).collect()
    assert (row["developer"], row["publisher"], row["genres"], row["year"]) == ("unknown", "unknown", ["not specified"], 2018)


def test_percent_rounds_half_even(spark):
    df = spark.range(1, 201).crossJoin(spark.range(0, 201).withColumnRenamed("id", "k")).where("k <= id")
    rows = df.select("k", "id", share_percent(F.col("k"), F.col("id")).alias("p")).collect()
    assert all(r["p"] == np.round(r["k"] / r["id"] * 100, 2) for r in rows)
    assert next(r["p"] for r in rows if (r["k"], r["id"]) == (1, 32)) == 3.12
    assert spark.range(1).select(share_percent(F.lit(1), F.lit(0)).alias("p")).first()["p"] is None


@pytest.mark.parametrize("title, key", [("Half-Life 2™", "half life 2"), ("日本語", ""), ("Café!", "caf"), (" A  b ", "a  b")])
def test_normalized_title(spark, title, key):
    assert spark.range(1).select(normalize_title(F.lit(title))).first()[0] == key


def test_list_kept_as_text(spark):
    df = spark.createDataFrame([("['Action', 'Indie']",)], "genres string")
    assert values(nested.explode_genres(df), "genres") == ["Action", "Indie"]
    assert df.select(list_items(F.col("genres"))).first()[0] == ["Action", "Indie"]


def test_genre_matches(spark):
    df = spark.createDataFrame([(1, ["Action", " Indie"]), (2, ["Interaction"]), (3, None)], "id int, genres array<string>")
    assert values(shape.genre_token_match(df, "action"), "id") == [1]
    assert values(shape.genre_token_match(df, "INDIE "), "id") == [1]
    assert values(shape.genre_regex_match(df, "action"), "id") == [1, 2]


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None), (None, None)], "a int, b string")
    assert cleaning.count_duplicates(df).first()["duplicates"] == 3
    assert cleaning.drop_duplicates(df).count() == 3
    assert cleaning.count_duplicates(df.where("a > 5")).first()["duplicates"] == 0


def test_items_without_id_and_name_go(spark):
    rows = [
        ("u", "x", None, None, "5", "1"),
        ("u", "x", None, "n", None, "1"),
        ("u", "x", "7", None, "9", "1"),
        ("u", "x", "7", None, "9", "2"),
    ]
    names = ["user_id", "user_url", "item_id", "item_name", "playtime_forever", "playtime_2weeks"]
    df = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
    got = {tuple(r) for r in tables.clean_items(df).collect()}
    assert got == {("u", None, "n", 0), ("u", 7, "no data", 9)}
    assert tables.clean_items(df).count() == 2


def test_description(spark):
    df = games(spark, {"genres": ["A", "B"], "specs": ["S"], "tags": ["T"], "title": "Name"})
    assert values(shape.add_description(df), "description") == ["['A', 'B'] ['S'] ['T'] Name"]
    assert values(shape.add_description(df, legacy_concat=True), "description") == ["['A', 'B'] ['S'] ['T']Name"]
    assert values(shape.add_description(games(spark, {})), "description") == [None]


def test_empty_list_keeps_a_row(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [(5,)])], "id int, r array<struct<x:int>>")
    assert [tuple(r) for r in nested.flatten_records(df, "r").collect()] == [(1, None), (2, None), (3, 5)]


@pytest.mark.parametrize(
    "text, want",
    [("January 2018", "2018-01-01"), ("January 4, 2018", "2018-01-04"), ("Jan 4 2018", "2018-01-04"), ("2018/01/04", "2018-01-04"),
     ("20180104", "2018-01-04"), ("04-01-2018", "2018-04-01"), ("Sept 2018", "2018-09-01"), ("1/2/18", "2018-01-02"), ("2018.01.04", "2018-01-04"),
     ("Jan 2018", "2018-01-01"), ("1/2/2018", "2018-01-02"), ("Jan 4, 2018", "2018-01-04"), ("4 Jan, 2018", "2018-01-04"), ("Soon..", None)],
)
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(to_date(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_sums_keep_every_digit(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(0.00004).alias("v"))
    assert abs(grouping.sum_minutes(df, ["k"], "v").first()["minutes"] - 4.0) < 1e-9
    large = spark.createDataFrame([("k", 1e15), ("k", 2.0)], "k string, v double")
    assert grouping.sum_minutes(large, ["k"], "v").first()["minutes"] == 1e15 + 2
    whole = spark.createDataFrame([("k", 2**53), ("k", 1), ("k", None)], "k string, v long")
    assert grouping.sum_minutes(whole, ["k"], "v").first()["minutes"] == 2**53 + 1


def test_ids_are_read_or_handed_back(spark):
    rows = [("u", "10", "yes"), ("u", "10.0", "no"), ("u", "abc", "bad"), ("u", None, "none"), ("u", " 7 ", "blank"), ("u", "1.5", "part"), ("u", "9" * 30, "long")]
    reviews = spark.createDataFrame([(u, i, "True", t) for u, i, t in rows], "user_id string, item_id string, recommend string, review string")
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    kept = {r.review: r.item_id for r in tables.clean_reviews(reviews, lexicon).collect()}
    assert kept == {"yes": 10, "no": 10, "blank": 7}
    assert {r.review for r in tables.with_unreadable_id(reviews, "item_id").collect()} == {"bad", "part", "long"}


def test_playtimes_that_are_no_whole_numbers(spark):
    items = spark.createDataFrame([("u", "1", "a", t) for t in ("5", "5.0", "1e30", "x", "2.5", None)], "user_id string, item_id string, item_name string, playtime_forever string")
    got = sorted(str(r.playtime_forever) for r in tables.clean_items(items).collect())
    assert got == sorted(map(str, [5, 5, None, None, 3, 0]))  # minutes with a fraction are rounded
