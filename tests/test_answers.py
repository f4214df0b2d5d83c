import datetime

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import grouping, joins, shape
from tallyshelf.plans import answers

GAMES = "id long, title string, price double, release_date date, year int, developer string, genres array<string>"
REVIEWS = "user_id string, item_id long, recommend boolean, review string, sentiment_analysis int"
ITEMS = "user_id string, item_id long, playtime_forever double"


def game(id, price=1.0, year=2000, developer="d", genres=("a",), title="t"):
    return (id, title, price, datetime.date(year, 1, 1), year, developer, list(genres))


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(
        [
            game(1, 0.0, 2000, "ann", ["Action", "Indie"]),
            game(2, 5.0, 2000, "ann", ["Action"]),
            game(3, 0.0, 2001, "bob", ["Indie"]),
            game(4, None, 2001, "cat", ["Puzzle"]),
        ],
        GAMES,
    )


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        ("u", 1, True, "x", 2),
        ("u", 2, False, "x", 0),
        ("u", 2, None, "x", 1),
        ("v", 3, True, "x", 2),
        ("v", 9, True, "x", 2),
        ("w", 4, None, "x", 0),
        (None, 1, True, "x", 2),
        ("z", None, True, "x", 2),
    ]
    return spark.createDataFrame(rows, REVIEWS)


@pytest.fixture(scope="module")
def items(spark):
    rows = [("b", 1, 60.0), ("a", 1, 30.0), ("a", 2, 30.0), ("c", 3, 6.0), ("c", 9, 600.0), ("d", 4, 0.0), ("a", 1, None)]
    return spark.createDataFrame(rows, ITEMS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_yearly_free(games):
    assert rows(answers.developer_yearly_free(games)) == [
        ("ann", 2000, 2, 50.0),
        ("bob", 2001, 1, 100.0),
        ("cat", 2001, 1, 0.0),
    ]
    assert rows(answers.developer_yearly_free(games, "Ann")) == []


def test_spend(reviews, games):
    everyone = rows(answers.user_spend_profile(reviews, games))
    assert everyone == [("u", 10.0, 50.0, 3), ("v", 0.0, 100.0, 2), ("w", 0.0, 0.0, 1), ("z", 0.0, 100.0, 0)]
    assert rows(answers.user_spend_profile(reviews, games, "u")) == everyone[:1]
    assert rows(answers.user_spend_profile(reviews, games, "nobody")) == []


def test_repeated_ids_multiply(reviews, games):
    twice = games.union(games.where("id = 2"))
    assert rows(answers.user_spend_profile(reviews, twice, "u")) == [("u", 20.0, 33.33, 5)]


def test_top_user_ties_go_to_the_smaller_id(items, games):
    got = rows(answers.genre_top_user(items, games))
    assert got == [("action", "a", 2000, 1.0), ("indie", "b", 2000, 1.0), ("puzzle", "d", 2001, 0.0)]
    for genre in ("action", "Indie ", "PUZZLE"):
        key = genre.strip().lower()
        assert rows(answers.genre_top_user(items, games, genre)) == [r for r in got if r[0] == key]
    assert rows(answers.genre_top_user(items, games, "none")) == []
    assert rows(answers.genre_top_user_regex(items, games, "ACT|ind")) == [("ACT|ind", "a", 2000, 1.0)]


def test_best_developers(spark, reviews, games):
    assert rows(answers.best_developers_year(reviews, games)) == [
        (2000, 1, "Puesto 1", "ann", 2),
        (2001, 1, "Puesto 1", "bob", 1),
    ]
    assert rows(answers.best_developers_year(reviews, games, 1990)) == []
    many = spark.createDataFrame([game(i, developer=f"d{i}") for i in range(9)], GAMES)
    praise = spark.createDataFrame([("u", i, True, "x", 2) for i in range(9)], REVIEWS)
    assert [r[3] for r in rows(answers.best_developers_year(praise, many))] == ["d0", "d1", "d2"]


def test_review_sentiment(reviews, games):
    got = rows(answers.developer_review_sentiment(reviews, games))
    assert got == [("ann", 1, 2), ("bob", 0, 1), ("cat", 1, 0)]
    assert rows(answers.developer_review_sentiment(reviews, games, "ann")) == [got[0]]
    assert rows(answers.developer_review_sentiment(reviews, games, "nobody")) == [("nobody", 0, 0)]


def test_popularity(reviews, games, items):
    assert rows(answers.top_genre_per_year(reviews, games)) == [(2000, "Action", 2), (2001, "Indie", 1)]
    assert rows(answers.top_games(reviews, games)) == [(1, 2, "t"), (3, 1, "t")]
    assert rows(answers.top_games_by_developer(reviews, games, 1)) == [(1, 2, "ann")]
    assert rows(answers.hours_by_genre_year(items, games)) == [
        (2000, "Action", 2.0),
        (2000, "Indie", 1.5),
        (2001, "Indie", 0.1),
    ]


def test_null_keys_meet_nothing(spark, games):
    loose = games.union(spark.createDataFrame([game(None, developer="loose")], GAMES))
    review = spark.createDataFrame([("z", None, True, "x", 2)], REVIEWS)
    assert joins.reviews_left_games(review, loose).where("developer is not null").count() == 0
    assert rows(answers.developer_review_sentiment(review, loose, "loose")) == [("loose", 0, 0)]


def test_games_left_reviews_is_a_left_join(spark, reviews, games):
    got = joins.games_left_reviews(games.union(games), reviews)
    both = games.union(games)
    want = both.join(reviews, both["id"] == reviews["item_id"], "left")
    assert got.schema.names == want.schema.names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_keys_that_exist(spark, games):
    wanted = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert rows(shape.key_exists(games.union(games), "id", wanted)) == [(1,), (1,)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("u", None)], "user_id string, playtime_forever double")
    assert rows(grouping.sum_minutes(df, ["user_id"])) == [("u", 0.0)]


def test_one_key_equals_its_row_of_all(spark, sf):
    from checks import bindings as b

    games, reviews = b.games(spark, sf), b.reviews(spark, sf)
    everyone = answers.developer_yearly_free(games)
    per_developer = {r["developer"]: r["n"] for r in games.groupBy("developer").agg(F.count("id").alias("n")).collect()}
    summed = everyone.groupBy("developer").agg(F.sum("total_items").alias("n")).collect()
    assert {r["developer"]: r["n"] for r in summed} == per_developer
    assert rows(answers.best_developers_year(reviews, games, 1996)) == rows(
        answers.best_developers_year(reviews, games).where("year = 1996")
    )
    sentiment = answers.developer_review_sentiment(reviews, games)
    total = reviews.join(games, reviews["item_id"] == games["id"]).groupBy("developer").count()
    assert sentiment.join(total, "developer").where("negative + positive > count").count() == 0


def test_a_popular_item_gives_whole_results(spark, sorted_joins):
    """A third of all reviews and minutes on one item, with joins that sort both sides and split large parts."""
    n = 30000
    games = spark.range(50).selectExpr(
        "id", "'t' as title", "2.0 as price", "date'2000-01-01' as release_date", "2000 as year",
        "concat('d', id % 7) as developer", "array('a', concat('g', id % 3)) as genres",
    )
    item = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    user = F.concat(F.lit("u"), (F.col("id") % 11).cast("string"))
    reviews = spark.range(n).select(
        user.alias("user_id"), item.alias("item_id"), F.lit(True).alias("recommend"), F.lit("x").alias("review"),
        F.lit(2).alias("sentiment_analysis"),
    )
    items = spark.range(n).select(user.alias("user_id"), item.alias("item_id"), F.lit(6.0).alias("playtime_forever"))
    questions = [
        lambda: answers.user_spend_profile(reviews, games),
        lambda: answers.genre_top_user(items, games),
        lambda: answers.best_developers_year(reviews, games),
        lambda: answers.developer_review_sentiment(reviews, games),
        lambda: answers.top_genre_per_year(reviews, games),
        lambda: answers.top_games(reviews, games),
        lambda: answers.hours_by_genre_year(items, games),
        lambda: joins.games_left_reviews(games, reviews).groupBy("id").count(),
    ]
    plain = [rows(q()) for q in questions]
    with sorted_joins():
        assert [rows(q()) for q in questions] == plain
    assert sum(r[3] for r in plain[0]) == n


def test_repeated_genres_count_once_in_both_forms(spark):
    games = spark.createDataFrame([game(1, genres=["Action", "action "]), game(2, genres=["Action"])], GAMES)
    items = spark.createDataFrame([("a", 1, 60.0), ("b", 2, 90.0)], ITEMS)
    assert rows(answers.genre_top_user(items, games)) == rows(answers.genre_top_user(items, games, "Action")) == [("action", "b", 2000, 1.5)]


def test_labels_of_a_ranking_move_only_its_games(spark, sorted_joins):
    top = spark.createDataFrame([(1, 5), (9, 4)], "item_id long, n long")
    games = spark.createDataFrame([game(i, title=f"t{i}") for i in range(1, 9)], GAMES)
    with sorted_joins():
        assert rows(joins.top_left_labels(top, games, "title")) == [(1, 5, "t1"), (9, 4, None)]
