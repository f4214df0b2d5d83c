"""The questions, each for one key or, without a key, for all keys in one job.

A key narrows the games before anything is joined. Counts that depend on the item alone are taken per item
first, so a review table meets the catalogue as one row per item however often an item was reviewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.functions.values import minutes_to_hours, total
from tallyshelf.operators import grouping, joins, nested, ranking, shape
from tallyshelf.sources.keyed import read_keys


def developer_yearly_free(games: DataFrame, developer: str | None = None) -> DataFrame:
    """Items and share of free items per developer and release year."""
    if developer is not None:
        games = shape.key_equals(games, "developer", developer)
    games = games.where(F.col("developer").isNotNull() & F.col("year").isNotNull())
    counts = grouping.count_and_zero_count(games, ["developer", "year"], "id", "price")
    shares = grouping.add_percentage(counts, "free_items", "total_items", "free_percentage")
    return shares.select("developer", "year", "total_items", "free_percentage")


def user_spend_profile(reviews: DataFrame, games: DataFrame, user_id: str | None = None) -> DataFrame:
    """Money, share of recommendations and items of the users, from what they reviewed."""
    if user_id is not None:
        reviews = shape.key_equals(reviews, "user_id", user_id)
    facts = reviews.where(F.col("user_id").isNotNull()).select("user_id", "item_id", "recommend")
    priced = joins.reviews_left_games(facts, games.select("id", "price"))
    totals = grouping.add_percentage(grouping.spend_totals(priced, ["user_id"]), "recommended", "rated", "share")
    return totals.select(
        "user_id", "money", F.coalesce("share", F.lit(0.0)).alias("recommend_percentage"), "items"
    )


def user_spend_profile_keyed(spark: SparkSession, reviews: str, games: str, user_id: str) -> DataFrame:
    """The same for one user, from tables that `write_keyed` laid out by user_id and by id: only the files, row groups and
    pages of the user's reviews and of their items are read. A user's items come to the driver for that."""
    own = read_keys(spark, reviews, "user_id", [user_id])
    items = [r["item_id"] for r in own.select("item_id").where("item_id is not null").distinct().collect()]
    return user_spend_profile(own, read_keys(spark, games, "id", items))


def _top_user(played: DataFrame) -> DataFrame:
    """Per genre the user with most minutes, with the hours per release year. Wants genre, user_id, year, minutes."""
    per_year = grouping.sum_minutes(played, ["genre", "user_id", "year"])
    whole = F.round(F.sum("minutes").over(Window.partitionBy("genre", "user_id")), 4)
    leader = Window.partitionBy("genre").orderBy(F.desc("total"), "user_id")
    best = per_year.withColumn("total", whole).withColumn("place", F.dense_rank().over(leader)).where("place = 1")
    return best.select("genre", "user_id", "year", minutes_to_hours(F.col("minutes")).alias("hours"))


def _played(items: DataFrame, games: DataFrame) -> DataFrame:
    facts = items.select("user_id", "item_id", "playtime_forever")
    return facts.join(games, facts["item_id"] == games["id"])


def genre_top_user(items: DataFrame, games: DataFrame, genre: str | None = None) -> DataFrame:
    """The user with most hours of a genre, with the hours per release year."""
    games = games.where(F.col("year").isNotNull())
    if genre is not None:
        games = shape.genre_token_match(games, genre).select("id", "year", F.lit(genre.strip().lower()).alias("genre"))
        return _top_user(_played(items, games))
    games = games.select("id", "year", F.array_distinct(shape.genre_tokens(F.col("genres"))).alias("genres"))
    played = _played(items, games)
    return _top_user(played.select("user_id", "year", "playtime_forever", F.explode("genres").alias("genre")))


def genre_top_user_regex(items: DataFrame, games: DataFrame, pattern: str) -> DataFrame:
    """The same for all games whose genres, as text, fit a pattern."""
    games = shape.genre_regex_match(games.where(F.col("year").isNotNull()), pattern)
    return _top_user(_played(items, games.select("id", "year", F.lit(pattern).alias("genre"))))


def _per_item(reviews: DataFrame, *counts: Column) -> DataFrame:
    return reviews.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(*counts)


def best_developers_year(reviews: DataFrame, games: DataFrame, year: int | None = None, k: int = 3) -> DataFrame:
    """The k developers with most recommended and positive reviews per release year."""
    if year is not None:
        games = shape.key_equals(games, "year", year)
    games = games.where(F.col("year").isNotNull() & F.col("developer").isNotNull()).select("id", "year", "developer")
    praised = _per_item(shape.recommended_positive(reviews), F.count(F.lit(1)).alias("n"))
    counts = praised.join(games, praised["item_id"] == games["id"]).groupBy("year", "developer")
    counts = counts.agg(F.sum("n").alias("recommendations"))
    best = ranking.top_per_group(counts, ["year"], "recommendations", "developer", k)
    return ranking.position_label(best).select("year", "place", "position", "developer", "recommendations")


def developer_review_sentiment(reviews: DataFrame, games: DataFrame, developer: str | None = None) -> DataFrame:
    """Negative and positive reviews per developer; a single developer always gives one row."""
    if developer is not None:
        games = shape.key_equals(games, "developer", developer)
    games = games.where(F.col("developer").isNotNull()).select("id", "developer")
    counts = grouping.sentiment_counts(reviews.where(F.col("item_id").isNotNull()), ["item_id"])
    counts = games.join(counts, games["id"] == counts["item_id"], "left")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("negative", "positive")]
    if developer is not None:
        return counts.agg(*sums).select(F.lit(developer).alias("developer"), "negative", "positive")
    return counts.groupBy("developer").agg(*sums)


def _complete(reviews: DataFrame) -> DataFrame:
    return reviews.na.drop("any", subset=["item_id", "recommend", "review", "sentiment_analysis"])


def _recommendations(reviews: DataFrame, games: DataFrame) -> DataFrame:
    """Recommendations of each dated game by its complete reviews: item_id, genres, year, recommendation_count."""
    counts = _per_item(shape.recommended_only(_complete(reviews)), F.count(F.lit(1)).alias("recommendation_count"))
    dated = games.where(F.col("genres").isNotNull() & F.col("release_date").isNotNull())
    dated = dated.select("id", "genres", F.year("release_date").alias("year"))
    return dated.join(counts, dated["id"] == counts["item_id"]).select("item_id", "genres", "year", "recommendation_count")


def top_genre_per_year(reviews: DataFrame, games: DataFrame) -> DataFrame:
    """The most recommended genre of each release year."""
    each = nested.explode_genres(_recommendations(reviews, games)).withColumnRenamed("genres", "genre")
    counts = each.groupBy("year", "genre").agg(F.sum("recommendation_count").alias("recommendation_count"))
    return ranking.first_per_group(counts, ["year"], "recommendation_count", "genre")


def _top_games(reviews: DataFrame, games: DataFrame, label: str, k: int) -> DataFrame:
    counts = _recommendations(reviews, games).groupBy("item_id")
    counts = counts.agg(F.sum("recommendation_count").alias("recommendation_count"))
    top = ranking.top_k(counts, "recommendation_count", "item_id", k)
    return ranking.resort_result(joins.top_left_labels(top, games, label), "recommendation_count", "item_id")


def top_games(reviews: DataFrame, games: DataFrame, k: int = 20) -> DataFrame:
    """The most recommended games with their titles."""
    return _top_games(reviews, games, "title", k)


def top_games_by_developer(reviews: DataFrame, games: DataFrame, k: int = 20) -> DataFrame:
    """The most recommended games with their developers; a developer can occur several times."""
    return _top_games(reviews, games, "developer", k)


def hours_by_genre_year(items: DataFrame, games: DataFrame) -> DataFrame:
    """Hours played per release year and genre."""
    played = shape.positive_playtime(items).where(F.col("item_id").isNotNull())
    minutes = played.groupBy("item_id").agg(total(F.col("playtime_forever")).alias("minutes"))
    dated = games.where(F.col("release_date").isNotNull()).select("id", "genres", F.year("release_date").alias("year"))
    each = nested.explode_genres(minutes.join(dated, minutes["item_id"] == dated["id"]))
    sums = each.groupBy("year", F.col("genres").alias("genre")).agg(total(F.col("minutes")).alias("minutes"))
    return sums.select("year", "genre", minutes_to_hours(F.col("minutes")).alias("hours"))
