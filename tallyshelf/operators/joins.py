"""Left joins between the tables.

No join is forced to broadcast: the planner broadcasts a side whose size, known from the files or measured at
run time, is below the session's threshold, and otherwise sorts both sides and splits skewed partitions.
Keys are compared with plain equality, so a null key finds no partner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reviews_left_games(reviews: DataFrame, games: DataFrame) -> DataFrame:
    return reviews.join(games, reviews["item_id"] == games["id"], "left")


def items_left_games(items: DataFrame, games: DataFrame) -> DataFrame:
    return items.join(games, items["item_id"] == games["id"], "left")


def games_left_reviews(games: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every game, with nulls where it has no review.

    Built from the matches and the games without any: in a left join the right side, where a popular game may
    hold a large part of the rows, could neither be split nor stay in place against a broadcast of the games.
    """
    matched = games.join(reviews, games["id"] == reviews["item_id"])
    reviewed = reviews.select(F.col("item_id").alias("_reviewed")).distinct()
    unmatched = games.join(reviewed, games["id"] == F.col("_reviewed"), "left_anti")
    nulls = [F.lit(None).cast(field.dataType).alias(field.name) for field in reviews.schema]
    return matched.union(unmatched.select("*", *nulls))


def top_left_labels(top: DataFrame, games: DataFrame, label: str) -> DataFrame:
    """A short ranking by item with a column of the game added; only the games of the ranking are moved.

    The ranking, a few rows by its k, is broadcast.
    """
    wanted = F.broadcast(top.select("item_id").distinct())
    labels = games.select(F.col("id").alias("item_id"), label).join(wanted, "item_id", "left_semi")
    return top.join(labels, "item_id", "left")
