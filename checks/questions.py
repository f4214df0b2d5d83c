"""Joins, grouping, ranking, profiling and the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.registry import check
from tallyshelf.operators import grouping, joins, nested, profiling, ranking
from tallyshelf.plans import answers
from tallyshelf.session import fresh_path
from tallyshelf.sources import keyed


GR = f"{b.GAMES}, {b.REVIEWS}"
GI = f"{b.GAMES}, {b.ITEMS}"


def total(number: str) -> str:
    return f"coalesce(sum({number}), 0)"


def six(number: str) -> str:
    return f"round({number}, 6)"


def rounded(df, *names):
    """Sums of doubles to six digits, as their last ones depend on the order of rows."""
    return df.withColumns({name: F.round(name, 6) for name in names})


def percent(part: str, whole: str) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 * 100, 0) / 100"


# --- joins -----------------------------------------------------------------------------------------------


@check(f"WITH {GR} SELECT user_id, item_id, recommend, price, developer, year FROM reviews LEFT JOIN games ON item_id = id")
def reviews_left_games(spark, sf):
    joined = joins.reviews_left_games(b.reviews(spark, sf), b.games(spark, sf))
    return joined.select("user_id", "item_id", "recommend", "price", "developer", "year")


@check(f"WITH {GI} SELECT user_id, item_id, playtime_forever, title, year FROM items LEFT JOIN games ON item_id = id")
def items_left_games(spark, sf):
    joined = joins.items_left_games(b.items(spark, sf), b.games(spark, sf))
    return joined.select("user_id", "item_id", "playtime_forever", "title", "year")


@check(f"WITH {GR} SELECT id, title, user_id, recommend, sentiment_analysis FROM games LEFT JOIN reviews ON item_id = id")
def games_left_reviews(spark, sf):
    joined = joins.games_left_reviews(b.games(spark, sf), b.reviews(spark, sf))
    return joined.select("id", "title", "user_id", "recommend", "sentiment_analysis")


@check(
    f"""WITH {GR}, top AS (
      SELECT item_id, count(*) AS n FROM reviews GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20)
    SELECT item_id, n, title FROM top LEFT JOIN games ON item_id = id"""
)
def topk_left_labels(spark, sf):
    counts = grouping.group_size(b.reviews(spark, sf), ["item_id"])
    return joins.top_left_labels(ranking.top_k(counts, "n", "item_id", 20), b.games(spark, sf), "title")


# --- aggregation -----------------------------------------------------------------------------------------


@check(
    f"""WITH {b.GAMES} SELECT developer, count(id) AS total_items, count(*) FILTER (WHERE price = 0) AS free_items
    FROM games GROUP BY developer"""
)
def count_and_zero_count(spark, sf):
    return grouping.count_and_zero_count(b.games(spark, sf), ["developer"], "id", "price")


@check(
    f"""WITH {b.REVIEWS}, c AS (SELECT item_id, count(*) AS whole, count(*) FILTER (WHERE sentiment_analysis = 2) AS part
      FROM reviews GROUP BY item_id)
    SELECT item_id, whole, part, {percent('part', 'whole')} AS share FROM c"""
)
def percentage_2dp(spark, sf):
    counts = b.reviews(spark, sf).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("whole"), F.count_if(F.col("sentiment_analysis") == 2).alias("part")
    )
    return grouping.add_percentage(counts, "part", "whole", "share")


@check(
    f"""WITH {GR} SELECT {six(total('price'))} AS money, count(item_id) AS items, count(recommend) AS rated,
    count(*) FILTER (WHERE recommend) AS recommended FROM reviews LEFT JOIN games ON item_id = id"""
)
def global_sum_count(spark, sf):
    joined = joins.reviews_left_games(b.reviews(spark, sf), b.games(spark, sf).select("id", "price"))
    return rounded(grouping.spend_totals(joined, []), "money")


@check(
    f"""WITH {GI} SELECT user_id, year, {six(total('playtime_forever'))} AS minutes
    FROM items JOIN games ON item_id = id GROUP BY user_id, year"""
)
def sum_by_user_year(spark, sf):
    joined = joins.items_left_games(b.items(spark, sf), b.games(spark, sf).select("id", "year"))
    return rounded(grouping.sum_minutes(joined, ["user_id", "year"]), "minutes")


@check(
    f"""WITH {b.ITEMS}, t AS (SELECT item_name, user_id, {six(total('playtime_forever'))} AS minutes FROM items GROUP BY ALL)
    SELECT item_name, user_id, minutes FROM t
    QUALIFY row_number() OVER (PARTITION BY item_name ORDER BY minutes DESC, user_id) = 1"""
)
def argmax_user(spark, sf):
    minutes = rounded(grouping.sum_minutes(b.items(spark, sf), ["item_name", "user_id"]), "minutes")
    return grouping.largest_per_group(minutes, ["item_name"], "minutes", "user_id")


@check(f"WITH {b.GAMES} SELECT developer, count(*) AS n FROM games GROUP BY developer")
def value_counts(spark, sf):
    return grouping.value_counts(b.games(spark, sf), "developer")


@check(
    f"""WITH {b.REVIEWS} SELECT user_id, count(*) FILTER (WHERE sentiment_analysis = 0) AS negative,
    count(*) FILTER (WHERE sentiment_analysis = 2) AS positive FROM reviews GROUP BY user_id"""
)
def conditional_counts(spark, sf):
    return grouping.sentiment_counts(b.reviews(spark, sf), ["user_id"])


@check(f"WITH {b.REVIEWS} SELECT item_id, recommend, count(*) AS n FROM reviews WHERE recommend IS NOT NULL GROUP BY ALL")
def group_size(spark, sf):
    return grouping.group_size(b.reviews(spark, sf), ["item_id", "recommend"])


@check(
    f"""WITH {GR}, {b.ITEMS.strip()} SELECT 'games' AS source, count(DISTINCT id) AS distinct_values FROM games
    UNION ALL SELECT 'reviews', count(DISTINCT item_id) FROM reviews
    UNION ALL SELECT 'items', count(DISTINCT item_id) FROM items"""
)
def distinct_counts(spark, sf):
    counts = [
        grouping.distinct_count(b.games(spark, sf), "id").withColumn("source", F.lit("games")),
        grouping.distinct_count(b.reviews(spark, sf), "item_id").withColumn("source", F.lit("reviews")),
        grouping.distinct_count(b.items(spark, sf), "item_id").withColumn("source", F.lit("items")),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check(
    f"""WITH {GI}, g AS (SELECT id, year, unnest(genres) AS genre FROM games)
    SELECT year, genre, {six(total('playtime_forever'))} AS minutes FROM items JOIN g ON item_id = id GROUP BY year, genre"""
)
def sum_by_year_genre(spark, sf):
    joined = joins.items_left_games(b.items(spark, sf), b.games(spark, sf).select("id", "year", "genres"))
    each = nested.explode_genres(joined).withColumnRenamed("genres", "genre")
    return rounded(grouping.sum_minutes(each, ["year", "genre"]), "minutes")


@check(
    """SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75
    FROM lineitem"""
)
def quantiles(spark, sf):
    q = profiling.exact_quantiles(b.table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.75])
    return q.select(*[F.round(F.col("quantiles")[i], 6).alias(name) for i, name in enumerate(("q25", "q75"))])


# --- ranking ---------------------------------------------------------------------------------------------

GENRE_YEAR = f"""{b.GAMES}, gy AS (SELECT year, genre, count(*) AS n FROM (SELECT year, unnest(genres) AS genre FROM games)
  GROUP BY ALL)"""


def _genre_year(spark, sf):
    each = nested.explode_genres(b.games(spark, sf)).withColumnRenamed("genres", "genre")
    return grouping.group_size(each, ["year", "genre"])


@check(f"WITH {GENRE_YEAR} SELECT year, genre, n FROM gy ORDER BY year, n DESC, genre")
def sort_multi_key(spark, sf):
    return ranking.sort_multi_key(_genre_year(spark, sf), "year", "n", "genre")


@check(f"WITH {GENRE_YEAR} SELECT * FROM gy QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, genre) = 1")
def first_per_group(spark, sf):
    return ranking.first_per_group(_genre_year(spark, sf), ["year"], "n", "genre")


@check(f"WITH {b.REVIEWS} SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_k(spark, sf):
    return ranking.top_k(grouping.group_size(b.reviews(spark, sf), ["user_id"]), "n", "user_id", 20)


@check(
    f"""WITH {GENRE_YEAR}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, genre) AS INTEGER)
      AS place FROM gy)
    SELECT year, genre, n, place, 'Puesto ' || place AS position FROM r WHERE place <= 3"""
)
def position_label(spark, sf):
    return ranking.position_label(ranking.top_per_group(_genre_year(spark, sf), ["year"], "n", "genre", 3))


@check(
    f"""WITH {GR}, top AS (SELECT item_id, count(*) AS n FROM reviews GROUP BY ALL ORDER BY n DESC, item_id LIMIT 20)
    SELECT item_id, n, developer FROM top LEFT JOIN games ON item_id = id ORDER BY n DESC, item_id"""
)
def resort_result(spark, sf):
    counts = grouping.group_size(b.reviews(spark, sf), ["item_id"])
    labelled = joins.top_left_labels(ranking.top_k(counts, "n", "item_id", 20), b.games(spark, sf), "developer")
    return ranking.resort_result(labelled, "n", "item_id")


# --- profiling -------------------------------------------------------------------------------------------

PROFILED = {
    "user_id": "string",
    "item_id": "bigint",
    "recommend": "boolean",
    "review": "string",
    "sentiment_analysis": "int",
}


@check(
    f"WITH {b.REVIEWS} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) - count({name}) AS nulls FROM reviews"""
        for name, kind in PROFILED.items()
    )
)
def null_profile(spark, sf):
    return profiling.null_profile(b.reviews(spark, sf))


@check(f"WITH {b.GAMES} SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM games")
def table_shape(spark, sf):
    return profiling.table_shape(b.games(spark, sf))


@check(f"WITH {b.GAMES} SELECT DISTINCT price FROM games")
def distinct_values(spark, sf):
    return profiling.distinct_values(b.games(spark, sf), "price")


def _described(source: str, column: str) -> str:
    quart = ", ".join(f"round(quantile_cont({column}, {q / 100}), 6) AS q{q}" for q in (25, 50, 75))
    return f"""SELECT count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
      min({column}) AS min, {quart}, max({column}) AS max FROM {source}"""


def _rounded(described):
    return described.withColumns({name: F.round(name, 6) for name in ("mean", "std", "q25", "q50", "q75")})


@check(f"WITH {b.GAMES} {_described('games', 'price')}")
def describe_price(spark, sf):
    return _rounded(profiling.describe_numeric(b.games(spark, sf), "price"))


@check(_described("events", "value"))
def describe_numeric(spark, sf):
    return _rounded(profiling.describe_numeric(b.table(spark, sf, "events"), "value"))


def _described_as(source: str, column: str) -> str:
    whole = _described(source, column).replace(f"min({column})", f"CAST(min({column}) AS DOUBLE)")
    return f"SELECT '{column}' AS \"column\", * FROM ({whole.replace(f'max({column})', f'CAST(max({column}) AS DOUBLE)')})"


@check(" UNION ALL ".join(_described_as("lineitem", name) for name in ("l_linenumber", "l_extendedprice", "l_tax")))
def describe_table(spark, sf):
    lines = b.table(spark, sf, "lineitem").select("l_linenumber", "l_extendedprice", "l_tax", "l_returnflag")
    return _rounded(profiling.describe_table(lines))


def _outliers(columns: str, source: str, column: str) -> str:
    return f"""SELECT {columns} FROM {source}, (
      SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}) AS q
    WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)"""


@check(_outliers("event_id, user_id, value", "events", "value"))
def iqr_outliers(spark, sf):
    return profiling.iqr_outliers(b.table(spark, sf, "events"), "value").select("event_id", "user_id", "value")


# prices of which one in forty is far above the others
STEEP = "steep AS (SELECT id, title, CASE WHEN id % 40 = 1 THEN price * 100 + 5000 ELSE price END AS price FROM games)"


@check(f"WITH {b.GAMES}, {STEEP} {_outliers('id, title, price', 'steep', 'price')}")
def iqr_outliers_price(spark, sf):
    steep = F.when(F.col("id") % 40 == 1, F.col("price") * 100 + 5000).otherwise(F.col("price"))
    games = b.games(spark, sf).withColumn("price", steep)
    return profiling.iqr_outliers(games, "price").select("id", "title", "price")


# --- questions -------------------------------------------------------------------------------------------

YEARLY_FREE = f"""yearly AS (
  SELECT developer, year, total_items, {percent('free_items', 'total_items')} AS free_percentage FROM (
    SELECT developer, year, count(id) AS total_items, count(*) FILTER (WHERE price = 0) AS free_items
    FROM games GROUP BY developer, year))"""


@check(f"WITH {b.GAMES}, {YEARLY_FREE} SELECT * FROM yearly")
def developer_yearly_free(spark, sf):
    return answers.developer_yearly_free(b.games(spark, sf))


@check(f"WITH {b.GAMES}, {YEARLY_FREE} SELECT * FROM yearly WHERE developer = 'Brand#12'")
def developer_yearly_free_one(spark, sf):
    return answers.developer_yearly_free(b.games(spark, sf), "Brand#12")


SPEND = f"""spend AS (
  SELECT user_id, {six(total('price'))} AS money,
    coalesce({percent('count(*) FILTER (WHERE recommend)', 'nullif(count(recommend), 0)')}, 0) AS recommend_percentage,
    count(item_id) AS items
  FROM reviews LEFT JOIN games ON item_id = id GROUP BY user_id)"""


@check(f"WITH {GR}, {SPEND} SELECT * FROM spend")
def user_spend_profile(spark, sf):
    return rounded(answers.user_spend_profile(b.reviews(spark, sf), b.games(spark, sf)), "money")


@check(f"WITH {GR}, {SPEND} SELECT * FROM spend WHERE user_id = '10'")
def user_spend_profile_one(spark, sf):
    return rounded(answers.user_spend_profile(b.reviews(spark, sf), b.games(spark, sf), "10"), "money")


@check(f"WITH {GR}, {SPEND} SELECT * FROM spend WHERE user_id = '10'")
def user_spend_profile_keyed(spark, sf):
    """One user, whose reviews and items are looked up in tables laid out by key."""
    reviews, games = fresh_path(spark, "reviews"), fresh_path(spark, "games")
    keyed.write_keyed(b.reviews(spark, sf), reviews, "user_id")
    keyed.write_keyed(b.games(spark, sf), games, "id")
    return rounded(answers.user_spend_profile_keyed(spark, reviews, games, "10"), "money")


TOP_USER = f"""per_year AS (
  SELECT genre, user_id, year, {total('playtime_forever')} AS minutes
  FROM items JOIN by_genre ON item_id = id GROUP BY ALL),
leader AS (
  SELECT genre, user_id FROM (SELECT genre, user_id, sum(minutes) AS total FROM per_year GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY genre ORDER BY round(total, 4) DESC, user_id) = 1)
SELECT genre, user_id, year, round(minutes / 60, 6) AS hours FROM per_year JOIN leader USING (genre, user_id)"""


@check(f"WITH {GI}, by_genre AS (SELECT id, year, unnest(genres) AS genre FROM games), {TOP_USER}")
def genre_top_user(spark, sf):
    return rounded(answers.genre_top_user(b.items(spark, sf), b.games(spark, sf)), "hours")


@check(f"WITH {GI}, by_genre AS (SELECT id, year, 'gizmo' AS genre FROM games WHERE list_contains(genres, 'gizmo')), {TOP_USER}")
def genre_top_user_one(spark, sf):
    return rounded(answers.genre_top_user(b.items(spark, sf), b.games(spark, sf), "Gizmo"), "hours")


@check(
    f"""WITH {GI}, by_genre AS (SELECT id, year, 'r[ei]' AS genre FROM games
      WHERE regexp_matches(array_to_string(genres, ', '), '(?i)r[ei]')), {TOP_USER}"""
)
def genre_top_user_regex(spark, sf):
    return rounded(answers.genre_top_user_regex(b.items(spark, sf), b.games(spark, sf), "r[ei]"), "hours")


BEST = """counts AS (
  SELECT year, developer, count(*) AS recommendations FROM reviews JOIN games ON item_id = id
  WHERE recommend AND sentiment_analysis = 2 GROUP BY ALL),
best AS (
  SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY recommendations DESC, developer) AS INTEGER) AS place,
    developer, recommendations FROM counts)
SELECT year, place, 'Puesto ' || place AS position, developer, CAST(recommendations AS BIGINT) AS recommendations
FROM best WHERE place <= 3"""


@check(f"WITH {GR}, {BEST}")
def best_developers_year(spark, sf):
    return answers.best_developers_year(b.reviews(spark, sf), b.games(spark, sf))


@check(f"WITH {GR}, {BEST} AND year = 1997")
def best_developers_year_one(spark, sf):
    return answers.best_developers_year(b.reviews(spark, sf), b.games(spark, sf), 1997)


SENTIMENT = """voices AS (
  SELECT developer, count(*) FILTER (WHERE sentiment_analysis = 0) AS negative,
    count(*) FILTER (WHERE sentiment_analysis = 2) AS positive
  FROM games LEFT JOIN reviews ON item_id = id GROUP BY developer)"""


@check(f"WITH {GR}, {SENTIMENT} SELECT * FROM voices")
def developer_review_sentiment(spark, sf):
    return answers.developer_review_sentiment(b.reviews(spark, sf), b.games(spark, sf))


@check(f"WITH {GR}, {SENTIMENT} SELECT * FROM voices WHERE developer = 'Brand#3'")
def developer_review_sentiment_one(spark, sf):
    return answers.developer_review_sentiment(b.reviews(spark, sf), b.games(spark, sf), "Brand#3")


COMPLETE = """complete AS (
  SELECT item_id, year, genres, title, developer FROM games JOIN reviews ON item_id = id
  WHERE recommend AND review IS NOT NULL AND sentiment_analysis IS NOT NULL)"""


@check(
    f"""WITH {GR}, {COMPLETE}, n AS (
      SELECT year, genre, count(*) AS recommendation_count FROM (SELECT year, unnest(genres) AS genre FROM complete) GROUP BY ALL)
    SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY year ORDER BY recommendation_count DESC, genre) = 1"""
)
def top_genre_per_year(spark, sf):
    return answers.top_genre_per_year(b.reviews(spark, sf), b.games(spark, sf))


def _top(label: str) -> str:
    return f"""WITH {GR}, {COMPLETE}
    SELECT item_id, count(*) AS recommendation_count, {label} FROM complete GROUP BY item_id, {label}
    ORDER BY recommendation_count DESC, item_id LIMIT 20"""


@check(_top("title"))
def top20_games(spark, sf):
    return answers.top_games(b.reviews(spark, sf), b.games(spark, sf))


@check(_top("developer"))
def top20_games_by_developer(spark, sf):
    return answers.top_games_by_developer(b.reviews(spark, sf), b.games(spark, sf))


@check(
    f"""WITH {GI}, g AS (SELECT id, year, unnest(genres) AS genre FROM games)
    SELECT year, genre, round({total('playtime_forever')} / 60, 6) AS hours FROM items JOIN g ON item_id = id
    WHERE playtime_forever > 0 GROUP BY year, genre"""
)
def hours_by_genre_year(spark, sf):
    return rounded(answers.hours_by_genre_year(b.items(spark, sf), b.games(spark, sf)), "hours")
