"""The given tables as catalogue, reviews, libraries and raw lines, in Spark and in SQL.

Nulls, unreadable prices and dates, and damaged lines are set by rules on the key, because the given tables have
none. No row is left out by these rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.text import list_literal, text_literal
from tallyshelf.plans.tables import clean_games
from tallyshelf.schemas import LEXICON


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, for work on every word. The given files are one row group each, which one task reads, so the rows are
    dealt out over all cores here; tables of many row groups need no such step."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)


# --- catalogue -------------------------------------------------------------------------------------------


def games_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows with every scalar as text, from `part`, dealt out over all cores as in `text_table`."""
    return table(spark, sf, "part").repartition(spark.sparkContext.defaultParallelism).selectExpr(
        "string(p_partkey) AS id",
        "CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS app_name",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN p_name || ' true NaN' ELSE p_name END AS title",
        "'http://shop/' || p_partkey AS url",
        "'http://shop/reviews/' || p_partkey AS reviews_url",
        """CASE WHEN p_partkey % 10 = 0 THEN 'Free to Play' WHEN p_partkey % 10 = 1 THEN 'Starting at $499.00'
           WHEN p_partkey % 10 <> 2 THEN string(p_retailprice) END AS price""",
        """CASE WHEN p_partkey % 25 = 0 THEN 'Soon..' WHEN p_partkey % 25 = 1 THEN 'Jan 2018'
           WHEN p_partkey % 25 = 2 THEN '1/2/2018' WHEN p_partkey % 25 = 3 THEN 'Jan 4, 2018'
           WHEN p_partkey % 125 = 5 THEN 'January 2018' WHEN p_partkey % 125 = 6 THEN 'January 4, 2018'
           WHEN p_partkey % 125 = 7 THEN 'Jan 4 2018' WHEN p_partkey % 125 = 8 THEN '2018/01/04'
           WHEN p_partkey % 125 = 9 THEN '20180104' WHEN p_partkey % 125 = 10 THEN '04-01-2018'
           WHEN p_partkey % 125 = 11 THEN 'Sept 2018' WHEN p_partkey % 125 = 12 THEN '1/2/18'
           WHEN p_partkey % 125 = 13 THEN '2018.01.04'
           WHEN p_partkey % 25 <> 4 THEN string(date_add(date'1995-01-01', int(p_partkey % 2500))) END AS release_date""",
        "CASE WHEN p_partkey % 31 <> 0 THEN p_brand END AS developer",
        "CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS publisher",
        "CASE WHEN p_partkey % 37 <> 0 THEN split(p_name, ' ') END AS genres",
        "array(p_brand, lower(p_type)) AS tags",
        "array(p_type, 'size ' || p_size) AS specs",
        "string(p_size % 2 = 0) AS early_access",
    )


def games(spark: SparkSession, sf: str) -> DataFrame:
    return clean_games(games_raw(spark, sf))


GAMES_RAW = """
games_raw AS (
  SELECT p_partkey AS id,
    CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS app_name,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN p_name || ' true NaN' ELSE p_name END AS title,
    CASE WHEN p_partkey % 10 = 0 THEN 'Free to Play' WHEN p_partkey % 10 = 1 THEN 'Starting at $499.00'
      WHEN p_partkey % 10 <> 2 THEN CAST(p_retailprice AS VARCHAR) END AS price,
    CASE WHEN p_partkey % 25 = 0 THEN 'Soon..' WHEN p_partkey % 25 = 1 THEN 'Jan 2018'
      WHEN p_partkey % 25 = 2 THEN '1/2/2018' WHEN p_partkey % 25 = 3 THEN 'Jan 4, 2018'
      WHEN p_partkey % 125 = 5 THEN 'January 2018' WHEN p_partkey % 125 = 6 THEN 'January 4, 2018'
      WHEN p_partkey % 125 = 7 THEN 'Jan 4 2018' WHEN p_partkey % 125 = 8 THEN '2018/01/04'
      WHEN p_partkey % 125 = 9 THEN '20180104' WHEN p_partkey % 125 = 10 THEN '04-01-2018'
      WHEN p_partkey % 125 = 11 THEN 'Sept 2018' WHEN p_partkey % 125 = 12 THEN '1/2/18'
      WHEN p_partkey % 125 = 13 THEN '2018.01.04'
      WHEN p_partkey % 25 <> 4 THEN CAST(DATE '1995-01-01' + CAST(p_partkey % 2500 AS INTEGER) AS VARCHAR)
      END AS release_date,
    CASE WHEN p_partkey % 31 <> 0 THEN p_brand END AS developer,
    CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS publisher,
    CASE WHEN p_partkey % 37 <> 0 THEN string_split(p_name, ' ') END AS genres,
    [p_brand, lower(p_type)] AS tags,
    [p_type, 'size ' || p_size] AS specs,
    p_size % 2 = 0 AS early_access
  FROM part)"""

PRICE = """coalesce(CASE WHEN price = 'Starting at $499.00' THEN 499.0 WHEN price = 'Free to Play' THEN 0.0
      ELSE try_cast(price AS DOUBLE) END, 0.0)"""
RELEASED = """coalesce(CASE release_date WHEN 'January 2018' THEN DATE '2018-01-01' WHEN 'January 4, 2018' THEN DATE '2018-01-04'
        WHEN 'Jan 4 2018' THEN DATE '2018-01-04' WHEN '2018/01/04' THEN DATE '2018-01-04' WHEN '20180104' THEN DATE '2018-01-04'
        WHEN '04-01-2018' THEN DATE '2018-04-01' WHEN 'Sept 2018' THEN DATE '2018-09-01' WHEN '1/2/18' THEN DATE '2018-01-02'
        WHEN '2018.01.04' THEN DATE '2018-01-04' END, try_cast(release_date AS DATE), CAST(try_strptime(release_date, '%b %Y') AS DATE),
      CAST(try_strptime(release_date, '%m/%d/%Y') AS DATE), CAST(try_strptime(release_date, '%b %d, %Y') AS DATE))"""

GAMES_TYPED = f"""{GAMES_RAW},
games_typed AS (
  SELECT id, coalesce(title, app_name) AS title, {PRICE} AS price, {RELEASED} AS release_date,
    coalesce(developer, 'unknown') AS developer, coalesce(publisher, 'unknown') AS publisher,
    coalesce(genres, ['not specified']) AS genres, tags, specs, early_access
  FROM games_raw WHERE coalesce(title, app_name) IS NOT NULL)"""

GAMES = f"""{GAMES_TYPED},
games AS (
  SELECT *, CAST(extract(year FROM release_date) AS INTEGER) AS year
  FROM games_typed WHERE release_date IS NOT NULL)"""


def game_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue rows as lines that mix Python and JSON words."""
    raw = games_raw(spark, sf)

    def field(name: str):
        value = F.col(name)
        if name in ("genres", "tags", "specs"):
            text = F.coalesce(list_literal(value), F.lit("NaN"))
        elif name == "early_access":
            text = value
        elif name in ("url", "reviews_url"):
            text = F.concat(F.lit('""'), value, F.lit('"'))
        else:
            text = F.when(value.isNull(), "NaN").otherwise(text_literal(value))
        return F.concat(F.lit(f'"{name}": '), text)

    return raw.select(F.concat(F.lit("{"), F.concat_ws(", ", *map(field, raw.columns)), F.lit("}")).alias("value"))


# --- reviews ---------------------------------------------------------------------------------------------


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews from `lineitem` and `orders`; some games get no review and some reviews no recommendation."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.when(F.col("l_partkey") % 50 == 7, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("item_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus") == "O").alias("recommend"),
        F.when(F.col("l_linenumber") != 6, F.concat(flag, F.lit(" "), F.col("l_linestatus"))).alias("review"),
        F.when(flag == "A", 2).when(flag == "N", 1).otherwise(0).alias("sentiment_analysis"),
    )


REVIEWS = """
reviews AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id,
    CASE WHEN l_partkey % 50 = 7 THEN l_partkey + 1 ELSE l_partkey END AS item_id,
    CASE WHEN l_linenumber <> 7 THEN l_linestatus = 'O' END AS recommend,
    CASE WHEN l_linenumber <> 6 THEN l_returnflag || ' ' || l_linestatus END AS review,
    CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS sentiment_analysis
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- libraries -------------------------------------------------------------------------------------------


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Libraries from `events`; some items are not in the catalogue."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("event_id") % 2500).alias("item_id"),
        F.col("event_type").alias("item_name"),
        F.col("value").alias("playtime_forever"),
    )


ITEMS = """
items AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_id % 2500 AS item_id, event_type AS item_name,
    value AS playtime_forever
  FROM events)"""


def item_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One library record per event as a Python literal: event_id, value.

    Some lists are empty, some fields are None, some strings have a prefix or need escapes, and every 97th line
    is cut short.
    """
    key = F.col("event_id")
    name = F.when(key % 7 == 0, F.concat(F.lit("it's None, "), F.col("event_type"))).otherwise(F.col("event_type"))
    name = F.when(key % 11 == 0, F.concat(F.lit('a "true" \\ it\'s '), F.col("event_type"))).otherwise(name)
    name = F.when((key % 13 != 0) & (key % 23 != 0), name)
    item = F.when(key % 23 != 0, F.concat(F.lit("'"), (key % 2500).cast("string"), F.lit("'")))
    entry = F.concat(
        F.lit("{'item_id': "),
        F.coalesce(item, F.lit("None")),
        F.lit(", 'item_name': "),
        text_literal(name),
        F.lit(", 'playtime_forever': "),
        F.when(key % 29 == 0, "None").otherwise(F.floor(F.col("value") * 10).cast("string")),
        F.lit(", 'playtime_2weeks': 0}"),
    )
    user = F.concat(F.when(key % 17 == 0, "u'").otherwise("'"), F.col("user_id").cast("string"), F.lit("'"))
    line = F.concat(
        F.lit("{'user_id': "),
        user,
        F.lit(", 'user_url': 'http://shop/user', 'items': ["),
        F.when(key % 10 == 3, "").otherwise(entry),
        F.lit("]}"),
    )
    cut = F.when(key % 97 == 0, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line"))
    events = table(spark, sf, "events")
    return events.select("event_id", line.alias("line")).select("event_id", cut.alias("value"))


ITEM_NAME = r"""CASE WHEN event_id % 13 = 0 OR event_id % 23 = 0 THEN NULL
      WHEN event_id % 11 = 0 THEN 'a "true" \ it''s ' || event_type
      WHEN event_id % 7 = 0 THEN 'it''s None, ' || event_type ELSE event_type END"""

ITEM_RECORDS = f"""
item_records AS (
  SELECT event_id, event_id % 97 <> 0 AS whole, event_id % 10 = 3 AS empty, CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN event_id % 23 <> 0 THEN CAST(event_id % 2500 AS VARCHAR) END AS item_id,
    {ITEM_NAME} AS item_name,
    CASE WHEN event_id % 29 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS playtime_forever
  FROM events)"""

ITEM_LINES = (
    ITEM_RECORDS
    + r""",
item_lines AS (
  SELECT event_id, whole, '{''user_id'': ' || CASE WHEN event_id % 17 = 0 THEN 'u' ELSE '' END || '''' || user_id
    || ''', ''user_url'': ''http://shop/user'', ''items'': [' || CASE WHEN empty THEN '' ELSE
    '{''item_id'': ' || coalesce('''' || item_id || '''', 'None') || ', ''item_name'': ' ||
    CASE WHEN item_name IS NULL THEN 'None'
      WHEN item_name LIKE 'a %' THEN '''' || replace(replace(item_name, '\', '\\'), '''', '\''') || ''''
      WHEN item_name LIKE 'it%' THEN '"' || item_name || '"' ELSE '''' || item_name || '''' END
    || ', ''playtime_forever'': ' || coalesce(CAST(playtime_forever AS VARCHAR), 'None')
    || ', ''playtime_2weeks'': 0}' END || ']}' AS line
  FROM item_records),
cut_lines AS (
  SELECT event_id, whole, CASE WHEN whole THEN line ELSE left(line, length(line) - 5) END AS value FROM item_lines)"""
)

FLAT_ITEMS = f"""{ITEM_RECORDS},
flat_items AS (
  SELECT user_id, CASE WHEN NOT empty THEN item_id END AS item_id, CASE WHEN NOT empty THEN item_name END AS item_name,
    CASE WHEN NOT empty THEN playtime_forever END AS playtime_forever
  FROM item_records WHERE whole)"""


# --- texts -----------------------------------------------------------------------------------------------

# A small lexicon for the checks: words that occur in the documents.
LEXICON_WORDS = {
    "best": 3.2,
    "trash": -1.5,
    "idiot": -2.3,
    "worthless": -1.9,
    "moron": -2.2,
    "pathetic": -2.7,
    "stupid": -2.4,
    "loser": -2.4,
    "disgusting": -2.4,
    "scum": -2.4,
    "no": -1.2,
    "this": 0.4,
    "with": 0.3,
    "from": -0.5,
    "und": 0.2,
    "les": -0.3,
}


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON_WORDS.items()), LEXICON)


LEXICON_SQL = "lexicon(token, valence) AS (VALUES " + ", ".join(
    f"('{token}', CAST({valence} AS DOUBLE))" for token, valence in LEXICON_WORDS.items()
) + ")"


def review_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as review texts: doc_id, review, recommend (null without a label)."""
    docs = text_table(spark, sf).withColumnRenamed("text", "review")
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("recommend"))
    return docs.join(labels, "doc_id", "left")


def review_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One review record per document as a Python literal; every 13th text and every 41st item id is None."""
    texts = review_texts(spark, sf)
    key = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("{'funny': '', 'posted': 'Posted May 1', 'last_edited': '', 'item_id': "),
        F.when(F.col("doc_id") % 41 == 0, "None")
        .when(F.col("doc_id") % 43 == 0, F.concat(F.lit("'a"), key, F.lit("'")))
        .when(F.col("doc_id") % 47 == 0, F.concat(F.lit("'"), key, F.lit(".0'")))
        .otherwise(F.concat(F.lit("'"), key, F.lit("'"))),
        F.lit(", 'recommend': "),
        F.coalesce(F.initcap(F.col("recommend").cast("string")), F.lit("None")),
        F.lit(", 'review': "),
        text_literal(F.when(F.col("doc_id") % 13 != 0, F.col("review"))),
        F.lit("}"),
    )
    # each review occurs twice in its list, as repeated records do
    return texts.select(
        F.concat(F.lit("{'user_id': 'u"), key, F.lit("', 'user_url': 'x', 'reviews': ["), entry, F.lit(", "), entry, F.lit("]}")).alias(
            "value"
        )
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt out as in `text_table` only where the reader's tasks have them unevenly: it moves every text once."""
    docs = table(spark, sf, "documents")
    rows = docs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    even = (rows[0] or 0) * spark.sparkContext.defaultParallelism <= 2 * (rows[1] or 0)
    return (docs.select("doc_id", "text") if even else text_table(spark, sf)).withColumnRenamed("doc_id", "id")


def nested_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a list of records, one per line of their text; every tenth list is empty."""
    lines = F.transform(
        F.split("text", "\n"), lambda text, nr: F.struct(nr.cast("bigint").alias("nr"), F.length(text).alias("chars"))
    )
    kept = F.filter(lines, lambda _: F.col("doc_id") % 10 != 0)
    return table(spark, sf, "documents").select("doc_id", kept.alias("lines"))
