"""Sources, sinks, projections, filters, cleaning and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import bindings as b
from checks.registry import check
from tallyshelf import schemas
from tallyshelf.functions.text import list_literal, normalize_title, strip_list_marks
from tallyshelf.functions.values import minutes_to_hours, to_date, to_number, to_whole
from tallyshelf.operators import cleaning, nested, shape
from tallyshelf.plans import tables
from tallyshelf.session import fresh_path
from tallyshelf.sources import files
from tallyshelf.sources.literals import parse_literal_records, rejected_records


# --- sources and sinks -----------------------------------------------------------------------------------


@check(f"WITH {b.ITEM_LINES} SELECT value FROM cut_lines")
def read_gz_lines(spark, sf):
    path = fresh_path(spark, "lines")
    b.item_lines(spark, sf).select("value").write.option("compression", "gzip").text(path)
    return files.read_gz_lines(spark, path).select("value")


@check(f"WITH {b.FLAT_ITEMS} SELECT * FROM flat_items", name="parse_literal_records")
def literal_records_of_events(spark, sf):
    return tables.flat_items(b.item_lines(spark, sf)).select(
        "user_id", "item_id", "item_name", F.col("playtime_forever").cast("bigint").alias("playtime_forever")
    )


@check(
    f"""WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, app_name, title, 'http://shop/' || id AS url, price,
    release_date, developer, publisher, array_to_string(genres, '|') AS genres, array_to_string(tags, '|') AS tags,
    array_to_string(specs, '|') AS specs, early_access FROM games_raw""",
    name="parse_patched_records",
)
def patched_records_of_parts(spark, sf):
    games = tables.raw_games(b.game_lines(spark, sf))
    lists = [F.array_join(name, "|").alias(name) for name in ("genres", "tags", "specs")]
    flag = F.col("early_access").cast("boolean").alias("early_access")
    scalars = ["id", "app_name", "title", "url", "price", "release_date", "developer", "publisher"]
    return games.select(*scalars, *lists, flag)


@check(f"WITH {b.ITEM_LINES} SELECT event_id, value FROM cut_lines WHERE NOT whole")
def quarantine_bad_records(spark, sf):
    return rejected_records(parse_literal_records(b.item_lines(spark, sf), schemas.RAW_ITEMS))


@check("SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_csv(spark, sf):
    path = fresh_path(spark, "documents")
    docs = b.table(spark, sf, "documents")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema, multi_line=True)


RAGGED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _ragged_files(spark, sf):
    """Events as CSV, every 89th row with a field too many and every 83rd with one too few."""
    key = F.col("event_id")
    text = F.concat(F.lit('"a ""b"", '), F.col("event_type"), F.lit('"'))
    row = F.concat_ws(
        ",",
        key.cast("string"),
        F.when(key % 7 == 0, text).otherwise(F.col("event_type")),
        F.when(key % 83 != 0, F.col("value").cast("string")),
        F.when(key % 89 == 0, F.lit("")),
    )
    rows = b.table(spark, sf, "events").select((key % 8).alias("part"), key.alias("at"), row.alias("value"))
    heads = rows.select("part").distinct().select(
        "part", F.lit(-1).cast("bigint").alias("at"), F.lit("event_id,event_type,value").alias("value")
    )
    path = fresh_path(spark, "ragged")
    ordered = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "at")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return path


RAGGED_TYPE = """CASE WHEN event_id % 7 = 0 THEN 'a "b", ' || event_type ELSE event_type END"""


@check(
    f"""SELECT event_id, {RAGGED_TYPE} AS event_type, CASE WHEN event_id % 83 <> 0 THEN value END AS value
    FROM events WHERE event_id % 89 <> 0 OR event_id % 83 = 0"""
)
def read_csv_skip_long_rows(spark, sf):
    return files.read_csv_skip_long_rows(spark, _ragged_files(spark, sf), RAGGED)


@check("SELECT count(*) AS skipped FROM events WHERE event_id % 89 = 0 AND event_id % 83 <> 0")
def read_csv_long_rows(spark, sf):
    return files.read_csv_long_rows(spark, _ragged_files(spark, sf), RAGGED).agg(F.count("row").alias("skipped"))


@check(f"WITH {b.ITEMS} SELECT user_id, item_id, playtime_forever FROM items")
def read_parquet_columns(spark, sf):
    path = fresh_path(spark, "items")
    files.write_parquet(b.items(spark, sf), path)
    return files.read_parquet_columns(spark, path, ["user_id", "item_id", "playtime_forever"])


@check(f"WITH {b.GAMES} SELECT id, title, year, price, early_access, developer FROM games")
def write_parquet(spark, sf):
    path = fresh_path(spark, "games")
    files.write_parquet(b.games(spark, sf), path, partition_by=["year"])
    return spark.read.parquet(path).select("id", "title", "year", "price", "early_access", "developer")


LIST_SQL = "'[' || array_to_string([chr(39) || x || chr(39) for x in {0}], ', ') || ']'"


@check(
    f"""WITH {b.GAMES} SELECT id, title, price, CAST(release_date AS VARCHAR) AS release_date, early_access,
    {LIST_SQL.format('genres')} AS genres, {LIST_SQL.format('specs')} AS specs FROM games"""
)
def write_csv(spark, sf):
    path = fresh_path(spark, "games")
    games = b.games(spark, sf).select("id", "title", "price", "release_date", "early_access", "genres", "specs")
    files.write_csv(games, path)
    flat = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in ("genres", "specs") else f.dataType) for f in games.schema]
    )
    return files.read_csv(spark, path, flat).withColumn("release_date", F.col("release_date").cast("string"))


# --- projections -----------------------------------------------------------------------------------------


@check(f"WITH {b.GAMES} SELECT id, price, developer FROM games")
def prune_columns(spark, sf):
    return shape.prune_columns(b.games(spark, sf), ["id", "price", "developer"])


@check("SELECT doc_id, text, lang FROM documents")
def drop_columns(spark, sf):
    return shape.drop_columns(b.table(spark, sf, "documents"), ["source", "n_chars"])


@check("SELECT p_partkey AS item, p_name AS label, p_retailprice AS amount FROM part")
def rename_columns(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return shape.rename_columns(part, ["item", "label", "amount"])


@check("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year FROM orders")
def release_year(spark, sf):
    return shape.add_release_year(b.table(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "year")


@check("SELECT event_id, value / 60 AS hours FROM events", name="minutes_to_hours")
def hours_of_events(spark, sf):
    return b.table(spark, sf, "events").select("event_id", minutes_to_hours(F.col("value")).alias("hours"))


def _description(gap: str) -> str:
    parts = " || ' ' || ".join(LIST_SQL.format(name) for name in ("genres", "specs", "tags"))
    return f"{parts} || '{gap}' || title"


@check(f"WITH {b.GAMES} SELECT id, {_description(' ')} AS description FROM games")
def build_description(spark, sf):
    return shape.add_description(b.games(spark, sf)).select("id", "description")


@check(f"WITH {b.GAMES} SELECT id, {_description('')} AS description FROM games")
def build_description_legacy(spark, sf):
    return shape.add_description(b.games(spark, sf), legacy_concat=True).select("id", "description")


@check(
    "SELECT doc_id, trim(lower(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g')), ' ') AS normalized FROM documents",
    name="normalize_title",
)
def normalized_texts(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", normalize_title(F.col("text")).alias("normalized"))


# --- filters ---------------------------------------------------------------------------------------------


@check(f"WITH {b.GAMES} SELECT id, title FROM games WHERE developer = 'Brand#7'")
def filter_key_equals(spark, sf):
    return shape.key_equals(b.games(spark, sf), "developer", "Brand#7").select("id", "title")


@check(f"WITH {b.GAMES} SELECT id, title FROM games WHERE list_contains(genres, 'ring')")
def genre_token_match(spark, sf):
    return shape.genre_token_match(b.games(spark, sf), " Ring").select("id", "title")


@check(f"WITH {b.GAMES} SELECT id, title FROM games WHERE regexp_matches({LIST_SQL.format('genres')}, '(?i)RIN|bo.t')")
def genre_regex_match(spark, sf):
    return shape.genre_regex_match(b.games(spark, sf), "RIN|bo.t").select("id", "title")


@check(f"WITH {b.REVIEWS} SELECT user_id, item_id FROM reviews WHERE recommend AND sentiment_analysis = 2")
def recommended_positive(spark, sf):
    return shape.recommended_positive(b.reviews(spark, sf)).select("user_id", "item_id")


@check(f"WITH {b.REVIEWS} SELECT user_id, item_id, sentiment_analysis FROM reviews WHERE recommend")
def recommended_only(spark, sf):
    return shape.recommended_only(b.reviews(spark, sf)).select("user_id", "item_id", "sentiment_analysis")


@check(f"WITH {b.ITEMS} SELECT user_id, item_id, item_name, playtime_forever - 50 AS playtime_forever FROM items WHERE playtime_forever > 50")
def positive_playtime(spark, sf):
    return shape.positive_playtime(b.items(spark, sf).withColumn("playtime_forever", F.col("playtime_forever") - 50))


@check(f"WITH {b.GAMES_TYPED} SELECT id, title, price FROM games_typed WHERE release_date IS NULL")
def rows_missing_key(spark, sf):
    return tables.undated_games(b.games_raw(spark, sf)).select("id", "title", "price")


@check(f"WITH {b.FLAT_ITEMS} SELECT * FROM flat_items WHERE item_id IS NOT NULL OR item_name IS NOT NULL")
def drop_double_sentinel(spark, sf):
    rows = shape.drop_rows_without_item(tables.flat_items(b.item_lines(spark, sf)))
    return rows.select(
        "user_id", "item_id", "item_name", F.col("playtime_forever").cast("bigint").alias("playtime_forever")
    )


@check(f"WITH {b.ITEMS}, {b.GAMES.strip()} SELECT DISTINCT item_id AS id FROM items WHERE item_id IN (SELECT id FROM games)")
def key_exists(spark, sf):
    wanted = b.items(spark, sf).select(F.col("item_id").alias("id")).distinct()
    return shape.key_exists(b.games(spark, sf), "id", wanted)


# --- cleaning --------------------------------------------------------------------------------------------


@check("SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicates(spark, sf):
    return cleaning.drop_duplicates(b.table(spark, sf, "documents").select("text", "lang", "source"))


@check(
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicates
    FROM documents"""
)
def count_duplicates(spark, sf):
    return cleaning.count_duplicates(b.table(spark, sf, "documents").select("text", "lang"))


@check(
    f"""WITH {b.REVIEWS} SELECT * FROM reviews WHERE recommend IS NOT NULL AND review IS NOT NULL
    AND user_id IS NOT NULL AND item_id IS NOT NULL AND sentiment_analysis IS NOT NULL"""
)
def drop_null_any(spark, sf):
    return cleaning.drop_null_any(b.reviews(spark, sf))


@check(f"WITH {b.GAMES_RAW} SELECT app_name, title FROM games_raw WHERE app_name IS NOT NULL OR title IS NOT NULL")
def drop_null_all(spark, sf):
    return cleaning.drop_null_all(b.games_raw(spark, sf).select("app_name", "title"))


@check(f"WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, title, developer FROM games_raw WHERE title IS NOT NULL")
def drop_null_subset(spark, sf):
    return cleaning.drop_null_subset(b.games_raw(spark, sf).select("id", "title", "developer"), ["title"])


@check(
    f"""WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, coalesce(developer, 'unknown') AS developer,
    coalesce(publisher, 'unknown') AS publisher,
    array_to_string(coalesce(genres, ['not specified']), '|') AS genres FROM games_raw"""
)
def fill_nulls(spark, sf):
    games = b.games_raw(spark, sf).select("id", "developer", "publisher", "genres")
    filled = {"developer": "unknown", "publisher": "unknown", "genres": ["not specified"]}
    return cleaning.fill_nulls(games, filled).withColumn("genres", F.array_join("genres", "|"))


@check(
    f"""WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, coalesce(app_name, title) AS app_name,
    coalesce(title, app_name) AS title FROM games_raw"""
)
def cross_fill(spark, sf):
    return cleaning.cross_fill(b.games_raw(spark, sf).select("id", "app_name", "title"), "app_name", "title")


@check(
    f"""WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, CASE price WHEN 'Starting at $499.00' THEN '499.0'
    WHEN 'Free to Play' THEN '0' ELSE price END AS price FROM games_raw"""
)
def map_price_text(spark, sf):
    return cleaning.map_price(b.games_raw(spark, sf).select("id", "price"))


# The price texts and what they stand for, in SQL; the plain texts that mean "free" are 0.
PRICED = {"Starting at $499.00": "499.0", "Starting at $449.00": "449.0", "Free To Play": "0", "Install Now": "0",
    "Play WARMACHINE: Tactics Demo": "0", "Free Mod": "0", "Install Theme": "0", "Third-party": "0", "Free HITMAN™ Holiday Pack": "0",
    "Play Now": "0", "Free to Try": "0", "Free Movie": "0", "Free to Use": "0", "Free to Play": "0", "Free": "0", "Free Demo": "0",
    "Play the Demo": "0", "Play for Free!": "0"}
PRICED_SQL = "[" + ", ".join(f"'{text}'" for text in PRICED) + "]"


@check(
    f"""SELECT p_partkey AS id, CASE {" ".join(f"WHEN text = '{t}' THEN '{n}'" for t, n in PRICED.items())} ELSE text END AS price
    FROM (SELECT p_partkey, coalesce({PRICED_SQL}[p_partkey % 20 + 1], CAST(p_partkey AS VARCHAR)) AS text FROM part)"""
)
def map_every_price_text(spark, sf):
    text = F.get(F.array(*map(F.lit, PRICED)), (F.col("p_partkey") % 20).cast("int"))
    rows = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.coalesce(text, F.col("p_partkey").cast("string")).alias("price"))
    return cleaning.map_price(rows)


@check(f"WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, try_cast(price AS DOUBLE) AS price FROM games_raw")
def to_number_or_null(spark, sf):
    return b.games_raw(spark, sf).select("id", to_number(F.col("price")).alias("price"))


@check(f"WITH {b.GAMES_RAW} SELECT CAST(id AS VARCHAR) AS id, CAST({b.RELEASED} AS VARCHAR) AS released FROM games_raw")
def to_date_or_null(spark, sf):
    return b.games_raw(spark, sf).select("id", to_date(F.col("release_date")).cast("string").alias("released"))


# --- nested data -----------------------------------------------------------------------------------------

NESTED = """nested AS (
  SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN string_split(text, chr(10)) ELSE [NULL] END AS lines FROM documents),
flat AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM nested)"""


@check(
    f"""WITH {NESTED} SELECT doc_id, CASE WHEN line IS NOT NULL THEN spot END AS nr,
    CAST(length(line) AS INTEGER) AS chars FROM flat"""
)
def explode_records(spark, sf):
    exploded = nested.explode_records(b.nested_lines(spark, sf), "lines")
    return exploded.select("doc_id", F.col("lines.nr").alias("nr"), F.col("lines.chars").alias("chars"))


@check(
    f"""WITH {NESTED} SELECT doc_id, CASE WHEN line IS NOT NULL THEN spot END AS nr,
    CAST(length(line) AS INTEGER) AS chars FROM flat"""
)
def flatten_struct(spark, sf):
    return nested.flatten_records(b.nested_lines(spark, sf), "lines")


@check(f"WITH {b.GAMES} SELECT id, array_to_string(genres, ', ') AS genres FROM games")
def clean_list_text(spark, sf):
    return b.games(spark, sf).select("id", strip_list_marks(list_literal(F.col("genres"))).alias("genres"))


@check(f"WITH {b.GAMES} SELECT id, unnest(genres) AS genre FROM games")
def explode_genres(spark, sf):
    text = b.games(spark, sf).select("id", list_literal(F.col("genres")).alias("genre"))
    return nested.explode_genres(text, "genre")


# --- pipelines from raw lines to clean tables --------------------------------------------------------------


@check(
    f"""WITH {b.FLAT_ITEMS}
    SELECT DISTINCT user_id, CAST(item_id AS BIGINT) AS item_id, coalesce(item_name, 'no data') AS item_name,
      coalesce(playtime_forever, 0) AS playtime_forever
    FROM flat_items WHERE item_id IS NOT NULL OR item_name IS NOT NULL"""
)
def clean_items(spark, sf):
    return tables.clean_items(tables.flat_items(b.item_lines(spark, sf)))


@check(
    f"""WITH {b.GAMES} SELECT id, title, price, CAST(release_date AS VARCHAR) AS release_date, year, developer, publisher,
    array_to_string(genres, '|') AS genres, array_to_string(tags, '|') AS tags,
    array_to_string(specs, '|') AS specs, early_access FROM games"""
)
def clean_games(spark, sf):
    games = tables.clean_games(tables.raw_games(b.game_lines(spark, sf)))
    lists = {name: F.array_join(name, "|") for name in ("genres", "tags", "specs")}
    return games.withColumns({**lists, "release_date": F.col("release_date").cast("string")})


@check(
    f"""WITH {b.GAMES} SELECT id, title, trim(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', ' ', 'g'))) AS normalized_title,
    {_description(' ')} AS description FROM games"""
)
def build_model_table(spark, sf):
    return tables.model_table(b.games(spark, sf))


@check(f"WITH {b.GAMES} SELECT id // 3 AS id, count(*) AS n FROM games GROUP BY id // 3 HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return tables.repeated_ids(b.games(spark, sf).withColumn("id", F.floor(F.col("id") / 3)))


@check(
    """SELECT 'u' || doc_id AS user_id, 'a' || doc_id AS item_id, CAST(2 AS BIGINT) AS copies
    FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 43 = 0"""
)
def reviews_with_unreadable_id(spark, sf):
    rows = tables.with_unreadable_id(tables.flat_reviews(b.review_lines(spark, sf)), "item_id")
    return rows.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("copies"))


def _worse(column: str, key: str):
    """Ids as text: some with a fraction, some no number, some none."""
    return F.when(F.col(key) % 7 == 0, F.concat(F.col(column).cast("string"), F.lit(".0"))).when(
        F.col(key) % 11 == 0, F.concat(F.col(column).cast("string"), F.lit(".5"))).when(F.col(key) % 13 != 0, F.col(column).cast("string"))


@check("SELECT CAST(event_id AS VARCHAR) || '.5' AS item_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 0")
def items_with_unreadable_id(spark, sf):
    events = b.table(spark, sf, "events").select(_worse("event_id", "event_id").alias("item_id"))
    return tables.with_unreadable_id(events, "item_id")


@check("SELECT CAST(p_partkey AS VARCHAR) || '.5' AS id FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 = 0")
def games_with_unreadable_id(spark, sf):
    return tables.with_unreadable_id(b.table(spark, sf, "part").select(_worse("p_partkey", "p_partkey").alias("id")), "id")


@check(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey WHEN p_partkey % 11 = 0 THEN NULL
      WHEN p_partkey % 13 <> 0 THEN p_partkey END AS read FROM part"""
)
def to_whole_or_null(spark, sf):
    return b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), to_whole(_worse("p_partkey", "p_partkey")).alias("read"))
