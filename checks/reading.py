"""Records with line breaks in quotes, and records whose fields are not known beforehand."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import bindings as b
from checks.registry import check
from tallyshelf import schemas
from tallyshelf.session import fresh_path
from tallyshelf.sources import files, literals


@check(
    """SELECT conv_id, turn, role, role || ':' || chr(13) || chr(10) || '"' || text || '",' || chr(10) || chr(10) || turn AS text
    FROM conversations"""
)
def read_csv_quoted_breaks(spark, sf):
    """Conversations whose texts hold line breaks of both kinds, empty lines, quotes and commas."""
    text = F.concat("role", F.lit(':\r\n"'), "text", F.lit('",\n\n'), F.col("turn").cast("string"))
    turns = b.table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    path = fresh_path(spark, "conversations")
    files.write_csv(turns, path)
    return files.read_csv(spark, path, turns.schema, multi_line=True)


def wide_lines(spark, sf):
    """Library records of which some name a country, and some items a rating, a whole number or a fraction."""
    key = F.col("event_id")
    country = F.concat(F.lit("'country': 'c"), (key % 5).cast("string"), F.lit("', 'user_url'"))
    rating = F.when(key % 2 == 0, (key % 5).cast("string")).otherwise(F.concat((key % 5).cast("string"), F.lit(".5")))
    rating = F.concat(F.lit("'playtime_2weeks': 0, 'rating': "), rating)
    value = F.when(key % 9 == 2, F.replace("value", F.lit("'user_url'"), country)).otherwise(F.col("value"))
    value = F.when(key % 7 == 1, F.replace(value, F.lit("'playtime_2weeks': 0"), rating)).otherwise(value)
    return b.item_lines(spark, sf).select("event_id", value.alias("value"))


WIDE = f"""{b.ITEM_RECORDS},
wide AS (
  SELECT *, CASE WHEN event_id % 9 = 2 THEN 'c' || event_id % 5 END AS country,
    CASE WHEN event_id % 7 = 1 AND NOT empty THEN event_id % 5 + CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.5 END END::DOUBLE AS rating
  FROM item_records WHERE whole)"""


@check(
    f"""WITH {WIDE}
    SELECT path, type FROM (
      SELECT 'country' AS path, CASE WHEN count(country) > 0 THEN 'string' END AS type FROM wide
      UNION ALL SELECT 'items[].item_id', CASE WHEN bool_or(NOT empty) THEN 'string' END FROM wide
      UNION ALL SELECT 'items[].item_name', CASE WHEN bool_or(NOT empty) THEN 'string' END FROM wide
      UNION ALL SELECT 'items[].playtime_2weeks', CASE WHEN bool_or(NOT empty) THEN 'bigint' END FROM wide
      UNION ALL SELECT 'items[].playtime_forever', CASE WHEN bool_or(NOT empty) THEN 'bigint' END FROM wide
      UNION ALL SELECT 'items[].rating', CASE WHEN bool_or(rating <> floor(rating)) THEN 'double' WHEN count(rating) > 0 THEN 'bigint' END FROM wide
      UNION ALL SELECT 'user_id', 'string' UNION ALL SELECT 'user_url', 'string') WHERE type IS NOT NULL"""
)
def found_record_schema(spark, sf):
    return spark.createDataFrame(literals.schema_paths(literals.found_schema(wide_lines(spark, sf))), "path string, type string")


@check(
    f"""WITH {WIDE}
    SELECT event_id, user_id, country, CASE WHEN NOT empty THEN item_id END AS item_id,
      CASE WHEN NOT empty THEN playtime_forever END AS playtime_forever, rating FROM wide"""
)
def records_of_found_schema(spark, sf):
    """The records with all fields that any of them has."""
    parsed = literals.parse_literal_records(wide_lines(spark, sf), None).where("record IS NOT NULL")
    item = F.get("record.items", F.lit(0))
    return parsed.select("event_id", "record.user_id", "record.country", *[item[c].alias(c) for c in ("item_id", "playtime_forever", "rating")])


@check(
    f"""WITH {WIDE}
    SELECT event_id, country, CASE WHEN NOT empty THEN item_id END AS item_id, rating FROM wide WHERE country IS NOT NULL OR rating IS NOT NULL"""
)
def unknown_record_fields(spark, sf):
    """Fields that the declared schema lacks: of the record as a map, of its items as fields added to the schema."""
    lines = wide_lines(spark, sf)
    schema = literals.widened(schemas.RAW_ITEMS, literals.found_schema(lines))
    known = T.StructType([f for f in schema if f.name in schemas.RAW_ITEMS.fieldNames()])
    parsed = literals.parse_literal_records(lines, known, unknown="unknown").where("record IS NOT NULL")
    item = F.get("record.items", F.lit(0))
    rows = parsed.select("event_id", F.col("unknown")["country"].alias("country"), item["item_id"].alias("item_id"), item["rating"].alias("rating"))
    return rows.where("country IS NOT NULL OR rating IS NOT NULL")
