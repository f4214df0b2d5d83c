"""Distinct rows by digest, dates by their tokens, stored sketches, and counts taken along with a job."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.registry import check
from tallyshelf.operators import cleaning, sketches
from tallyshelf.plans import observed
from tallyshelf.session import fresh_path
from tallyshelf.sources.files import write_parquet


@check("SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicates_by_digest(spark, sf):
    return cleaning.drop_duplicates_by_digest(b.table(spark, sf, "documents").select("text", "lang", "source"))


@check("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents")
def count_duplicates_by_digest(spark, sf):
    return cleaning.count_duplicates_by_digest(b.table(spark, sf, "documents").select("text", "lang"))


# how a date is written, and whether the day gets lost
FORMS = [
    ("d MMMM yyyy", False), ("d'th' MMMM yyyy", False), ("EEE MMM d yyyy", False), ("MMM, yyyy", True), ("M-yyyy", True), ("M.d.yyyy", False),
    ("MMMyyyy", True), ("EEEE, MMMM d, yyyy", False), ("yyyy MMM d", False), ("d-MMM-yyyy", False), ("d. MMMM yyyy", False),
    ("MMM d yyyy HH:mm", False), ("yyyy MMMM", True), ("d MMM yy", False), ("yyyy-M", True), ("MMMM 'the' d'th', yyyy", False),
]


@check(
    f"""SELECT o_orderkey, CASE WHEN (o_orderkey % {len(FORMS)}) IN ({', '.join(str(i) for i, (_, lost) in enumerate(FORMS) if lost)})
      THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS released FROM orders"""
)
def dates_by_tokens(spark, sf):
    """Order dates written in sixteen ways and read again."""
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    written = F.lit(None).cast("string")
    for i, (form, _) in enumerate(FORMS):
        written = F.when(F.col("o_orderkey") % len(FORMS) == i, F.date_format("o_orderdate", form)).otherwise(written)
    return cleaning.date_or_null(orders.select("o_orderkey", written.alias("released")), "released")


@check(
    """SELECT * FROM (
      SELECT 'user_id' AS "column", count(*) AS rows, count(*) - count(user_id) AS missing, true AS distinct_near, true AS median_near FROM events
      UNION ALL SELECT 'value', count(*), count(*) - count(CASE WHEN event_id % 10 <> 0 THEN value END), true, true FROM events
      UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), true, NULL FROM events)"""
)
def sketch_profile(spark, sf):
    """Estimates from sketches per day, merged, and whether they are as near to the exact figures as promised."""
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    events = b.table(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id", value.alias("value"), "event_type")
    path = fresh_path(spark, "sketches")
    write_parquet(sketches.sketch(events, ["user_id", "value", "event_type"], "day"), path)
    found = sketches.profile(sketches.merged(spark.read.parquet(path)), [0.5])
    long = events.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), n.cast("double").alias("number"))
                           for c, n in (("user_id", F.col("user_id")), ("value", F.col("value")), ("event_type", F.lit(None)))]))
    )
    median = found.select("column", F.get("quantiles", F.lit(0)).alias("median"))
    exact = long.join(median, "column").groupBy("column").agg(
        F.count_distinct("text").alias("distinct"),
        F.avg((F.col("number") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("number") <= F.col("median")).cast("int")).alias("upto"),
    )
    near = F.abs(F.col("distinct_values") - F.col("distinct")) <= 0.04 * F.col("distinct") + 1
    within = (F.col("below") <= 0.52) & (F.col("upto") >= 0.48)
    return found.join(exact, "column").select("column", "rows", "missing", near.alias("distinct_near"), within.alias("median_near"))


@check(
    f"""WITH {b.GAMES_TYPED}
    SELECT 'lines' AS name, count(*) AS n FROM games_raw UNION ALL SELECT 'rejected_lines', 0
    UNION ALL SELECT 'untitled', count(*) FROM games_raw WHERE coalesce(title, app_name) IS NULL
    UNION ALL SELECT 'unreadable_ids', 0
    UNION ALL SELECT 'unreadable_dates', count(*) FROM games_raw WHERE coalesce(title, app_name) IS NOT NULL AND release_date = 'Soon..'
    UNION ALL SELECT 'undated', count(*) FROM games_typed WHERE release_date IS NULL"""
)
def observed_game_counts(spark, sf):
    return _counts(spark, lambda counts: observed.clean_games(b.game_lines(spark, sf), counts))


@check(
    f"""WITH {b.ITEM_RECORDS}
    SELECT 'lines' AS name, count(*) AS n FROM item_records UNION ALL SELECT 'rejected_lines', count(*) FROM item_records WHERE NOT whole
    UNION ALL SELECT 'unreadable_ids', 0 UNION ALL SELECT 'unreadable_minutes', 0"""
)
def observed_item_counts(spark, sf):
    return _counts(spark, lambda counts: observed.clean_items(b.item_lines(spark, sf), counts))


@check(
    """SELECT 'lines' AS name, count(*) AS n FROM documents UNION ALL SELECT 'rejected_lines', 0
    UNION ALL SELECT 'unreadable_ids', 2 * count(*) FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 43 = 0
    UNION ALL SELECT 'without_text', 2 * count(*) FROM documents WHERE doc_id % 13 = 0"""
)
def observed_review_counts(spark, sf):
    return _counts(spark, lambda counts: observed.clean_reviews(b.review_lines(spark, sf), b.lexicon(spark), counts))


def _counts(spark, clean):
    """What is counted while the clean table is written."""
    counts = observed.Counts()
    found = observed.write_within(clean(counts), fresh_path(spark, "clean"), counts)
    return spark.createDataFrame(list(found.items()), "name string, n long")
