"""Counts along with a job, sketches, distinct rows by digest, dates against pandas."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.values import to_date
from tallyshelf.operators import cleaning, sketches
from tallyshelf.plans import observed, tables
from tallyshelf.session import fresh_path


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


GAMES = [
    "{'id': '1', 'title': 'a', 'release_date': '2018-01-04'}",
    "{'id': 'x', 'title': 'b', 'release_date': 'soon'}",
    "{'id': '3', 'app_name': 'c'}",
    "{'id': '4', 'release_date': 'soon'}",
    "{broken",
]


def test_counts_come_with_the_table(spark):
    counts, path = observed.Counts(), fresh_path(spark, "games")
    found = observed.write_within(observed.clean_games(lines(spark, *GAMES), counts), path, counts, {"rejected_lines": 1, "undated": 2})
    assert found == {"lines": 5, "rejected_lines": 1, "untitled": 1, "unreadable_ids": 1, "unreadable_dates": 1, "undated": 2}
    assert [r["title"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_a_count_above_its_limit_is_an_error(spark):
    counts = observed.Counts()
    with pytest.raises(observed.TooManyRejected, match="rejected_lines"):
        observed.write_within(observed.clean_games(lines(spark, *GAMES), counts), fresh_path(spark, "games"), counts, {"rejected_lines": 0})


def test_minutes_with_a_fraction_are_kept(spark):
    raw = lines(spark, "{'user_id': 'u', 'items': [{'item_id': '1', 'playtime_forever': 12.5}, {'item_id': '2', 'playtime_forever': 'x'}, {'item_id': '3', 'playtime_forever': 7}]}")
    counts, path = observed.Counts(), fresh_path(spark, "items")
    found = observed.write_within(observed.clean_items(raw, counts), path, counts)
    assert found["unreadable_minutes"] == 1 and [r["item_id"] for r in tables.unreadable_minutes(tables.flat_items(raw)).collect()] == ["2"]
    assert {r["item_id"]: r["playtime_forever"] for r in spark.read.parquet(path).collect()} == {1: 13, 2: None, 3: 7}


def test_merged_sketches_equal_one_over_all_rows(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 777).alias("few"), (F.col("id") % 5).alias("part"), F.lit("x").alias("text"), F.lit(None).cast("double").alias("none"))
    parts = sketches.sketch(rows, ["id", "few", "text", "none"], "part")
    assert parts.count() == 20
    whole = sketches.sketch(rows.withColumn("part", F.lit(0)), ["id", "few", "text", "none"], "part")
    several, one = ({r["column"]: r for r in sketches.profile(x, [0.0, 0.25, 0.5, 1.0]).collect()} for x in (sketches.merged(parts), sketches.merged(whole)))
    for name, distinct in (("id", 20_000), ("few", 777), ("text", 1), ("none", 0)):
        assert several[name]["rows"] == one[name]["rows"] == 20_000
        assert several[name]["distinct_values"] == one[name]["distinct_values"] == pytest.approx(distinct, rel=0.03, abs=0)
    assert several["id"]["quantiles"] == pytest.approx([0, 5_000, 10_000, 19_999], abs=250)
    assert several["text"]["quantiles"] is None and several["none"]["quantiles"] is None and several["none"]["missing"] == 20_000
    assert sketches.merged(parts, ["part"]).count() == 20


def test_distinct_rows_by_digest(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b" * 50]), [rng.randrange(3)]) for _ in range(200)] + [(i, str(i), None) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>")
    path = fresh_path(spark, "rows")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, cleaning.drop_duplicates_by_digest(df).collect())) == sorted(map(key, cleaning.drop_duplicates(df).collect()))
    assert cleaning.count_duplicates_by_digest(df).first() == cleaning.count_duplicates(df).first()
    assert cleaning.drop_duplicates_by_digest(df.limit(0)).count() == 0


def test_rows_with_equal_digests_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(cleaning.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "a int, b string")
    assert sorted(map(tuple, cleaning.drop_duplicates_by_digest(df).collect())) == [(1, "a"), (2, "b")]


def test_dates_equal_pandas(spark):
    texts = ["4 January 2018", "4th January 2018", "Thu Jan 4 2018", "Jan, 2018", "1-2018", "4.1.2018", "Mar2018", "soon", "", "Jan 2018 soon", "13/13/2018", "31 Feb 2018", None]
    for day, month, year in itertools.product((1, 12, 28), (1, 5, 9, 12), (1997, 2018)):
        stamp = pd.Timestamp(year, month, day)
        forms = ["%d %B %Y", "%B %d %Y", "%a %b %d %Y", "%A, %B %d, %Y", "%b %Y", "%b, %Y", "%B%Y", "%m-%Y", "%Y-%m", "%m.%d.%Y", "%Y %b %d", "%d-%b-%Y", "%b %d %Y %H:%M", "%d. %B %Y", "%Y/%m/%d", "%d %b %y"]
        texts += [stamp.strftime(form) for form in forms]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(to_date(F.col("text"))).collect()]
    want = [pd.to_datetime(t, errors="coerce") for t in texts]
    odd = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != (None if pd.isna(w) else w.date())]
    assert odd == []
