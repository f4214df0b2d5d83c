"""Quality counts taken along with a job, and limits on them.

What is rejected on the way to a clean table is counted by the pass that makes the table, not by another one over the
lines. The counts are there once the table has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyshelf import schemas
from tallyshelf.functions.values import to_date, to_number, to_whole
from tallyshelf.operators import nested
from tallyshelf.plans import tables
from tallyshelf.sources.files import write_parquet
from tallyshelf.sources.literals import good_records, parse_literal_records, parse_patched_records


class TooManyRejected(ValueError):
    """A count is above its limit."""


class Counts:
    """Counts of a job: rows, and rows for which a condition holds, at any of its steps."""

    def __init__(self):
        self._observed: list[Observation] = []

    def along(self, df: DataFrame, rows: str | None = None, **conditions: Column) -> DataFrame:
        """The same rows; counts them under the name `rows`, and those that meet a condition under its name."""
        counts = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
        if rows:
            counts.append(F.count(F.lit(1)).alias(rows))
        self._observed.append(Observation())
        return df.observe(self._observed[-1], *counts)

    def get(self) -> dict[str, int]:
        """All counts; waits for the job."""
        return {name: n for o in self._observed for name, n in o.get.items()}


def write_within(df: DataFrame, path: str, counts: Counts, limits: dict[str, int] | None = None) -> dict[str, int]:
    """Writes the table and gives the counts. Above a limit the write counts as failed: an error tells the counts, and
    what was written is not to be read."""
    write_parquet(df, path)
    found = counts.get()
    over = {name: found[name] for name, most in (limits or {}).items() if found[name] > most}
    if over:
        raise TooManyRejected(f"{path}: {over}, all counts {found}")
    return found


def _observed(lines: DataFrame, parse: Callable, schema, counts: Counts) -> DataFrame:
    parsed = counts.along(parse(lines, schema), rows="lines", rejected_lines=F.col("record").isNull())
    return good_records(parsed)


def _unreadable(column: str, read: Callable[[Column], Column] = to_whole) -> Column:
    return F.col(column).isNotNull() & read(F.col(column)).isNull()


def clean_games(lines: DataFrame, counts: Counts) -> DataFrame:
    """Catalogue lines to the clean table; counts lines, rejected_lines, untitled, unreadable_ids, undated, unreadable_dates."""
    raw = _observed(lines, parse_patched_records, schemas.RAW_GAMES, counts)
    untitled = F.col("app_name").isNull() & F.col("title").isNull()
    raw = counts.along(raw, untitled=untitled, unreadable_ids=_unreadable("id"), unreadable_dates=~untitled & _unreadable("release_date", to_date))
    typed = counts.along(tables.typed_games(raw), undated=F.col("release_date").isNull())
    return tables.dated_games(typed)


def clean_reviews(lines: DataFrame, lexicon: DataFrame, counts: Counts, **options) -> DataFrame:
    """Review lines to the clean table; counts lines, rejected_lines, unreadable_ids and reviews without a text."""
    raw = nested.flatten_records(_observed(lines, parse_literal_records, schemas.RAW_REVIEWS, counts), "reviews")
    raw = counts.along(raw, unreadable_ids=_unreadable("item_id"), without_text=F.col("review").isNull())
    return tables.clean_reviews(raw, lexicon, **options)


def clean_items(lines: DataFrame, counts: Counts) -> DataFrame:
    """Library lines to the clean table; counts lines, rejected_lines, unreadable_ids and unreadable_minutes."""
    raw = nested.flatten_records(_observed(lines, parse_literal_records, schemas.RAW_ITEMS, counts), "items")
    raw = counts.along(raw, unreadable_ids=_unreadable("item_id"), unreadable_minutes=_unreadable("playtime_forever", to_number))
    return tables.clean_items(raw)
