"""Steps that the optimizer keeps apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps read as values.

    A plain projection may be merged into its uses, and filters on it are moved below it; each use then computes
    the expression again. Here neither happens, which pays for expressions as dear as parsing a record.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
