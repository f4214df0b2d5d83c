"""Null profile, distinct values, exact quantiles, summary and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_profile(df: DataFrame) -> DataFrame:
    """Type, rows and nulls of every column, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f.name).isNull()).alias(f"nulls_{i}") for i, f in enumerate(df.schema)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("rows"),
                F.col(f"nulls_{i}").alias("nulls"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counted.select(F.inline(lines))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


#: error of the sketches, as a share of the rows; what they leave open is counted exactly
SKETCH = 100_000


def _summaries(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, dict]:
    """Per column count, mean, std, min, max and exact quantiles (linear between neighbouring ranks), from two scans.

    The first scan gives a sketch, and with it for each share two values that are sure to have the wanted ranks
    between them. The second counts what lies below and every value between, which is some hundred thousandths of the
    rows, or one count for a value that many rows hold. Nulls and NaN are left out.
    """
    number = {name: F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double")) for name in columns}
    sides = [min(max(share + side * 4 / SKETCH, 0.0), 1.0) for share in shares for side in (-1, 1)]
    first = df.select(*[number[name].alias(f"v{i}") for i, name in enumerate(columns)]).agg(
        *[
            F.struct(
                F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                F.percentile_approx(v, sides or [0.5], SKETCH).alias("sides"),
            ).alias(v)
            for v in (f"v{i}" for i in range(len(columns)))
        ]
    ).first()
    found = {name: first[f"v{i}"].asDict() | {"quantiles": [None] * len(shares)} for i, name in enumerate(columns)}
    open_ends = []
    for name, own in found.items():
        for k, share in enumerate(shares if own["count"] else ()):
            few = own["count"] < SKETCH  # a rank is then more than the sketch's error: every value is counted
            low = own["min"] if few or sides[2 * k] == 0 else own["sides"][2 * k]
            high = own["max"] if few or sides[2 * k + 1] == 1 else own["sides"][2 * k + 1]
            open_ends.append((name, k, (own["count"] - 1) * share, low, high))
    if not open_ends:
        return found
    marks = F.array(*[
        F.when(number[name] < low, F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))).when(
            number[name] <= high, F.struct(F.lit(i).alias("i"), number[name].alias("v")))
        for i, (name, _, _, low, high) in enumerate(open_ends)
    ])
    counts = df.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.i", "m.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first()))
    spot = F.get(F.array(*[F.lit(float(rank)) for _, _, rank, _, _ in open_ends]), "i")
    at = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("v")))
    placed = counts.withColumn("upto", upto).withColumn("spot", spot).groupBy("i").agg(at(F.floor("spot")).alias("low"), at(F.ceil("spot")).alias("high"))
    for i, low, high in placed.select("i", "low", "high").collect():
        name, k, rank, _, _ = open_ends[i]
        found[name]["quantiles"][k] = low + (high - low) * (rank - int(rank))
    return found


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with `quantiles`, linearly interpolated between neighbouring ranks; null for no values."""
    own = _summaries(df, [column], shares)[column]["quantiles"]
    return df.sparkSession.range(1).select(F.array(*[F.lit(q).cast("double") for q in own]).alias("quantiles"))


DESCRIBED = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def _described(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = []
    for name, own in _summaries(df, columns, [0.25, 0.5, 0.75]).items():
        rows.append((name, own["count"], own["mean"], own["std"], own["min"], *own["quantiles"], own["max"]))
    types = [f"{name} {'bigint' if name == 'count' else 'double'}" for name in DESCRIBED]
    return df.sparkSession.createDataFrame(rows, ", ".join(["column string", *types]))


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, all exact."""
    return _described(df, [column]).drop("column")


def describe_table(df: DataFrame) -> DataFrame:
    """The same for every numeric column, one row each, from the same two scans."""
    return _described(df, [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def iqr_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the lower and upper bound, 1.5 quartile distances outside the quartiles."""
    q1, q3 = _summaries(df, [column], [0.25, 0.75])[column]["quantiles"]
    bounds = (None, None) if q1 is None else (q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5)
    return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(n) for x, n in zip(bounds, ("lower", "upper"))])


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows strictly outside the bounds: two scans for the bounds, one for the rows."""
    bounds = iqr_bounds(df, column).select(F.struct("lower", "upper")).scalar()
    return df.where((F.col(column) < bounds["lower"]) | (F.col(column) > bounds["upper"]))
