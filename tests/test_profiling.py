import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import grouping, profiling

RNG = np.random.default_rng(7)
SAMPLES = {
    "uniform": RNG.uniform(-50, 50, 4001),
    "one value": np.full(500, 3.25),
    "a third the same": np.concatenate([np.full(1000, 7.0), RNG.normal(7, 1, 2000)]),
    "heavy tail": np.exp(RNG.normal(0, 12, 3000)) * RNG.choice([-1, 1], 3000),
    "close together": 1e9 + RNG.integers(0, 9, 2000) * 1e-6,
    "extremes": np.array([-1.7e308, -1e-300, 0.0, 1e-300, 1.7e308]),
    "two": np.array([1.0, 2.0]),
    "one": np.array([4.0]),
    "whole": RNG.integers(0, 1000, 3000).astype(float),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_quantiles_are_exact(spark, name):
    sample = SAMPLES[name]
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": sample})).repartition(3)
    got = profiling.exact_quantiles(df, "x", shares).first()[0]
    with np.errstate(over="ignore"):
        want = np.quantile(sample, shares)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_quantiles_leave_out_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert profiling.exact_quantiles(df, "x", [0.5]).first()[0] == [2.0]
    assert profiling.exact_quantiles(df.where("x > 99 and x < 100"), "x", [0.5]).first()[0] == [None]


def test_describe(spark):
    sample = pd.Series(SAMPLES["a third the same"])
    row = profiling.describe_numeric(spark.createDataFrame(sample.to_frame("x")), "x").first()
    want = sample.describe()
    got = [row[n] for n in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
    assert np.allclose(got, want.to_numpy(), rtol=1e-9)


def test_outliers_and_inliers_make_all_rows(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": SAMPLES["heavy tail"]}))
    bounds = profiling.iqr_bounds(df, "x").first()
    inside = df.where(F.col("x").between(bounds["lower"], bounds["upper"])).count()
    outside = profiling.iqr_outliers(df, "x").count()
    assert inside + outside == df.count() and outside > 0


def test_a_dense_cluster_with_one_outlier(spark):
    sample = np.append(np.random.default_rng(1).uniform(0, 2e-9, 30_000), 9e-4)
    df = spark.createDataFrame(pd.DataFrame({"x": sample})).repartition(5)
    assert np.allclose(profiling.exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()[0], np.quantile(sample, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_quantiles_over_generated_ranges(spark):
    df = spark.range(100).union(spark.range(100, 200)).withColumn("id", F.col("id").cast("double"))
    assert profiling.exact_quantiles(df, "id", [0.5]).first()[0] == [99.5]


def test_describing_takes_two_scans_for_any_number_of_columns(spark, sf):
    before = spark.sparkContext.statusTracker()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_extendedprice", "l_tax", "l_quantity")
    spark.sparkContext.setJobGroup("describe", "describe")
    rows = profiling.describe_table(lines).collect()
    spark.sparkContext.setJobGroup("other", "other")
    stages = {s for j in before.getJobIdsForGroup("describe") for s in before.getJobInfo(j).stageIds}
    # each scan is one stage of one task here, the others read shuffles or make the result
    assert len(rows) == 4 and len(stages) <= 12


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b array<string>")
    got = [tuple(r) for r in profiling.null_profile(df).collect()]
    assert got == [("a", "int", 2, 1), ("b", "array<string>", 2, 2)]
    assert tuple(profiling.table_shape(df).first()) == (2, 2)


def test_distinct_counts(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 1000)
    assert grouping.distinct_count(df, "x").first()[0] == 1000
    assert abs(grouping.approx_distinct_count(df, "x").first()[0] - 1000) < 50
