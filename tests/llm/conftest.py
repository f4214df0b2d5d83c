import pytest
from pyspark.sql import Row


@pytest.fixture
def table(spark):
    """A table from rows and a schema in DDL, with extra columns whose names the operators use themselves."""

    def make(schema, rows, extra=True):
        df = spark.createDataFrame([Row(*r) for r in rows], schema) if rows else spark.createDataFrame([], schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "node", "kept", "score", "row", "text_hash", "size", "key", "_size", "single", "bucket"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("clash"))
        return df

    return make
