"""Readers and writers for compressed lines, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.steps import computed
from tallyshelf.functions.text import list_literal
from tallyshelf.functions.values import to_number
from tallyshelf.session import dropping_shuffles, fresh_path
from tallyshelf.sources.records import csv_records

# CSV fields that count as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]


def read_gz_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of compressed text with the name of their file.

    A gzip file is read by one task, so the lines are spread out at once for the parsing that follows: over
    `partitions`, or else over the session's shuffle partitions and at least all cores.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return lines.repartition(partitions or usual)


def _read_text_fields(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    fields = [T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_ragged", T.StringType())]
    if multi_line:
        names = ", ".join("`{}` string".format(f.name.replace("`", "``")) for f in fields)
        options = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged"}
        parsed = computed(csv_records(spark, path), _fields=F.from_csv("record", names, options))
        return parsed.select("_fields.*")
    return (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_ragged")
        .option("columnPruning", False)
        .csv(path)
    )


def _typed(field: T.StructField) -> Column:
    text = F.when(~F.col(field.name).isin(MISSING_TEXTS), F.col(field.name))
    if isinstance(field.dataType, T.StringType):
        return text.alias(field.name)
    if isinstance(field.dataType, T.NumericType):
        return to_number(text).try_cast(field.dataType).alias(field.name)
    return text.try_cast(field.dataType).alias(field.name)


def _too_long(schema: T.StructType) -> Column:
    """More fields than columns, counting the separators outside quotes of a flagged row."""
    bare = F.regexp_replace("_ragged", r'"[^"]*+"', "")
    # the reader sets the flag only where a field is asked for as well
    flagged = F.coalesce("_ragged", *schema.fieldNames()).isNotNull()
    return F.coalesce(flagged & (F.size(F.split(bare, ",", -1)) > len(schema)), F.lit(False))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with header and doubled quotes. Fields that do not fit their type are null, a row with too many ends the job.

    `multi_line` reads quoted line breaks too, in two passes over the file's splits.
    """
    error = F.raise_error(F.concat(F.lit("too many fields: "), "_ragged")).cast("boolean")
    rows = _read_text_fields(spark, path, schema, multi_line).where(F.when(_too_long(schema), error).otherwise(True))
    return rows.select(*[_typed(f) for f in schema])


def read_csv_skip_long_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """As read_csv, without the rows that have too many fields; short rows are filled with nulls."""
    return _read_text_fields(spark, path, schema, multi_line).where(~_too_long(schema)).select(*[_typed(f) for f in schema])


def read_csv_long_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """The rows that read_csv_skip_long_rows leaves out, as text."""
    return _read_text_fields(spark, path, schema, multi_line).where(_too_long(schema)).select(F.col("_ragged").alias("row"))


def read_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated sentiment lexicon: the token, its mean valence, and further fields that are not used."""
    fields = F.split("value", "\t")
    lexicon = spark.read.text(path).select(F.get(fields, F.lit(0)).alias("token"), to_number(F.get(fields, F.lit(1))).alias("valence"))
    return lexicon.where(F.col("valence").isNotNull())


def _csv_column(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        return list_literal(F.col(field.name)).alias(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(F.col(field.name).cast("string")).alias(field.name)
    return F.col(field.name)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; lists are written as Python lists, flags as True and False."""
    flat = df.select(*[_csv_column(f) for f in df.schema])
    writer = flat.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once below the shared folder, to be read as often as needed; the shuffles of the job go with it."""
    path, writer = fresh_path(df.sparkSession, name), df.write
    for field in df.schema:
        if isinstance(field.dataType, T.DoubleType):  # hardly any repeats
            writer = writer.option(f"parquet.enable.dictionary#{field.name}", "false")
    with dropping_shuffles(df.sparkSession):
        writer.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
