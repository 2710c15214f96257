"""Sources and sinks: explicit schemas, no inference, no path work on the driver but Spark's own readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What an upload may be.
UPLOAD_TYPES, MAX_UPLOAD = ("jpg", "jpeg", "png", "pdf"), 10 * 1024 * 1024

MASTER_SCHEMA = "brand string, model string, year_start int, year_end int"
INPUT_SCHEMA = "user_input_plate string, user_input_brand string, user_input_model string, user_input_year string"
LOG_SCHEMA = "level string, message string, timestamp string, service string"
MAPPING_SCHEMA = "input string, correction string, confidence double, method string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, LOG_SCHEMA)


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content]) of the files a glob finds."""
    found = spark.read.format("binaryFile").load(path)
    return found if content else found.drop("content")


def newest(found: DataFrame) -> DataFrame:
    return found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def uploads(found: DataFrame) -> DataFrame:
    """Files of an allowed type and size."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return found.where(kind.isin(*UPLOAD_TYPES) & (F.col("length") <= MAX_UPLOAD))


def extracted(found: DataFrame, reader: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds extracted_text by a plugged-in reader of (path, content); there is none by default, so the text is null."""
    text = reader(F.col("path"), F.col("content")) if reader else F.lit(None).cast("string")
    return found.withColumn("extracted_text", text)


def inspect(df: DataFrame, n: int = 5) -> tuple[int, list[str], DataFrame]:
    """(rows, columns, a few rows)."""
    return df.count(), df.columns, df.limit(n)
