"""Distributions and test reports: the data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, n): equal-width bins over the values' range, the top edge in the last bin; the range is two numbers."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.limit(0).select(F.lit(1).alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("bigint").alias("n"))
    width = (high - low) / bins or 1.0
    number = F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + (F.col("bin") - 1) * width).alias("low"), "n")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).count().na.fill(0)


def status_breakdown(df: DataFrame, kind: str, status: str, seconds: str) -> DataFrame:
    """Totals by kind: passed, failed, errors, success rate in percent and times."""
    n = lambda s: F.count_if(F.col(status) == s)
    return df.groupBy(kind).agg(F.count("*").alias("total"), n("PASSED").alias("passed"), n("FAILED").alias("failed"), n("ERROR").alias("errors"), F.round(100 * F.avg((F.col(status) == "PASSED").cast("double")), 4).alias("rate"), F.min(seconds).alias("fastest"), F.max(seconds).alias("slowest"), F.round(F.avg(seconds), 6).alias("mean"))


def throughput(df: DataFrame, kind: str, seconds: str) -> DataFrame:
    """Rows a second and mean latency in milliseconds by kind."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*").cast("double"), F.sum(seconds)), 6).alias("per_second"), F.round(1000 * F.avg(seconds), 4).alias("latency_ms"))
