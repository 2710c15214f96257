"""Row numbers over a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendwright.functions.storage import kept


def numbered(df: DataFrame, order: list[str], name: str = "position", by: str | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of the columns, anew for each value of ``by``.

    Rows are dealt by ranges of the order, numbered inside each range, and moved on by the rows of the ranges before; these counts, one for
    each range and value of ``by`` in it, are all that is gathered.
    """
    keys = [*([by] if by else []), *[c for c in order if c != by]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    group = ["_range", *([by] if by else [])]
    before = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*keys)))
    return within.join(counts, group).withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before").select(*df.columns, name)
