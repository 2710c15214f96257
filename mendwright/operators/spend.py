"""Spend analytics over (amount, category, date, created, owner) records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwright.functions.expr import js_round, money, month_spine, month_start

# How stored categories, older aliases among them, are shown.
CATEGORY_LABELS = {
    "Fuel": "Fuel",
    "Maintenance": "Maintenance",
    "Service": "Maintenance",
    "Parts": "Maintenance",
    "Insurance": "Insurance",
    "RoadTax": "Road Tax",
    "Tax": "Road Tax",
    "Toll_Parking": "Toll/Parking",
    "Toll": "Toll/Parking",
    "General": "Other",
    "Other": "Other",
}


def relabelled(category: Column, labels: dict[str, str], other: str | None = None) -> Column:
    """The label of a stored value; unknown values keep their name, or become ``other``."""
    table = F.create_map(*[F.lit(x) for p in labels.items() for x in p])
    return F.coalesce(F.try_element_at(table, category), F.lit(other) if other is not None else category)


def total(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(money(F.col(amount))), F.lit(0)).cast("double").alias("total"), F.count("*").alias("records"))


def month_total(df: DataFrame, amount: str, date: Column, as_of: str) -> DataFrame:
    """Spend in as_of's calendar month; the bounds of the month reach the scan."""
    first = F.trunc(F.to_date(F.lit(as_of)), "MM")
    inside = (date >= first.cast("timestamp_ntz")) & (date < F.add_months(first, 1).cast("timestamp_ntz"))
    return df.where(inside).agg(F.coalesce(F.sum(money(F.col(amount))), F.lit(0)).cast("double").alias("month_total"))


def monthly_series(df: DataFrame, amount: str, date: Column, as_of: str, months: int = 12, until_now: bool = True) -> DataFrame:
    """(month, label, total, rounded): every month of the window, empty ones as 0.

    ``until_now`` leaves out what is dated after as_of; without it a later day of the current month counts.
    The filter on dates reaches the scan; the sums are made before the join with the twelve months.
    """
    spine = month_spine(df.sparkSession, as_of, months)
    first = F.add_months(F.trunc(F.to_date(F.lit(as_of)), "MM"), -(months - 1)).cast("timestamp")
    last = F.lit(as_of).cast("timestamp")
    within = (date >= first) & ((date <= last) if until_now else (date < F.add_months(F.trunc(F.to_date(last), "MM"), 1).cast("timestamp")))
    sums = df.where(within).groupBy(month_start(date).alias("month")).agg(F.sum(money(F.col(amount))).alias("s"))
    joined = spine.join(sums, "month", "left").withColumn("total", F.coalesce("s", F.lit(0)).cast("double"))
    return joined.select("month", F.date_format("month", "MM/yy").alias("label"), "total", js_round(F.col("total")).cast("bigint").alias("rounded"))


def monthly_average(df: DataFrame, amount: str, date: Column, as_of: str) -> DataFrame:
    return monthly_series(df, amount, date, as_of).agg((F.sum("total") / 12).alias("average"))


def by_category(df: DataFrame, amount: str, label: Column, positive_only: bool = False) -> DataFrame:
    out = df.groupBy(label.alias("category")).agg(F.sum(money(F.col(amount))).cast("double").alias("total"), F.count("*").alias("records"))
    return out.where("total > 0") if positive_only else out


def category_shares(df: DataFrame, amount: str, label: Column) -> DataFrame:
    sums = by_category(df, amount, label)
    whole = Window.partitionBy()  # one row for each category
    return sums.withColumn("share", F.round(F.try_divide("total", F.sum("total").over(whole)), 6))


def recent(df: DataFrame, n: int, date: Column, created: Column, key: str) -> DataFrame:
    """The n latest records by date, else creation, else the epoch; ties by key."""
    return df.orderBy(F.coalesce(date, created, F.lit("1970-01-01").cast("timestamp_ntz")).desc(), F.col(key)).limit(n)


def latest_per_owner(df: DataFrame, owner: str, stamp: str, key: str) -> DataFrame:
    """Each owner's latest record, ties to the larger key: an aggregate, no sort of the owner's rows."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(stamp), F.col(key)))
    return df.groupBy(F.col(owner).alias("__owner")).agg(best.alias("r")).select("r.*")


def first_records(df: DataFrame, owner: str, order: str, n: int = 2) -> DataFrame:
    """Each owner's first n rows; ranks are cut before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(owner).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")
