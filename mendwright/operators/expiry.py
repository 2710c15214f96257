"""Expiry classes, alerts made of them, and their dismissal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import days_until, elapsed_days, iso_date


def calendar_class(x: Column, as_of: Column, window: int = 30) -> Column:
    """none, expired (before today), expiring (within the window, both ends included) or valid, by calendar days."""
    d = days_until(x, as_of)
    return F.when(x.isNull(), "none").when(d < 0, "expired").when(d <= window, "expiring").otherwise("valid")


def pill(x: Column, as_of: Column) -> Column:
    return F.when(x.isNull(), "-").when(days_until(x, as_of) < 0, "Expired").otherwise("OK")


def elapsed_class(x: Column, as_of: Column, window: int = 30) -> Column:
    """expired, expiring or ok by rounded elapsed days: half a day past is not expired."""
    d = elapsed_days(x, as_of)
    return F.when(x.isNull(), "none").when(d < 0, "expired").when(d <= window, "expiring").otherwise("ok")


def dashboard_alerts(df: DataFrame, key: str, kinds: dict[str, str], as_of: Column) -> DataFrame:
    """(key, kind, status, days, due): up to one alert a kind and record, made in one pass. kinds: label -> date column."""
    alerts = F.array(*[
        F.struct(F.lit(k).alias("kind"), elapsed_class(F.col(c), as_of).alias("status"), F.abs(elapsed_days(F.col(c), as_of)).alias("days"), iso_date(F.col(c)).alias("due"))
        for k, c in kinds.items()
    ])
    return df.select(F.col(key), F.inline(F.filter(alerts, lambda a: a["status"].isin("expired", "expiring"))))


# Priority of an alert by kind, when past its date and when due.
PRIORITIES = {"insurance": ("high", "medium"), "roadtax": ("high", "medium"), "service": ("medium", "low")}
PRIORITY_ORDER = {"high": 3, "medium": 2, "low": 1}


def smart_alerts(df: DataFrame, key: str, label: Column, kinds: dict[str, str], as_of: Column, tip: str | None = None, window: int = 30) -> DataFrame:
    """(id, kind, priority, title, message, due): expired and expiring dates by calendar days, and one daily tip.

    The id is ``kind-record-date``, so the same alert keeps its id. One pass over the records.
    """
    def one(kind: str, c: str) -> Column:
        d = days_until(F.col(c), as_of)
        past, soon = PRIORITIES[kind]
        return F.when(F.col(c).isNotNull() & (d <= window), F.struct(
            F.concat_ws("-", F.lit(kind), F.col(key).cast("string"), iso_date(F.col(c))).alias("id"), F.lit(kind).alias("kind"),
            F.when(d < 0, past).otherwise(soon).alias("priority"),
            F.concat(F.lit(kind), F.when(d < 0, F.lit(" expired")).otherwise(F.lit(" due"))).alias("title"),
            F.concat(label, F.when(d < 0, F.concat(F.lit(": "), (-d).cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit(": in "), d.cast("string"), F.lit(" days")))).alias("message"),
            iso_date(F.col(c)).alias("due"),
        ))

    out = df.select(F.inline(F.array_compact(F.array(*[one(k, c) for k, c in kinds.items()]))))
    if tip is None:
        return out
    day = F.date_format(as_of, "yyyy-MM-dd")
    once = df.sparkSession.range(1).select(F.concat(F.lit("tip-"), day).alias("id"), F.lit("tip").alias("kind"), F.lit("low").alias("priority"), F.lit("tip").alias("title"), F.lit(tip).alias("message"), day.alias("due"))
    return out.unionByName(once)


def priority_weight(p: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for q in PRIORITY_ORDER.items() for x in q]), p)


def not_dismissed(alerts: DataFrame, dismissed: DataFrame, as_of: Column) -> DataFrame:
    """Alerts without those whose dismissal still holds."""
    return alerts.join(dismissed.where(F.col("until") > as_of), "id", "left_anti")


def dismiss(dismissed: DataFrame, ids: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The dismissals that still hold, and ``ids`` until as_of + days (anew, if they were there)."""
    until = ids.select("id", (as_of + F.expr(f"interval {days} days")).alias("until")).distinct()
    return dismissed.where(F.col("until") > as_of).join(ids, "id", "left_anti").unionByName(until)


def priority_counts(alerts: DataFrame) -> DataFrame:
    n = lambda p: F.count_if(F.col("priority") == p)
    return alerts.agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), F.count("*").alias("total"), (n("high") + n("medium")).alias("actions"))


def class_counts(df: DataFrame, cls: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(cls == c).alias(c) for c in ("valid", "expiring", "expired")])
