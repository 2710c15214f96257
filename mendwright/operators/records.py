"""Row-store access: owner-bound scans and lookups, changes as set operations, integrity, views and search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import blank_to_null, iso_date, trimmed


def owned(df: DataFrame, owner: str, who) -> DataFrame:
    """The caller's rows alone; every access goes through this filter."""
    return df.where(F.col(owner) == F.lit(who))


def owned_latest_first(df: DataFrame, owner: str, who, stamps: list[str], key: str) -> DataFrame:
    return owned(df, owner, who).orderBy(*[F.col(s).desc() for s in stamps], key)


def lookup(df: DataFrame, owner: str, who, key: str, value) -> DataFrame:
    """The caller's row of a key, a value or a column that gives one."""
    return owned(df, owner, who).where(F.col(key) == F.lit(value)).limit(1)


def allowed(df: DataFrame, names: list[str]) -> DataFrame:
    """The allowed columns that are there, in the list's order."""
    return df.select(*[c for c in names if c in df.columns])


def upserted(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` take the place of rows with their key, new ones are added."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def set_null(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """A deleted parent's reference becomes null."""
    gone = keys.select(F.col(key).alias(column), F.lit(True).alias("__gone")).distinct()
    return df.join(gone, column, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone").select(*df.columns)


def restricting(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Parents that can't be deleted because rows refer to them."""
    return keys.join(df.select(F.col(column).alias(key)), key, "left_semi")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def matching_text(columns: Iterable[str], q: str) -> Column:
    """Does the trimmed, lower-cased query occur in the fields joined by spaces?"""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.trim(F.lit(q))))


def filtered(df: DataFrame, equal: dict[str, str | None]) -> DataFrame:
    """Equality filters; "All", an empty string and None don't filter."""
    for c, v in equal.items():
        if v not in (None, "", "All"):
            df = df.where(F.col(c) == v)
    return df


def label(plate: Column, brand: Column, model: Column, key: Column) -> Column:
    """The plate, else brand and model, else six characters of the key."""
    return F.coalesce(blank_to_null(plate), F.nullif(trimmed(F.concat_ws(" ", brand, model)), F.lit("")), F.substring(key.cast("string"), 1, 6))


def titled(brand: Column, model: Column, suffix: Column) -> Column:
    return F.concat(F.concat_ws(" ", brand, blank_to_null(model)), F.when(suffix.isNotNull() & (suffix != ""), F.concat(F.lit(" ("), suffix, F.lit(")"))).otherwise(""))


def autofill(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns for a form: nothing is null, numbers are text, time stamps yyyy-MM-dd. names: new -> old."""
    kinds = dict(df.dtypes)
    return df.select(*[(iso_date(F.col(o)) if kinds[o].startswith(("timestamp", "date")) else F.coalesce(F.col(o).cast("string"), F.lit(""))).alias(n) for n, o in names.items()])


def first_keyword(df: DataFrame, key: str, text: str, keywords: list[tuple[str, list[str]]]) -> DataFrame:
    """(key, field): the first field any of whose keywords occurs in the lower-cased text. One expression, no join."""
    low = F.lower(F.col(text))
    hits = [F.when(F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in words]), F.lit(f)) for f, words in keywords]
    return df.select(key, F.coalesce(*hits).alias("field"))


def with_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, measures: list[Column]) -> DataFrame:
    """Each parent with aggregates over its children (none: nulls). Children are summed up before the join."""
    return parents.join(children.groupBy(F.col(foreign).alias(key)).agg(*measures), key, "left")
