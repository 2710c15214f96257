"""Shared column expressions. Time is always a parameter; nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Rounds half towards positive infinity."""
    return F.floor(x + 0.5)


def trimmed(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def money(x: Column) -> Column:
    """A number as decimal(12,2); what is missing or no number counts 0."""
    return F.coalesce(x.try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))


def day(x: Column) -> Column:
    return F.to_date(x)


def days_until(x: Column, as_of: Column) -> Column:
    """Calendar days from as_of's day to x's day."""
    return F.datediff(day(x), day(as_of)).cast("bigint")


def elapsed_days(x: Column, as_of: Column) -> Column:
    """Elapsed time in days, time of day included, rounded half up."""
    ms = F.unix_millis(x.cast("timestamp")) - F.unix_millis(as_of.cast("timestamp"))
    return js_round(ms / F.lit(86400000.0)).cast("bigint")


def month_start(x: Column) -> Column:
    return F.to_date(F.trunc(F.to_date(x), "MM"))


def month_spine(spark: SparkSession, as_of: str, months: int = 12) -> DataFrame:
    """(month) - the first days of the last ``months`` calendar months, as_of's included."""
    last = F.trunc(F.to_date(F.lit(as_of)), "MM")
    return spark.range(1).select(F.explode(F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))).alias("month"))


def iso_date(x: Column) -> Column:
    """yyyy-MM-dd, or an empty string."""
    return F.coalesce(F.date_format(x, "yyyy-MM-dd"), F.lit(""))


def parse_date(x: Column) -> Column:
    """ISO time stamps, yyyy-MM-dd and dd.MM.yyyy (also with - or /); null for anything else."""
    t = trimmed(x)
    dotted = F.regexp_replace(t, r"^(\d{2})[.\-/](\d{2})[.\-/](\d{4})$", "$3-$2-$1")
    return F.coalesce(F.try_to_timestamp(dotted, F.lit("yyyy-MM-dd")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), t.try_cast("timestamp")))


def size_label(x: Column) -> Column:
    """Bytes as MB, KB (one decimal, halves up) or B."""

    def one(unit: int) -> Column:
        tenths = F.floor((x + unit // 20) / F.lit(unit // 10))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.when(x >= 1_000_000, F.concat(one(1_000_000), F.lit(" MB"))).when(x >= 1_000, F.concat(one(1_000), F.lit(" KB"))).otherwise(F.concat(x.cast("string"), F.lit(" B")))


def shortened(x: Column, most: int = 120) -> Column:
    """The first ``most`` characters and three dots when there are more."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def char_ngrams(x: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the lengths low..high, by length, then position."""
    def of(n: int) -> Column:
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def once(x: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def currency(x: Column, places: int = 2) -> Column:
    """Ringgit as a reader sees it: ``RM``, a no-break space, thousands and decimals; the sign comes first."""
    d = x.cast("double")
    return F.concat(F.when(d < 0, "-").otherwise(""), F.lit("RM\u00a0"), F.format_number(F.abs(d), places))


def kilometres(x: Column) -> Column:
    return F.concat(F.format_number(x.cast("bigint"), 0), F.lit(" km"))


def number_prefix(x: Column) -> Column:
    """The number that a text begins with, after white space; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")


def progress(x: Column, whole: int) -> Column:
    """How far into its current ``whole`` a count is, in percent; nulls are at the beginning."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0)) % whole * 100 / whole))


def uri_part(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def midnight_text(x: Column) -> Column:
    return F.concat(F.date_format(x, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
