"""Cleaning of master records and validation of year inputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import once, rate, trimmed

# Fixed values.
MIN_YEAR, MAX_YEAR, CUTOFF = 1980, 2025, 1900
PIVOT, LOW_MATCH, HIGH_MATCH = 50, 1900, 2030


def normalized_text(x: Column) -> Column:
    """Null as empty; lower case, trimmed, digits that were read for letters turned back: 0 to o, 1 to i, 5 to s."""
    return F.translate(trimmed(F.lower(F.coalesce(x, F.lit("")))), "015", "ois")


def century(y: Column) -> Column:
    """Two-digit years below the pivot belong to the 2000s, the others to the 1900s."""
    return F.when(y.between(0, PIVOT - 1), y + 2000).when(y.between(PIVOT, 99), y + 1900).otherwise(y)


def whole_number(x: Column) -> Column:
    """The integer part of a number in text; null for anything else, and for what no int holds."""
    d = x.try_cast("double")
    return F.when(F.abs(d) < 2_000_000_000, d.try_cast("int"))


def match_year(x: Column) -> Column:
    """The year a match compares: integer part, century, and only 1900 to 2030."""
    y = century(whole_number(x))
    return F.when(y.between(LOW_MATCH, HIGH_MATCH), y)


def clean_master(df: DataFrame, texts: list[str], years: list[str]) -> DataFrame:
    """Lower-cased, trimmed texts; years as nullable integers with their century; each distinct row once. Nulls stay nulls."""
    cols = [trimmed(F.lower(F.col(c))).alias(c) for c in texts] + [century(whole_number(F.col(c).cast("string"))).alias(c) for c in years]
    return df.select(*cols).distinct()


def year_text(x: Column) -> Column:
    """The input cut at the first point, with digits and the letters o, O, l, I alone."""
    return F.regexp_replace(F.split_part(trimmed(F.coalesce(x, F.lit(""))), F.lit("."), F.lit(1)), "[^0-9oOlI]", "")


def repaired_format(s: Column) -> Column:
    """struct(text, confidence, reason). A later repair's confidence and reason take the place of an earlier one's."""
    return once(F.translate(s, "oOlI", "0011"), lambda t: _completed(s, t))


def _completed(s: Column, t: Column) -> Column:
    two = t.rlike(r"^[0-9]{2}$")
    n = F.when(two, t.cast("int"))
    three = t.rlike(r"^20[012]$")
    text = F.when(n >= 80, F.concat(F.lit("19"), t)).when(n <= 30, F.concat(F.lit("20"), t)).when(three, F.concat(t, F.lit("0"))).otherwise(t)
    seen = s.rlike("[oOlI]")
    confidence = F.when((n >= 80) | (n <= 30), 0.8).when(three, 0.7).when(seen, 0.9).otherwise(1.0)
    reason = F.when(n >= 80, "century_completion_1900s").when(n <= 30, "century_completion_2000s").when(three, "year_completion").when(seen, "ocr_correction").otherwise("no_correction_needed")
    return F.struct(text.alias("text"), confidence.alias("confidence"), reason.alias("reason"))


def repaired_range(t: Column, low: int = MIN_YEAR, high: int = MAX_YEAR) -> Column:
    """struct(text, confidence, reason) of digits held against the allowed years. Any number of digits compares."""
    digits = F.regexp_replace(t, "^0+(?=.)", "")
    return once(F.when(t.rlike("^[0-9]+$"), F.when(F.length(digits) > 9, F.lit(999_999_999)).otherwise(digits.try_cast("int"))), lambda n: _in_range(t, n, low, high))


def _in_range(t: Column, n: Column, low: int, high: int) -> Column:
    top = F.lit(str(high))
    text = F.when(n.isNull(), t).when((n > high) | (n < CUTOFF), top).otherwise(t)
    confidence = F.when(n.isNull(), 0.0).when(n > high, 1.0).when(n < CUTOFF, 0.8).when(n < low, 0.9).otherwise(1.0)
    reason = F.when(n.isNull(), "invalid_format").when(n > high, f"future_year_corrected_to_{high}").when(n < CUTOFF, f"invalid_old_year_corrected_to_{high}").when(n < low, "old_year_accepted").otherwise("valid_year")
    return F.struct(text.alias("text"), confidence.alias("confidence"), reason.alias("reason"))


def validated(df: DataFrame, column: str, threshold: float = 0.7, prefix: str | None = None) -> DataFrame:
    """Adds <c>_original, _validated, _correction_applied, _confidence and _correction_reason. No Python code runs on rows."""
    c = prefix or column
    text = F.col(f"`{column}`").cast("string")
    original = F.coalesce(text, F.lit(""))
    if dict(df.dtypes)[column] != "string":
        original = F.when(original == "0", F.lit("")).otherwise(original)

    def judged(o: Column, s: Column, f: Column, r: Column) -> Column:
        empty = s == ""
        confidence = F.when(empty, 0.0).otherwise(F.least(f["confidence"], r["confidence"]))
        applied = ~empty & (o != r["text"]) & (F.least(f["confidence"], r["confidence"]) >= threshold)
        parts = F.filter(F.array(f["reason"], r["reason"]), lambda x: ~x.isin("no_correction_needed", "valid_year"))
        reason = F.when(empty, "empty_or_invalid_input").otherwise(F.coalesce(F.nullif(F.array_join(parts, "+"), F.lit("")), F.lit("no_correction_needed")))
        return F.struct(o.alias("original"), F.when(empty, "").when(applied, r["text"]).otherwise(o).alias("validated"), applied.alias("correction_applied"), confidence.alias("confidence"), reason.alias("correction_reason"))

    # each step once: cut, repaired in format, held against the range; as generated columns, so no filter repeats the steps
    result = F.transform(F.array(year_text(text)), lambda s: once(repaired_format(s), lambda f: once(repaired_range(f["text"]), lambda r: judged(original, s, f, r))))
    names = [f"{c}_{x}" for x in ("original", "validated", "correction_applied", "confidence", "correction_reason")]
    return df.select(*[F.col(f"`{x}`") for x in df.columns if x not in names], F.inline(result).alias(*names))


def report(df: DataFrame, c: str) -> DataFrame:
    """One row over validated years: counts, the rate, the mean of positive confidences, counts by kind of repair."""
    applied, reason, confidence = F.col(f"{c}_correction_applied"), F.col(f"{c}_correction_reason"), F.col(f"{c}_confidence")
    return df.agg(
        F.count("*").alias("total"), F.count_if(applied).alias("corrected"), F.round(rate(F.count_if(applied), F.count("*")), 6).alias("rate"),
        F.round(F.coalesce(F.avg(F.when(confidence > 0, confidence)), F.lit(0.0)), 6).alias("mean_confidence"),
        F.count_if(F.contains(reason, F.lit("future_year_corrected"))).alias("future"), F.count_if(F.contains(reason, F.lit("ocr")) | F.contains(reason, F.lit("completion"))).alias("repaired"),
    )


def reasons(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.col(f"{c}_correction_reason").alias("reason")).agg(F.count("*").alias("n"))
