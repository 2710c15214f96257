"""Validation rules as row predicates, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import blank_to_null, js_round, parse_date, trimmed

# The two plate rules (they differ on purpose), the phone rule and the shape of an address.
PLATE_STRICT = r"^[A-Z]{2,3}\s?\d{3,4}$"
PLATE_WIDE = r"^[A-Z]{1,3}\s?\d{1,4}\s?[A-Z]?$"
PLATE_W = r"^W[A-Z]{2}\s?\d{1,4}$"
PHONE = r"^(\+?6?01)[0-46-9]-*[0-9]{7,8}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"
MAX_UPLOAD_UI, MAX_UPLOAD = 5_000_000, 10 * 1024 * 1024


def plate_strict(x: Column) -> Column:
    return F.coalesce(F.upper(trimmed(x)).rlike(PLATE_STRICT), F.lit(False))


def plate_wide(x: Column) -> Column:
    up = F.upper(x)
    return F.coalesce(up.rlike(PLATE_WIDE) | up.rlike(PLATE_W), F.lit(False))


def phone(x: Column) -> Column:
    return F.coalesce((x == "") | x.rlike(PHONE), F.lit(True))


def violations(rules: dict[str, Column]) -> Column:
    """The names of all rules that don't hold, in their order; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def account_rules(email: Column, password: Column, first: Column, last: Column, confirm: Column) -> dict[str, Column]:
    return {"email": email.rlike(EMAIL), "password": F.length(password).between(6, 100), "first_name": F.length(first).between(2, 50), "last_name": F.length(last).between(2, 50), "confirm": password.eqNullSafe(confirm)}


def vehicle_rules(plate: Column, make: Column, model: Column, year: Column, vin: Column, score: Column, this_year: int) -> dict[str, Column]:
    some = lambda x: blank_to_null(x).isNotNull()
    return {"plate": some(plate), "make": some(make), "model": some(model), "year": year.between(1900, this_year + 1), "vin": vin.isNull() | (F.length(vin) == 17), "score": score.isNull() | score.between(0, 100)}


def document_rules(kind: Column, name: Column, size: Column, kinds: list[str], most: int = MAX_UPLOAD_UI) -> dict[str, Column]:
    return {"type": kind.isin(kinds), "name": blank_to_null(name).isNotNull(), "size": size <= most}


def expense_rules(amount: Column, owner: Column) -> dict[str, Column]:
    return {"amount": amount.try_cast("double") > 0, "vehicle": owner.isNotNull()}


def cross_checks(make: Column, ocr_make: Column, year: Column, ocr_year: Column, plate: Column) -> dict[str, Column]:
    """Declared against read values; what is missing passes, and the plate counts only if something was read."""
    read = ocr_make.isNotNull() | ocr_year.isNotNull()
    return {
        "make": F.coalesce(F.contains(F.lower(ocr_make), F.lower(make)), F.lit(True)),
        "year": F.coalesce(F.abs(year - ocr_year) <= 1, F.lit(True)),
        "plate": F.when(read & plate.isNotNull(), plate_wide(plate)).otherwise(True),
    }


def checks_score(checks: dict[str, Column]) -> Column:
    return sum((c.cast("int") for c in checks.values()), F.lit(0)) * 100 / F.lit(float(len(checks)))


def overall_score(ml: Column, cross: Column, ocr: Column) -> Column:
    return js_round(0.6 * ml + 0.3 * cross + 0.1 * ocr).cast("bigint")


def recommendations(df: DataFrame, key: str, fields: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(key, field, suggestion, priority) for invalid fields with a suggestion. fields: (name, valid, suggestion, confidence)."""
    each = [F.when(~valid & suggestion.isNotNull(), F.struct(F.lit(n).alias("field"), suggestion.alias("suggestion"), F.when(conf < 50, "high").otherwise("medium").alias("priority"))) for n, valid, suggestion, conf in fields]
    return df.select(key, F.inline(F.array_compact(F.array(*each))))


def coerced(df: DataFrame, integers: list[str], dates: list[str], texts: list[str]) -> DataFrame:
    """A patch's columns: integers, dates and trimmed texts, null where they can't be read; others are left out."""
    has = set(df.columns)
    return df.select(*[F.col(c).try_cast("double").try_cast("int").alias(c) for c in integers if c in has], *[parse_date(F.col(c)).alias(c) for c in dates if c in has], *[blank_to_null(F.col(c)).alias(c) for c in texts if c in has])
