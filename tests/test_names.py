"""Jaro and Jaro-Winkler similarity against DuckDB (which counts bytes, so ASCII alone is compared)."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mendwright.functions.names import jaro, jaro_winkler


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "aeiouxyz-1", "abcdefghijklmnopqrstuvwxyz"])
def test_is_duckdb(spark, letters):
    r = random.Random(letters)
    word = lambda n: "".join(r.choices(letters, k=r.randrange(n)))
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "a"), ("martha", "marhta"), ("dixon", "dicksonx"), ("toyota", "toyot")]
    for _ in range(400):
        a = word(14)
        pairs.append((a, word(14) if r.random() < 0.4 else "".join(c for c in a if r.random() < 0.8) + word(3)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro(F.col("a"), F.col("b")), jaro_winkler(F.col("a"), F.col("b"))).collect()
    for a, b, j, w in got:
        other = duckdb.execute("select jaro_similarity(?, ?), jaro_winkler_similarity(?, ?)", [a, b, a, b]).fetchone()
        assert (j, w) == pytest.approx(other, abs=1e-12), (a, b)


def test_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(jaro(F.col("a"), F.col("b")), jaro_winkler(F.col("a"), F.col("b"))).collect()] == [(None, None)] * 3


def test_letters_are_characters(spark):
    r = spark.createDataFrame([("é漢a", "é漢b")], "a string, b string").select(jaro(F.col("a"), F.col("b"))).first()
    assert r[0] == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)
