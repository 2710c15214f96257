"""Correctors that plug in, the harness, and the ensemble of real correctors."""

import random

import pytest
from pyspark.sql import functions as F

from mendwright.operators import cascade, harness, reports, synthetic
from mendwright.plans import matching, registry

SF = "/root/testdata/sf0.001"


def table_corrector():
    def fixed(text):  # inside, so that it travels by value
        if text == "bad":
            raise KeyError("bad")
        return {"toyot": ("toyota", 0.9, "table"), "hond": ("honda", 0.5, "table"), "blank": (" ", 0.9, "table")}.get(text, (None, 0.0, "table"))

    return harness.of_function(fixed)


def test_functions_columns_and_fallback(spark):
    inputs = spark.createDataFrame([("toyot",), ("hond",), ("bad",), ("blank",), ("zz",), (None,), ("toyot",)], "input string")
    plug_in, upper = table_corrector(), harness.of_column(lambda x: F.struct(F.upper(x).alias("corrected"), F.lit(0.8).alias("confidence")), "upper")
    got = {r["input"]: (r["candidate"], r["confidence"], r["method"], r["error"]) for r in harness.answers(plug_in, inputs).collect()}
    assert got == {"toyot": ("toyota", 0.9, "table", None), "hond": ("honda", 0.5, "table", None), "bad": (None, 0.0, None, "KeyError: 'bad'")}
    both = {r["input"]: (r["candidate"], r["method"]) for r in harness.answers(harness.fallback([plug_in, upper]), inputs).collect()}
    assert both == {"toyot": ("toyota", "table"), "hond": ("HOND", "upper"), "bad": ("BAD", "upper"), "blank": ("BLANK", "upper"), "zz": ("ZZ", "upper")}
    assert harness.answers(plug_in, inputs.limit(0)).collect() == []


def test_several_answers(spark):
    inputs = spark.createDataFrame([("a",)], "input string")
    many = lambda df: df.select("input", F.explode(F.array(F.struct(F.lit("y").alias("candidate"), F.lit(0.9).alias("confidence")), F.struct(F.lit("x").alias("candidate"), F.lit(0.9).alias("confidence")), F.struct(F.lit("z").alias("candidate"), F.lit(0.1).alias("confidence")))).alias("s")).select("input", "s.*")
    assert harness.answers(many, inputs).first()["candidate"] == "x"


def test_cases(spark):
    cases = spark.createDataFrame([("a", "toyot", "toyota"), ("a", "hond", "other"), ("b", "bad", "x"), ("b", "zz", None), ("b", "zz", "y"), ("b", None, None)], "kind string, input string, expected string")
    rows = harness.tried({"table": table_corrector()}, cases)
    assert sorted((r["kind"], r["input"] or "", r["expected"] or "", r["status"]) for r in rows.collect()) == [("a", "hond", "other", "FAILED"), ("a", "toyot", "toyota", "PASSED"), ("b", "", "", "PASSED"), ("b", "bad", "x", "ERROR"), ("b", "zz", "", "PASSED"), ("b", "zz", "y", "FAILED")]
    report = {r["kind"]: (r["total"], r["passed"], r["failed"], r["errors"]) for r in reports.status_breakdown(rows, "kind", "status", "seconds").collect()}
    assert report == {"a": (2, 1, 1, 0), "b": (4, 2, 1, 1)}


def test_the_ensemble_is_the_vote_of_its_correctors(spark):
    inputs = matching._inputs(spark, SF)
    given = {name: {r["input"]: (r["candidate"], r["confidence"]) for r in harness.answers(c, inputs).collect()} for name, c in matching._correctors(spark, SF).items()}
    assert min(map(len, given.values())) > 20, {k: len(v) for k, v in given.items()}
    expected = {}
    for x in {i for v in given.values() for i in v}:
        sums = {}
        for name, v in given.items():
            if x in v:
                sums[v[x][0]] = sums.get(v[x][0], 0) + cascade.VOTE_WEIGHTS[name] * v[x][1]
        best = min(sums, key=lambda c: (-round(sums[c], 9), c))  # noqa: B023
        if round(sums[best], 6) >= 0.6:
            expected[x] = (best, round(sums[best], 6))
    got = {r["input"]: (r["candidate"], r["confidence"]) for r in registry.QUERIES["ensemble_correct"](spark, SF).collect()}
    assert got.keys() == expected.keys() and all(got[x][0] == expected[x][0] and got[x][1] == pytest.approx(expected[x][1], abs=2e-6) for x in got)


def test_gram_vectors_are_made_once_a_text(spark, monkeypatch):
    real, given = matching.nearest.nearest, []
    monkeypatch.setattr(matching.nearest, "nearest", lambda q, t, *more: given.extend((q, t)) or real(q, t, *more))
    assert matching._embedding(matching._names(spark, SF))(matching._inputs(spark, SF)).count() > 20
    for df in given:  # a filter on the vectors doesn't bring them back to the rows before distinct
        plan = df.where("embedding[0] > 0")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "xxhash64" not in plan
        for r in df.collect():
            n = len(r["vec_id"]) - 2
            assert len(r["embedding"]) == 64 and sum(r["embedding"]) == n - 1 + max(n - 2, 0)


def test_the_comparison_asks_each_corrector_once(spark, monkeypatch):
    asked = []

    def corrector(name):
        return lambda inputs: asked.append(name) or inputs.select("input", F.col("input").alias("candidate"), F.lit(0.9).alias("confidence"))

    monkeypatch.setattr(matching, "_correctors", lambda spark, sf_dir: {name: corrector(name) for name in cascade.VOTE_WEIGHTS})
    rows = {r["corrector"]: (r["accuracy"], r["coverage"], r["n"]) for r in registry.QUERIES["model_comparison"](spark, SF).collect()}
    same = matching._cases(spark, SF).where("input = expected").count()
    assert sorted(asked) == sorted(cascade.VOTE_WEIGHTS) and rows == dict.fromkeys([*cascade.VOTE_WEIGHTS, "ensemble"], (round(same / 200, 6), 1.0, 200))


def test_model_comparison(spark):
    rows = registry.QUERIES["model_comparison"](spark, SF).collect()
    assert {r["corrector"] for r in rows} == {"rule", "ml", "transformer", "ensemble"}
    assert [r["pseudo_f1"] for r in rows] == sorted((r["pseudo_f1"] for r in rows), reverse=True)
    by = {r["corrector"]: r for r in rows}
    assert by["rule"]["accuracy"] > 0.8 and by["ensemble"]["accuracy"] > 0.9 and len({r["n"] for r in rows}) == 1


def test_every_name_is_learned(spark):
    # more names than any fixed number of training rows used to cover
    words = spark.range(2200).select(F.translate(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 10), "0123456789", "ghijklmnop").alias("candidate"))
    told = harness.answers(matching._learned(words), words.select(F.col("candidate").alias("input"))).select("input", "candidate").collect()
    assert len(told) == 2200 and sum(r["input"] == r["candidate"] for r in told) > 2180


def test_training_rows_of_a_name_hang_on_it_alone(spark):
    rows = lambda *names: {tuple(r) for r in synthetic.faults_of_each(spark.createDataFrame([(x,) for x in names], "value string")).collect()}
    few, many = rows("old gear"), rows("old gear", "red rod", None, "red rod", "x")
    assert len(few) == 72 and len(many) == 3 * 72 and few < many
    assert {n for *_, n in few} == {1, 2} and {t for i, t, c, n in many if c == "x"} == {"x"}


def test_names_that_differ_in_rare_letters_are_told_apart(spark):
    # over 1,000 n-grams stand in more names than the last two letters do
    r = random.Random(1)
    bases = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(8)]
    names = spark.createDataFrame([(b + chr(945 + k) + chr(945 + k * 7 % 24),) for b in bases for k in range(20)], "candidate string")
    told = harness.answers(matching._learned(names), names.select(F.col("candidate").alias("input"))).select("input", "candidate").collect()
    assert len(told) == 160 and all(r["input"] == r["candidate"] for r in told)
