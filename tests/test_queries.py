"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from mendwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", ["suggest_gestalt", "match_gestalt", "comprehensive_correct", "integrated_pipeline", "synthetic_dataset", "suggest_years_top5", "extract_one", "rule_corrector_accuracy", "cascade_full", "nb_classifier", "nb_cross_validation"])
def test_python_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_month_is_read(spark):
    plan = registry.QUERIES["month_spend"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_each_pattern_runs_once(spark):
    plan = registry.QUERIES["year_validation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 12


@pytest.mark.parametrize("name", ["year_validation", "cross_check", "typo_ops", "alerts_smart"])
def test_no_python_in_plans(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_filter_reaches_scan(spark):
    plan = registry.QUERIES["monthly_series_bounded"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan
    assert "o_custkey" not in plan
