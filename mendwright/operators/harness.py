"""Correctors that plug in, alone or in a row, and the harness that tries them on cases.

A corrector takes a DataFrame of distinct texts (input) and gives (input, candidate, confidence, method) for those it has an answer to.
``of_function`` makes one of a Python function text -> (text, confidence, method), which runs by batches where the rows are; what it raises
is kept as its answer's ``error``, the other rows go on. ``of_column`` makes one of an expression. ``fallback`` asks one after another, each
for what the earlier ones had no sure answer to.

``tried`` runs named correctors over cases (kind, input, expected) and gives a row for each: PASSED, FAILED, or ERROR, with seconds where
they were taken; ``reports.status_breakdown`` and ``throughput`` make the report of it.

Defined cases: null texts have no answer; an answer that is null or blank is none; of several answers to one text the surest counts, ties go to the
first text; a case without an expected text passes if there is no answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Corrector = Callable[[DataFrame], DataFrame]
ANSWER = "input string, candidate string, confidence double, method string, error string, seconds double"


def of_function(f: Callable[[str], tuple[str | None, float, str]]) -> Corrector:
    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["input"]:
                began = time.perf_counter()
                try:
                    candidate, confidence, method = f(text)
                    rows.append((text, candidate, float(confidence), method, None, time.perf_counter() - began))
                except Exception as e:  # noqa: BLE001  a faulty corrector is a result
                    rows.append((text, None, 0.0, None, f"{type(e).__name__}: {e}"[:500], time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["input", "candidate", "confidence", "method", "error", "seconds"])

    return lambda inputs: inputs.mapInPandas(answered, ANSWER)


def of_column(f: Callable[[Column], Column], method: str) -> Corrector:
    """``f`` gives struct(corrected, confidence) of a text."""
    return lambda inputs: inputs.withColumn("_c", f(F.col("input"))).select("input", F.col("_c.corrected").alias("candidate"), F.col("_c.confidence").cast("double").alias("confidence"), F.lit(method).alias("method"))


def answers(corrector: Corrector, inputs: DataFrame) -> DataFrame:
    """One row for each text that the corrector has an answer or an error for, all columns of ``ANSWER``."""
    found = corrector(inputs.select("input").where("input is not null").distinct())
    for c, kind in (("method", "string"), ("error", "string"), ("seconds", "double")):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast(kind))
    there = F.when(F.trim("candidate") != "", F.col("candidate"))
    found = found.select("input", there.alias("candidate"), F.col("confidence").cast("double").alias("confidence"), "method", "error", "seconds").where("candidate is not null or error is not null")
    order = F.struct(F.col("candidate").isNull(), -F.coalesce("confidence", F.lit(0.0)), "candidate")
    rest = ["candidate", "confidence", "method", "error", "seconds"]
    return found.groupBy("input").agg(F.min_by(F.struct(*rest), order).alias("b")).select("input", "b.*")


def fallback(correctors: list[Corrector], threshold: float = 0.7) -> Corrector:
    """The first answer of ``threshold`` or more; each corrector sees only what is still open."""

    def one(inputs: DataFrame) -> DataFrame:
        left, sure = inputs, []
        for corrector in correctors:
            found = answers(corrector, left).where(F.col("candidate").isNotNull() & (F.col("confidence") >= threshold))
            sure.append(found)
            left = left.join(found.select("input"), "input", "left_anti")
        out = sure[0]
        for found in sure[1:]:
            out = out.unionByName(found)
        return out

    return one


def tried(correctors: dict[str, Corrector], cases: DataFrame) -> DataFrame:
    """(corrector, kind, input, expected, actual, confidence, method, status, error, seconds) of each corrector and case."""
    out = None
    for name, corrector in correctors.items():
        found = answers(corrector, cases).withColumnRenamed("candidate", "actual")
        rows = cases.select("kind", "input", "expected").join(found, "input", "left")
        status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("actual").eqNullSafe(F.col("expected")), "PASSED").otherwise("FAILED")
        rows = rows.select(F.lit(name).alias("corrector"), "kind", "input", "expected", "actual", "confidence", "method", status.alias("status"), "error", "seconds")
        out = rows if out is None else out.unionByName(rows)
    return out
