"""The radial-basis machine, boosted trees and row numbers."""

import random
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from mendwright.functions.numbering import numbered
from mendwright.operators.machines import FourierFeatures, SoftmaxBoosting, Trees, wave_weights
from mendwright.plans import registry

SF = "/root/testdata/sf0.001"


def rings(n, seed):
    """Points on three rings: no line parts them."""
    r = np.random.default_rng(seed)
    label = r.integers(0, 3, n)
    angle = r.uniform(0, 2 * np.pi, n)
    size = 0.6 + label + r.normal(0, 0.12, n)
    return np.c_[size * np.cos(angle), size * np.sin(angle)], label


def frame(spark, x, y):
    vector = lambda k, a: Vectors.dense(a) if k % 2 else Vectors.sparse(2, [0, 1], a)
    return spark.createDataFrame([(vector(k, a), int(b)) for k, (a, b) in enumerate(zip(x.tolist(), y, strict=True))], ["features", "label_index"])


def test_waves_stand_for_the_kernel(spark):
    x, y = rings(60, 1)
    got = np.array([r["waves"].toArray() for r in FourierFeatures(size=2, dims=4000, gamma=0.7).transform(frame(spark, x, y)).collect()])
    w, b = wave_weights(2, 4000, 0.7, 42)
    assert np.allclose(got, np.sqrt(2 / 4000) * np.cos(x @ w + b))
    kernel = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(got @ got.T - kernel).max() < 0.1


def test_radial_machine_against_a_kernel_machine(spark, tmp_path):
    (x, y), (u, v) = rings(400, 2), rings(300, 3)
    steps = [FourierFeatures(size=2, dims=200, gamma=1.0), LogisticRegression(featuresCol="waves", labelCol="label_index", maxIter=60)]
    model = Pipeline(stages=steps).fit(frame(spark, x, y))
    model.write().overwrite().save(f"{tmp_path}/m")
    out = PipelineModel.load(f"{tmp_path}/m").transform(frame(spark, u, v)).select("prediction", "probability").collect()
    ours = np.mean([r["prediction"] for r in out] == v)
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2))
    weights = np.linalg.solve(kernel(x, x) + 1e-2 * np.eye(len(x)), np.eye(3)[y])
    theirs = np.mean((kernel(u, x) @ weights).argmax(1) == v)
    linear = LogisticRegression(labelCol="label_index").fit(frame(spark, x, y)).transform(frame(spark, u, v))
    assert theirs > 0.95 and ours > theirs - 0.03 and linear.where("prediction = label_index").count() / len(v) < 0.6
    assert all(abs(r["probability"].toArray().sum() - 1) < 1e-9 for r in out)


def words(n, seed):
    """Rows of features that are there; the label follows from two of them."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        there = sorted({f for f in range(12) if r.random() < 0.5})
        rows.append((Vectors.sparse(12, there, [1.0] * len(there)), 2 * (3 in there) + (7 in there)))
    return rows


def test_boosting(spark, tmp_path):
    train, test = (spark.createDataFrame(words(n, s), ["features", "label_index"]) for n, s in ((500, 1), (300, 2)))
    model = SoftmaxBoosting(maxIter=8, maxDepth=2).fit(train)
    out = model.transform(test)
    assert out.where("prediction = label_index").count() >= 297
    trees = Trees.of(model.getOrDefault("trees"))
    assert {int(f) for s in trees.splits[:3] for f in s[:, 0]} <= {3, 7}
    p = trees.probabilities(trees.there([r["features"].indices for r in test.collect()]))
    assert np.allclose(p, [r["probability"].toArray() for r in out.collect()])
    model.write().overwrite().save(f"{tmp_path}/b")
    again = type(model).load(f"{tmp_path}/b").transform(test)
    assert [r["prediction"] for r in again.collect()] == [r["prediction"] for r in out.collect()]


def test_first_splits_are_brute_force(spark):
    rows = words(200, 5)
    model = SoftmaxBoosting(maxIter=1, maxDepth=1, stepSize=1.0).fit(spark.createDataFrame(rows, ["features", "label_index"]).repartition(7))
    trees = Trees.of(model.getOrDefault("trees"))
    x = np.zeros((200, 12), bool)
    for k, (v, _) in enumerate(rows):
        x[k, v.indices] = True
    y = np.eye(4)[[b for _, b in rows]]
    prior = y.sum(0) + 0.5
    p = prior / prior.sum()
    for label in range(4):
        g, h = y[:, label] - p[label], np.full(200, p[label] * (1 - p[label]))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1e-6)  # noqa: B023, E731
        best = max(range(12), key=lambda f: (round(score(x[:, f]) + score(~x[:, f]) - score(np.ones(200, bool)), 9), -f))  # noqa: B023
        assert trees.splits[0][label, 0] == best
        assert np.allclose(trees.values[0][label], [0.75 * np.clip(g[m].sum() / (h[m].sum() + 1e-6), -4, 4) for m in (~x[:, best], x[:, best])])


def test_boosting_of_nothing(spark):
    none = spark.createDataFrame(words(3, 1), ["features", "label_index"])
    model = SoftmaxBoosting().fit(none.where("label_index > 9"))
    assert [r["prediction"] for r in model.transform(none).collect()] == [0.0] * 3
    blank = spark.createDataFrame([(Vectors.sparse(4, [], []), 1), (Vectors.sparse(4, [], []), 1), (Vectors.sparse(4, [], []), 0)], ["features", "label_index"])
    assert [r["prediction"] for r in SoftmaxBoosting().fit(blank).transform(blank).collect()] == [1.0] * 3


@pytest.mark.parametrize("name", ["svm_classifier", "boosting_classifier"])
def test_queries(spark, name):
    began = time.time()
    rows = registry.QUERIES[name](spark, SF).collect()
    assert time.time() - began < 240 and all(0 <= r["confidence"] <= 1 for r in rows)
    told = [r for r in rows if r["predicted"]]
    assert len(told) > 0.8 * len(rows) and sum(r["predicted"] == r["correct_text"] for r in told) > 0.7 * len(told)


def test_numbers(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.randrange(50)) for _ in range(300)] + [(None, 3), ("a", None)]
    df = spark.createDataFrame(rows, "kind string, value int")
    got = sorted((x["position"], x["value"] if x["value"] is not None else -1) for x in numbered(df, ["value"]).collect())
    assert got == list(enumerate(sorted(v if v is not None else -1 for _, v in rows), 1))
    each = numbered(df.where("kind is not null"), ["value"], "n", by="kind").collect()
    for kind in "abc":
        mine = sorted((x["n"], x["value"] if x["value"] is not None else -1) for x in each if x["kind"] == kind)
        assert mine == list(enumerate(sorted(v if v is not None else -1 for k, v in rows if k == kind), 1))
    assert numbered(df.limit(0), ["value"]).collect() == [] and numbered(df, ["value"]).columns == ["kind", "value", "position"]
