"""Naive Bayes by tables of counts against its formula, and against Spark ML's classifier."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mendwright.operators import bayes, learned


def grams(text):
    return Counter(text.lower()[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1))


def brute(train, texts):
    """The likeliest label of each text, with its probability, over all n-grams of the training rows."""
    rows, counts = Counter(), {}
    for label, text in train:
        if label is not None and text is not None:
            rows[label] += 1
            counts.setdefault(label, Counter()).update(grams(text))
    known = {g for c in counts.values() for g in c}
    each = 1000 / len(known)
    out = {}
    for x in texts:
        score = {
            label: round(math.log((rows[label] + each) / (rows.total() + each * len(rows))) + sum(n * math.log((counts[label][g] + each) / (counts[label].total() + 1000)) for g, n in grams(x).items() if g in known), 9)
            for label in rows
        }
        best = min(score, key=lambda k: (-score[k], k))  # noqa: B023
        out[x] = (best, 1 / sum(math.exp(v - score[best]) for v in score.values()))
    return out


def sample(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeé") for _ in range(n))
    names = [word(r.randint(1, 9)) for _ in range(40)]
    train = [(n, n[: r.randint(0, len(n))] + word(r.randint(0, 3))) for n in names for _ in range(r.randint(1, 5))]
    train += [("", "abab"), ("two", "one one"), ("twin", "one one"), (None, "abc"), ("abc", None), ("long", "abc" * 60)]
    return train, sorted({*names, *(word(5) for _ in range(60)), "", "q", "qq", "ABC", "abc" * 100, "one one", "deé" * 2})


@pytest.mark.parametrize("text_rows,label_rows", [(4000, 1000), (7, 1000), (4000, 3), (10, 4)])
def test_the_likeliest_label(spark, text_rows, label_rows):
    train, texts = sample(3)
    model = bayes.fit(spark.createDataFrame(train, "correct_text string, input_text string"))
    inputs = spark.createDataFrame([(x,) for x in [*texts, texts[0], None]], "input string")
    got = {r["input"]: (r["label"], r["confidence"]) for r in bayes.predict(model, inputs, text_rows, label_rows).collect()}
    expected = brute(train, texts)
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in expected.items()}
    assert all(got[x][1] == pytest.approx(expected[x][1], abs=2e-8) for x in texts)
    assert got["one one"][0] == "twin"  # of two labels that are alike the first


def test_the_same_as_the_classifier_of_spark(spark):
    rows = [(f"{k}", x, y) for k, (y, x) in enumerate(sample(5)[0]) if y is not None and x is not None and y != "twin"]
    train = spark.createDataFrame(rows, "row_id string, input_text string, correct_text string")
    theirs = {r["input_text"]: (r["predicted"], r["confidence"]) for r in learned.predict(learned.fit(train, "naive_bayes", 10000), train).collect()}
    size = float(len({g for _, x, _ in rows for g in grams(x)}))  # its smoothing is one for each n-gram
    ours = {r["input"]: (r["label"], r["confidence"]) for r in bayes.predict(bayes.fit(train, pseudo=size), train.select(F.col("input_text").alias("input"))).collect()}
    assert ours.keys() == theirs.keys() and all(ours[x][1] == pytest.approx(theirs[x][1], abs=1e-7) for x in ours)
    assert sum(ours[x][0] == theirs[x][0] for x in ours) >= len(ours) - 3  # equal likelihoods alone may differ


def test_nothing_learned_or_asked(spark):
    train = spark.createDataFrame([("a", "ab")], "correct_text string, input_text string")
    asked = spark.createDataFrame([("ab",)], "input string")
    assert [tuple(r) for r in bayes.predict(bayes.fit(train), asked).collect()] == [("ab", "a", 1.0)]
    assert bayes.predict(bayes.fit(train.limit(0)), asked).collect() == [] and bayes.predict(bayes.fit(train), asked.limit(0)).collect() == []
