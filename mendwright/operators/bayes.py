"""Multinomial naive Bayes over character n-grams for any number of labels: counts are tables, and no vocabulary or matrix is gathered.

``fit`` counts each label's n-grams (of two to four characters, lower-cased), all of them; ``predict`` gives each text's likeliest label and
its probability among all labels; n-grams that no label has don't count, as in Spark ML's classifier. A label's counts are smoothed by ``PSEUDO``
more in all, shared out over the n-grams: a fixed share for each n-gram would outweigh the counts the more n-grams there are, and hide how long labels are.

Each text meets each label, since a probability is a share of all labels: as blocks of ``TEXTS`` texts and ``LABELS`` labels, so no task holds
more than two blocks, however many there are. A block hands on its best label and the sum of its likelihoods relative to that one.

Defined cases: null labels and texts aren't among the rows; texts without a known n-gram have the label with the most rows; log-likelihoods
that are equal to nine decimals are ties, which go to the first label.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import char_ngrams
from mendwright.functions.storage import kept

#: Texts and labels of a block.
TEXTS, LABELS = 4000, 1000
#: What smoothing adds to a label's counts: as much as one for each of the 1,000 n-grams that used to be told apart.
PSEUDO = 1000.0


class Model(NamedTuple):
    """labels: (label, prior, scale); grams: (label, gram, weight). A text's log-likelihood is ``prior``, less ``scale`` for each of its n-grams,
    and ``weight`` for each that the label has."""

    labels: DataFrame
    grams: DataFrame


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): how often each n-gram stands in the texts of a key."""
    return df.select(key, F.explode(char_ngrams(F.lower(F.col(text)), 2, 4)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def fit(train: DataFrame, text: str = "input_text", label: str = "correct_text", pseudo: float = PSEUDO) -> Model:
    # kept: filters would else move into what makes the texts
    own = kept(train.select(F.col(label).alias("label"), F.col(text).alias("text"))).where("label is not null and text is not null")
    grams = kept(_grams(own, "label", "text"))
    each = pseudo / max(1, grams.select("gram").distinct().count())
    rows = own.groupBy("label").agg(F.count("*").alias("rows"))
    total = own.count() + each * rows.count()
    sums = grams.groupBy("label").agg(F.sum("n").alias("n"))
    prior, scale = F.log((F.col("rows") + F.lit(each)) / F.lit(total)), F.log((F.coalesce("n", F.lit(0)) + F.lit(pseudo)) / F.lit(each))
    labels = kept(rows.join(sums, "label", "left").select("label", prior.alias("prior"), scale.alias("scale")))
    return Model(labels, grams.select("label", "gram", F.log(F.col("n") / F.lit(each) + 1.0).alias("weight")))


def _block(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """(input, label, score, mass) of a block of texts (input, gram, n) and one of labels (label, gram, weight, prior, scale)."""
    if not len(mine) or not len(theirs):
        return pd.DataFrame({"input": [], "label": [], "score": [], "mass": []}, dtype=object)
    text, texts = pd.factorize(mine["input"], sort=True)
    label, labels = pd.factorize(theirs["label"], sort=True)  # of equals the first is the smallest
    per = theirs.drop_duplicates("label").sort_values("label")
    length = np.bincount(text, mine["n"].to_numpy(), len(texts))
    scores = per["prior"].to_numpy()[None, :] - length[:, None] * per["scale"].to_numpy()[None, :]
    x, y = mine.assign(at=text).dropna(subset="gram"), theirs.assign(at=label).dropna(subset="gram")
    of_text, of_label = x.groupby("gram").indices, y.groupby("gram").indices
    x_at, x_n, y_at, y_weight = x["at"].to_numpy(), x["n"].to_numpy(np.float64), y["at"].to_numpy(), y["weight"].to_numpy()
    for gram in sorted(of_text.keys() & of_label.keys()):  # in the same order for a pair in every block
        i, k = of_text[gram], of_label[gram]
        scores[np.ix_(x_at[i], y_at[k])] += np.outer(x_n[i], y_weight[k])
    scores = np.round(scores, 9)
    best = scores.argmax(1)
    top = scores[np.arange(len(best)), best]
    return pd.DataFrame({"input": texts, "label": labels[best], "score": top, "mass": np.exp(scores - top[:, None]).sum(1)})


def predict(model: Model, texts: DataFrame, text_rows: int = TEXTS, label_rows: int = LABELS) -> DataFrame:
    """(input, label, confidence) of each distinct text (input)."""
    own = kept(texts.select("input").where("input is not null").distinct())
    x_parts, y_parts = (max(1, -(-n // rows)) for n, rows in ((own.count(), text_rows), (model.labels.count(), label_rows)))
    known = _grams(own, "input", "input").join(model.grams.select("gram").distinct(), "gram", "left_semi")
    x = own.join(known, "input", "left").select("input", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    y = model.labels.join(model.grams, "label", "left").select("label", "gram", "weight", "prior", "scale")
    slot = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    x = x.withColumn("xs", slot("input", x_parts)).withColumn("ys", all_of(y_parts))
    y = y.withColumn("ys", slot("label", y_parts)).withColumn("xs", all_of(x_parts))
    met = x.groupBy("xs", "ys").cogroup(y.groupBy("xs", "ys")).applyInPandas(lambda mine, theirs: _block(mine, theirs), "input string, label string, score double, mass double")
    best = met.groupBy("input").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("b"), F.array_sort(F.collect_list(F.struct("score", "mass"))).alias("blocks"))
    mass = F.aggregate("blocks", F.lit(0.0), lambda s, k: s + k["mass"] * F.exp(k["score"] - F.col("b.score")))
    return best.select("input", "b.label", F.round(1 / mass, 9).alias("confidence"))
