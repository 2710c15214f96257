"""Two learners that Spark ML lacks: radial-basis features for linear machines, and boosted trees for many labels at once.

``FourierFeatures`` draws random waves whose products stand for the radial-basis kernel exp(-gamma * |x - y|^2); a linear machine with
softmax probabilities over them is a kernel machine, and its cost grows with the rows, not with pairs of rows.

``SoftmaxBoosting`` grows one small tree for each label an iteration, all of them in the same jobs: a job a level. Each task adds up,
for every label and open node, the softmax gradients of its rows by feature, as products of matrices; the sums of features meet by
blocks, and what reaches the driver is the best split of each block, label and node. Features split by being there or not, as suits n-grams.
Tasks see rows in pieces, so memory is that of the sums: labels x nodes of a level x features, bounded by the parameters. Scores of rows
follow from the trees so far. Rows without a label index are left out; without rows or features every label is as likely as it occurs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked off side by side, features of a block, tasks that sums come from at most.
PIECE, BLOCK, MOST_TASKS = 500, 200, 64


def _param(name: str, doc: str, kind=TypeConverters.toInt) -> Param:
    return Param(Params._dummy(), name, doc, kind)


def _sparse(column: str) -> Column:
    """struct(size, indices, values) of a vector, dense or sparse."""
    v = F.unwrap_udt(column)
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    indices = F.when(v["type"] == 0, v["indices"]).when(F.size(v["values"]) > 0, every).otherwise(F.array().cast("array<int>"))
    return F.struct(indices.alias("indices"), v["values"].alias("values"))


def _dense(rows: pd.Series, size: int) -> np.ndarray:
    """A row for each vector, given as indices and values."""
    out = np.zeros((len(rows), size))
    for k, r in enumerate(rows):
        at = np.asarray(r["indices"], np.int64)
        inside = at < size
        out[k, at[inside]] = np.asarray(r["values"], np.float64)[inside]
    return out


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2 / dims) * cos(W x + b) of a vector column, W normal with variance 2 * gamma, b even in a circle."""

    inputCol, outputCol = _param("inputCol", "vectors", TypeConverters.toString), _param("outputCol", "waves", TypeConverters.toString)
    size, dims, seed = _param("size", "length of the vectors"), _param("dims", "number of waves"), _param("seed", "of the waves")
    gamma = _param("gamma", "of the kernel", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "waves", size: int = 5000, dims: int = 512, gamma: float = 1.0, seed: int = 42) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="features", outputCol="waves", size=5000, dims=512, gamma=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, dims, gamma, seed = (self.getOrDefault(p) for p in ("size", "dims", "gamma", "seed"))

        def waves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            w, b = wave_weights(size, dims, gamma, seed)
            for batch in batches:
                rows = list(batch.itertuples(index=False))
                found = [np.sqrt(2 / dims) * np.cos(_dense([{"indices": i, "values": v} for i, v in rows[k : k + PIECE]], size) @ w + b) for k in range(0, len(rows), PIECE)]
                yield pd.Series([x for part in found for x in part], dtype=object)

        told = F.pandas_udf(waves, "array<double>")
        return df.withColumn(self.getOrDefault("outputCol"), array_to_vector(told(_sparse(self.getOrDefault("inputCol")))))


def wave_weights(size: int, dims: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.normal(0, np.sqrt(2 * gamma), (size, dims)), r.uniform(0, 2 * np.pi, dims)


class Trees:
    """Boosted trees of all labels: splits (iteration, label, inner node) are feature numbers, -1 for none; values (iteration, label, leaf)."""

    def __init__(self, prior: np.ndarray, size: int, depth: int) -> None:
        self.prior, self.size, self.depth = prior, size, depth
        self.splits: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def nodes(self, there: np.ndarray, splits: np.ndarray, levels: int) -> np.ndarray:
        """The node (rows x labels) that each row has come to after so many levels of a tree. there: rows x (features and one that is never there)."""
        labels = np.arange(splits.shape[0])[None, :]
        rows = np.arange(len(there))[:, None]
        node = np.zeros((len(there), splits.shape[0]), np.int64)
        for _ in range(levels):
            node = 2 * node + 1 + there[rows, splits[labels, node]]
        return node

    def scores(self, there: np.ndarray) -> np.ndarray:
        out = np.repeat(self.prior[None, :], len(there), 0)
        labels = np.arange(len(self.prior))[None, :]
        for splits, values in zip(self.splits, self.values, strict=True):
            out += values[labels, self.nodes(there, splits, self.depth) - (2**self.depth - 1)]
        return out

    def probabilities(self, there: np.ndarray) -> np.ndarray:
        s = self.scores(there)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def there(self, rows: list) -> np.ndarray:
        out = np.zeros((len(rows), self.size + 1), np.int8)
        for k, indices in enumerate(rows):
            at = np.asarray(indices, np.int64)
            out[k, at[at < self.size]] = 1
        return out

    def told(self) -> str:
        return json.dumps({"prior": self.prior.tolist(), "size": self.size, "depth": self.depth, "splits": [s.tolist() for s in self.splits], "values": [v.tolist() for v in self.values]})

    @classmethod
    def of(cls, told: str) -> Trees:
        x = json.loads(told)
        out = cls(np.array(x["prior"]), x["size"], x["depth"])
        out.splits, out.values = [np.array(s) for s in x["splits"]], [np.array(v) for v in x["values"]]
        return out


class SoftmaxBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol, labelCol = _param("featuresCol", "vectors", TypeConverters.toString), _param("labelCol", "numbers of labels from 0", TypeConverters.toString)
    maxIter, maxDepth = _param("maxIter", "trees for each label"), _param("maxDepth", "levels of a tree")
    stepSize = _param("stepSize", "share of each tree's values that counts", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label_index", maxIter: int = 6, maxDepth: int = 2, stepSize: float = 0.5) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label_index", maxIter=6, maxDepth=2, stepSize=0.5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        label, depth, step = self.getOrDefault("labelCol"), self.getOrDefault("maxDepth"), self.getOrDefault("stepSize")
        sparse = _sparse(self.getOrDefault("featuresCol"))
        own = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.array_compact(F.zip_with(sparse["indices"], sparse["values"], lambda i, v: F.when(v != 0, i))).alias("there"))
        own = own.coalesce(MOST_TASKS).persist()
        try:
            counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
            size = (own.agg(F.max(F.array_max("there"))).first()[0] or -1) + 1
            n = max(counts, default=0) + 1
            share = np.array([counts.get(k, 0) + 0.5 for k in range(n)])
            trees = Trees(np.log(share / share.sum()), size, depth)
            for _ in range(self.getOrDefault("maxIter") if size and counts else 0):
                splits = np.full((n, 2**depth - 1), size, np.int64)  # the feature that is never there
                for level in range(depth):
                    found = _best_splits(own, trees, splits, level)
                    leaves = np.zeros((n, 2 ** (level + 1)))
                    for f in found.itertuples(index=False):
                        splits[f.label, 2**level - 1 + f.node] = f.feature
                        leaves[f.label, 2 * f.node : 2 * f.node + 2] = f.left, f.right
                trees.splits.append(splits)
                trees.values.append(step * (n - 1) / n * leaves)
        finally:
            own.unpersist()
        model = SoftmaxBoostingModel()
        return model._set(featuresCol=self.getOrDefault("featuresCol"), trees=trees.told())


def _best_splits(rows: DataFrame, trees: Trees, splits: np.ndarray, level: int) -> pd.DataFrame:
    """(label, node, feature, left, right): the best split of each open node of each label's tree, and the values of its two sides."""
    n, size, nodes = len(trees.prior), trees.size, 2**level

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Gradients and their weights of this task's rows, by node, label and feature; the last place is their whole."""
        g, h = np.zeros((nodes, n, size + 1)), np.zeros((nodes, n, size + 1))
        for frame in frames:
            for a in range(0, len(frame), PIECE):
                there = trees.there(frame["there"].iloc[a : a + PIECE].tolist())
                p = trees.probabilities(there)
                residual = -p
                residual[np.arange(len(p)), frame["label"].iloc[a : a + PIECE].to_numpy()] += 1
                weight = p * (1 - p)
                node = trees.nodes(there, splits, level) - (nodes - 1)
                x = there.astype(np.float64)
                x[:, -1] = 1
                for k in range(nodes):
                    here = node == k
                    g[k] += (residual * here).T @ x
                    h[k] += (weight * here).T @ x
        for b in range(0, size, BLOCK):
            part = np.r_[b : min(b + BLOCK, size), size]
            yield pd.DataFrame({"block": [b], "g": [g[:, :, part].tobytes()], "h": [h[:, :, part].tobytes()]})

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        g, h = (sum(np.frombuffer(x, np.float64) for x in frame[c]).reshape(nodes, n, -1) for c in ("g", "h"))
        whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
        right_g, right_h = g[:, :, :-1], h[:, :, :-1]
        left_g, left_h = whole_g - right_g, whole_h - right_h
        gain = right_g**2 / (right_h + 1e-6) + left_g**2 / (left_h + 1e-6) - whole_g**2 / (whole_h + 1e-6)
        at = gain.argmax(2)
        take = lambda x: np.take_along_axis(x, at[:, :, None], 2)[:, :, 0].ravel()
        node, label = (x.ravel() for x in np.meshgrid(np.arange(nodes), np.arange(n), indexing="ij"))
        value = lambda a, b: np.clip(take(a) / (take(b) + 1e-6), -4, 4)
        return pd.DataFrame({"label": label, "node": node, "feature": at.ravel() + int(frame["block"].iloc[0]), "gain": take(gain), "left": value(left_g, left_h), "right": value(right_g, right_h)})

    parts = rows.mapInPandas(summed, "block int, g binary, h binary").groupBy("block").applyInPandas(best, "label int, node int, feature int, gain double, left double, right double")
    order = F.struct(F.round("gain", 9), -F.col("feature"))
    return parts.groupBy("label", "node").agg(F.max_by(F.struct("feature", "left", "right"), order).alias("b")).select("label", "node", "b.*").toPandas()


class SoftmaxBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``."""

    featuresCol, trees = _param("featuresCol", "vectors", TypeConverters.toString), _param("trees", "the trees, as JSON", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features")

    def _transform(self, df: DataFrame) -> DataFrame:
        told = self.getOrDefault("trees")

        def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            trees = Trees.of(told)
            for batch in batches:
                rows = [np.asarray(i, np.int64)[np.asarray(v) != 0] for i, v in batch.itertuples(index=False)]
                found = [trees.probabilities(trees.there(rows[k : k + PIECE])) for k in range(0, len(rows), PIECE)]
                yield pd.Series([x for part in found for x in part], dtype=object)

        p = F.pandas_udf(judged, "array<double>")(_sparse(self.getOrDefault("featuresCol")))
        out = df.withColumn("_p", p)
        return out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")
