"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters, ``width`` bytes wide, slide over every byte of the UTF-8 text. Their responses, rectified, are
max-pooled over chunks of 512 positions that overlap by half; the chunks, which cover the whole document, are
combined by their mean and their maximum, and a logistic unit makes one probability of these.

Training (the one place with a bound): at most ``train_rows`` labelled rows outside the held-out third, those
with the lowest hash of their id, whose text has at most ``train_chars`` characters; of each, up to three chunks
a pass. It runs on the driver with numpy and a fixed seed; the weights are some 150 KB. Scoring is over all
documents and whole texts.

Defined cases: null and empty texts get the probability of a document without responses; without any labelled
row every score is 0.5 (predicted 1); extra columns are ignored; equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.llm.common import blocks, texts_of

STEP, WIDTH = 256, 6


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class ByteCNN:
    """filters: (width, 256, n) weights by place and byte; out: weights of the n means, the n maxima, and the bias."""

    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray) -> None:
        self.filters, self.bias, self.out = filters.astype(np.float32), bias.astype(np.float32), out.astype(np.float64)
        self._pairs: list[np.ndarray] | None = None

    def __reduce__(self):
        return ByteCNN, (self.filters, self.bias, self.out)

    @classmethod
    def blank(cls, n: int = 24) -> ByteCNN:
        return cls(np.zeros((WIDTH, 256, n)), np.zeros(n), np.zeros(2 * n + 1))

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(mean, max) over the chunks of each text, of each filter's largest response."""
        if self._pairs is None:  # responses to byte pairs: a table look-up for every two bytes of a filter
            self._pairs = [(self.filters[j][:, None, :] + self.filters[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]
        n = len(self.bias)
        pad = b"\0" * (WIDTH - 1)
        sizes = np.array([max(1, len(t)) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(t + pad if t else b"\0" + pad for t in texts) + pad, np.uint8).astype(np.int32)
        pair = flat[:-1] * 256 + flat[1:]
        begins = np.cumsum(sizes + WIDTH - 1) - sizes - WIDTH + 1
        counts = -(-sizes // STEP)
        first = np.cumsum(counts) - counts
        starts = np.repeat(begins - first * STEP, counts) + np.arange(int(counts.sum())) * STEP
        padding = (begins + sizes)[:, None] + np.arange(WIDTH - 1)
        top = np.empty((len(starts), n), np.float32)
        total = int(begins[-1] + sizes[-1])
        pads = padding.ravel()
        group = 256  # steps at a time
        for a in range(0, len(starts), group):
            b = min(a + group, len(starts))
            x, y = int(starts[a]), int(starts[b]) if b < len(starts) else total
            r = self._pairs[0][pair[x:y]]
            for k in range(1, WIDTH // 2):
                r += self._pairs[k][pair[x + 2 * k : y + 2 * k]]
            i, j = np.searchsorted(pads, (x, y))
            r[pads[i:j] - x] = -np.inf
            top[a:b] = np.maximum.reduceat(r, starts[a:b] - x, axis=0)
        top = np.maximum(top + self.bias, 0)
        last = first + counts - 1
        over = np.maximum(top, np.append(top[1:], top[-1:], axis=0))  # chunks of two steps
        over[last] = top[last]
        # a chunk begins at each step but the last, or at the only one
        weight = np.ones(len(top))
        weight[last[counts > 1]] = 0
        mean = np.add.reduceat(over * weight[:, None], first, axis=0) / np.maximum(counts - 1, 1)[:, None]
        return np.hstack([mean, np.maximum.reduceat(top, first, axis=0)])

    def predict(self, texts: list[bytes]) -> np.ndarray:
        z = self.pooled(texts) @ self.out[:-1] + self.out[-1] if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, n: int = 24, passes: int = 8, batch: int = 32, seed: int = 7, rate: float = 0.02) -> ByteCNN:
    """Adam on the logistic loss; gradients go through each chunk's best position alone."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        model = ByteCNN.blank(n)
        if len(texts):
            model.out[-1] = 3 if labels[0] else -3
        return model
    rng = np.random.default_rng(seed)
    size, length = 2 * STEP, 2 * STEP + WIDTH - 1
    filters, bias = rng.normal(0, 0.3, (WIDTH, 256, n)).astype(np.float32), np.zeros(n, np.float32)
    out = np.append(rng.normal(0, 0.1, 2 * n), np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3)))
    held = [filters, bias, out]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in held]
    step = 0
    for epoch in range(passes):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows, owner = [], []
            for k, i in enumerate(order[a : a + batch]):
                t = texts[i]
                most = max(1, -(-len(t) // STEP) - 1)
                for c in rng.choice(most, min(most, 3), replace=False):
                    rows.append(np.frombuffer(t[c * STEP : c * STEP + length].ljust(length, b"\0"), np.uint8))
                    owner.append(k)
            x, owner = np.array(rows), np.array(owner)
            y = labels[order[a : a + batch]].astype(np.float64)
            lens = np.array([min(size, max(1, len(texts[i]) - 0)) for i in order[a : a + batch]])[owner]
            r = filters[0][x[:, :size]]
            for j in range(1, WIDTH):
                r += filters[j][x[:, j : j + size]]
            r[np.arange(size)[None, :] >= lens[:, None]] = -1e9
            best = r.argmax(1)
            h = np.maximum(np.take_along_axis(r, best[:, None, :], 1)[:, 0] + bias, 0)
            count = np.bincount(owner, minlength=len(y))
            edge = np.cumsum(count) - count
            mean, top = np.add.reduceat(h, edge, axis=0) / count[:, None], np.maximum.reduceat(h, edge, axis=0)
            f = np.hstack([mean, top])
            p = 1 / (1 + np.exp(-np.clip(f @ out[:-1] + out[-1], -30, 30)))
            g = (p - y) / len(y)
            d_out = np.append(f.T @ g + 1e-4 * out[:-1], g.sum())
            d_f = g[:, None] * out[None, :-1]
            d_h = (d_f[:, :n] / count[:, None])[owner] + d_f[:, n:][owner] * (h == top[owner])
            d_h = (d_h * (h > 0)).astype(np.float32)
            d_filters = np.zeros_like(filters)
            which = np.broadcast_to(np.arange(n), best.shape)
            for j in range(WIDTH):
                np.add.at(d_filters[j], (np.take_along_axis(x, best + j, 1), which), d_h)
            step += 1
            for w, d, (m, v) in zip(held, (d_filters, d_h.sum(0), d_out), moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (1 - epoch / passes) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(filters, bias, out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 2000, train_chars: int = 30_000) -> ByteCNN:
    """Learns from a bounded sample of the labelled rows outside the held-out third, of each text the first ``train_chars`` characters."""
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    rows = texts_of(docs).withColumn("text", F.substring("text", 1, train_chars)).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").limit(train_rows).collect()
    return train([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.int64))


def score(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            p = model.predict([t.encode("utf-8", "surrogatepass") for t in frame["text"]])
            yield frame.drop(columns="text").assign(score=p, predicted=(p >= 0.5).astype(np.int32))

    own = texts_of(docs, id_col, text_col)
    own = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInPandas(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
