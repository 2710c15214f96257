"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max bounds.

The items are the indexed documents; every passage of every training text is a query. Passages are windows of
words that overlap by half and are twice as long as the longest item, so that any occurrence of an item lies
whole in one of them. Weights are BM25's, divided by the item's score for itself, so one threshold (``least``,
a share of the full score) holds for all items. Retrieval is block-max WAND in two steps. Over all passages of a text at
once, by arrays: terms so common that all of them together stay well below the threshold for every item can't select one,
so for a passage and a block of items the block maxima of the others, with the most that the common terms can add, must
reach the threshold. For the passages that remain, cursors over the postings go from pivot to pivot and skip blocks whose
maxima stay below the threshold; scores are exact, and all items at or above it are retrieved.
Each retrieved item is then verified: its question (all but the last line or sentence) and its answer (that last
one) must both recur in the passage, as shares of their word trigrams.

The index of one block of items is sent to the executors; blocks hold ``block_items`` items at most and are
worked off one after the other, so a large benchmark takes more passes, not more memory. Document frequencies, mean
length and longest item are those of all items, whatever the blocks.

Defined cases: null and empty texts and items match nothing; an item of one sentence is question and answer
in one; case and punctuation don't count; of an item's passages in one document the best is returned (by
score, then by position); ids of items may be of any type, repeated or null (rows of one id and text count once);
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwright.llm.common import blocks, texts_of, written

#: The share of the threshold that all common terms of an item may make up; any share below 1 gives the same results.
COMMON = 0.6
WORDS = re.compile(r"\w+").findall
ANSWER = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def _grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item's question and of its answer, the last line or sentence; one sentence is both."""
    parts = [w for w in map(words_of, ANSWER.split(text)) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


#: Cells of the matrix of windows and blocks of items that are worked off at once.
MOST_CELLS = 1_000_000


class Bm25Index:
    """Postings of a block of items with weights relative to each item's own score, and maxima by term and by block of items."""

    def __init__(self, items: list[tuple[object, str]], k1: float = 1.2, b: float = 0.75, least: float = 0.5, block: int = 8, whole: tuple[int, int, int, dict[str, int]] | None = None) -> None:
        """whole: number of all items, of their words and of the longest one's, and of the items with each term; None if these are all."""
        items = [(i, t) for i, t in items if t and words_of(t)]
        self.ids = [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.parts = [tuple(map(_grams, question_and_answer(t))) for _, t in items]
        counts = [Counter(w) for w in split]
        df = Counter(t for c in counts for t in c)
        n_all, n_words, self.longest, df_all = whole or (len(split), sum(map(len, split)), max(map(len, split), default=1), df)
        mean = n_words / max(1, n_all)
        idf = {t: math.log(1 + (n_all - df_all[t] + 0.5) / (df_all[t] + 0.5)) for t in df}
        self.terms = {t: k + 1 for k, t in enumerate(df)}  # 0: not in the index
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        for i, c in enumerate(counts):
            weights = {t: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(split[i]) / mean)) for t, f in c.items()}
            full = sum(weights.values())
            for t, w in weights.items():
                postings[self.terms[t]].append((i, w / full))
        self.block = block
        self.known: dict[str, int] = {}
        self.starts = np.cumsum([0] + [len(p) for p in postings])
        self.items = np.array([i for p in postings for i, _ in p], np.int64)
        self.weights = np.array([w for p in postings for _, w in p], np.float64)
        n_blocks = -(-max(1, len(items)) // block)
        self.n_blocks = n_blocks
        maxima: list[dict[int, float]] = [{} for _ in postings]
        for p, m in zip(postings, maxima, strict=True):
            for i, w in p:
                m[i // block] = max(m.get(i // block, 0.0), w)
        self.block_starts = np.cumsum([0] + [len(m) for m in maxima])
        self.block_of = np.array([k for m in maxima for k in m], np.int64)
        self.block_top = np.array([w for m in maxima for w in m.values()], np.float64)
        # for the search, as plain lists, with the maxima by term
        self._items, self._weights = self.items.tolist(), self.weights.tolist()
        self._tops = [max(m.values(), default=0.0) for m in maxima]
        # common terms: as many of the most frequent as leave each item well below the threshold
        light = np.zeros(len(items))
        self.essential = np.ones(len(df) + 1, bool)
        self.essential[0] = False
        for t, _ in sorted(df.items(), key=lambda p: (-p[1], p[0])):
            k = self.terms[t]
            i, w = self.items[self.starts[k] : self.starts[k + 1]], self.weights[self.starts[k] : self.starts[k + 1]]
            if (light[i] + w <= COMMON * least).all():
                light[i] += w
                self.essential[k] = False
        self.light = np.maximum.reduceat(light, np.arange(0, len(items), block)) if len(items) else np.zeros(1)

    def term_ids(self, text: str) -> np.ndarray:
        """The term (0 for others) of each word of the text. Pieces between white space that hold one word, most of them, are looked up as they are."""
        known, pieces = self.known, text.lower().split()
        ids = list(map(known.get, pieces))
        if None in ids:
            if len(known) > 120_000:
                known.clear()
            for k, piece in enumerate(pieces):
                if ids[k] is None:
                    words = WORDS(piece)
                    ids[k] = known[piece] = self.terms.get(words[0], 0) if len(words) == 1 else -1 - len(words)
        ids = np.array(ids, np.int64)
        if len(ids) and ids.min() < 0:
            if ids.min() < -1:  # a piece of several words
                get = self.terms.get
                return np.array([get(w, 0) for w in words_of(text)], np.int64)
            ids = ids[ids >= 0]
        return ids

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(item, score) of all items that reach ``least`` for the distinct terms of a passage, by block-max WAND.

        Blocks of items are live if the terms' maxima in them reach the threshold; the others are skipped. Each term has a cursor
        on its postings, which stand by item. With the cursors in order of their items, the pivot is the first item that the
        terms' maxima up to it could lift to the threshold; everything before it is skipped. If the pivot's block isn't live, the
        cursors skip to the next live one, else the pivot is scored.
        """
        need = least - 1e-9
        terms = np.unique(terms)
        terms = terms[terms > 0]
        runs = _runs(self.block_starts, terms)
        live = np.flatnonzero(np.bincount(self.block_of[runs], weights=self.block_top[runs], minlength=self.n_blocks) >= need).tolist()
        if not live:
            return []
        out, items, weights, tops = [], self._items, self._weights, self._tops
        cursors = []  # [item, place, end, term]
        for t in terms.tolist():
            end = int(self.starts[t + 1])
            at = bisect_left(items, live[0] * self.block, int(self.starts[t]), end)
            if at < end:
                cursors.append([items[at], at, end, t])
        cursors.sort()
        while cursors:
            bound, k = 0.0, -1
            for k, c in enumerate(cursors):
                bound += tops[c[3]]
                if bound >= need:
                    break
            else:
                break
            pivot = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            at = bisect_left(live, pivot // self.block)
            if at < len(live) and live[at] == pivot // self.block:
                score, aim = 0.0, pivot + 1
                for c in cursors[: k + 1]:
                    c[1] = bisect_left(items, pivot, c[1], c[2])
                    if c[1] < c[2] and items[c[1]] == pivot:
                        score += weights[c[1]]
                if score >= need:
                    out.append((pivot, score))
                moved = k + 1
            else:
                if at == len(live):
                    break
                aim, moved = live[at] * self.block, len(cursors)
            for c in cursors[:moved]:
                c[1] = bisect_left(items, aim, c[1], c[2])
                c[0] = items[c[1]] if c[1] < c[2] else -1
            cursors = sorted(c for c in cursors if c[0] >= 0)
        return out

    def _bounds(self, ids: np.ndarray, step: int, windows: int) -> np.ndarray:
        """For each window of two steps, the most that any item can score, over blocks of items. Windows of long texts are worked off in slices."""
        most = max(1, MOST_CELLS // self.n_blocks)
        return np.concatenate([self._bounds_of(ids[w * step : (w + most + 1) * step], step, min(most, windows - w)) for w in range(0, windows, most)])

    def _bounds_of(self, ids: np.ndarray, step: int, windows: int) -> np.ndarray:
        at = np.flatnonzero(self.essential[ids])
        terms = ids[at]
        runs = _runs(self.block_starts, terms)
        half = np.repeat(at // step, self.block_starts[terms + 1] - self.block_starts[terms])
        sums = np.bincount(half * self.n_blocks + self.block_of[runs], weights=self.block_top[runs], minlength=(windows + 1) * self.n_blocks).reshape(-1, self.n_blocks)
        return (sums[:windows] + sums[1 : windows + 1] + self.light).max(1)

    def matches(self, text: str, least: float, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the passage, score, question's and answer's share) of each verified item."""
        ids = self.term_ids(text) if self.ids else np.zeros(0, np.int64)
        words: list[str] = []
        if not len(ids):
            return []
        step = max(32, self.longest)
        begins = np.arange(0, max(1, len(ids) - step), step)
        ends = np.minimum(begins + 2 * step, len(ids))
        best: dict[int, tuple[float, int, float, float]] = {}
        for k in np.flatnonzero(self._bounds(ids, step, len(begins)) >= least - 1e-9).tolist():
            a, b = int(begins[k]), int(ends[k])
            found = self.search(ids[a:b], least)
            if not found:
                continue
            words = words or words_of(text)
            grams = {n: _grams(words[a:b], n) for n in (1, 2, 3)}
            for i, score in found:
                shares = []
                for part in self.parts[i]:
                    n = len(next(iter(part)))
                    shares.append(len(part & grams[n]) / len(part))
                if shares[0] >= question and shares[1] >= answer and (i not in best or score > best[i][0]):
                    best[i] = (score, a, *shares)
        return [(self.ids[i], a, score, q, r) for i, (score, a, q, r) in sorted(best.items())]


def _runs(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    begins = starts[which]
    sizes = starts[which + 1] - begins
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, question: float = 0.6, answer: float = 0.5, block_items: int = 5000, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap) of each item found in a document."""
    own = texts_of(docs, id_col, text_col)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id {kind}, passage long, score double, question_overlap double, answer_overlap double"
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    n_blocks = max(1, -(-size[0] // block_items), -(-(size[1] or 0) // block_chars))
    if n_blocks > 1:

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                words = [words_of(t) for t in frame["text"]]
                yield frame.assign(words=[len(w) for w in words], terms=[list(set(w)) for w in words])

        items = written(items.mapInPandas(split, f"item_id {kind}, text string, words long, terms array<string>"))
        totals = items.where("words > 0").agg(F.count("*"), F.sum("words"), F.max("words")).first()
        frequencies = written(items.select(F.explode("terms").alias("term")).groupBy("term").count())
    parts = []
    for k in range(n_blocks):
        own_items = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = own_items.select("item_id", "text").orderBy("item_id", "text").collect()
        whole = None
        if n_blocks > 1:
            df = own_items.select(F.explode("terms").alias("term")).distinct().join(frequencies, "term").collect()
            whole = (totals[0], totals[1] or 0, totals[2] or 1, {r["term"]: r["count"] for r in df})
        index = Bm25Index([(r["item_id"], r["text"]) for r in rows], least=least, whole=whole)
        shared = own.sparkSession.sparkContext.broadcast(index)

        def work(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for frame in blocks(frames):
                out = [(i, *m) for i, text in zip(frame["doc_id"], frame["text"], strict=True) for m in index.matches(text, least, question, answer)]
                found = pd.DataFrame(out, columns=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])
                yield found.assign(item_id=pd.Series([m[1] for m in out], dtype="Int64" if kind in ("bigint", "int", "smallint", "tinyint") else object))

        parts.append(own.mapInPandas(work, schema))
    return reduce(DataFrame.unionByName, parts)
