"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a maximal stretch of words of smallest period q and length of ``least`` words and 2 * q at least. All of it but
q words is found again q words on, and that overlap has k = ceil(least / 2) words at least; every word of a run so stands in
a k-gram that the document holds twice. ``surviving`` masks all other words by hashes of the k-grams (equal
k-grams have equal hashes, so nothing is lost; a chance collision lets a word more survive). Only the stretches that are
left, most texts have none, go through the divide and conquer of Main and Lorentz: for every middle, Z-functions tell how far
each period reaches to either side; what is maximal on both sides is a run, and of equal intervals the smallest period holds.

``collapsed`` drops each word that some run contains after its first period, so what is repeated stays once.

Defined cases: null and empty texts and texts of white space have no words and no runs; a null id plants nothing; repeated
rows repeat their result; an empty table gives no rows; extra columns are ignored. A document's time is that of n * log(n)
steps over its longest surviving stretch, its memory in proportion to its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwright.llm.common import row_blocks, texts_of

#: Words that a run has at least.
LEAST = 12
Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, different ones different."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def surviving(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The stretches [a, b) of words that stand in a k-gram which occurs twice or more, of 2 * k - 1 words at least."""
    n = len(ids)
    if n < 2 * k - 1:
        return []
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        grams = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + mixed[j : n - k + 1 + j]
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + k, -1)
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in turns if b - a >= 2 * k - 1]


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of s and its suffix from there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def main_lorentz(s: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, smallest period) of every run of s, by start."""
    n = len(s)
    found: dict[tuple[int, int], int] = {}
    work = [(0, n)]
    while work:
        low, high = work.pop()
        if high - low < least:  # no run crosses its middle that a larger part has not seen
            continue
        mid = (low + high) // 2
        work += [(low, mid), (mid, high)]
        u, v = s[low:mid], s[mid:high]
        back_u, back_v = u[::-1], v[::-1]
        nu, nv = len(u), len(v)
        ahead_v, behind_u = z_function(v), z_function(back_u)
        ahead_uv, behind_vu = z_function([*v, -1, *u, *v]), z_function([*back_u, -1, *back_v, *back_u])
        # periods whose first copy begins at the middle, then those whose copy ends there
        for p in range(1, nv + 1):
            back, ahead = behind_vu[nu + 1 + nv - p], ahead_v[p] if p < nv else 0
            if back + ahead >= p:
                _keep(found, s, mid - back, mid + p + ahead, p, least)
        for p in range(1, nu + 1):
            back, ahead = behind_u[p] if p < nu else 0, ahead_uv[nv + 1 + nu - p]
            if back + ahead >= p:
                _keep(found, s, mid - p - back, mid + ahead, p, least)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _keep(found: dict[tuple[int, int], int], s: list[int], a: int, b: int, p: int, least: int) -> None:
    """Takes [a, b) of period p if it is long enough and no neighbour extends it: the border of a part cuts none off."""
    if b - a >= least and (a == 0 or s[a - 1] != s[a - 1 + p]) and (b == len(s) or s[b] != s[b - p]) and found.get((a, b), p) >= p:
        found[a, b] = p


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of a document's word numbers, by start, then period."""
    out = []
    for a, b in surviving(ids, -(-least // 2)):
        out += [(a + start, length, p) for start, length, p in main_lorentz(ids[a:b].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: str | None, n: int) -> np.ndarray:
    """Which original word stands at each place of a document of n words, once every tenth document has a repeating tail."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(doc_id.encode())
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        edges[start + p] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """One row per document: the number of runs, the longest one, digests of all runs and of the collapsed text. With ``plant`` tails are repeated first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole):
                rows = [_row(doc_id, text, least, plant) for doc_id, text in zip(batch.column("id_text").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, COLUMNS.values(), strict=True))], names=["doc_id", *COLUMNS])

    own = texts_of(docs, id_col, text_col)
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(c, T.LongType() if k == pa.int64() else T.StringType()) for c, k in COLUMNS.items())])
    return own.withColumn("id_text", F.col("doc_id").cast("string")).mapInArrow(work, schema)


COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _row(doc_id: str | None, text: str, least: int, plant: bool) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    if plant:
        words = [words[i] for i in planted(doc_id, len(words)).tolist()]
    runs = runs_of(word_numbers(words), least)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    exponent = 1000 * length // period if runs else None
    return len(runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
