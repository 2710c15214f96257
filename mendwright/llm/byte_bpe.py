"""Byte-level BPE by a hierarchical-bitmap rank queue.

Pre-tokens are laid end to end in one linked list. Each adjacent pair that the ranks know stands in the bucket
of its rank; a bitmap of three levels says which buckets are in use, and find-first-set gives the lowest
rank next. All live positions of that bucket merge (stale ones, whose pair has changed, are skipped), and the
new pairs go to their buckets. Merges in different pre-tokens don't touch, so one queue serves many short
pre-tokens or one very long one alike. Within a pre-token the order is the library's: the lowest rank, the
leftmost first; where a merge makes a pair of an even lower rank, only the leftmost position merges and the
rest wait.

Defined cases: null and empty texts have no ids (digests of no bytes); special tokens are ordinary text;
extra columns are ignored; repeated rows repeat their result. Ids already worked out for a pre-token are kept
in a table of bounded size and reused.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from mendwright.llm.common import blocks, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NO_ID = 65535


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: White space as Unicode defines it, which the pattern's \\s means.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Single spaces between characters that no white space rule takes for white space: no pre-token reaches over their left side.
CUT = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")


def exact_pattern(pattern: str) -> regex.Pattern:
    r"""``pattern`` with \s and \S spelled out."""
    own = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(own)


def pieces_of(text: str) -> list[str]:
    """The text cut at single spaces, a piece for each; the spaces are left out and stand before every piece but the first."""
    if RUN.search(text) or text.endswith(" "):
        return CUT.split(text)
    return text.split(" ")


class RankQueue:
    """Buckets by rank under a bitmap of three levels of 64-bit words (262,144 ranks)."""

    def __init__(self) -> None:
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096
        self.buckets: dict[int, list] = {}

    def put(self, rank: int, position) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def first(self) -> tuple[int, list] | None:
        """The lowest rank in use and its bucket, which is taken out."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] &= word - 1
        if not self.low[b]:
            self.middle[a] &= self.middle[a] - 1
            if not self.middle[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder over ranks; ids are ranks and must lie below 65,535."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 150_000) -> None:
        self.ranks, self.most_kept = ranks, most_kept
        self.split = exact_pattern(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        keys = np.fromiter(pairs, np.uint32, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.uint32(0xFFFFFFFF))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(-1))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # places of pieces at a text's start, and of those after a space
        self.later: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int32), sizes
        ids = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.int32(NO_ID))
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)[sizes > 0]
        following, before = np.arange(1, n + 2, dtype=np.int64), np.arange(-1, n, dtype=np.int64)
        following[ends - 1] = n
        following[n] = n
        before[np.append(0, ends[:-1])] = n
        before[n] = n
        dead = np.zeros(n + 1, bool)
        current = np.append(self._rank(ids[:n], ids[following[:n]]), np.int32(-1))
        queue = RankQueue()
        known = np.flatnonzero(current >= 0)
        known = known[np.argsort(current[known], kind="stable")]
        ranks, begins = np.unique(current[known], return_index=True)
        for rank, group in zip(ranks.tolist(), np.split(known, begins[1:]), strict=False):
            queue.put(rank, group)
        while (found := queue.first()) is not None:
            rank, bucket = found
            if isinstance(bucket[0], np.ndarray):
                p = bucket[0] if len(bucket) == 1 else np.concatenate([bucket[0], np.array(bucket[1:], np.int64)])
            else:
                p = np.array(bucket, np.int64)
            p = p[current[p] == rank]  # what is stale is skipped
            if len(p) > 1:
                p = np.unique(p)
            if not len(p):
                continue
            q = following[p]
            if len(p) > 1 and (chained := p[1:] == q[:-1]).any():  # overlapping pairs: every other one of a run merges
                k = np.arange(len(p))
                run = np.maximum.accumulate(np.where(np.append(True, ~chained), k, 0))
                p = p[(k - run) % 2 == 0]
                q = following[p]
            if len(p) > 1:
                left = before[p]
                left_ids = ids[left]
                left_ids[1:][left[1:] == q[:-1]] = rank
                right_rank, left_rank = self._rank(np.full(len(p), rank), ids[following[q]]), self._rank(left_ids, np.full(len(p), rank))
                lower = (right_rank >= 0) & (right_rank < rank) | (left_rank >= 0) & (left_rank < rank)
                if lower.any():
                    w = word_of[p]
                    wait = np.isin(w, w[lower]) & np.append(False, w[1:] == w[:-1])
                    for x in p[wait].tolist():
                        queue.put(rank, x)
                    p = p[~wait]
                    q = following[p]
            after = following[q]
            ids[p] = rank
            dead[q] = True
            current[q] = -1
            following[p] = after
            before[after] = p
            before[n] = n
            left = before[p]
            right_rank, left_rank = self._rank(ids[p], ids[after]), self._rank(ids[left], ids[p])
            current[p] = right_rank
            current[left] = left_rank
            current[n] = -1
            for positions, new in ((p, right_rank), (left, left_rank)):
                on = new >= 0
                if on.any():
                    for r, x in zip(new[on].tolist(), positions[on].tolist(), strict=True):
                        queue.put(r, x)
        live = ~dead[:n]
        return ids[:n][live], np.bincount(word_of[live], minlength=len(words))

    def _learn(self, new: list[str]) -> None:
        """Works out the ids of new pieces, through the distinct pre-tokens in them."""
        tokens: dict[str, int] = {}
        parts, counts = [], []
        for piece in new:
            found = self.split(piece)
            counts.append(len(found))
            parts += [tokens.setdefault(x, len(tokens)) for x in found]
        words = [x.encode("utf-8", "surrogatepass") for x in tokens]
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        single = whole >= 0
        rest, sizes = self.merge([b"" if s else w for w, s in zip(words, single.tolist(), strict=True)])
        sizes = np.where(single, 1, sizes)
        starts = np.append(0, np.cumsum(sizes))
        flat = np.empty(starts[-1], np.int32)
        mask = np.zeros(starts[-1], bool)
        mask[starts[:-1][single]] = True
        flat[mask], flat[~mask] = whole[single], rest
        place = np.array(parts, np.int64)
        ids = _gathered(flat, starts, place)
        ends = np.append(0, np.cumsum(sizes[place] if len(place) else []))[np.cumsum(counts)].astype(np.int64)
        self.starts = np.append(self.starts, ends + self.starts[-1])
        self.flat = np.append(self.flat, ids)

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.starts) > self.most_kept:
            self._forget()
        index, later, new, places = self.index, self.later, [], []
        for text in texts:
            pieces = pieces_of(text)
            first = pieces[0]
            place = list(map(later.get, pieces))
            place[0] = index.get(first)
            if None in place:
                for k, piece in enumerate(pieces):
                    if place[k] is None:
                        own = later if k else index
                        place[k] = own.get(piece)
                        if place[k] is None:
                            place[k] = own[piece] = len(self.starts) - 1 + len(new)
                            new.append(f" {piece}" if k else piece)
            places.append(np.array(place, np.int32))
        if new:
            self._learn(new)
        for place in places:
            yield _gathered(self.flat, self.starts, place)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _gathered(flat: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[p]:starts[p + 1]]`` of all p, end to end."""
    begins = starts[place]
    sizes = starts[place + 1] - begins
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begins - ends + sizes, sizes)] if total else np.zeros(0, np.int32)


_KEPT: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each vocabulary and worker process."""
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _KEPT[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most_chars: int = 3_000_000) -> DataFrame:
    """One row per document: n_tokens, digests of the ids and of their decoding; ``with_ids`` adds the ids themselves."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for frame in blocks(frames, most_chars):
            yield from done(own, frame)

    def done(own: ByteBPE, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        for ids in own.encode_many(frame["text"].tolist()):
            row = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
            rows.append((*row, ids.tolist()) if with_ids else row)
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        if with_ids:
            for a in range(0, len(out), 1000):
                yield out.iloc[a : a + 1000]
        else:
            yield out

    own = texts_of(docs, id_col, text_col)
    return own.mapInPandas(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
