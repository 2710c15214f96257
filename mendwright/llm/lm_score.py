"""LM scoring with a weighted backoff automaton.

The model: every n-gram of the training documents (up to ``order`` words) is an arc; the n-grams below that
order, with the empty one, are the states. At a state with context u the arc of word w weighs

    P(w | u) = a(u) * c(u w) / c(u) + (1 - a(u)) * P(w | u without its first word),   a(u) = top * c(u) / (c(u) + 1)

and where there is no such arc, a failure arc of weight 1 - a(u) leads to the state of the shorter context.
At the empty state every token has an arc, P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Each distribution sums to
one over the training tokens and one unknown token. A text is traversed once from left to right: the state
carried on is the one that the arc just taken leads to, the longest context the model knows (``order`` - 1 words
at most). ``Automaton`` holds that part of the states, arcs and failure arcs that a chunk's texts can reach, with
weights worked out once for each arc; ``traverse`` follows them at all positions of the chunk's texts side by side,
since the state at a position depends on the last words alone: failure arcs add their weights until there is an arc.

Distribution: documents are dealt by a hash to chunks of about ``chunk_docs`` rows and ``chunk_bytes`` of text at most. Each chunk sends its distinct
n-grams, as sorted hashed keys packed into one binary value for each bucket of the key space; each bucket adds
the chunks' training counts and sends back, for each chunk, the totals in the order of its keys. Nothing is
pruned, capped or sampled, no model is broadcast (N and V alone are), and a frequent n-gram is one key a chunk.
Messages are at most as many as chunks times buckets, and never more than distinct n-grams of chunks. Keys of longer
n-grams have ``KEY_BITS`` bits more than the number of training tokens, so at any size an n-gram shares its key with
another one with a chance of at most 2^-``KEY_BITS`` for each length.

Defined cases: null and empty texts have the one token ``end``; with no training documents every count is 0;
rows with one id are scored apart; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwright.llm.common import blocks, byte_words, chunks_for, texts_of
from mendwright.llm.packed import filled, pack, pack_counts, unpack, unpack_counts

#: Bits of a word's key, and bits of a longer n-gram's key beyond those that count the training tokens.
WORD_BITS, KEY_BITS = 60, 20
#: Chunks for each bucket of the key space.
CHUNKS_A_BUCKET = 2
_HASHES: dict[bytes, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_HASHES) > 250_000:
            _HASHES.clear()
        for w in words:
            if w not in _HASHES:
                _HASHES[w] = xxhash.xxh3_64_intdigest(w) >> 4
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: The token that ends each text; no word can be the empty one.
END = xxhash.xxh3_64_intdigest(b"") >> 4


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed tokens of all texts end to end, number of tokens of each)."""
    parts, sizes = [], np.empty(len(texts), np.int64)
    end = np.array([END], np.uint64)
    for k, text in enumerate(texts):
        h = _hashes(byte_words(text))
        parts += [h, end]
        sizes[k] = len(h) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def _key_bits(n_all: int, order: int) -> list[int]:
    return [WORD_BITS] + [min(64, KEY_BITS + n_all.bit_length())] * (order - 1)


def _grams(tokens: np.ndarray, sizes: np.ndarray, bits: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: (keys of the n-grams that end at the positions, those positions). None reaches over a text's start."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(starts, sizes)
    out = [(tokens, np.arange(len(tokens)))]
    key = tokens
    for n in range(2, len(bits) + 1):
        key = _scrambled(np.append(key[:1], key[:-1]) * _MIX[0] + tokens)  # of the n-gram that ends here
        at = np.flatnonzero(place >= n - 1)
        out.append((key[at] >> np.uint64(64 - bits[n - 1]), at))
    return out


def corpus_totals(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the training documents, exactly."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, 12_000_000):
            tokens, _ = _tokens(frame["text"].tolist())
            keys = np.unique(tokens)
            yield pd.DataFrame([(b, pack(keys[i:j]), 0) for b, i, j in filled(keys, WORD_BITS, buckets)] + [(0, pack(keys[:0]), len(tokens))], columns=["bucket", "keys", "n"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(0, np.uint64)
        for data in frame["keys"]:
            seen = np.union1d(seen, unpack(data))
        return pd.DataFrame({"n": [int(frame["n"].sum())], "v": [len(seen)]})

    train = docs.where(~held_out(F.col("doc_id")))
    row = train.mapInPandas(gather, "bucket int, keys binary, n long").groupBy("bucket").applyInPandas(add, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, top: float = 0.3, chunk_docs: int = 3000, chunk_bytes: int = 12_000_000) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score (the model)."""
    own = texts_of(docs, id_col, text_col)
    total = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = chunks_for(*total, chunk_docs, chunk_bytes)
    buckets = max(8, -(-chunks // CHUNKS_A_BUCKET))
    n_all, v_all = corpus_totals(own, buckets)
    bits = _key_bits(n_all, order)
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, sizes = _tokens(frame["text"].tolist())
        train = np.repeat(~frame["held_out"].to_numpy(bool), sizes)
        none = [pack(tokens[:0]), pack_counts(np.zeros(0, np.int64))]
        rows: dict[int, list[bytes]] = {}
        for n, (keys, at) in enumerate(_grams(tokens, sizes, bits)):
            distinct, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place, weights=train[at], minlength=len(distinct)).astype(np.int64)
            for b, i, j in filled(distinct, bits[n], buckets):
                rows.setdefault(b, none * order)[2 * n : 2 * n + 2] = pack(distinct[i:j]), pack_counts(counts[i:j])
        number = int(frame["chunk"].iloc[0])
        return pd.DataFrame([(number, b, *r) for b, r in rows.items()], columns=["chunk", "bucket", *(f"{x}{n}" for n in range(1, order + 1) for x in ("keys", "counts"))])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"chunk": frame["chunk"].to_numpy(), "bucket": frame["bucket"].to_numpy()}
        for n in range(1, order + 1):
            keys = [unpack(x) for x in frame[f"keys{n}"]]
            every = np.concatenate(keys)
            distinct, place = np.unique(every, return_inverse=True)
            totals = np.bincount(place, weights=np.concatenate([unpack_counts(x) for x in frame[f"counts{n}"]]), minlength=len(distinct)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            out[f"totals{n}"] = [pack_counts(x) for x in np.split(totals[place], ends)]
        return pd.DataFrame(out)

    def answer(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        tokens, sizes = _tokens(frame["text"].tolist())
        model = Automaton(n_all, v_all, top)
        for n, (keys, at) in enumerate(_grams(tokens, sizes, bits)):
            distinct, place = np.unique(keys, return_inverse=True)
            totals = np.concatenate([unpack_counts(x) for x in told[f"totals{n + 1}"]]) if len(told) else np.zeros(len(distinct), np.int64)
            model.add(totals, place, at, len(tokens))
        base, scores, _ = model.traverse(sizes)
        starts = np.cumsum(sizes) - sizes
        return pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy(bool), "n_tokens": sizes, "n_known": np.add.reduceat((model.counts[0][model.grams[0]] > 0).astype(np.int64), starts),
            "train_tokens": n_all, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(scores, starts),
        })

    sent = dealt.groupBy("chunk").applyInPandas(ask, "chunk int, bucket int, " + ", ".join(f"keys{n} binary, counts{n} binary" for n in range(1, order + 1)))
    told = sent.groupBy("bucket").applyInPandas(add, "chunk int, bucket int, " + ", ".join(f"totals{n} binary" for n in range(1, order + 1)))
    kind = own.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(answer, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Automaton:
    """States, arcs and failure arcs that some texts can reach, and the traversal of these texts.

    A state is a context of n words known to the model, numbered among the distinct n-grams of the texts; the empty
    context is state 0 of length 0. An arc of a state is a known (n + 1)-gram; it leads to the longest known end of that
    gram of at most ``order`` - 1 words. The failure arc leads to the state without the first word.
    """

    def __init__(self, n_all: int, v_all: int, top: float) -> None:
        self.n_all, self.v_all, self.top = n_all, v_all, top
        self.counts: list[np.ndarray] = []  # training counts of the distinct n-grams
        self.grams: list[np.ndarray] = []  # the n-gram that ends at each position, -1 where the text's start is too near
        self.arcs: list[np.ndarray] = []  # probability of the last word of each n-gram after the others
        self.leave: list[np.ndarray] = [np.zeros(1)]  # weight of the failure arc of each state, as 1 - a; the empty context has none

    def add(self, counts: np.ndarray, place: np.ndarray, at: np.ndarray, size: int) -> None:
        """The next length: counts of the distinct n-grams, the one of each of the positions ``at``."""
        n = len(self.counts)
        gram = np.full(size, -1, np.int64)
        gram[at] = place
        if not n:
            arc = (counts + 0.1) / (self.n_all + 0.1 * (self.v_all + 1))
        else:
            where = np.zeros(len(counts), np.int64)
            where[place] = at  # a position of each distinct n-gram
            context, end = self.grams[-1][where - 1], self.grams[-1][where]
            c = np.maximum(self.counts[-1][context], 1)
            a = self.top * c / (c + 1)
            arc = a * counts / c + (1 - a) * self.arcs[-1][end]
        self.counts.append(counts)
        self.grams.append(gram)
        self.arcs.append(arc)
        self.leave.append(1 - self.top * counts / (counts + 1))

    def traverse(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position: log10 probability by words alone, by the automaton, and the length of the state carried on from it."""
        order, size = len(self.counts), len(self.grams[0])
        first = np.zeros(size, bool)
        first[np.cumsum(sizes) - sizes] = True
        # the state after a position is the longest known n-gram that ends there
        carried = np.zeros(size, np.int64)
        for n in range(1, order):
            known = self.grams[n - 1] >= 0
            known[known] = self.counts[n - 1][self.grams[n - 1][known]] > 0
            carried[known] = n
        state = np.append(0, carried[:-1])  # its length before a position
        state[first] = 0
        weight = np.ones(size)
        for n in range(order - 1, -1, -1):
            at = np.flatnonzero(state == n)
            gram = self.grams[n][at]
            there = (gram >= 0) & (self.counts[n][gram] > 0) if n else np.ones(len(at), bool)
            weight[at[there]] *= self.arcs[n][gram[there]]
            failed = at[~there]
            if len(failed):
                weight[failed] *= self.leave[n][self.grams[n - 1][failed - 1]]
                state[failed] = n - 1
        return np.log10(self.arcs[0][self.grams[0]]), np.log10(weight), carried
