"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A text's pre-tokens are its runs of non-space characters, each with the word mark in front. The distinct ones of a
block of texts go into a trie (they are sorted, and the trie is walked depth first, so that only the path from
the root is held). At a trie node the forward score is the best log-probability of the string from the root to
it: the best, over pieces that end there, of the forward score at the piece's start plus the piece's score. It
is worked out once for all pre-tokens that share the prefix; where a pre-token ends its token count is stored.
Documents then add up their pre-tokens' counts. What is stored is kept for later blocks up to a bound.

The pieces' scores are log(1 / ((rank + 1) * H)), Zipf's law over the vocabulary's order, for a vocabulary
without probabilities of its own. A character that no piece covers costs one token for each of its UTF-8 bytes.

Defined cases: null and empty texts have no tokens; of equal scores the one with fewer tokens counts; repeated
rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mendwright.llm.common import blocks, texts_of

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Log-probability of one byte of a character without a piece.
BYTE = -16.0


def load_scores(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model, by their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - norm for k, p in enumerate(pieces)}


class TrieCounter:
    """Token counts and scores of pre-tokens; terminal values are kept up to ``most_kept``."""

    def __init__(self, scores: dict[str, float], most_kept: int = 300_000) -> None:
        self.scores, self.most_kept = scores, most_kept
        # pieces by last character, with their lengths: those that can end at a node
        self.longest = max(map(len, scores), default=1)
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(v) for c, v in lengths.items()}
        self.stored: dict[str, tuple[int, float]] = {}
        self.nodes = 0

    def learn(self, words: list[str]) -> None:
        """Stores the terminal values of the distinct words."""
        forward: list[tuple[float, int]] = [(0.0, 0)]  # along the path from the root: score, minus tokens
        path, get, all_lengths = "", self.scores.get, self.lengths
        for word in sorted(words):
            shared = len(commonprefix((path, word)))
            del forward[shared + 1 :]
            self.nodes += len(word) - shared
            for i in range(shared + 1, len(word) + 1):
                c = word[i - 1]
                size = len(c.encode("utf-8", "surrogatepass"))
                score, tokens = forward[i - 1]
                best = (score + BYTE * size, tokens - size)
                for n in all_lengths.get(c, ()):
                    if n > i:
                        break
                    s = get(word[i - n : i])
                    if s is not None:
                        score, tokens = forward[i - n]
                        new = (score + s, tokens - 1)
                        if new > best:
                            best = new
                forward.append(best)
            path = word
            score, tokens = forward[-1]
            self.stored[word] = (-tokens, score)

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, log-probability of the best segmentation) of each text."""
        if len(self.stored) > self.most_kept:
            self.stored.clear()
        split = [[MARK + w for w in t.split()] for t in texts]
        self.learn(list({w for words in split for w in words if w not in self.stored}))
        out = []
        for words in split:
            if not words:
                out.append((0, 0, 0.0))
                continue
            found = np.array([self.stored[w] for w in words])
            out.append((len(words), int(found[:, 0].sum()), float(found[:, 1].sum())))
        return out


_KEPT: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _KEPT:
        _KEPT[path] = TrieCounter(load_scores(path))
    return _KEPT[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, log_prob."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for frame in blocks(frames, 8_000_000):
            out = pd.DataFrame(own.count(frame["text"].tolist()), columns=["n_pretokens", "n_tokens", "log_prob"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    own = texts_of(docs, id_col, text_col)
    return own.mapInPandas(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, log_prob double")
