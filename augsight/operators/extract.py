"""Extractive summaries by the graph of a text's sentences.

Sentences are joined by the cosine of their token counts.  Their ranks come
from a fixed number of power iterations on that graph (each sentence gives its
rank to the others in proportion to the cosines, itself included).  The
product with the matrix of cosines is taken through the tokens, so time and
memory follow the length of a text, not the square of its sentences.

A summary picks sentences by rank less a penalty for the greatest cosine with
those already picked.  Ranks are rounded to nine digits and equal ones go to
the earlier sentence, so equal sentences are told apart the same everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from augsight.operators.plugins import regex_tokenizer, split_lead

ROUNDS, DAMPING, PENALTY = 20, 0.85, 0.5


class SentenceGraph:
    """Unit vectors of token counts of the sentences, as triples (sentence, token, weight)."""

    def __init__(self, sentences: Sequence[Sequence[str]]):
        self.n = len(sentences)
        numbers: dict[str, int] = {}
        flat = [(s, numbers.setdefault(t, len(numbers))) for s, tokens in enumerate(sentences) for t in tokens]
        self.tokens = max(1, len(numbers))
        pairs, counts = np.unique(np.array([s * self.tokens + t for s, t in flat], np.int64), return_counts=True)
        self.sentence, self.token = pairs // self.tokens, pairs % self.tokens
        norm = np.sqrt(np.bincount(self.sentence, counts.astype(float) ** 2, self.n))
        self.weight = counts / norm[self.sentence]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The matrix of cosines times ``x``."""
        by_token = np.bincount(self.token, self.weight * x[self.sentence], self.tokens)
        return np.bincount(self.sentence, self.weight * by_token[self.token], self.n)

    def ranks(self, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
        degree = self.times(np.ones(self.n))
        rank = np.full(self.n, 1.0 / self.n)
        for _ in range(rounds):
            given = np.divide(rank, degree, out=np.zeros(self.n), where=degree > 0)
            rank = (1 - damping) / self.n + damping * self.times(given)
        return rank

    def cosines(self, i: int) -> np.ndarray:
        one = np.zeros(self.n)
        one[i] = 1.0
        return self.times(one)

    def picked(self, n: int, penalty: float = PENALTY) -> list[int]:
        """The first ``n`` sentences of a summary, in the order in which they are picked."""
        rank, near, out = self.ranks() * self.n, np.zeros(self.n), []
        for _ in range(min(n, self.n)):
            score = np.round(rank - penalty * near, 9)
            score[out] = -np.inf
            out.append(int(score.argmax()))
            near = np.maximum(near, self.cosines(out[-1]))
        return out


def rank_generator(texts: list[str], n: int) -> list[list[str]]:
    """Generator plug-in: variant j is the first j + 1 picked sentences, in the order of the text."""
    out = []
    for text in texts:
        sentences = split_lead(text)
        picked = SentenceGraph(regex_tokenizer(sentences)).picked(n)
        out.append([" ".join(sentences[i] for i in sorted(picked[:j + 1])) for j in range(n)])
    return out
