"""Operator 9, toxicity: a factorization machine over hashed terms.

A term is a word (A-Z lower-cased, without punctuation) or the first four or
six bytes of a longer word, hashed to 64 bits; a text is the set of its
terms.  The machine keeps the ``TERMS`` terms that speak most for the label
(more frequent with it; log-likelihood ratio of the training counts), so no
harmless passage can outweigh an insult, and the words of the ``PAIRS`` pairs
that speak most for or against it beyond what their words do alone, so that
words which only mean something together are learned too.  (With all terms,
chosen by frequency, the machine learns the training texts by heart; the
README has figures.)  It scores

    w0 + sum of w[i] + sum over pairs of <v[i], v[j]>

over a text's terms, so a pair such as an insult next to a group's name can
weigh more, or less, than its two terms alone.  It is fitted by full-batch
Adam on the logistic loss with classes weighed equally, on at most
``TRAIN_ROWS`` rows (smallest key hashes) among the labelled documents whose
``crc32(doc_id) % 3`` is not 1.

Defined results: an empty or null text has no terms and gets the score of
``w0``; without training rows of both classes every score is 0; repeated
label rows count as rows, and so do repeated documents; null labels are no
labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import bitmap, bounded_sample, in_bitmap, staged, text_key
from augsight.llm.words import ALNUM_FOLDED, Words, mix, signed, slices, split_words

FOLDS, HELD_OUT = 3, 1
#: Rows that the machine is fitted on at most.
TRAIN_ROWS = 20_000
#: Terms of the machine at most, and the least log-likelihood ratio of one.
TERMS, LEAST_LLR = 4096, 12.0
#: Pairs whose words are kept, words between two of a pair at most, least ratio beyond that of its words, least rows of a word.
PAIRS, WINDOW, LEAST_PAIR_LLR, LEAST_ROWS = 512, 8, 30.0, 8
#: Rows that pairs are looked for in, about: those with the smallest hashes of the rows that the machine is fitted on.
PAIR_ROWS = 5_000
FACTORS = 4
EPOCHS, RATE, DECAY = 400, 0.1, 1e-3
#: A text is called toxic from this score.
THRESHOLD = 0.7
PREFIXES = (4, 6)


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word and every prefix of a longer word, with repeats."""
    fold = ALNUM_FOLDED[1]
    texts, out = [words.doc], [words.hash]
    size = words.end - words.start
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h << np.uint64(8)) | fold[words.data[words.start[at] + j]].astype(np.uint64)
        texts.append(words.doc[at])
        out.append(mix(h))
    return np.concatenate(texts), np.concatenate(out)


def _labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of terms of each labelled text, and its words in order."""
    for part, data, bounds in slices(batches):
        words = split_words(data, bounds, ALNUM_FOLDED)
        doc, term = terms(words)
        by = np.lexsort((term, doc))
        doc, term = doc[by], term[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        ends = np.searchsorted(doc[new], np.arange(part.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [part.column("toxic"), part.column("place"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(term[new]))),
             pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(signed(words.hash)))],
            ["toxic", "place", "terms", "words"])


def _near_pairs(frequent: bytes):
    """Distinct pairs of words that stand within ``WINDOW`` of one another in a text; only words that the filter lets pass."""
    bits = np.frombuffer(frequent, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words")):
                w = words.values.to_numpy().view(np.uint64)
                at = np.flatnonzero(in_bitmap(bits, w))
                names, w = np.unique(w[at], return_inverse=True)
                found = []
                for gap in range(1, WINDOW + 1):
                    near = np.flatnonzero(at[gap:] - at[:-gap] <= WINDOW) if len(at) > gap else np.empty(0, np.int64)
                    a, b = w[near], w[near + gap]
                    found.append(np.unique(np.minimum(a, b)[a != b] * len(names) + np.maximum(a, b)[a != b]))
                pairs = np.unique(np.concatenate(found))
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), toxic, np.int32)), pa.array(signed(names[pairs // len(names)])),
                                                      pa.array(signed(names[pairs % len(names)]))], ["toxic", "x", "y"])
    return run


def _ratio(one: float, zero: float) -> Column:
    """Log-likelihood ratio of being in ``a`` of ``one`` texts with the label and ``b`` of ``zero`` without it."""
    def part(seen, total, share):
        return F.when(seen > 0, seen * F.log(seen / (total * share))).otherwise(F.lit(0.0))

    share = (F.col("a") + F.col("b")) / (one + zero)
    present = part(F.col("a"), F.lit(one), share) + part(F.col("b"), F.lit(zero), share)
    absent = part(one - F.col("a"), F.lit(one), 1 - share) + part(zero - F.col("b"), F.lit(zero), 1 - share)
    return 2 * (present + absent)


def _by_label(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with the label (``a``) and without it (``b``)."""
    return rows.groupBy(*keys).agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))


@dataclass
class Machine:
    terms: np.ndarray  # sorted uint64
    w0: float
    w: np.ndarray
    v: np.ndarray  # terms x factors

    def raw(self, text: np.ndarray, at: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and per text the sums of factors, from pairs (text, place of term)."""
        linear = np.bincount(text, self.w[at], minlength=texts)
        sums = np.stack([np.bincount(text, self.v[at, f], minlength=texts) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(text, (self.v[at] ** 2).sum(1), minlength=texts)
        return self.w0 + linear + 0.5 * ((sums ** 2).sum(1) - squares), sums


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(chosen: np.ndarray, text: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Fit on pairs (text, place of a term in ``chosen``) and the texts' labels."""
    rng = np.random.default_rng(9)
    m = Machine(chosen, 0.0, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS)))
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    params = [np.zeros(1), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, epochs + 1):
        raw, sums = m.raw(text, at, len(label))
        error = weight * (_logistic(raw) - label)
        e = error[text]
        slope_v = np.empty_like(m.v)
        square = np.bincount(at, e, minlength=len(chosen))
        for f in range(FACTORS):
            slope_v[:, f] = np.bincount(at, e * sums[text, f], minlength=len(chosen)) - m.v[:, f] * square
        slopes = [np.array([error.sum()]), square + DECAY * m.w / max(1, len(chosen)), slope_v + DECAY * m.v / max(1, len(chosen))]
        for p, g, a, b in zip(params, slopes, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9 ** epoch)) / (np.sqrt(b / (1 - 0.999 ** epoch)) + 1e-8)
        m.w0 = float(params[0][0])
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine, or None if the labels outside the held-out fold are of one class only."""
    marked = (labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
              .select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    sample = F.broadcast(bounded_sample(marked, "doc_id", rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("place"))
    listed = staged(texts.mapInArrow(_labelled_terms, "toxic int, place long, terms array<long>, words array<long>"), "labelled_terms")
    n = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    one, zero = float(n[1]), float(n[0])
    counts = _by_label(listed.select("toxic", F.explode("terms").alias("term")), "term").filter("a + b >= 2")
    counts = staged(counts.withColumn("llr", _ratio(one, zero)), "term_counts")
    best = (counts.filter((F.col("llr") >= LEAST_LLR) & (F.col("a") * zero > F.col("b") * one))
            .orderBy(F.desc("llr"), "term").limit(TERMS).select("term").collect())
    frequent = bitmap(counts.filter(F.col("a") + F.col("b") >= LEAST_ROWS), "term")
    some = listed.filter(F.col("place") < int(min(1.0, PAIR_ROWS / (one + zero)) * (1 << 62))).select("toxic", "words")
    n = {r["toxic"]: float(r["n"]) for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen_one, seen_zero = n.get(1, 1.0), n.get(0, 1.0)
    part = (seen_one + seen_zero) / (one + zero)  # a ratio grows with the rows
    pairs = _by_label(some.mapInArrow(_near_pairs(frequent), "toxic int, x long, y long"), "x", "y")
    pairs = pairs.filter(F.col("a") + F.col("b") >= LEAST_ROWS).withColumn("llr", _ratio(seen_one, seen_zero)).filter(F.col("llr") >= LEAST_PAIR_LLR)
    own = lambda c: counts.select(F.col("term").alias(c), (F.col("llr") * part).alias(f"llr_{c}"))
    beyond = F.col("llr") - F.col("llr_x") - F.col("llr_y")
    together = (pairs.join(own("x"), "x").join(own("y"), "y").withColumn("beyond", beyond).filter(F.col("beyond") >= LEAST_PAIR_LLR)
                .orderBy(F.desc("beyond"), "x", "y").limit(PAIRS).select("x", "y").collect())
    chosen = {r["term"] for r in best} | {x for r in together for x in r}
    chosen = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))
    kept = F.array_intersect("terms", F.lit(signed(chosen).tolist()).cast("array<long>"))
    table = listed.select("toxic", kept.alias("terms")).toArrow()  # TRAIN_ROWS rows of TERMS + 2 * PAIRS terms at most
    label = table.column("toxic").to_numpy().astype(np.float64)
    found = table.column("terms").combine_chunks()
    text = np.repeat(np.arange(len(label)), np.asarray(found.value_lengths()))
    at = np.searchsorted(chosen, np.asarray(found.flatten()).astype(np.int64).view(np.uint64))
    return train(chosen, text, at, label)


def _score(machine: Machine | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            score = np.zeros(part.num_rows)
            if machine is not None:
                doc, term = terms(split_words(data, bounds, ALNUM_FOLDED))
                at = np.searchsorted(machine.terms, term)
                hit = np.flatnonzero(machine.terms[np.minimum(at, len(machine.terms) - 1)] == term) if len(machine.terms) else []
                pairs = np.unique(doc[hit] * len(machine.terms) + at[hit]) if len(hit) else np.empty(0, np.int64)
                width = max(1, len(machine.terms))
                score = _logistic(machine.raw(pairs // width, pairs % width, part.num_rows)[0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(score)],
                                             ["doc_id", "text_key", "score"])
    return run


def toxicity_scores(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``(doc_id, text_key, score)`` of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
            .mapInArrow(_score(machine), f"doc_id {kind}, text_key string, score double"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    scored = toxicity_scores(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
