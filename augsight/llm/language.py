"""Operator 4, language ID: script ranges, per-word scores, and Viterbi over words.

A word is a run of letters.  Its script (the range of its first letter)
leaves the languages that were learned with that script; its score for each
is the log-likelihood of its letter trigrams (hashed to ``BUCKETS``, word
ends included).  Viterbi with a switching penalty then labels every word of
the whole text, so a text that changes language falls into spans, and the
language with most letters names the text.  All texts of a slice advance one
word at a time together.

Training counts trigrams of at most ``TRAIN_ROWS`` rows (those with the
smallest key hashes) among the documents with a label whose
``crc32(doc_id) % 5`` is not 0.  The model has ``languages * BUCKETS``
numbers, whatever the corpus.

Defined results: a text that is null or has no letter is ``und`` with score
0 and no spans; without any training row every text is ``und``; ties go to
the first language in code-point order; repeated rows get the same result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import bounded_sample, staged, text_key
from augsight.llm.words import slices

UNDETERMINED = "und"
FOLDS = 5
#: Rows that a model is fitted on at most.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
#: What a change of language between two words costs, in nats.
SWITCH = 8.0
#: A language may stand in a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.005
#: Below this share of its letters the winning language is not trusted by :func:`identified`.
REJECT_BELOW = 0.4

# First and last code points of scripts (other letters are one more script).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul Jamo", 0x1100, 0x11FF), ("Latin additional", 0x1E00, 0x1EFF), ("Greek extended", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its lower-case form if it is a letter, else 0; and its script."""
    fold = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for i, (_, lo, hi) in enumerate(SCRIPTS):
        script[lo:hi + 1] = i
    return fold, script


@dataclass
class LetterWords:
    """Words of a slice: of word w, text ``doc[w]``, letters ``start[w]:`` in the arrays of letters."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    gram: np.ndarray
    begin: np.ndarray  # code point of the slice where the word begins
    text_begin: np.ndarray  # code point of the slice where each text begins


def letter_words(data: np.ndarray, bounds: np.ndarray) -> LetterWords:
    fold, scripts = _letters()
    raw = data.tobytes()
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    text_begin = lead[bounds]
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = fold[points]
    at = np.flatnonzero(low)
    low = low[at]
    doc = np.searchsorted(text_begin, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    last = np.append(new[1:], True)[:len(at)]
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[new], after[last] = 0, 0
    gram = (before * np.uint32(0x9E3779B1) + low) * np.uint32(0x85EBCA77) + after
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0xC2B2AE3D)
    gram = (gram >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    start = np.flatnonzero(new)
    return LetterWords(doc[start], start, np.diff(np.append(start, len(at))), scripts[points[at[start]]], gram, at[start], text_begin)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages: 0 where the language may stand, else a large penalty


def _counts(languages: list[str]):
    """(language, bucket, n) of a task; buckets from ``BUCKETS`` on count letters by script."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + len(SCRIPTS) + 1
        counts = np.zeros(len(languages) * width, np.int64)
        for part, data, bounds in slices(batches):
            words = letter_words(data, bounds)
            of = np.array([place[x] for x in part.column("lang").to_pylist()])[words.doc] * width
            counts += np.bincount(np.repeat(of, words.size) + words.gram, minlength=len(counts))
            counts += np.bincount(of + BUCKETS + words.script, words.size, minlength=len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["cell", "n"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model of ``rows`` labelled documents outside the held-out fold."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sample = staged(bounded_sample(labelled, "doc_id", rows), "language_sample")
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())  # at most `rows`
    width = BUCKETS + len(SCRIPTS) + 1
    counts = np.zeros(len(languages) * width, np.float64)
    if languages:
        cells = (sample.select("lang", "text").mapInArrow(_counts(languages), "cell long, n long")
                 .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
        counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(languages), width)
    grams, scripts = counts[:, :BUCKETS] + 0.05, counts[:, BUCKETS:]
    share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32),
                 np.where(share >= SCRIPT_SHARE, 0, -1e6).T.astype(np.float32))


def word_scores(words: LetterWords, model: Model) -> np.ndarray:
    """words x languages."""
    allowed = model.scripts[words.script]
    allowed[(allowed < 0).all(1)] = 0  # a script that no language was learned with narrows nothing
    return np.add.reduceat(model.logp[words.gram], words.start, axis=0) + allowed


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word; each text ``first[d]:first[d + 1]`` has a path of its own.

    All texts advance one word per step; the longest come first, so the
    texts that still have a word are always the leading ones.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")[:np.count_nonzero(size)]
    begin, size = first[order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    n, width = scores.shape
    back = np.empty((n, width), np.int16)
    own, rows = np.arange(width, dtype=np.int16), np.arange(len(size))
    value = scores[begin]
    for t in range(1, steps):
        m = active[t]
        v, at = value[:m], begin[:m] + t
        top = v.argmax(1)
        switch = (v[rows[:m], top] - penalty)[:, None]
        back[at] = np.where(v >= switch, own, top[:, None])
        value[:m] = np.maximum(v, switch) + scores[at]
    labels = np.empty(n, np.int64)
    now = value.argmax(1)
    for t in range(steps - 1, 0, -1):
        m = active[t]
        at = begin[:m] + t
        labels[at] = now[:m]
        now[:m] = back[at, now[:m]]
    labels[begin] = now
    return labels


def _predict(model: Model, with_spans: bool):
    names = ["doc_id", "text_key", "lang_pred", "score"] + ["spans"] * with_spans
    span = pa.list_(pa.struct([("start", pa.int64()), ("lang", pa.string())]))
    known = np.array([*model.languages, UNDETERMINED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            texts, width = part.num_rows, len(model.languages)
            pred, score = np.full(texts, width), np.zeros(texts)
            words = letter_words(data, bounds)
            spans: list[list] = [[] for _ in range(texts)]
            if width and len(words.doc):
                first = np.searchsorted(words.doc, np.arange(texts + 1))
                labels = viterbi(word_scores(words, model), first)
                letters = np.bincount(words.doc * width + labels, words.size, minlength=texts * width).reshape(texts, width)
                total = letters.sum(1)
                has = total > 0
                pred[has] = letters[has].argmax(1)
                score[has] = letters[has].max(1) / total[has]
                if with_spans:
                    change = np.ones(len(labels), bool)
                    change[1:] = (labels[1:] != labels[:-1]) | (words.doc[1:] != words.doc[:-1])
                    for i in np.flatnonzero(change).tolist():
                        d = int(words.doc[i])
                        spans[d].append({"start": int(words.begin[i] - words.text_begin[d]), "lang": model.languages[labels[i]]})
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(known[pred].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, span)] * with_spans, names)
    return run


def predictions(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``(doc_id, text_key, lang_pred, score[, spans])`` of every row; a span starts at a code point, until the next.

    ``score`` is the share of the text's letters in spans of its language.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key string, lang_pred string, score double"
    if with_spans:
        schema += ", spans array<struct<start:long,lang:string>>"
    return (docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
            .mapInArrow(_predict(model, with_spans), schema))


def language_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs``."""
    return predictions(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: not ``und``, and at least two fifths of the letters in it."""
    model = fit(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _predict(model, False)
        for part, _, _ in slices(batches):
            own = pa.RecordBatch.from_arrays([part.column("text"), part.column("text"), part.column("text")],
                                             ["doc_id", "text_key", "text"])
            for out in judge(iter([own])):
                known = np.array([x != UNDETERMINED for x in out.column("lang_pred").to_pylist()])
                yield part.filter(pa.array(known & (out.column("score").to_numpy() >= REJECT_BELOW)))

    return docs.mapInArrow(keep, docs.schema)
