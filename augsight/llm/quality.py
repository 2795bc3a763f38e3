"""Operator 3, quality rules: hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are hashed to ``BUCKETS``.  Two
multinomials over the buckets, one of trusted target text and one of the raw
corpus, are counted with map-side aggregation (the tables have ``BUCKETS``
rows at any scale, which is why they may be sent to every task).  A text's
score is the mean over its grams of ``log p_target - log p_raw``, so its
length does not matter, and every document is kept or dropped by the same
threshold.

Trusted target: documents that ``labels`` calls quality 1, at most
``TRUSTED_ROWS`` of them (smallest key hashes); the raw model counts all
documents.  Base rules fail a text of fewer than 50 words, or one of whose
words more than half stand in 3-word windows that repeat in it.

Defined results: a null or empty text has no words and fails the base rules;
without trusted rows the target is the raw corpus, so all scores are 0 and
pass; repeated rows are rows; several labels for one document make it
trusted if one of them is 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import bounded_sample, staged

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
#: Grams of the raw corpus's mixture that are added to the target's counts.
PRIOR = 1 << 16
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.1
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SPACE = r"[\x20\x09-\x0D]+"
WHITE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _count(text: Column, characters: str) -> Column:
    """How many characters of ``characters`` (ASCII) the text has."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda p, j: (p["g"] == F.get(sorted_, j - 1)["g"]) | (p["g"] == F.get(sorted_, j + 1)["g"]))
        places = F.sort_array(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("far"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (p + 3).alias("far"), (a["n"] + p + 3 - F.greatest(a["far"], p)).alias("n")), lambda a: a["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(pairs, covered)).otherwise(F.lit(0))

    return F.when(F.size(words) >= 3, let(grams, count)).otherwise(F.lit(0))


def _gram_buckets(words: Column) -> Column:
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.size(words) - 2),
                      lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(words) >= 2, F.concat(one, two)).otherwise(one)


def base_counts(text: Column) -> list[Column]:
    """word_chars, n_symbols, n_dup_lines of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return [(F.char_length(t) - _count(t, WHITE)).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")]


def gram_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, weight)``: log-likelihood ratio of every bucket that the corpus has."""
    trusted = bounded_sample(labels.filter("quality = 1 and doc_id is not null").select("doc_id"), "doc_id", TRUSTED_ROWS)
    trusted = F.broadcast(trusted.distinct().select(F.col("doc_id").alias("_trusted")))
    flagged = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_trusted"), "left")
    grams = flagged.select(F.col("_trusted").isNotNull().cast("int").alias("t"), words_of(F.col("text")).alias("w"))
    counts = (grams.select("t", F.explode(let(F.col("w"), _gram_buckets)).alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")))
    counts = staged(counts, "gram_counts")  # BUCKETS rows at most
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    share = F.col("raw") / F.lit(float(raw))
    return counts.select("bucket", F.log((F.col("target") + PRIOR * share) / F.lit(float(target + PRIOR)) / share).alias("weight"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` of every row."""
    weights = F.broadcast(gram_weights(docs, labels))
    described = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"),
                            *base_counts(F.col("text")))
    per_text = let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                  _repeat_words(w).cast("long").alias("n_repeat_words"),
                                                  _gram_buckets(w).alias("grams")))
    rows = described.select("row", "doc_id", "word_chars", "n_symbols", "n_dup_lines", per_text.alias("p"))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # The grams of a row never leave their task: the sums are made where they are exploded.
    grams = rows.select("row", "doc_id", "p.n_words", "word_chars", "n_symbols", "n_dup_lines", "p.n_repeat_words",
                        F.explode_outer("p.grams").alias("bucket"))
    scored = (grams.join(weights, "bucket", "left").groupBy("row")
              .agg(*[F.first(c).alias(c) for c in kept], F.avg("weight").alias("score")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.select(*kept, failed.alias("base_failed"),
                         (~failed & (F.coalesce("score", F.lit(0.0)) >= threshold)).alias("kept"), "score")
