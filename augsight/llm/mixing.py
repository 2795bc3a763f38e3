"""Operator 7, mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Inside each source the documents are
laid out in key order, in ranges of the key's leading digits; range totals
are summed along a source, and rows inside a range, so a source that holds a
third of all rows is spread over all ranges.  The laid-out words of a source
are taken from the front, whole epochs first, and the last epoch is cut at
the exact word budget.  What the prefix sums give is one row per source
(whole epochs, the key on the cut, the words taken of that document), so the
texts themselves are never sorted or shuffled.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share 100 % of all words.  A target stops at ``max_epochs`` times its
source's words; the excess is shared again by weight among the others until
none is above its stop.  Every round caps at least one more source or is the
last, and only two sums leave the table of sources in a round.

Defined results: a null text has 0 words; a null source is a source of its
own; rows with one doc_id and source have one key, go together, and share a
cut in proportion; a source without words has target 0; an empty table gives
no rows; other columns are ignored by the digest and kept by :func:`mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import packed, running_total, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the key that name a range: 16 ** 3 ranges of a source.
RANGE_DIGITS = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source."""
    ranges = (sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
              .select("source", "source_size", F.spark_partition_id().alias("range"), F.lit(0).alias("all")))
    place = running_total(staged(ranges, "source_ranges"), ["all"], "range",
                          [F.col("source").asc_nulls_last()], F.lit(1), "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = staged(place.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    stop = F.col("source_size") * max_epochs
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = stop < F.lit(level) * F.col("weight")
        fixed, free = table.agg(F.coalesce(F.sum(F.when(capped, stop)), F.lit(0)),
                                F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = (total - fixed) / free if free else level
        if new <= level:
            break
        level = new
    target = F.when(stop < F.lit(level) * F.col("weight"), stop.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def source_cuts(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``(source, key, size)``: its target and where the mix cuts it.

    ``epochs`` whole passes, then every key below ``cut_key``, then
    ``cut_words`` of the ``cut_size`` words at ``cut_key`` (null: none).
    """
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = (targets.withColumn("epochs", whole)
               .withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    keyed = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    laid = running_total(keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), ["source"], "range",
                         [F.col("key")], F.col("size"), "before").alias("l")
    t = targets.alias("t")
    on_cut = (F.col("l.source").eqNullSafe(F.col("t.source")) & (F.col("l.before") < F.col("t.rest"))
              & (F.col("t.rest") <= F.col("l.before") + F.col("l.size")))
    return t.join(laid, on_cut, "left").select(
        "t.source", "t.source_size", "t.target", "t.epochs", F.col("l.key").alias("cut_key"),
        (F.col("t.rest") - F.col("l.before")).alias("cut_words"), F.col("l.size").alias("cut_size"))


def _with_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with ``source, key, size``) and, after their columns, ``cut`` and ``last``: words of the last epoch."""
    c = cuts.select(F.struct("*").alias("cut"))
    joined = rows.join(c, rows["source"].eqNullSafe(c["cut.source"]))
    last = (F.when(F.col("key") < F.col("cut.cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut.cut_key"), F.expr("size * cut.cut_words div cut.cut_size"))
            .otherwise(F.lit(0)))
    return joined.withColumn("last", last.cast("long"))


def mix_digest(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row of ``docs``."""
    rows = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              mix_key(F.col("doc_id"), seed).alias("key")), "sizes")
    return _with_cut(rows, source_cuts(rows)).select(
        "doc_id", "size", "cut.source_size", "cut.target",
        (F.col("cut.epochs") * F.col("size") + F.col("last")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row once per epoch that takes it whole.

    The document on a source's cut comes once more with its first words only
    (joined by one space, ``n_chars`` set anew if there is one).
    """
    sized = packed(docs, source=F.col("source"), key=mix_key(F.col("doc_id"), seed), size=n_words(F.col("text")))
    cuts = source_cuts(staged(sized.select("source", "key", "size"), "sizes"))
    full = (F.col("key") < F.col("cut.cut_key")) | ((F.col("last") == F.col("size")) & (F.col("size") > 0))
    copies = F.col("cut.epochs") + F.when(full | (F.col("last") > 0), 1).otherwise(0)
    rows = (_with_cut(sized, cuts).withColumn("copies", copies.cast("int")).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    part = (F.col("copy") > F.col("cut.epochs")) & ~full
    first_words = F.concat_ws(" ", F.slice(words_of(F.col("row.text")), F.lit(1), F.col("last").cast("int")))
    rows = rows.select("row", F.when(part, first_words).alias("first_words"))
    row = F.col("row").withField("text", F.coalesce("first_words", "row.text"))
    if "n_chars" in docs.columns:
        n = F.coalesce(F.char_length("first_words"), "row.n_chars").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", n)
    return rows.select(row.alias("row")).select("row.*")
