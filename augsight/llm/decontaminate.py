"""Operator 2, benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive benchmark words (a shorter item is one
window).  Both sides keep, of every ``WINDOW - K + 1`` consecutive k-gram
hashes, the smallest (the rightmost among equals).  A window holds that many
k-grams, so a copy of it in a document selects the same k-gram in it: every
shared window shares a fingerprint at the same place.  Items of fewer than
``WINDOW`` words are found the same way, at their own length (``k`` at most
their length), since any shared span of that length must be found.

Test and training fingerprints are joined by Spark.  A bitmap of fixed size
(2 MB whatever the size of the benchmark) lets a task forget
fingerprints that no item has; it can only pass too many.  Each survivor
carries the words around it, so hits are extended on the words themselves,
left and right, to the shared span.  Spans of one document are merged to
count its words.

Equal items' windows are joined once and their items listed afterwards, so a
passage shared by many items and many documents does not multiply.

Defined results: a null or empty text has no words; an item without words
has no window; null items are ignored; repeated rows are rows of their own;
a null doc_id is kept; empty tables on either side leave nothing
contaminated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import bitmap, in_bitmap, packed, staged, text_key
from augsight.llm.words import ALNUM_FOLDED, Words, signed, slices, split_words

WINDOW = 10
K = 5


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that winnowing keeps for spans of ``length`` words."""
    k = min(K, length)
    at, h = words.grams(k, seed=length)
    span = length - k + 1
    if not len(at):
        return at, h
    if span == 1:
        return at, h
    m = len(at) - span + 1
    if m <= 0:
        return at[:0], h[:0]
    best, where = h[:m].copy(), np.arange(m)
    for j in range(1, span):
        better = h[j:j + m] <= best
        best = np.where(better, h[j:j + m], best)
        where = np.where(better, np.arange(j, j + m), where)
    inside = words.doc[at[:m]] == words.doc[at[span - 1:]]
    kept = np.unique(where[inside])
    return at[kept], h[kept]


def _around(words: Words, p: int, length: int) -> tuple[int, int]:
    """The words that a span of ``length`` words over the k-gram at ``p`` can reach."""
    k = min(K, length)
    d = words.doc[p]
    return max(int(words.first[d]), p - (length - k)), min(int(words.first[d + 1]), p + length)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, len, back, around) of every item's fingerprints, with the item."""
    for part, data, bounds in slices(batches):
        words = split_words(data, bounds, ALNUM_FOLDED)
        ids, out = part.column("item_id"), ([], [], [], [], [])
        sizes = np.diff(words.first)
        for length in np.unique(np.minimum(sizes[sizes > 0], WINDOW)).tolist():
            at, h = fingerprints(words, length)
            own = np.minimum(sizes[words.doc[at]], WINDOW) == length
            for p, x in zip(at[own].tolist(), signed(h[own]).tolist()):
                lo, hi = _around(words, p, length)
                for v, c in zip(out, (x, length, p - lo, words.text(lo, hi).lower().decode(), int(words.doc[p]))):
                    v.append(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
             pa.array(out[3], pa.string()), ids.take(pa.array(out[4], pa.int64()))],
            ["fp", "len", "back", "around", "item_id"])


def _doc_rows(lengths: list[int], known_bits: bytes):
    bits = np.frombuffer(known_bits, np.uint8)
    hit = pa.list_(pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("at", pa.int32()), ("back", pa.int32()),
                              ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            words = split_words(data, bounds, ALNUM_FOLDED)
            hits: list[list] = [[] for _ in range(part.num_rows)]
            for length in lengths:
                at, h = fingerprints(words, length)
                known = in_bitmap(bits, h)
                for p, x in zip(at[known].tolist(), signed(h[known]).tolist()):
                    lo, hi = _around(words, p, length)
                    d = int(words.doc[p])
                    hits[d].append((x, length, p - int(words.first[d]), p - lo, words.text(lo, hi).lower().decode()))
            fields = ("fp", "len", "at", "back", "around")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(words.first), pa.int64()),
                 pa.array([[dict(zip(fields, x)) for x in v] for v in hits], hit)],
                ["doc_id", "text_key", "n_words", "hits"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: rows ``(_row, doc_id, text_key, n_words)``; spans ``(_row, start, end, items)``, end exclusive, in words.

    A span is a maximal stretch of a document around one fingerprint that
    an item also has and that holds a window; ``items`` lists its items.
    """
    items = staged(benchmark.filter("item_id is not null").select("item_id", "text").mapInArrow(
        _item_rows, f"fp long, len int, back int, around string, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        .distinct().groupBy("fp", "len", "back", "around").agg(F.collect_set("item_id").alias("items")), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # 1 to WINDOW
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key string, n_words long, "
              "hits array<struct<fp:long,len:int,at:int,back:int,around:string>>")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(_doc_rows(lengths, bitmap(items, "fp")), schema)
    # The number is stored with the row: made anew by each job it would follow that job's packing of the files.
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    hits = rows.filter(F.size("hits") > 0).select("_row", F.explode("hits").alias("h"))
    both = hits.join(items.alias("i"), (F.col("h.fp") == F.col("i.fp")) & (F.col("h.len") == F.col("i.len")))
    # Extend: equal words to the left of the fingerprint, and from it to the right.
    words = both.select("_row", "h.at", "h.len", "items", F.col("h.back").alias("a"), F.col("i.back").alias("b"),
                        F.split("h.around", " ").alias("u"), F.split("i.around", " ").alias("v"))
    fwd = F.expr("coalesce(array_position(transform(sequence(0, greatest(size(u) - a, size(v) - b)), "
                 "j -> get(u, a + j) is null or get(v, b + j) is null or get(u, a + j) <> get(v, b + j)), true), 1) - 1")
    back = F.expr("coalesce(array_position(transform(sequence(1, greatest(a, b) + 1), "
                  "j -> get(u, a - j) is null or get(v, b - j) is null or get(u, a - j) <> get(v, b - j)), true), 1) - 1")
    spans = (words.withColumn("fwd", fwd).withColumn("back", back).filter("back + fwd >= len and fwd > 0")
             .select("_row", (F.col("at") - F.col("back")).cast("long").alias("start"),
                     (F.col("at") + F.col("fwd")).cast("long").alias("end"), "items"))
    return rows.select("_row", "doc_id", "text_key", "n_words"), spans


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key)`` of every row of ``docs``."""
    rows, spans = contamination(docs, benchmark)
    # Spans in order; a word counts once: each adds what lies beyond the furthest end so far.
    merged = F.expr("aggregate(array_sort(collect_set(struct(start, end))), struct(0L as far, 0L as n), "
                    "(x, s) -> struct(greatest(x.far, s.end) as far, "
                    "x.n + greatest(0L, s.end - greatest(x.far, s.start)) as n), x -> x.n)")
    n_hit = spans.groupBy("_row").agg(merged.alias("n_hit"))
    found = (spans.select("_row", F.explode("items").alias("item")).distinct().groupBy("_row")
             .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.join(n_hit, "_row", "left").join(found, "_row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_key"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark window."""
    hit = contamination_digest(docs, benchmark).filter("contaminated").select("doc_id", "text_key").distinct().alias("h")
    rows = packed(docs, doc_id=F.col("doc_id"), text_key=text_key(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key"))
    return rows.join(hit, same, "left_anti").select("row.*")
