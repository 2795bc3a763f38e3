"""Operator 6, substring dedup by recompression.

Rounds rename a token string: the first names maximal runs of one word, and
each of ``ROUNDS`` further ones names pairs.  In a pair round every symbol
falls on the left or the right side by a bit of its name, and a left symbol
followed by a right one becomes one symbol, so whether two symbols pair
depends on these two alone.  Names are keyed 64-bit hashes of what they
stand for: all tasks of a round agree on them without a dictionary.  (Runs
are named once: later, equal neighbours cannot pair, and a window of
``WINDOW`` words has no room for more context.)

Each symbol knows the words that determine it.  A window holds the symbols
whose words all lie in it, and these are the same in every copy of the
window; its widest one of the last round (or of an earlier one) is its
anchor.  Copies of a window thus share their anchor's name.  Neighbouring
windows share anchors, so about one row in six words leaves a task: the
anchor, and a hash of the stretch of words whose windows it anchors.

Documents that share a whole stretch with a smaller doc_id lose its windows
at once.  Only where one anchor stands in different stretches (edges of a
repeat) the smallest document of each stretch is verified window by window,
by hashes of the words.  Every step is an aggregate with map-side
combination; no pairs of documents are made.

Defined results: a null or empty text has no words and loses none; fewer
words than a window lose none; equal doc_ids are one document and never
remove from each other; a null doc_id removes nothing and loses nothing;
repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import bitmap, in_bitmap, staged, text_key
from augsight.llm.words import AS_IS, Words, mix, signed, slices, split_words

WINDOW = 13
ROUNDS = 3
#: Bits of the filter of shared anchors: 4 MB for every task at any size of the corpus.
ANCHOR_BITS = 1 << 25

_RUN = np.uint64(0x8CB92BA72F3D8DD7)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _levels(words: Words):
    """Symbols of every round, last first: (name, first word, end, words that determine it from, to)."""
    n = len(words.hash)
    at = np.arange(n + 1)
    levels = [(words.hash, at[:-1], at[1:], at[:-1], at[1:])]
    change = np.ones(n, bool)
    change[1:] = (words.hash[1:] != words.hash[:-1]) | (words.doc[1:] != words.doc[:-1])
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], n)
    run = (hi - lo).astype(np.uint64)
    name = np.where(run > 1, mix(words.hash[lo] + run * _RUN), words.hash[lo])
    doc = words.doc[lo]
    need_lo, need_hi = lo - 1, hi + 1  # a run ends where its neighbours differ
    for r in range(1, ROUNDS + 1):
        right = (mix(name + np.uint64(r * int(_RUN) % (1 << 64))) & np.uint64(1)).astype(bool)
        same = doc[:-1] == doc[1:]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & same
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # A symbol that stays alone shows that its neighbour is no partner.
        after = np.append(np.where(same, need_hi[1:], hi[:-1] + 1), hi[-1:] + 1)
        before = np.insert(np.where(same, need_lo[:-1], lo[1:] - 1), 0, lo[:1] - 1)
        new_name, new_hi = name.copy(), hi.copy()
        new_need_hi = np.where(~right & ~pair, np.maximum(need_hi, after), need_hi)
        new_need_lo = np.where(right & ~second, np.minimum(need_lo, before), need_lo)
        i = np.flatnonzero(pair)
        new_name[i] = mix(name[i] * _PAIR + name[i + 1] + np.uint64(r))
        new_hi[i], new_need_hi[i] = hi[i + 1], need_hi[i + 1]
        keep = ~second
        name, lo, hi, doc = new_name[keep], lo[keep], new_hi[keep], doc[keep]
        need_lo, need_hi = new_need_lo[keep], new_need_hi[keep]
        levels.append((name, lo, hi, need_lo, need_hi))
    return levels[::-1]


def _anchors(words: Words):
    """Stretches of windows with one anchor: (key, first window, windows, text)."""
    n = len(words.hash)
    if n < WINDOW:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    window = np.flatnonzero(words.doc[:n - WINDOW + 1] == words.doc[WINDOW - 1:])
    key = np.zeros(len(window), np.uint64)
    place = np.full(len(window), -1)
    todo = np.arange(len(window))
    for level, (name, lo, hi, need_lo, need_hi) in enumerate(_levels(words)):
        starts = np.zeros(n + 2, np.int64)
        np.cumsum(np.bincount(np.clip(need_lo, 0, n) + 1, minlength=n + 2)[:n + 2], out=starts)
        ends = np.cumsum(np.bincount(np.clip(need_hi, 0, n + 1), minlength=n + 2)[:n + 2])
        w = window[todo]
        # need_lo below 0 counts as 0, but lies outside every window
        first = np.maximum(starts[w], np.searchsorted(need_lo, 0)) if len(need_lo) and need_lo[0] < 0 else starts[w]
        last = ends[w + WINDOW]
        has = np.flatnonzero(last > first)
        if len(has):
            first, last, own = first[has], last[has], todo[has]
            rank = (np.uint64(15) - np.minimum(hi - lo, 15).astype(np.uint64) << np.uint64(60)) | (name >> np.uint64(4))
            best, at = rank[first], first.copy()
            for j in range(1, int((last - first).max())):
                open_ = np.flatnonzero(first + j < last)
                cand = rank[first[open_] + j]
                win = cand < best[open_]
                best[open_[win]], at[open_[win]] = cand[win], first[open_[win]] + j
            anchors = np.zeros(len(name), bool)
            anchors[at] = True
            used = np.flatnonzero(anchors)
            names = np.zeros(len(name), np.uint64)
            names[used] = mix(name[used] + words.range_hash(need_lo[used], need_hi[used]) + np.uint64(level))
            key[own], place[own] = names[at], at * (ROUNDS + 2) + level
            todo = np.delete(todo, has)
        if not len(todo):
            break
    change = np.ones(len(window), bool)
    change[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    i = np.flatnonzero(change)
    return key[i], window[i], np.diff(np.append(i, len(window))), words.doc[window[i]]


def _stretch(words: Words, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return words.range_hash(first, first + count + WINDOW - 1)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, bounds in slices(batches):
        words = split_words(data, bounds, AS_IS)
        key, first, count, doc = _anchors(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(key), pa.int64()), pa.array(signed(_stretch(words, first, count)), pa.int64()),
             part.column("doc_id").take(pa.array(doc))], ["key", "stretch", "doc_id"])


_ANCHOR = pa.list_(pa.struct([("key", pa.int64()), ("stretch", pa.int64()), ("first", pa.int32()), ("n", pa.int32()),
                              ("varied", pa.bool_()), ("windows", pa.list_(pa.int64()))]))


def _second_pass(shared: bytes, varied: bytes):
    """Rows with each text's shared anchors.

    Hashes of the windows themselves go with an anchor that stands in several
    stretches, and only for the smallest doc_id so far that has its stretch
    in this task: the smallest of all has them for certain.
    """
    shared_bits, varied_bits = np.frombuffer(shared, np.uint8), np.frombuffer(varied, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, object] = {}
        for part, data, bounds in slices(batches):
            words = split_words(data, bounds, AS_IS)
            key, first, count, doc = _anchors(words)
            known = in_bitmap(shared_bits, key)
            key, first, count, doc = key[known], first[known], count[known], doc[known]
            stretch = signed(_stretch(words, first, count)).tolist()
            detail = in_bitmap(varied_bits, key)
            ids = part.column("doc_id").to_pylist()
            anchors: list[list] = [[] for _ in range(part.num_rows)]
            if detail.any():
                place, hashes = words.grams(WINDOW)
                hashes, place = signed(hashes), np.searchsorted(place, first)
            for i, (k, f, n, d) in enumerate(zip(signed(key).tolist(), first.tolist(), count.tolist(), doc.tolist())):
                own, doc_id = None, ids[d]
                if detail[i] and doc_id is not None and doc_id <= least.get(stretch[i], doc_id):
                    least[stretch[i]] = doc_id
                    own = hashes[place[i]:place[i] + n]
                anchors[d].append({"key": k, "stretch": stretch[i], "first": f - int(words.first[d]), "n": n,
                                   "varied": bool(detail[i]), "windows": own})
            out, ends = words.joined()
            raw, ends = out.tobytes(), ends.tolist()
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(words.first), pa.int64()),
                 pa.array(digests), pa.array(anchors, _ANCHOR)],
                ["doc_id", "text_key", "n_words", "sha256", "anchors"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their removed stretches of windows."""
    for part, data, bounds in slices(batches):
        words = split_words(data, bounds, AS_IS)
        spans = part.column("spans")
        flat, text = spans.flatten(), np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths()))
        start = words.first[text] + np.asarray(flat.field("first"))
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + np.asarray(flat.field("n")) + WINDOW - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out, ends = words.joined(~gone)
        raw, ends = out.tobytes(), ends.tolist()
        kept = [raw[a:b] for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"),
             pa.array(np.bincount(words.doc[gone], minlength=part.num_rows), pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "text_key", "n_removed", "sha256", "text"])


def _only(wanted: bytes, column: str):
    bits = np.frombuffer(wanted, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(bits, batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield batch.filter(pa.array(hit))
    return run


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, removed)``: rows ``(doc_id, text_key, n_words, sha256)`` of whole texts, and for each text that
    loses words ``(doc_id, text_key, spans)`` with its removed stretches of windows (first window, number)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    shared = (docs.select("doc_id", "text").mapInArrow(_first_pass, f"key long, stretch long, doc_id {kind}")
              .groupBy("key").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"),
                                  (F.min("stretch") < F.max("stretch")).alias("varied"))
              .filter("least_id < most_id").select("key", "least_id", "varied"))
    shared = staged(shared, "shared")
    anchors_type = "array<struct<key:long,stretch:long,first:int,n:int,varied:boolean,windows:array<long>>>"
    passed = _second_pass(bitmap(shared, "key", ANCHOR_BITS), bitmap(shared.filter("varied"), "key", ANCHOR_BITS))
    rows = keyed.mapInArrow(passed, f"doc_id {kind}, text_key string, n_words long, sha256 string, anchors {anchors_type}")
    # The number is stored with the row: made anew by each job it would follow that job's packing of the files.
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = rows.filter("doc_id is not null").select("row", "doc_id", F.inline("anchors"))
    # An anchor that always stands in one stretch: its smallest document keeps it.
    plain = (found.filter("not varied").select("row", "doc_id", "key", "first", "n")
             .join(shared.filter("not varied").select("key", "least_id"), "key")
             .filter("least_id < doc_id").select("row", "first", "n"))
    # Others: the same for each stretch, and its smallest document window by window.
    many = found.filter("varied").drop("varied")
    many = staged(many.join(many.groupBy("key", "stretch").agg(F.min("doc_id").alias("least_id")), ["key", "stretch"])
                  .select("row", "doc_id", "key", "first", "n", "least_id",
                          F.when(F.col("least_id") == F.col("doc_id"), F.col("windows")).alias("windows")), "stretches")
    whole = many.filter("least_id < doc_id").select("row", "first", "n")
    windows = (many.filter("windows is not null").select("row", "doc_id", "key", "first", F.posexplode("windows").alias("i", "h"))
               .select("row", "doc_id", "key", (F.col("first") + F.col("i")).cast("int").alias("first"), "h"))
    # Equal windows have equal anchors: key and hash of the words name a window with 128 bits.
    smallest = staged(windows.groupBy("key", "h").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
                      .filter("least_id < most_id").select("key", "h", "least_id"), "windows")
    again = windows.mapInArrow(_only(bitmap(smallest, "h"), "h"), windows.schema)
    single = again.join(smallest, ["key", "h"]).filter("least_id < doc_id").select("row", "first", F.lit(1).alias("n"))
    removed = plain.union(whole).union(single).groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    removed = rows.select("row", "doc_id", "text_key").join(removed, "row").drop("row").dropDuplicates(["doc_id", "text_key"])
    return rows.drop("anchors", "row"), staged(removed, "removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, text)`` of every row of ``docs``; text is null where nothing goes."""
    rows, removed = repeats(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"), F.xxhash64("doc_id").alias("h"))
    near = texts.mapInArrow(_only(bitmap(removed.select(F.xxhash64("doc_id").alias("h")), "h"), "h"),
                            f"doc_id {kind}, text string, text_key string, h long").drop("h")
    cut = (near.dropDuplicates(["doc_id", "text_key"]).join(removed, ["doc_id", "text_key"])
           .select("doc_id", "text_key", "text", "spans")
           .mapInArrow(_cut, f"doc_id {kind}, text_key string, n_removed long, sha256 string, text string"))
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_removed",
                     F.col("sha256").alias("_sha"), "text")
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key"))
    return (rows.join(cut, same, "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("_sha", "sha256").alias("kept_sha256"), "text"))
