"""Phrase collocation mining by dynamic itemset counting.

Documents are dealt into shards, which are scanned in a cycle.  Words are
counted from the first scan on.  A phrase starts to be counted at the scan
after the one in which both of its subphrases (without its last and without
its first word) had been seen ``least`` times, so lengths are counted side by
side, and it stops when it has seen every shard once.  The scan in which a
phrase starts (its generation) follows from its subphrases alone, so every
task knows it without a table of phrases: of each subphrase only the scan in
which it came to ``least`` is kept, in an array of a fixed number of slots
that goes to every task.  Two names that share a slot can only start a phrase
early; it still sees every shard once, so its count is whole.

Counts are kept by 64-bit names, as sorted tables of ranges of names: a scan
sends a task's counts on as one row for each range, and rows of one range are
merged, a range being sized so that a task holds it.  At the end the phrases with ``least`` or
more are spelled out and counted by their spelling in one more scan, so two
phrases with one name cannot add up.

Null texts are empty, a null language is ``und``.  Repeated rows count each
time; empty texts and texts of separators have no words; a text of any length
is worked on whole, but apart from others when longer than a slice.  An
empty table gives no rows.  Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsight.llm import grams
from augsight.llm.common import bitmap, in_bitmap, scratch, staged
from augsight.llm.words import FOLDED, slices

#: Occurrences of a phrase, and words of the longest one (the scans know lengths 1 to 3).
LEAST, LONGEST = 10, 3
#: Rows of the report for a language.
TOP = 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
SHARE = 50
#: Shards of the cycle.
SHARDS = 3
#: Slots of the two arrays of scans, one byte each: a power of two near a 64th of the bytes of all texts, within these.
SLOTS = (1 << 20, 1 << 26)
#: A range of names stands for 2 to this many bytes of text (up to 2^24 ranges).
BUCKET_BYTES = 21
_NEVER = 255

_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_SPLIT
_WORD[[9, 32]] = False
KIND = (_WORD, FOLDED[1])


class _Slice:
    """Names of the words and phrases of one slice: ``names[n - 1][i]`` begins at word i if ``whole[n - 1][i]``."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, salts: dict[str, int]):
        langs = part.column("lang").to_pylist()
        own = np.array([salts[x] if x in salts else salts.setdefault(x, grams.salt(x)) for x in langs], np.uint64)
        self.words = grams.named_words(data, bounds, KIND, own)
        piece = np.cumsum(_SPLIT[data])[self.words.start] + self.words.doc if len(self.words.start) else self.words.doc
        h, m = self.words.hash, len(self.words.hash)
        near = piece[1:] == piece[:-1]
        pairs = grams.next_name(h[:-1], h[1:]) if m > 1 else h[:0]
        triples = grams.next_name(pairs[:-1], h[2:]) if m > 2 else h[:0]
        self.names = [h, pairs, triples]
        self.whole = [np.ones(m, bool), near[:m - 1 if m else 0], (near[1:] & near[:-1]) if m > 2 else np.empty(0, bool)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, without the planes that are zero; the first byte counts the planes."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def _tables(n: int, g: int, bits: int, names: np.ndarray, counts: np.ndarray, reached: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each range of names: the gaps between the sorted names, their counts, the scan in which each came to the threshold."""
    if not len(names):
        return
    bucket = (names >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(names))
    yield pa.RecordBatch.from_pydict({
        "n": pa.array(np.full(len(cuts), n, np.int8)), "g": pa.array(np.full(len(cuts), g, np.int16)), "bucket": pa.array(bucket[cuts].astype(np.int32)),
        "names": pa.array([names[lo].tobytes() + _packed(np.diff(names[lo:hi], prepend=names[lo])) for lo, hi in zip(cuts, ends)], pa.binary()),
        "counts": pa.array([_packed(counts[lo:hi]) for lo, hi in zip(cuts, ends)], pa.binary()),
        "reached": pa.array([None if reached is None else reached[lo:hi].tobytes() for lo, hi in zip(cuts, ends)], pa.binary())})


_TABLES = "n byte, g short, bucket int, names binary, counts binary, reached binary"


def _table(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.cumsum(_unpacked(row["names"][8:]), dtype=np.uint64) + np.frombuffer(row["names"], np.uint64, 1)
    reached = np.full(len(names), _NEVER, np.uint8) if row["reached"] is None else np.frombuffer(row["reached"], np.uint8)
    return names, _unpacked(row["counts"]).astype(np.int64), reached


def _scan(step: int, shards: int, bits: int, seen: list[np.ndarray]):
    """Counts of one scan: words in the first cycle, and the phrases whose generation is counted in this step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts: dict[str, int] = {}
        sums: dict[tuple[int, int], grams.Sums] = {}
        for part, data, bounds in slices(batches):
            s = _Slice(part, data, bounds, salts)
            if step < shards:
                sums.setdefault((1, 0), grams.Sums()).add(s.names[0])
            for n in (2, 3):
                if len(s.names[n - 1]) == 0:
                    continue
                below = seen[n - 2][(s.names[n - 2] & np.uint64(len(seen[n - 2]) - 1)).astype(np.int64)].astype(np.int16)
                start = np.maximum(below[:-1], below[1:]) + 1
                on = s.whole[n - 1] & (start <= step) & (step < start + shards)
                for g in np.unique(start[on]).tolist():
                    sums.setdefault((n, g), grams.Sums()).add(s.names[n - 1][on & (start == g)])
            for (n, g), x in sums.items():
                if x.ready():
                    yield from _tables(n, g, bits, *x.rest())
        for (n, g), x in sums.items():
            yield from _tables(n, g, bits, *x.rest())
    return run


def _merge(step: int, least: int, bits: int):
    """One row for each length, generation and range of names, from rows sorted by them."""
    def merged(key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        names, counts, reached = (np.concatenate(x) for x in zip(*map(_table, rows)))
        order = np.argsort(names)
        names = names[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        counts, reached = np.add.reduceat(counts[order], first), np.minimum.reduceat(reached[order], first)
        reached[(reached == _NEVER) & (counts >= least)] = step
        yield from _tables(key[0], key[1], bits, names[first], counts, reached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = row["n"], row["g"], row["bucket"]
                if own != key:
                    if rows:
                        yield from merged(key, rows)
                    key, rows = own, []
                rows.append(row)
        if rows:
            yield from merged(key, rows)
    return run


def _names(wanted):
    """Names of the tables for which ``wanted(counts, reached)`` holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, counts, reached = _table(row)
                names = names[wanted(counts, reached)]
                yield from grams.rows({"n": np.full(len(names), row["n"], np.int8), "key": names})
    return run


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def _came(step: int):
    return lambda counts, reached: reached == step


def _enough(least: int):
    return lambda counts, reached: counts >= least


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """Text and language of every document, written once by shard; rows are dealt in turn."""
    path = scratch(docs.sparkSession, "dealt")
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    (rows.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
     .write.partitionBy("shard").parquet(path))
    return docs.sparkSession.read.schema("text string, lang string, shard int").parquet(path)


def frequent(parts: DataFrame, least: int, shards: int) -> DataFrame:
    """Names ``(n, key)`` of the phrases of ``n`` = 1 to 3 words that occur ``least`` times or more in ``parts``.

    Two phrases that share a name count as one here.
    """
    size = _bytes(parts)
    slots = min(max(SLOTS[0], 1 << max(0, (size >> 6) - 1).bit_length()), SLOTS[1])
    bits = min(max(4, size.bit_length() - BUCKET_BYTES), 24)
    seen = [np.full(slots, _NEVER, np.uint8) for _ in range(2)]
    state, found, step, latest, old = None, [], 0, 0, None
    while step < shards or step < latest + shards + 1:
        rows = (parts.filter(F.col("shard") == step % shards).select("text", "lang")
                .mapInArrow(_scan(step, shards, bits, seen), _TABLES))
        if state is not None:
            rows = rows.unionByName(state.filter(F.col("g") > step - shards))
        rows = rows.repartition("n", "g", "bucket").sortWithinPartitions("n", "g", "bucket")
        path = scratch(parts.sparkSession, "counts")
        rows.mapInArrow(_merge(step, least, bits), _TABLES).write.parquet(path)
        state = parts.sparkSession.read.schema(_TABLES).parquet(path)
        for n in (1, 2):
            new = state.filter(F.col("n") == n).mapInArrow(_names(_came(step)), "n byte, key long")
            new = np.unpackbits(np.frombuffer(bitmap(new, "key", slots), np.uint8), bitorder="little").view(bool)
            if new.any():
                latest = step
                seen[n - 1][new & (seen[n - 1] == _NEVER)] = step
        done = state.filter(F.col("g") == step - shards + 1)
        found.append(staged(done.mapInArrow(_names(_enough(least)), "n byte, key long"), "names"))
        if old:  # its rows are in the table that was just written
            _delete(parts.sparkSession, old)
        old = path
        step += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a table of this operator that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _larger(parts: DataFrame) -> DataFrame:
    """The same rows in a quarter of the partitions, but at least one for each core: a task sums more before it sends."""
    return parts.coalesce(max(parts.sparkSession.sparkContext.defaultParallelism, parts.rdd.getNumPartitions() // 4))


def _spell(filters: list[np.ndarray]):
    """Spelling and count of the phrases whose names a filter lets pass, and the number of words of each language (n = 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts: dict[str, int] = {}
        langs, sums = grams.Codes(), [grams.SpelledSums() for _ in filters]
        totals: dict[int, int] = {}

        def sent(n: int) -> Iterator[pa.RecordBatch]:
            names, counts, lang, spelled = sums[n - 1].rest()
            yield from grams.rows({"n": np.full(len(names), n, np.int8), "key": names, "lang": pa.array(langs.values(), pa.string()).take(pa.array(lang)),
                                   "phrase": spelled, "c": counts})

        for part, data, bounds in slices(batches):
            s = _Slice(part, data, bounds, salts)
            lang = langs(part.column("lang").to_pylist())
            for code, count in zip(*np.unique(lang[s.words.doc], return_counts=True)):
                totals[int(code)] = totals.get(int(code), 0) + int(count)
            spelled = grams.Spelled(s.words, KIND[1])
            for n, table in enumerate(filters, 1):
                names = s.names[n - 1]
                at = np.flatnonzero(s.whole[n - 1] & in_bitmap(table, names)) if len(names) else np.empty(0, np.int64)
                own, place, counts = grams.unique_counts(names[at])
                first = at[place]
                sums[n - 1].add(own, counts, lang[s.words.doc[first]], lambda new, first=first, n=n: spelled.phrases(first[new], n))
                if sums[n - 1].ready():
                    yield from sent(n)
        for n in range(1, len(filters) + 1):
            yield from sent(n)
        codes = list(totals)
        yield from grams.rows({"n": np.zeros(len(codes), np.int8), "key": np.zeros(len(codes), np.int64), "lang": pa.array([langs.values()[c] for c in codes], pa.string()),
                               "phrase": pa.array([""] * len(codes), pa.string()), "c": np.array([totals[c] for c in codes], np.int64)})
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """``(n, lang, phrase, f)`` of all phrases of 1 to 3 words with ``least`` occurrences; n = 0: all words of a language."""
    parts = dealt(docs, shards)
    names = frequent(parts, least, shards)
    filters = []
    for n in range(1, LONGEST + 1):
        own = names.filter(F.col("n") == n)
        bits = min(1 << 27, 1 << max(20, (256 * own.count()).bit_length()))
        filters.append(np.frombuffer(bitmap(own, "key", bits), np.uint8))
    wanted = names.unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("byte").alias("n"), F.lit(0).cast("long").alias("key")))
    spelled = _larger(parts.select("text", "lang")).mapInArrow(_spell(filters), "n byte, key long, lang string, phrase string, c long")
    counted = (spelled.join(wanted, ["n", "key"], "left_semi").groupBy("n", "key", "lang", "phrase").agg(F.sum("c").alias("f"))
               .filter((F.col("f") >= least) | (F.col("n") == 0)))
    return staged(counted.select("n", "lang", "phrase", "f"), "phrases")


def _cuts(phrases: DataFrame) -> DataFrame:
    """Each phrase of 2 or 3 words with its cuts: ``k`` words before, the ``first`` part, the ``rest``."""
    def cut(k, first, rest):
        return F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", first).alias("first"), F.substring_index("phrase", " ", rest).alias("rest"))
    cuts = F.when(F.col("n") == 2, F.array(cut(1, 1, -1))).otherwise(F.array(cut(1, 1, -2), cut(2, 2, -1)))
    return (phrases.filter("n > 1").select("n", "lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("cut"))
            .select("n", "lang", "phrase", "a", "cut.*"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    Products are decimals of 38 digits, so a count may pass 64 bits when squared.
    """
    counts = phrase_counts(docs, least, shards)
    count_of = lambda part, f: counts.filter("n > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = _cuts(counts).join(count_of("first", "l"), ["lang", "first"]).join(count_of("rest", "r"), ["lang", "rest"])
    d = lambda c: f"cast({c} as decimal(20, 0))"
    score = F.expr(f"(1000000 * ({d('a')} * {d('a')})) div ({d('l')} * {d('r')})")
    scored = (cuts.withColumn("score", score.cast("long"))
              .groupBy("n", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    longer = (counts.filter("n = 3").select("lang", inner.alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longest")))
    kept = (scored.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longest").isNull() | (F.col("n") == 3) | (F.col("longest").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * share)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("n = 0").select("lang", F.col("f").alias("words"))
    return (first.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
                    F.col("words").alias("n"), F.col("best.score").alias("score")))
