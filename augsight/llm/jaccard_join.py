"""Operator 5, n-gram Jaccard join: a size-aware heavy-light join.

A document's set holds its distinct shingles of a number of words (operator
5: ``SHINGLE``).  Two sets with Jaccard similarity of at least ``j`` (operator
5: ``J``; both are parameters) share ``t = ceil(j * size)`` shingles of either
side, so under any global order of shingles their first ``size - t + c``
ones share at least ``c``.  Light sets (small) enumerate all pairs (``c =
2``) of their first ones as join keys, which are rare; heavy sets (large)
would have too many pairs and scan the inverted lists of their first single
shingles (``c = 1``).  Light sets near the boundary are in the lists too, so
no pair across it is missed.  The boundary is where the rows of an
enumeration cost more than a set's list entries and the entries that reading
those lists is expected to give, from measured list lengths.

The global order puts shingles that many documents share last, so a passage
found everywhere is no join key.  Its statistics are counted over all
documents in hash buckets of fixed number and only steer the cost.

Equal sets are one node (their copies never meet each other).  In short lists
all pairs are candidates.  A long list is first chained: each set with the
next one in size order; verified links give components, and only pairs of
still different components are enumerated afterwards.  So near copies that
form one component cost one check each, and no link between components is
missed.  Candidates must pass parity sketches (a lower bound of the number
of shingles in which two sets differ); those that do are verified on whole
sets.

Defined results: a null or empty text, or one without words, has an empty
set and is its own component; fewer words than a shingle are one; equal
doc_ids are one document's rows and repeated rows get one row each; a null
doc_id is a row, never a component's name unless alone; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsight.llm.common import bitmap, components, in_bitmap, packed, staged, text_key
from augsight.llm.words import FOLDED, mix, signed, slices, split_words

#: Operator 5: words of a shingle, and similarity in percent.
SHINGLE = 4
J = 85
#: Buckets of the shingle counts that order shingles; a table of 4 MB.
BUCKETS = 1 << 22
#: A bucket is frequent in a task from this count, and from this multiple of the mean count.
FREQUENT, FREQUENT_MEANS = 4, 8
#: What a shuffled row costs, in entries read from a list.
ROW_COST = 4
#: Lists up to this length are joined pair by pair at once.
SHORT_LIST = 24
#: Bits of the filter of sets to fetch: 8 MB for every task at any size of the corpus.
ID_BITS = 1 << 26
#: Bits of a set's parity sketch.
PARITIES = 4096
#: Entries of a frequent key that are chained in one piece, about.
PIECE_BITS = 12


class Lists(NamedTuple):
    """What the boundary follows from: the expected length of a shingle's list, and the similarity in percent."""

    length: float
    j: int


def least_size(j: int) -> int:
    """Sets below this size have no partner but equal sets: for 85 % 6, since 5 of 6 is less."""
    return -(-j // (100 - j))


def _sets(words, shingle: int, order: np.ndarray | None = None):
    """Sorted distinct shingles (58 bits) of each text: (values, first); with ``order``, frequent ones last."""
    at, h = words.grams(shingle)
    doc = words.doc[at]
    sizes = np.diff(words.first)
    if (few := np.flatnonzero((sizes > 0) & (sizes < shingle))).size:
        extra = []
        for d in few.tolist():
            i, n = int(words.first[d]), int(sizes[d])
            acc = np.array([n], np.uint64)
            for j in range(n):
                acc = mix(acc + words.hash[i + j])
            extra.append(acc[0])
        h, doc = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([doc, few])
        by = np.argsort(doc, kind="stable")
        h, doc = h[by], doc[by]
    h = h >> np.uint64(6)
    if order is not None:
        h |= order[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
    first = np.searchsorted(doc, np.arange(len(sizes) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(sizes) + 1))


def _set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each set, by its shingles without their order."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values & np.uint64((1 << 58) - 1)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]])


def _describe(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for the task with the frequent buckets and, of the others, the sums of counts
    and squares; equal sets of a task count once."""
    seen: set[int] = set()
    counts = np.zeros(BUCKETS, np.int32)
    frequent = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())]))
    names = ["doc_id", "text_key", "n_shingles", "set_id", "frequent", "shingles", "squares"]
    doc_type = None
    for part, data, bounds in slices(batches):
        values, first = _sets(split_words(data, bounds, FOLDED), shingle)
        ids = _set_ids(values, first)
        new = np.array([len(seen) < (seen.add(x) or len(seen)) for x in ids.tolist()], bool)
        np.add.at(counts, (values[np.repeat(new, np.diff(first))] & np.uint64(BUCKETS - 1)).astype(np.int32), 1)
        rows, doc_type = part.num_rows, part.column("doc_id").type
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(first), pa.int64()),
             pa.array(signed(ids), pa.int64()), pa.nulls(rows, frequent),
             pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.float64())], names)
    if doc_type is None:
        return
    most = np.flatnonzero(counts >= max(FREQUENT, FREQUENT_MEANS * counts.sum() / BUCKETS))
    listed = [{"bucket": b, "n": n} for b, n in zip(most.tolist(), counts[most].tolist())]
    counts[most] = 0
    total, squares = float(counts.sum()), float((counts.astype(np.float64) ** 2).sum())
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(1, doc_type), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
         pa.array([listed], frequent), pa.array([total]), pa.array([squares])], names)


def _first_ones(size: np.ndarray, j: int) -> np.ndarray:
    """How many first shingles hold one that any partner shares."""
    return size - (j * size + 99) // 100 + 1


def _keys(order: bytes, boundary: int, shingle: int, similarity: int):
    """(key, salt, set_id, size, pos): pairs of light sets' first shingles, and list entries of the others."""
    ranks = np.frombuffer(order, np.uint8)
    listed_from, least = (similarity * (boundary + 1) + 99) // 100, least_size(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, bounds in slices(batches):
            values, first = _sets(split_words(data, bounds, FOLDED), shingle, ranks)
            ids = _set_ids(values, first)
            size = np.diff(first)
            new = np.zeros(len(size), bool)
            for d in np.flatnonzero(size >= least).tolist():  # an equal set gives the same keys
                if (x := int(ids[d])) not in seen:
                    seen.add(x)
                    new[d] = True
            p = np.where(new, _first_ones(size, similarity), 0)
            # List entries.
            n = np.where(size >= listed_from, p, 0)
            doc = np.repeat(np.arange(len(size)), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            keys, docs, places = [values[first[doc] + pos]], [doc], [pos]
            # All pairs of one more first shingle of each light set, set sizes together.
            light = np.flatnonzero(new & (size <= boundary))
            for m in np.unique(p[light] + 1).tolist():
                own = light[p[light] + 1 == m]
                i, j = np.triu_indices(m, 1)
                a = values[(first[own][:, None] + i[None, :]).ravel()]
                b = values[(first[own][:, None] + j[None, :]).ravel()]
                pair = mix(mix(a + np.uint64(0x632BE59BD9B4E019)) + b) >> np.uint64(6)
                # A pair is at most as frequent as its rarer shingle.
                keys.append(pair | (np.minimum(a, b) >> np.uint64(58) << np.uint64(58)))
                docs.append(np.repeat(own, len(i)))
                places.append(np.tile(i, len(own)))
            key, doc, pos = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            pieces = np.uint64(1) << np.maximum((key >> np.uint64(58)).astype(np.int64) - PIECE_BITS, 0).astype(np.uint64)
            salt = (ids[doc] >> np.uint64(40)) & (pieces - np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key), pa.int64()), pa.array(salt.astype(np.int32), pa.int32()),
                 pa.array(signed(ids[doc]), pa.int64()), pa.array(size[doc], pa.int32()), pa.array(pos, pa.int32())],
                ["key", "salt", "set_id", "size", "pos"])
    return run


def _members(wanted: bytes, whole: bool, shingle: int, j: int):
    """(set_id, size, shingles or parities) of the sets that the filter lets pass, once in a task."""
    bits, least = np.frombuffer(wanted, np.uint8), least_size(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, bounds in slices(batches):
            values, first = _sets(split_words(data, bounds, FOLDED), shingle)
            ids = _set_ids(values, first)
            rows = []
            for d in np.flatnonzero(in_bitmap(bits, ids) & (np.diff(first) >= least)).tolist():
                if (x := int(ids[d])) not in seen:
                    seen.add(x)
                    rows.append(d)
            sets = [values[first[d]:first[d + 1]] for d in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(ids[rows]), pa.int64()), pa.array(np.diff(first)[rows], pa.int32()),
                 pa.array([v.view(np.int64) if whole else _parities(v) for v in sets], pa.list_(pa.int64()))],
                ["set_id", "size", "shingles" if whole else "parities"])
    return run


def _parities(values: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` hash buckets, one bit: whether an odd number of the shingles falls into it.

    Two sets that differ in n shingles differ in n bits at most.
    """
    odd = np.bincount((values & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fetch(docs: DataFrame, ids: DataFrame, whole: bool, shingle: int, j: int) -> DataFrame:
    """``(set_id, size, shingles)``, or its ``parities``, of the sets named in the only column of ``ids``."""
    column = "shingles" if whole else "parities"
    members = _members(bitmap(ids.toDF("id"), "id", ID_BITS), whole, shingle, j)
    return staged(docs.select("text").mapInArrow(members, f"set_id long, size int, {column} array<long>")
                  .dropDuplicates(["set_id", "size"]), column)


def _differ_little(j: int) -> str:
    """Similar sets differ in at most (for 85 %) 15 of 185 of their sizes' sum; sketches show at most what differs."""
    return ("aggregate(zip_with(u.parities, v.parities, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) "
            f"* {100 + j}L <= {100 - j}L * (u.size + v.size)")


def _close(pairs: DataFrame, sketches: DataFrame, j: int) -> DataFrame:
    """The pairs ``(a, asize, b, bsize)`` that their sketches do not rule out."""
    u, v = sketches.alias("u"), sketches.alias("v")
    return (pairs.join(u, F.expr("a = u.set_id and asize = u.size")).join(v, F.expr("b = v.set_id and bsize = v.size"))
            .filter(_differ_little(j)).select("a", "asize", "b", "bsize"))


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, j: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    sets = _fetch(docs, pairs.select("a").union(pairs.select("b")), True, shingle, j)
    a = sets.select(F.col("set_id").alias("a"), F.col("size").alias("asize"), F.col("shingles").alias("u"))
    b = sets.select(F.col("set_id").alias("b"), F.col("size").alias("bsize"), F.col("shingles").alias("v"))
    common = F.size(F.array_intersect("u", "v"))
    return (pairs.join(a, ["a", "asize"]).join(b, ["b", "bsize"]).withColumn("common", common)
            .filter(f"100L * common >= {j}L * (asize + bsize - common)").select("a", "asize", "b", "bsize"))


def _pairs(entries: DataFrame, condition: str, j: int) -> DataFrame:
    """Distinct pairs of sets in one list that sizes and places do not rule out."""
    u, v = entries.alias("u"), entries.alias("v")
    # At the first shared shingle, what lies behind it bounds the overlap.
    possible = (f"least(u.size - u.pos, v.size - v.pos) * {100 + j}L >= {j}L * (u.size + v.size) "
                "and u.set_id < v.set_id")
    return (u.join(v, F.expr(f"u.key = v.key and {possible} and {condition}"))
            .select(F.col("u.set_id").alias("a"), F.col("u.size").alias("asize"),
                    F.col("v.set_id").alias("b"), F.col("v.size").alias("bsize")).distinct())


def boundary_size(lists: Lists) -> int:
    """The largest size whose pairs of first shingles cost no more than its list entries and reading their lists."""
    size = least_size(lists.j) - 1
    while size < 10_000:
        p = int(_first_ones(np.array([size + 1]), lists.j)[0])
        if ROW_COST * p * (p + 1) / 2 > p * (ROW_COST + lists.length):
            break
        size += 1
    return size


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, j: int = J) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id)`` of every row of ``docs``; components by similarity >= ``j`` %
    of sets of ``shingle``-word shingles."""
    if shingle < 1 or not 1 <= j < 100:
        raise ValueError(f"shingle={shingle}, j={j}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    described = staged(texts.mapInArrow(partial(_describe, shingle=shingle), f"doc_id {kind}, text_key string, n_shingles long, set_id long, "
                       "frequent array<struct<bucket:int,n:long>>, shingles double, squares double"), "described")
    tasks = described.filter("shingles is not null")
    counts = tasks.select(F.explode("frequent").alias("f")).groupBy("f.bucket").agg(F.sum("f.n").alias("n")).toArrow()
    order = np.zeros(BUCKETS, np.uint8)  # BUCKETS rows of 12 bytes at most reach the driver
    order[counts.column("bucket").to_numpy()] = np.log2(counts.column("n").to_numpy()).astype(np.uint8)
    # Entries of other sets that a shingle's list is expected to have: what squares hold beyond chance and itself.
    chance = F.col("squares") - F.col("shingles") * F.col("shingles") / BUCKETS - F.col("shingles")
    r = tasks.agg(F.sum(chance).alias("extra"), F.sum("shingles").alias("n"), F.count(F.lit(1)).alias("tasks")).first()
    boundary = boundary_size(Lists(max(0.0, r["extra"] / r["n"] * r["tasks"]) if r["n"] else 0.0, j))

    keys = docs.select("text").mapInArrow(_keys(order.tobytes(), boundary, shingle, j), "key long, salt int, set_id long, size int, pos int")
    piece = Window.partitionBy("key", "salt")
    chain = piece.orderBy("size", "set_id", "pos")
    lists = (keys.withColumn("lo", F.min("set_id").over(piece)).withColumn("hi", F.max("set_id").over(piece))
             .withColumn("n", F.count(F.lit(1)).over(piece))
             .withColumn("before", F.lag(F.struct("set_id", "size")).over(chain))
             .filter(f"lo <> hi or shiftrightunsigned(key, 58) > {PIECE_BITS}")
             .filter("before is null or before.set_id <> set_id or before.size <> size"))
    lists = staged(lists.withColumn("long", F.expr(f"n > {SHORT_LIST} or shiftrightunsigned(key, 58) > {PIECE_BITS}"))
                   .drop("lo", "hi", "n"), "lists")
    short, long = lists.filter("not long"), lists.filter("long")
    heads = Window.partitionBy("key").orderBy("size", "set_id")
    links = long.filter("before is not null").select("set_id", "size", "before")
    links = links.union(long.filter("before is null").withColumn("before", F.lag(F.struct("set_id", "size")).over(heads))
                        .filter("before is not null").select("set_id", "size", "before"))
    chained = (links.filter(f"100L * least(size, before.size) >= {j}L * greatest(size, before.size) and before.set_id <> set_id")
               .select(F.least("set_id", "before.set_id").alias("a"),
                       F.when(F.col("set_id") < F.col("before.set_id"), F.col("size")).otherwise(F.col("before.size")).alias("asize"),
                       F.greatest("set_id", "before.set_id").alias("b"),
                       F.when(F.col("set_id") < F.col("before.set_id"), F.col("before.size")).otherwise(F.col("size")).alias("bsize")))
    first_pairs = staged(_pairs(short, "true", j).union(chained).distinct(), "pairs")
    ends = first_pairs.select("a").union(first_pairs.select("b")).union(long.select("set_id"))
    sketches = _fetch(docs, ends, False, shingle, j)
    similar = staged(_verified(docs, staged(_close(first_pairs, sketches, j), "close"), shingle, j), "similar")

    # Long lists: pairs of sets that are not yet in one component.
    joined = components(similar)
    of = joined.withColumnRenamed("node", "set_id")
    entries = (long.select("key", "set_id", "size", "pos").join(of, "set_id", "left")
               .withColumn("component", F.coalesce("component", "set_id")))
    open_keys = entries.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    entries = staged(entries.join(open_keys.select("key"), "key", "left_semi"), "open")
    entries = entries.join(sketches, ["set_id", "size"])
    late = staged(_pairs(entries, f"u.component <> v.component and {_differ_little(j)}", j)
                  .join(first_pairs, ["a", "asize", "b", "bsize"], "left_anti"), "late_pairs")
    if not late.isEmpty():
        # Links between components, named by them, join components into larger ones.
        more = _verified(docs, late, shingle, j)
        for end in ("a", "b"):
            name = joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_name"))
            more = more.join(name, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
        larger = components(more.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")).distinct())
        larger = larger.select(F.col("node").alias("component"), F.col("component").alias("larger"))
        alone = larger.select(F.col("component").alias("node"), "component").join(joined, "node", "left_anti")
        joined = (joined.union(alone).join(larger, "component", "left")
                  .select("node", F.coalesce("larger", "component").alias("component")))

    rows = described.filter("shingles is null").select("doc_id", "text_key", "n_shingles", "set_id")
    smallest = rows.filter("n_shingles > 0").groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("least_id"))
    smallest = smallest.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
    names = smallest.groupBy(F.coalesce("component", "set_id").alias("component")).agg(F.min("least_id").alias("component_id"))
    named = (smallest.withColumn("component", F.coalesce("component", "set_id")).join(names, "component")
             .select("set_id", "n_shingles", "component_id"))
    return (rows.join(named, ["set_id", "n_shingles"], "left")
            .select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def group_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``."""
    return similar_groups(docs, SHINGLE, J).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, j: int = J) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: its smallest doc_id, once (null only if it has no other).

    Of several rows with that doc_id the one with the smallest text digest
    stays; rows that agree in both are one row.
    """
    groups = similar_groups(docs, shingle, j).withColumn("unnamed", F.when(F.col("component_id").isNull(), F.col("text_key")))
    groups = staged(groups, "groups")
    kept = (groups.groupBy("component_id", "unnamed")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed_id"), "doc_id", "text_key")).alias("k"))
            .select("k.doc_id", "k.text_key").distinct())
    kept = staged(kept, "kept")
    ids, rows = kept.alias("k"), packed(docs, doc_id=F.col("doc_id"), text_key=text_key(F.col("text"))).alias("d")

    def same(side: str) -> Column:
        return F.col(f"{side}.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"{side}.text_key") == F.col("k.text_key"))

    rows = rows.join(ids, same("d"), "left_semi")
    # Whole rows are sorted only if some kept row is there twice.
    twice = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").alias("t")
    if not twice.join(ids, same("t"), "left_semi").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "text_key"])
    return rows.select("row.*")
