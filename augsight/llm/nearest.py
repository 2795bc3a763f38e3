"""Nearest vectors by an adaptive scan of dimensions in probed lists.

Every distinct vector lies in the list of its nearest centre, in chunks of
bounded size, turned by a random rotation and stored by blocks of columns.  A
query reads the lists with the nearest centres.  After each block of columns
its partial distance to a candidate, scaled to all columns, is tested against
the query's bound (the distance of its nearest found so far): on rotated
vectors the scaled distance is close to the true one, so a candidate that
lies beyond the bound by more than the test's margin is given up.  Those that
pass all blocks get their distance from the original vectors in double
precision.  A query's nearest list is scanned first and gives the bound for
its other lists, which other tasks scan.

Centres come from about ``SAMPLE`` distinct vectors, chosen by hash; the number
of lists that a query probes is the one that holds ``HELD`` of the nearest
neighbours of sample rows among the sample.  All vectors are indexed.

Equal vectors are one candidate with the smallest ids of its rows, so a vector
that a third of the table shares is compared once.  A list of any length is
split over tasks by its chunks, and the queries that read it by blocks.

Vectors that are null, empty, zero, or hold a null or a non-finite component
take no part, nor do rows with a null id.  Rows that repeat (same id, same
vector) count once; rows with one id and several vectors are candidates each
and query each, and never for one another.  Only vectors of a query's own length are its
candidates.  Ties go to the smaller id.  An empty table gives no rows.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsight.llm.common import small_batches, staged

#: Neighbours of a query; queries are the rows whose id this divides.
NEAREST, EVERY = 10, 100
#: Rows that the centres are learned from, about; lists at most, and sample rows for each.
SAMPLE, LISTS, ROWS_PER_LIST = 20_000, 1024, 16
#: Share of true neighbours that the probed lists are to hold, measured on so many sample rows.
HELD, TRIED = 0.98, 400
#: Columns of a block, and the margin of the test in standard errors.
BLOCK, MARGIN = 8, 2.1
#: Vectors of a chunk and queries of a block at most, and bytes of either.
CHUNK, QUERIES, BYTES = 1024, 64, 1 << 20
#: Columns that are rotated together.
TURNED = 1024

Model = dict[int, tuple[np.ndarray, int]]


def _vector(c: Column) -> Column:
    v = F.transform(c.cast("array<double>"), lambda x: x + F.lit(0.0))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good & F.exists(v, lambda x: x != 0), v)


@functools.lru_cache(maxsize=4)
def _rotation(dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A shuffle of the columns and orthogonal matrices for slabs of them, the same in every task."""
    rng = np.random.default_rng(dim)
    slabs = [np.linalg.qr(rng.standard_normal((n, n)))[0] for n in (min(TURNED, dim - lo) for lo in range(0, dim, TURNED))]
    return rng.permutation(dim), slabs


def rotated(m: np.ndarray) -> np.ndarray:
    shuffle, slabs = _rotation(m.shape[1])
    m, at, out = m[:, shuffle], 0, []
    for s in slabs:
        out.append(m[:, at:at + len(s)] @ s)
        at += len(s)
    return np.concatenate(out, 1)


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def centres(m: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spaced rows."""
    c = m[np.linspace(0, len(m) - 1, lists).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([_square_distances(m[lo:lo + 4096], c).argmin(1) for lo in range(0, len(m), 4096)])
        sums, n = np.zeros_like(c), np.bincount(own, minlength=lists)
        np.add.at(sums, own, m)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def probes(m: np.ndarray, c: np.ndarray) -> int:
    """Lists to probe: of the sample's rows' nearest neighbours in the sample, ``HELD`` lie in so many nearest lists."""
    tried = m[np.linspace(0, len(m) - 1, min(TRIED, len(m))).astype(int)]
    own = np.concatenate([_square_distances(m[lo:lo + 4096], c).argmin(1) for lo in range(0, len(m), 4096)])
    near = np.argsort(_square_distances(tried, m), 1)[:, 1:NEAREST + 1]
    order = np.argsort(_square_distances(tried, c), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], 1)
    held = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(held[min(len(held) - 1, int(np.ceil(HELD * len(held))))]) + 1 if len(held) else len(c)


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE) -> Model:
    """Centres and number of probes for each length of vectors in the sample; other lengths have one list."""
    few = vectors
    if n > sample:
        few = vectors.filter(F.shiftrightunsigned("k1", 1) < int(sample / n * (1 << 63)))
    by_dim: dict[int, list] = {}
    for r in few.select("vec").sort("k1", "k2").toLocalIterator():
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    model = {}
    for dim, rows in by_dim.items():
        m = np.array(rows, np.float64)
        lists = min(LISTS, max(1, round(n ** 0.5)), len(m) // ROWS_PER_LIST)
        if lists > 1:
            c = centres(m, lists)
            model[dim] = c, probes(m, c)
    return model


# --- rows of vectors ---------------------------------------------------------------------------

def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    size = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def _in_lists(model: Model):
    """Vectors with the list of their nearest centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _by_dim(batch.column("vec")):
                own = _square_distances(m, model[m.shape[1]][0]).argmin(1) if m.shape[1] in model else np.zeros(len(m), np.int64)
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(m), m.shape[1], np.int32)), "list": pa.array(own.astype(np.int32)),
                                                  **{c: batch.column(c).take(pa.array(at)) for c in ("k1", "ids", "vec")}})
    return run


def _to_probe(model: Model, first: bool):
    """A row for each query and list that it reads: its nearest list (``first``), or the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _by_dim(batch.column("vec")):
                dim = m.shape[1]
                if dim in model:
                    c, count = model[dim]
                    order = np.argsort(_square_distances(m, c), 1, kind="stable")[:, slice(1) if first else slice(1, count)]
                else:
                    order = np.zeros((len(m), 1 if first else 0), np.int64)
                for lo in range(0, len(m), 256):
                    part = order[lo:lo + 256]
                    rows = pa.array(np.repeat(at[lo:lo + 256], part.shape[1]))
                    yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(part.size, dim, np.int32)), "list": pa.array(part.ravel().astype(np.int32)),
                                                      **{c: batch.column(c).take(rows) for c in ("k1", "k2", "bound", "vec")}})
    return run


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    """Dimension, list, rows and matrix of consecutive rows of one list, at most ``most`` and ``BYTES``."""
    dim, own = batch.column("dim").to_numpy(), batch.column("list").to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (own[1:] != own[:-1])])) if len(dim) else []
    for lo, end in zip(new, [*new[1:], len(dim)]):
        size = max(1, min(most, BYTES // (12 * int(dim[lo]))))
        for at in range(lo, end, size):
            part = batch.slice(at, min(size, end - at))
            yield int(dim[lo]), int(own[lo]), part, part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a list: ids, rotated vectors by blocks of columns, original vectors."""
    for batch in batches:
        for dim, own, part, m in _runs(batch, CHUNK):
            ids, turned = part.column("ids"), rotated(m).astype(np.float32)
            blocks = b"".join(np.ascontiguousarray(turned[:, lo:lo + BLOCK]).tobytes() for lo in range(0, dim, BLOCK))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "list": pa.array([own], pa.int32()), "n": pa.array([len(part)], pa.int32()),
                "n_ids": pa.array([ids.value_lengths().to_numpy().astype(np.int32).tobytes()], pa.binary()),
                "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
                "blocks": pa.array([blocks], pa.binary()), "vecs": pa.array([m.tobytes()], pa.binary())})


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, own, part, m in _runs(batch, QUERIES):
            keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2")])
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "list": pa.array([own], pa.int32()), "m": pa.array([len(part)], pa.int32()),
                "keys": pa.array([keys.tobytes()], pa.binary()), "bounds": pa.array([part.column("bound").to_numpy().tobytes()], pa.binary()),
                "asked": pa.array([m.tobytes()], pa.binary())})


def scan(asked: np.ndarray, bounds: np.ndarray, blocks: list[np.ndarray], vecs: np.ndarray, least: np.ndarray,
         keep: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``keep`` nearest of a chunk within each query's bound: distances (infinite: none), places, and column values read.

    ``least`` breaks ties.  The bound shrinks as candidates are found.
    """
    dim, turned = asked.shape[1], rotated(asked)
    best, place = np.full((len(asked), keep), np.inf), np.full((len(asked), keep), -1, np.int64)
    bounds, read = bounds.copy(), 0
    for lo in range(0, len(vecs), step):
        partial, seen = _square_distances(turned[:, :BLOCK], blocks[0][lo:lo + step].astype(np.float64)), min(BLOCK, dim)
        read += partial.size * seen
        limit = lambda done: (bounds * (1 + MARGIN / done ** 0.5)) ** 2 * done / dim if done < dim else (bounds * (1 + 1e-4)) ** 2 + 1e-12
        q, c = np.nonzero(partial <= limit(seen)[:, None])
        partial = partial[q, c]
        for b in range(1, len(blocks)):
            if not len(q):
                break
            block = blocks[b]
            gap = block[lo + c].astype(np.float64) - turned[q, seen:seen + block.shape[1]]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            seen += block.shape[1]
            read += gap.size
            on = partial <= limit(seen)[q]
            q, c, partial = q[on], c[on], partial[on]
        if not len(q):
            continue
        exact = np.sqrt(((vecs[lo + c] - asked[q]) ** 2).sum(1))
        new = np.full((len(asked), min(step, len(vecs) - lo)), np.inf)
        new[q, c] = np.where(exact <= bounds[q], exact, np.inf)
        far = np.concatenate([best, new], 1)
        at = np.concatenate([place, np.broadcast_to(np.arange(lo, lo + new.shape[1]), new.shape)], 1)
        order = np.lexsort((least[at], far))[:, :keep]
        best, place = np.take_along_axis(far, order, 1), np.take_along_axis(at, order, 1)
        bounds = np.minimum(bounds, best[:, -1])
    return best, place, read


def _scan_rows(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, n, m = r["dim"], r["n"], r["m"]
                flat, blocks, at = np.frombuffer(r["blocks"], np.float32), [], 0
                for lo in range(0, dim, BLOCK):
                    width = min(BLOCK, dim - lo)
                    blocks.append(flat[at:at + n * width].reshape(n, width))
                    at += n * width
                n_ids, ids = np.frombuffer(r["n_ids"], np.int32), np.frombuffer(r["ids"], np.int64)
                starts = np.cumsum(n_ids) - n_ids
                keys = np.frombuffer(r["keys"], np.int64).reshape(2, m)
                best, place, _ = scan(np.frombuffer(r["asked"]).reshape(m, dim), np.frombuffer(r["bounds"]), blocks,
                                      np.frombuffer(r["vecs"]).reshape(n, dim), ids[starts], keep)
                q, k = np.nonzero(np.isfinite(best))
                if not len(q):
                    continue
                own = place[q, k]
                ends = np.concatenate([[0], np.cumsum(n_ids[own])]).astype(np.int32)
                items = ids[np.arange(ends[-1]) + np.repeat(starts[own] - ends[:-1], n_ids[own])]
                yield pa.RecordBatch.from_pydict({"k1": pa.array(keys[0][q]), "k2": pa.array(keys[1][q]), "score": pa.array(best[q, k]),
                                                  "least": pa.array(ids[starts][own]),
                                                  "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(items))})
    return run


# --- search ------------------------------------------------------------------------------------

def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors ``(k1, k2, vec, ids)`` with their ``keep`` smallest ids."""
    by = Window.partitionBy("k1", "k2").orderBy("id")
    few = rows.withColumn("_place", F.dense_rank().over(by)).filter(F.col("_place") <= keep)
    return few.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.any_value("vec").alias("vec"))


def search(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``nearest`` found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _vector(F.col(vec_col)).alias("vec")).filter("id is not null and vec is not null")
    rows = rows.select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))
    keep = nearest + 1  # a query's own vector may be among them
    distinct = staged(_distinct(rows, keep), "vectors")
    model = fit(distinct, distinct.count(), sample)
    index = (distinct.mapInArrow(_in_lists(model), "dim int, list int, k1 long, ids array<long>, vec array<double>")
             .repartitionByRange("dim", "list", "k1").sortWithinPartitions("dim", "list", "k1"))
    index = staged(index.mapInArrow(_chunks, "dim int, list int, n int, n_ids binary, ids binary, blocks binary, vecs binary"), "index")
    asking = staged(rows.filter(F.col("id") % every == 0).select("id", "k1", "k2").distinct(), "queries")
    asked = distinct.select("k1", "k2", "vec").join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    best = Window.partitionBy("k1", "k2").orderBy("score", "least")

    def scanned(queries: DataFrame, first: bool) -> DataFrame:
        """The nearest within the bounds of ``queries``, from their nearest lists or from the others."""
        probe = (queries.mapInArrow(_to_probe(model, first), "dim int, list int, k1 long, k2 long, bound double, vec array<double>")
                 .repartitionByRange("dim", "list", "k1").sortWithinPartitions("dim", "list", "k1"))
        blocks = staged(probe.mapInArrow(_query_blocks, "dim int, list int, m int, keys binary, bounds binary, asked binary"), "asked")
        found = blocks.join(index, ["dim", "list"]).mapInArrow(_scan_rows(keep), "k1 long, k2 long, score double, least long, ids array<long>")
        return found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= keep).drop("_place")

    near = staged(scanned(asked.withColumn("bound", F.lit(float("inf"))), True), "near")
    bound = near.groupBy("k1", "k2").agg(F.when(F.count(F.lit(1)) >= keep, F.max("score")).alias("bound"))
    bounded = asked.join(bound, ["k1", "k2"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    both = near.unionByName(scanned(bounded, False))
    both = both.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= keep)
    named = (asking.withColumnRenamed("id", "query_id").join(both, ["k1", "k2"])
             .select("query_id", "k1", "k2", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id"))
    order = Window.partitionBy("query_id", "k1", "k2").orderBy("score", "vec_id")
    return (named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
