"""Scalable row numbering and first rows.

``row_number() over (order by ...)`` without a partition moves the whole
table into one task.  Here a rank is ``rows in earlier buckets +
row_number() within the bucket``, with a bucket that is monotone in the sort
key: leading hex digits of a hash key, or ranges of about equally many rows,
cut at values from a sample of the keys (:func:`key_cuts`), so keys that crowd
together, or one that lies far out, leave the ranges as large as any.  Rows
are counted per range exactly; the sample decides about balance only.
Windows over rows run per bucket.  Rows in earlier buckets are prefix sums in
two levels, the same at every size: inside a group of buckets by a window
per group (or per partition of the rank), and across groups from at most
:data:`GROUPS` sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that keys are cut into at most, rows that a range is to have at least, and keys sampled for each range.
RANGES, RANGE_ROWS, SAMPLED = 1 << 12, 1 << 11, 16
#: Groups of buckets at most; their sums are what the driver sees.
GROUPS = 1 << 10


def key_cuts(df: DataFrame, key: str, rows: int) -> tuple:
    """Values that cut the ``rows`` keys of ``df`` into ranges of about equally many rows (none for a small table).

    The sample is the keys with a small hash, about ``SAMPLED`` for each
    range, so at most about 65 000 keys reach the driver.
    """
    ranges = min(RANGES, rows // RANGE_ROWS)
    if ranges < 2:
        return ()
    part = int(min(1.0, ranges * SAMPLED / rows) * (1 << 62))
    few = df.select(F.col(key).alias("k")).where((F.shiftrightunsigned(F.xxhash64("k"), 2) < part) & F.col("k").isNotNull()).distinct()
    keys = sorted(r["k"] for r in few.collect())
    return tuple(dict.fromkeys(keys[i * len(keys) // ranges] for i in range(1, ranges))) if keys else ()


def cut_bucket(key: str, cuts: Sequence) -> Column:
    """Number of the cuts that are not above the key, by halving; a null key is below all."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = F.lit(list(cuts))
    below = lambda at, step: F.coalesce(F.get(table, at + step - 1) <= F.col(key), F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))


@dataclass(frozen=True)
class IdRange:
    """Smallest and largest id, number of rows and of different ids, and the cuts of the ids' ranges."""

    lo: int
    hi: int
    rows: int
    distinct: int
    cuts: tuple = ()

    def dense(self) -> bool:
        """Whether the ids are 0 to N - 1."""
        return self.lo == 0 and self.hi == self.rows - 1 and self.distinct == self.rows

    def bucket(self, id_col: str) -> Column:
        """Number of the range that holds an id."""
        return cut_bucket(id_col, self.cuts)


def id_range(df: DataFrame, id_col: str = "id") -> IdRange | None:
    """From an aggregate over the id column alone, and a sample of it unless the ids are dense; None for an empty table.

    A null id is an error.
    """
    lo, hi, rows, with_id, distinct = df.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1)), F.count(id_col),
                                             F.count_distinct(id_col)).first()
    if rows != with_id:
        raise ValueError(f"{rows - with_id} rows have no {id_col}; ranks need one")
    if not rows:
        return None
    ids = IdRange(int(lo), int(hi), int(rows), int(distinct))
    ranges = min(RANGES, ids.rows // RANGE_ROWS)
    cuts = tuple(i * ids.rows // ranges for i in range(1, ranges)) if ids.dense() and ranges > 1 else key_cuts(df, id_col, ids.rows)
    return IdRange(ids.lo, ids.hi, ids.rows, ids.distinct, cuts)


def bucketed_rank(df: DataFrame, bucket: Column, order: Sequence[Column], partition: Sequence[str] = (),
                  out: str = "rank", group: Column | None = None, return_total: bool = False):
    """Add a 0-based rank over ``order`` (within ``partition``) to ``df``.

    ``bucket`` must not decrease along ``order``; ``group`` is a function of
    the column ``_bucket`` that does not decrease either and has at most
    :data:`GROUPS` values (default: two leading hex digits).  It is needed
    without a ``partition`` only.  ``return_total`` also returns the number
    of rows (without a ``partition``).
    """
    part = list(partition)
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    total = None
    if part:
        before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        counts = counts.withColumn("_group", F.substring("_bucket", 1, 2) if group is None else group)
        sums = counts.groupBy("_group").agg(F.sum("_n").alias("_n")).collect()
        starts, total = [], 0
        for r in sorted(sums, key=lambda r: r["_group"]):
            starts.append((r["_group"], total))
            total += r["_n"]
        kind = counts.schema["_group"].dataType.simpleString()
        groups = F.broadcast(df.sparkSession.createDataFrame(starts, f"_group {kind}, _start long"))
        before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(groups, "_group")
                   .withColumn("_off", F.col("_start") + F.col("_in")))
    in_bucket = Window.partitionBy(*part, "_bucket").orderBy(*order)
    ranked = (b.withColumn("_r", F.row_number().over(in_bucket) - 1)
              .join(offsets.select(*part, "_bucket", "_off"), [*part, "_bucket"])
              .withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
              .drop("_bucket", "_r", "_off"))
    return (ranked, total) if return_total else ranked


def id_rank(df: DataFrame, ids: IdRange | None, id_col: str = "id", out: str = "rank", before: Column | None = None) -> DataFrame:
    """Rank by id; with ``before`` (a 0/1 column) its 0 rows come first.  ``ids`` must cover the table's ids."""
    if ids is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    bucket, order = ids.bucket(id_col), [F.col(id_col)]
    if before is not None:
        bucket, order = bucket + before * RANGES, [before, *order]
    return bucketed_rank(df, bucket, order, out=out, group=_group())


def _group() -> Column:
    """At most ``GROUPS`` groups of the buckets of one or two rounds of ranges."""
    return F.shiftright("_bucket", (2 * RANGES // GROUPS).bit_length() - 1)


def dense_reindex(df: DataFrame, order: Sequence[str], out: str = "new_id") -> DataFrame:
    """Dense 0..N-1 ids following ``order`` (first column an integer id, the rest tie-breaks)."""
    ids = id_range(df, order[0])
    if ids is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    return bucketed_rank(df, ids.bucket(order[0]), [F.col(c) for c in order], out=out, group=_group())


def dense_ids(df: DataFrame, id_col: str = "id", out: str = "new_id") -> tuple[DataFrame, IdRange | None]:
    """0..N-1 ids in ``id_col`` order, and the range of the old ids.

    If the ids already are 0..N-1 they are reused as they are and the rows
    are never shuffled.
    """
    ids = id_range(df, id_col)
    if ids is None or ids.dense():
        return df.withColumn(out, F.col(id_col).cast("long")), ids
    return id_rank(df, ids, id_col, out), ids


def first_rows(df: DataFrame, n: int, key: str, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by ``key`` (nulls first), then by ``order``; all rows if there are fewer.

    Rows are counted by ranges of the key; the ranges before the one that
    holds the n-th row are kept whole, and only that range is sorted.  A range
    whose rows are many because one key is frequent is sorted by ``order`` in
    its one task, which spills.
    """
    rows = df.count()
    if rows <= n or n <= 0:
        return df if n > 0 else df.limit(0)
    ranged = df.withColumn("_bucket", cut_bucket(key, key_cuts(df, key, rows)))
    before = 0
    for r in sorted(ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_bucket"]):  # at most RANGES rows
        if before + r["n"] >= n:
            break
        before += r["n"]
    if before + r["n"] == n:
        return ranged.where(F.col("_bucket") <= r["_bucket"]).drop("_bucket")
    last = ranged.where(F.col("_bucket") == r["_bucket"])
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *order))
    kept = last.withColumn("_place", place).where(F.col("_place") <= n - before).drop("_place")
    return ranged.where(F.col("_bucket") < r["_bucket"]).unionByName(kept).drop("_bucket")
