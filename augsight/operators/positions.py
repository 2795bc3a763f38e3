"""Rows by position: the i-th row of one file set with the i-th row of another.

A generator that runs elsewhere gives its outputs in the order of its inputs,
without a key.  A row's position is the number of rows before it in the file
set, files taken by name: rows before its part of the files (from counts of
the parts, stored with the rows) and its place in the part.  How files are
packed into partitions therefore does not matter, only their names and rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsight.operators.features import materialize
from augsight.operators.ranks import GROUPS, RANGES, cut_bucket, key_cuts
from augsight.operators.small import small_table


def part_offsets(parts: DataFrame) -> DataFrame:
    """Add ``offset``, the rows in parts before this one in the order of (file, start); ``parts`` has (file, start, n).

    Prefix sums in two levels: over ranges of files, then inside a range.
    """
    ranged = parts.withColumn("_bucket", cut_bucket("file", key_cuts(parts, "file", parts.count())))
    ranged = ranged.withColumn("_group", F.shiftright("_bucket", (RANGES // GROUPS).bit_length() - 1))
    starts, total = [], 0
    for r in sorted(ranged.groupBy("_group").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["_group"]):  # at most GROUPS rows
        starts.append((r["_group"], total))
        total += r["n"]
    groups = F.broadcast(parts.sparkSession.createDataFrame(starts, "_group int, _start long"))
    before = Window.partitionBy("_group").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_in", F.coalesce(F.sum("n").over(before), F.lit(0))).join(groups, "_group")
            .select(*parts.columns, (F.col("_start") + F.col("_in")).alias("offset")))


def with_positions(rows: DataFrame, out: str = "position") -> DataFrame:
    """Add each row's position (from 0) to a table that is read straight from files.

    Filters and new columns on the way are fine as long as every row stays in
    the partition that read it; a filter makes positions count what it keeps.
    The rows are written once, with their part of the files and their number,
    and positions follow from that stored table.
    """
    named = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    stored = materialize(named, "augsight-positions")
    parts = materialize(stored.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max("number").alias("last")),
                        "augsight-parts")
    torn = parts.where("last - first + 1 <> n").count()
    if torn:
        raise ValueError(f"{torn} parts of files were not read in one piece; positions need rows straight from files")
    place = (F.col("offset") + F.col("number") - F.col("first")).cast("long").alias(out)
    return stored.join(small_table(part_offsets(parts)), ["file", "start"]).select("row.*", place)


def in_position_order(rows: DataFrame, position: str = "position", columns: Sequence[str] = ()) -> DataFrame:
    """``rows`` dealt and sorted so that files written from them hold the rows in order of position, files by name."""
    return rows.repartitionByRange(position).sortWithinPartitions(position).select(*(columns or [c for c in rows.columns if c != position]))


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both, the i-th row of ``left`` with the i-th of ``right``; both straight from files.

    Raises if the numbers of rows differ.  ``left`` keeps its ``position``.
    """
    a, b = with_positions(left), with_positions(right, "_position")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be joined with {m} by position")
    return a.join(b, a["position"] == b["_position"]).drop("_position")
