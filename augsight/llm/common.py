"""Helpers shared by the operators: the shared folder, written intermediate tables, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsight.session import checkpoint_dir, small_batches


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``, which all executors share."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor never recomputes what is written)
    and lets several later plans read one result.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns of ``docs``) beside ``columns``, so that no name of a caller's column can clash."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in columns.items()])


def text_key(text: Column) -> Column:
    """Digest of a text; null texts share one that no text has."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def bounded_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The rows with the ``n`` smallest hashes of ``id_col`` (all rows of the ids on the edge).

    Only ids are sorted, each task keeping its ``n`` smallest; the chosen
    ids, at most ``n``, go to every task.
    """
    key = F.md5(F.col(id_col).cast("string").cast("binary"))
    ids = rows.select(F.col(id_col).alias("_id"), key.alias("_k")).distinct().orderBy("_k").limit(n).select("_id")
    return rows.join(F.broadcast(ids), rows[id_col] == F.col("_id"), "left_semi")


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column,
                  out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    ``bucket`` cuts the order of a group into many ranges: rows are summed
    inside one range, and only the table of range totals is summed along the
    group.  A group of any size is thus spread over as many tasks as it has
    ranges.
    """
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    keys = [within[c].eqNullSafe(offsets[c]) for c in [*groups, bucket]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    return (within.join(offsets, cond)
            .select(*[within[c] for c in df.columns], (F.col("_offset") + F.col("_within")).alias(out)))


#: Bits of a fixed-size filter: 2 MB for every task, whatever the number of members.
FILTER_BITS = 1 << 24
_PAGE_BITS = 1 << 15


def bitmap(members: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """Filter of the longs in ``column`` by their low bits; at most ``bits / 8`` bytes reach the driver.

    It never misses a member; with more members it only lets more others pass.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = batch.column("lows")
            flat, ends = lows.flatten().to_numpy(zero_copy_only=False), lows.value_lengths().to_numpy().cumsum()
            rows = []
            for own in np.split(flat, ends[:-1]):
                page = np.zeros(_PAGE_BITS, np.uint8)
                page[own] = 1
                rows.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(rows, pa.binary())], ["page", "bits"])

    slot = F.col(column).bitwiseAND(bits - 1)
    pages = (members.select((slot / _PAGE_BITS).cast("int").alias("page"), (slot % _PAGE_BITS).cast("int").alias("low"))
             .filter("page is not null").groupBy("page").agg(F.collect_set("low").alias("lows"))
             .mapInArrow(packed, "page int, bits binary").collect())
    out = bytearray(bits >> 3)
    for r in pages:
        out[r["page"] * (_PAGE_BITS >> 3):(r["page"] + 1) * (_PAGE_BITS >> 3)] = r["bits"]
    return bytes(out)


def in_bitmap(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which uint64 values the filter (its bytes as an array) lets pass."""
    slot = (values & np.uint64(table.size * 8 - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``: the smallest node it can reach.

    A round contracts the graph: each node moves to the neighbour with the
    smallest hash (or stays if its own is smaller), and on to where that one
    moved; links inside what has come together vanish.  Hash order keeps the
    chains short, so few rounds are needed and links get fewer in each.
    Rounds are written tables; only "is it empty" reaches the driver.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, labels = staged(ends.filter("a <> b").distinct(), "links"), None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        moves = staged(both.groupBy("a").agg(best.alias("best")).select("a", F.least("best", own)["n"].alias("to")), "moves")
        on = moves.select(F.col("a").alias("to"), F.col("to").alias("then"))
        moves = staged(moves.join(on, "to").select("a", F.col("then").alias("to")), "moves")
        x, y = moves.select("a", F.col("to").alias("x")), moves.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = staged(edges.join(x, "a").join(y, "b").filter("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = moves.select(F.col("a").alias("node"), F.col("to").alias("name"))
        else:
            moved = moves.select(F.col("a").alias("name"), "to")
            labels = staged(labels.join(moved, "name", "left").select("node", F.coalesce("to", "name").alias("name")), "names")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).filter("false")
    least = labels.groupBy("name").agg(F.min("node").alias("component"))
    return staged(labels.join(least, "name").select("node", "component"), "components")
