"""Operator 1, sharding: longest-processing-time scheduling of groups that stay together.

A group is all rows of one text (all null texts are one group).  Group sizes
come from a pre-aggregated sum, so a group that holds a third of all rows
costs one row per task.  Scheduling needs one sorted list, which must not
grow with the corpus; so groups above ``total / units`` (there are at most
``units`` of them) are scheduled one by one, and all smaller groups are first
bundled by hash into ``units`` bundles.  The heap on the driver therefore
gets at most ``2 * units`` sizes at any scale, and the sizes of two shards
differ by about one bundle, a ``units``-th of the corpus, unless one group
alone is larger than a shard's share.

Defined results: a null text has size 1 and a null checksum; empty texts are
a group of their own; repeated rows are rows; equal sizes go in key order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsight.llm.common import running_total, staged, text_key

#: Scheduling units a shard has: large groups that go singly, and as many bundles of small ones.
UNITS_PER_SHARD = 1024
#: Rows that one window of slot numbers holds on average.
SLOT_ROWS = 50_000


def schedule(sizes: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """Largest first, each to the least loaded shard (the lowest number among equals)."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        placed[name] = s
    return placed


def lpt_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    spark, units = docs.sparkSession, n_shards * UNITS_PER_SHARD
    text = F.col(text_col)
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(text).alias("key")), "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    total, n_rows = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(units)).cast("string"))
    unit = F.when(F.col("size") * units >= total, F.col("key")).otherwise(bundle)
    sizes = groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).collect()  # 2 * units at most
    placed = schedule([(r["size"], r["unit"]) for r in sizes], n_shards)
    plan = F.broadcast(spark.createDataFrame(list(placed.items()), "unit string, shard int"))
    single = F.broadcast(plan.select(F.col("unit").alias("key"), F.col("shard").alias("own")))
    placed_rows = (rows.join(single, "key", "left")
                   .withColumn("unit", bundle).join(plan, "unit", "left")
                   .withColumn("shard", F.coalesce("own", "shard"))
                   .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"),
                                                F.lit(1 + n_rows // (n_shards * SLOT_ROWS)))))
    order = [F.col("doc_id"), F.col("key")]
    ranked = running_total(placed_rows.select("doc_id", "key", "size", "text_crc32", "shard", "bucket"),
                           ["shard"], "bucket", order, F.lit(1), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
