"""Size-checked materialisation of tables that are small by construction.

Class tables, label dictionaries and (class, hash-bucket) offset tables are
derived from the data, so their size is *checked*, not assumed: the table is
collected only if it has at most ``max_rows`` rows and ``MAX_BYTES`` bytes, and then re-enters the
plan as a broadcast local relation (which also cuts its lineage, so a lost
executor never recomputes it).  Beyond the bound the distributed table is
returned unchanged and joins on it fall back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound for tables we are willing to hold on the driver and broadcast.
DEFAULT_MAX_ROWS = 250_000
MAX_BYTES = 16 << 20


def small_table(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Broadcastable copy of ``df`` if it has <= ``max_rows`` rows, else ``df``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows or sum(len(str(v)) for r in rows for v in r) > MAX_BYTES:
        return df
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame(rows, schema=df.schema))


def collect_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> list:
    """Rows of a table that must be small (e.g. per-class arithmetic); raises otherwise."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, table is larger")
    return rows
