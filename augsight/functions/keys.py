"""Deterministic hash keys.

Sampling, shuffling and fold assignment order rows by
``md5('<seed>:<id>')`` with ``id`` as tie-break.  Unlike ``rand(seed)`` the
key does not depend on partitioning, so every run, every cluster size and
the SQL oracle agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """Hex md5 of ``'<seed>:<c1>:<c2>...'`` (nulls render as empty)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
                                 for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of a hex hash: a bucket whose order agrees with the key's order."""
    return F.substring(key, 1, hex_digits)
