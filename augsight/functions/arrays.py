"""Array expressions: arg-max, label decoding, truncation, padding, ignore-index replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(v: str | Column) -> Column:
    """0-based index of the largest element; the first maximum wins."""
    a = _c(v)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def decode_model_label(label: str | Column) -> Column:
    """``LABEL_7`` -> 7 (null when the text is not of that shape)."""
    return F.split_part(_c(label), F.lit("_"), F.lit(2)).try_cast("int")


def truncate(a: str | Column, max_len: int) -> Column:
    """First ``max_len`` elements."""
    return F.slice(_c(a), 1, max_len)


def pad_to(a: str | Column, length: str | Column, pad) -> Column:
    """Right-pad ``a`` with ``pad`` up to ``length`` elements."""
    arr = _c(a)
    n = F.greatest(_c(length) - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(F.lit(pad), n.cast("int")))


def replace_ignore_index(a: str | Column, pad, ignore: int = -100) -> Column:
    """Replace the loss ignore index (-100) by the pad id."""
    return F.transform(_c(a), lambda x: F.when(x == F.lit(ignore), F.lit(pad)).otherwise(x))
