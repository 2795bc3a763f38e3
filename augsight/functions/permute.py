"""A keyed permutation of the numbers 0 to n - 1 as a column expression, and back.

Swap-or-not shuffle (Hoang, Morris and Rogaway, 2012): a round pairs each
number x with ``K - x`` modulo n and swaps the two or not by a hash of the
larger one, so every round undoes itself and any n will do.  A number's place
is thus computed alone, without the other numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from augsight.functions.keys import hash_key

ROUNDS = 24


def _rounds(x: Column, n: int, key: Column, order: range) -> Column:
    def one(at: Column, r: Column) -> Column:
        shift = F.conv(F.substring(hash_key("k", key, r), 1, 15), 16, 10).cast("long") % n
        other = (shift + n - at) % n
        swap = F.substring(hash_key("b", key, r, F.greatest(at, other)), 1, 1) >= "8"
        return F.when(swap, other).otherwise(at)
    return F.aggregate(F.lit(list(order)), x.cast("long"), one)


def permuted(x: Column, n: int, key: Column) -> Column:
    """Place of the number ``x`` (0 to n - 1) in the order of ``key``."""
    return _rounds(x, n, key, range(ROUNDS))


def unpermuted(place: Column, n: int, key: Column) -> Column:
    """The number whose place is ``place``."""
    return _rounds(place, n, key, range(ROUNDS - 1, -1, -1))
