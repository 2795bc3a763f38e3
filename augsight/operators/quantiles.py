"""Exact quantiles per group by distributed selection.

A quantile needs one or two order statistics of its group.  Each is searched
in an interval that holds it, at first all of the group's values: a round
counts the values of every interval in ``BINS`` bins, with each bin's smallest
and largest value, and goes on with the bin that holds the wanted rank, from
its smallest to its largest value.  When those are equal the order statistic
is found.  Only counts of bins are aggregated, so a group of any size and any
number of distinct values costs each task ``BINS`` numbers an interval.

Bins are of equal width, in the values or, where an interval spans a power of
two or more, in their logarithms: a factor that is left to search shrinks by
``BINS`` a round, whatever the distribution, and doubles have 64 bits, so about
eight rounds are enough for any values.  A round is one pass over the rows
that still lie in an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsight.operators.features import materialize
from augsight.operators.small import small_table

BINS, ROUNDS = 1024, 40
_LARGEST = 1.7976931348623157e308


def _log(v: Column) -> Column:
    """A function of doubles that never decreases: logarithm of the size, with the sign, above those of all doubles."""
    size = F.log(F.greatest(F.abs(v), F.lit(5e-324))) + 800.0
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Number of the bin of [lo, hi] that holds ``value``; never decreases with it."""
    v, low, high = (F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)) for x in (value, lo, hi))
    wide = (F.signum(low) * F.signum(high) <= 0) | (F.greatest(F.abs(low), F.abs(high)) / 2 > F.least(F.abs(low), F.abs(high)))
    place = F.when(wide, _log(v) - _log(low)).otherwise(v - low)
    width = F.when(wide, _log(high) - _log(low)).otherwise(high - low)
    at = F.least(F.floor(F.try_divide(place, width) * BINS).cast("int"), F.lit(BINS - 1))
    # Without a width (only the largest double and infinity are left) the ends are told apart.
    return F.coalesce(at, F.when(value >= hi, BINS - 1).otherwise(0))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def order_statistics(values: DataFrame, wanted: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups..., k, value)``: the ``k``-th smallest ``v`` (from 0) of each group.

    ``values`` has the groups' columns and a double ``v`` without nulls and
    NaNs; ``wanted`` has (groups..., k, lo, hi), with the group's smallest and
    largest value.
    """
    groups = list(groups)
    state = materialize(wanted.withColumn("below", F.lit(0).cast("long")), "augsight-ranks")
    for _ in range(ROUNDS):
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            return state.select(*groups, "k", F.col("lo").alias("value"))
        spans = small_table(open_.select(*[F.col(g).alias(f"_{g}") for g in groups], "lo", "hi").distinct())
        mine = F.lit(True)
        for g in groups:
            mine = mine & values[g].eqNullSafe(F.col(f"_{g}"))
        inside = values.join(spans, mine & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bins = (inside.select(*groups, "lo", "hi", "v", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
                .groupBy(*groups, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        before = Window.partitionBy(*groups, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = _same(open_, bins, [*groups, "lo", "hi"]) & (open_["k"] >= open_["below"] + bins["skip"]) & (open_["k"] < open_["below"] + bins["skip"] + bins["n"])
        found = open_.join(bins, hit).select(*[open_[g] for g in groups], open_["k"], bins["least"].alias("lo"), bins["most"].alias("hi"),
                                             (open_["below"] + bins["skip"]).alias("below"))
        state = materialize(state.where("lo = hi").unionByName(found), "augsight-ranks")
    raise RuntimeError(f"order statistics were not found in {ROUNDS} rounds")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles per group, columns ``q25`` for 0.25 and so on.

    Nulls and NaNs are no values; a group without values has null quantiles.
    """
    k = list(by)
    own = [f"_g{i}" for i in range(max(1, len(k)))]  # all rows are one group if none is named
    named = [F.col(c).alias(g) for c, g in zip(k, own)] or [F.lit(0).alias(own[0])]
    values = materialize(df.select(*named, F.col(value).cast("double").alias("v")), "augsight-values")
    usable = F.col("v").isNotNull() & ~F.isnan("v")
    ends = materialize(values.groupBy(*own).agg(F.count(F.when(usable, 1)).alias("n"), F.min(F.when(usable, F.col("v"))).alias("lo"),
                                                F.max(F.when(usable, F.col("v"))).alias("hi")), "augsight-ends")
    ranks = F.array(*[(F.col("n") - 1) * F.lit(float(p)) for p in probs])
    wanted = (ends.where("n > 0").select(*own, "lo", "hi", F.explode(ranks).alias("h"))
              .select(*own, "lo", "hi", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k")).distinct())
    found = order_statistics(values.where(usable), wanted, own)
    listed = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))
    both = ends.join(listed.select(*[F.col(g).alias(f"_{g}") for g in own], "at"), _renamed(own), "left")
    out = []
    for p in probs:
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.try_element_at("at", F.floor(h)), F.try_element_at("at", F.ceil(h))
        part = h - F.floor(h)
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(f"q{int(round(p * 100))}"))
    return both.select(*[F.col(g).alias(c) for c, g in zip(k, own)], *out)


def _renamed(own: Sequence[str]) -> Column:
    cond = F.lit(True)
    for g in own:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return cond
