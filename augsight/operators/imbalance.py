"""Class-imbalance analysis: class counts, low-resource slices, news/wiki parts, coverage.

Counting is one partially-aggregated ``groupBy`` (map-side combine, so a
class holding a third of all rows costs one row per task).  Slicing joins
the resulting class list back with a size-checked broadcast, so the corpus
itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsight.operators.small import collect_small, small_table

LABEL = "event_type"


def class_counts(df: DataFrame, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n, n_classes, total): rows per class plus the class count and total."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if not by:  # scalar subqueries: one partial sum per task meets, not the table of classes
        return counts.select(label, "n", counts.agg(F.count(F.lit(1))).scalar().alias("n_classes"),
                             counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().cast("long").alias("total"))
    whole = Window.partitionBy(*by)
    return counts.select(*by, label, "n",
                         F.count(F.lit(1)).over(whole).alias("n_classes"),
                         F.sum("n").over(whole).cast("long").alias("total"))


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Classes largest first with their position (ties by label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), F.col(label))
    return counts.withColumn("position", F.row_number().over(order)).orderBy("position")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of distinct non-null values per column (missing column -> null)."""
    aggs = [(F.count_distinct(c) if c in df.columns else F.lit(None).cast("long")).alias(f"n_{c}")
            for c in columns]
    return df.agg(*aggs)


def _threshold(cutoff: int | float, total: str) -> F.Column:
    # int = absolute row count; float in (0, 1] = share of all rows (in the same part).
    if isinstance(cutoff, float):
        if not 0 <= cutoff <= 1:
            raise ValueError(f"a share must be between 0 and 1, got {cutoff}; give a number of rows as an int")
        return F.floor(F.lit(cutoff) * F.col(total))
    return F.lit(int(cutoff))


def low_resource_classes(df: DataFrame, cutoff: int | float, label: str = LABEL,
                         by: Sequence[str] = ()) -> DataFrame:
    """Classes whose row count is <= cutoff (inclusive), with their counts."""
    counts = class_counts(df, label, by)
    return (counts.where(F.col("n") <= _threshold(cutoff, "total"))
            .select(*by, label, "n"))


def low_resource_slice(df: DataFrame, cutoff: int | float | None, label: str = LABEL,
                       by: Sequence[str] = (), return_classes: bool = False,
                       none_means_all: bool = False):
    """Rows of low-resource classes.

    ``by`` counts inside groups (e.g. ``part``: split-before-extract).  With
    ``none_means_all`` a cutoff of 0/None keeps every row (augmentation
    scope); otherwise 0 keeps nothing (extraction job).
    """
    if none_means_all and not cutoff:
        classes = df.select(*by, label).distinct()
        return (classes, df) if return_classes else df
    classes = low_resource_classes(df, cutoff or 0, label, by)
    keys = [*by, label]
    rows = df.join(small_table(classes.select(*keys)), keys, "left_semi")
    return (classes, rows) if return_classes else rows


def news_wiki(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Tag each row with ``part``: 'news' when a date exists, else 'wiki'."""
    return df.withColumn("part", F.when(F.col(date_col).isNull(), F.lit("wiki")).otherwise(F.lit("news")))


def news_only(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.where(F.col(date_col).isNotNull())


def wiki_only(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.where(F.col(date_col).isNull())


def extract_before_splitting(df: DataFrame, cutoff: int | float, label: str = LABEL) -> DataFrame:
    """Low-resource over all rows, then tag the parts."""
    return news_wiki(low_resource_slice(df, cutoff, label))


def split_before_extracting(df: DataFrame, cutoff: int | float, label: str = LABEL) -> DataFrame:
    """Tag the parts, then low-resource counted inside each part."""
    return low_resource_slice(news_wiki(df), cutoff, label, by=["part"])


def label_coverage(df: DataFrame, split_col: str = "split", label: str = LABEL,
                   whole: DataFrame | None = None) -> DataFrame:
    """Per split: rows, distinct labels, and how many labels of the whole table it lacks.

    ``whole`` is the table before it was split, if there is one: its labels
    are counted without splitting again.  No job runs while the plan is made.
    """
    n_all = (df if whole is None else whole).agg(F.count_distinct(label)).scalar()
    return (df.groupBy(split_col)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_labels"))
            .withColumn("n_missing_labels", n_all - F.col("n_labels")))


def missing_labels(df: DataFrame, split_col: str = "split", label: str = LABEL) -> DataFrame:
    """(split, label) pairs absent from the data: per split, the labels it never contains.

    The label list is bounded by the number of classes and size-checked; the
    splits (which may be as many as there are batches) stay distributed: each
    split gathers the set of labels it holds (at most the number of classes),
    so no split x label grid is materialised.
    """
    labels = sorted(r[0] for r in collect_small(df.select(label).distinct()) if r[0] is not None)
    all_labels = F.array(*[F.lit(v) for v in labels]) if labels else F.array().cast("array<string>")
    return (df.groupBy(split_col).agg(F.collect_set(label).alias("_present"))
            .select(split_col, F.explode(F.array_except(all_labels, F.col("_present"))).alias(label)))
