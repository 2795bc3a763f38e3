"""Deterministic splits and k-fold assignment.

Order = ``md5('<seed>:<id>')`` then ``id``.  Ranks come from
:func:`augsight.operators.ranks.bucketed_rank` with the leading hex digits of
the hash as bucket, so even a class holding a third of the rows is ranked by
many tasks in parallel.  Only per-class arithmetic (targets, offsets) runs
on the small class table.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsight.functions.keys import hash_bucket, hash_key
from augsight.operators.ranks import bucketed_rank
from augsight.operators.small import collect_small

LABEL = "event_type"
GLOBAL_HEX = 4      # 65 536 buckets for table-wide ranks
CLASS_HEX = 3       # 4 096 buckets per class for per-class ranks


def validate_sizes(names: Sequence[str], sizes: Sequence[float]) -> None:
    if len(names) != len(sizes):
        raise ValueError(f"{len(names)} split names for {len(sizes)} sizes")
    if not math.isclose(sum(sizes), 1.0, abs_tol=1e-9):
        raise ValueError(f"split sizes must sum to 1.0, got {sum(sizes)}")
    if any(s < 0 for s in sizes):
        raise ValueError("split sizes must be non-negative")


def stage_fractions(sizes: Sequence[float]) -> list[float]:
    """Fraction of the *remaining* rows each stage takes (the last takes the rest)."""
    return [sizes[i] / sum(sizes[i:]) for i in range(len(sizes) - 1)]


def _with_hash(df: DataFrame, seed, id_col: str) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, id_col))


def _case(rank: str, bounds: list, names: Sequence[str]):
    expr = None
    for b, name in zip(bounds, names[:-1]):
        expr = (F.when(F.col(rank) < b, F.lit(name)) if expr is None
                else expr.when(F.col(rank) < b, F.lit(name)))
    return expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])


def split_plain(df: DataFrame, names: Sequence[str], sizes: Sequence[float], seed: int = 42,
                id_col: str = "id", out: str = "split") -> DataFrame:
    """n-way unstratified split: stage i takes floor(f_i * remaining) rows in hash order.

    The row count comes from the bucket sums that the ranking makes anyway.
    """
    validate_sizes(names, sizes)
    h = _with_hash(df, seed, id_col)
    ranked, n = bucketed_rank(h, hash_bucket(F.col("_h"), GLOBAL_HEX), [F.col("_h"), F.col(id_col)],
                              out="_rank", return_total=True)
    bounds, start, remaining = [], 0, n
    for f in stage_fractions(sizes):
        take = math.floor(f * remaining)
        start += take
        remaining -= take
        bounds.append(start)
    return ranked.withColumn(out, _case("_rank", bounds, names)).drop("_h", "_rank")


def _largest_remainder(counts: dict, draws: int) -> dict:
    """Proportional integer allocation of ``draws`` over classes; ties by label."""
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    cont = {k: (v * draws) / total for k, v in counts.items()}
    alloc = {k: math.floor(c) for k, c in cont.items()}
    need = draws - sum(alloc.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - alloc[k]), k))
    for k in order[:need]:
        alloc[k] += 1
    return alloc


def stratified_bounds(counts: dict, sizes: Sequence[float]) -> dict:
    """Per class, the cumulative upper rank bound of every stage but the last."""
    remaining = dict(counts)
    bounds = {k: [] for k in counts}
    acc = {k: 0 for k in counts}
    for f in stage_fractions(sizes):
        take = math.floor(f * sum(remaining.values()))
        alloc = _largest_remainder(remaining, take)
        for k in counts:
            acc[k] += alloc[k]
            remaining[k] -= alloc[k]
            bounds[k].append(acc[k])
    return bounds


def class_sizes(df: DataFrame, label: str = LABEL) -> dict:
    """Rows per class in label order: one row per class reaches the driver.  A null label is an error."""
    rows = collect_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    if any(r[label] is None for r in rows):
        raise ValueError(f"rows without a {label} cannot be stratified; filter them out first")
    return {r[label]: r["_n"] for r in sorted(rows, key=lambda r: r[label])}


def split_stratified(df: DataFrame, names: Sequence[str], sizes: Sequence[float], seed: int = 42,
                     label: str = LABEL, id_col: str = "id", out: str = "split") -> DataFrame:
    """n-way split with per-class proportional targets (largest remainder)."""
    validate_sizes(names, sizes)
    h = _with_hash(df, seed, id_col)
    ranked = bucketed_rank(h, hash_bucket(F.col("_h"), CLASS_HEX), [F.col("_h"), F.col(id_col)],
                           partition=[label], out="_rank")
    counts = class_sizes(df, label)
    if any(v < 2 for v in counts.values()):
        raise ValueError("stratified split needs at least 2 rows in every class")
    bounds = stratified_bounds(counts, sizes)
    spark = df.sparkSession
    bcols = [f"_b{i}" for i in range(len(names) - 1)]
    btable = spark.createDataFrame([(k, *v) for k, v in bounds.items()],
                                   f"{label} string, " + ", ".join(f"{c} long" for c in bcols))
    expr = None
    for c, name in zip(bcols, names[:-1]):
        cond = F.col("_rank") < F.col(c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return (ranked.join(F.broadcast(btable), label)  # one row per class, already collected
            .withColumn(out, expr).drop("_h", "_rank", *bcols))


def kfold_stratified(df: DataFrame, k: int, seed: int = 18091999, label: str = LABEL,
                     id_col: str = "id", out: str = "fold") -> DataFrame:
    """Stratified k-fold: rows in (label, hash) order are dealt round-robin over k folds.

    Per class the fold sizes differ by at most one.  Ranks are made inside
    each class; a class starts where the smaller labels' rows end, which its
    size table (collected for the checks) tells.
    """
    h = _with_hash(df, seed, id_col)
    ranked = bucketed_rank(h, hash_bucket(F.col("_h"), CLASS_HEX), [F.col("_h"), F.col(id_col)],
                           partition=[label], out="_rank")
    sizes = class_sizes(df, label)
    if sizes and all(v < k for v in sizes.values()):
        raise ValueError(f"n_splits={k} is greater than the number of members in every class")
    if sizes and min(sizes.values()) < k:
        warnings.warn(f"the least populated class has fewer than n_splits={k} members")
    starts, at = [], 0
    for name, n in sizes.items():
        starts.append((name, at % k))
        at += n
    kind = df.schema[label].dataType.simpleString()
    first = F.broadcast(df.sparkSession.createDataFrame(starts, f"{label} {kind}, _first int"))  # one row per class
    return (ranked.join(first, label)
            .withColumn(out, ((F.col("_first") + F.col("_rank")) % k).cast("int")).drop("_h", "_rank", "_first"))


def kfold_leakage_safe(df: DataFrame, k: int, seed: int = 18091999, label: str = LABEL,
                       id_col: str = "id", source_col: str = "source_doc_id") -> DataFrame:
    """Leakage-safe stratified k-fold over originals + augmentations.

    Long output ``(fold, id, role)``: test(f) = originals dealt to fold f;
    train(f) = the other originals plus every augmentation whose source is
    not in test(f).  An augmentation whose source is not among the originals
    is in every train set.  Augmentations are never in a test set.
    """
    originals = df.where(F.col(source_col).isNull())
    folds = kfold_stratified(originals.select(id_col, label), k, seed, label, id_col).select(id_col, "fold")
    aug = (df.where(F.col(source_col).isNotNull()).select(id_col, source_col)
           .join(folds.withColumnRenamed(id_col, source_col).withColumnRenamed("fold", "_src_fold"),
                 source_col, "left"))
    all_folds = F.sequence(F.lit(0), F.lit(k - 1))
    orig_rows = (folds.select(id_col, "fold", F.explode(all_folds).alias("_f"))
                 .select(F.col("_f").alias("fold"), id_col,
                         F.when(F.col("_f") == F.col("fold"), F.lit("test")).otherwise(F.lit("train")).alias("role")))
    aug_rows = (aug.select(id_col, "_src_fold", F.explode(all_folds).alias("fold"))
                .where(F.col("_src_fold").isNull() | (F.col("fold") != F.col("_src_fold")))
                .select("fold", id_col, F.lit("train").alias("role")))
    return orig_rows.unionByName(aug_rows)


def fold_assignment(df: DataFrame, k: int, seed: int = 18091999, label: str = LABEL,
                    id_col: str = "id", source_col: str = "source_doc_id") -> DataFrame:
    """Compact leakage-safe assignment: one row per document, ``(id, is_augmented, test_fold)``.

    ``test_fold`` is the fold an original is tested in, or for an augmentation
    the fold its source is tested in (null for an orphan).  Every fold's train
    and test sets follow by a filter (:func:`fold_members`), so the k-times
    larger long table never has to be materialised.
    """
    originals = df.where(F.col(source_col).isNull())
    folds = kfold_stratified(originals.select(id_col, label), k, seed, label, id_col).select(id_col, "fold")
    orig = folds.select(id_col, F.lit(False).alias("is_augmented"), F.col("fold").alias("test_fold"))
    aug = (df.where(F.col(source_col).isNotNull()).select(id_col, source_col)
           .join(folds.select(F.col(id_col).alias(source_col), F.col("fold").alias("test_fold")), source_col, "left")
           .select(id_col, F.lit(True).alias("is_augmented"), "test_fold"))
    return orig.unionByName(aug)


def fold_members(assignment: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train ids, test ids) of one fold from a compact assignment."""
    test = assignment.where(~F.col("is_augmented") & (F.col("test_fold") == fold)).select("id")
    train = assignment.where(F.col("test_fold").isNull() | (F.col("test_fold") != fold)).select("id")
    return train, test


def leakage_audit(assignment: DataFrame, df: DataFrame, id_col: str = "id",
                  source_col: str = "source_doc_id") -> DataFrame:
    """Per fold: test/train sizes and the number of train augmentations whose source is tested.

    Each document's folds by role are gathered once (at most k of them);
    provenance and the source's test fold are joined to that row, so the
    k-times larger assignment is read once and never joined to itself.
    """
    per_doc = assignment.groupBy(id_col).agg(
        F.collect_list(F.when(F.col("role") == "train", F.col("fold"))).alias("_train"),
        F.collect_list(F.when(F.col("role") == "test", F.col("fold"))).alias("_test"))
    docs = per_doc.join(df.select(id_col, source_col), id_col)
    tested = per_doc.where(F.size("_test") > 0).select(F.col(id_col).alias(source_col), F.col("_test").alias("_leak"))
    docs = docs.join(tested, source_col, "left")
    no_folds = F.array().cast(per_doc.schema["_train"].dataType)
    is_aug = F.col(source_col).isNotNull()
    rows = docs.select(F.explode(F.concat(
        F.transform("_test", lambda f: F.struct(f.alias("fold"), F.lit("n_test").alias("what"))),
        F.transform("_train", lambda f: F.struct(f.alias("fold"), F.when(is_aug, "n_train_augmented").otherwise("n_train_original").alias("what"))),
        F.transform(F.array_intersect(F.when(is_aug, F.col("_train")).otherwise(no_folds), F.coalesce("_leak", no_folds)),
                    lambda f: F.struct(f.alias("fold"), F.lit("n_leaks").alias("what"))))).alias("r")).select("r.*")
    return rows.groupBy("fold").agg(*[F.count_if(F.col("what") == w).alias(w)
                                      for w in ("n_test", "n_train_original", "n_train_augmented", "n_leaks")])
