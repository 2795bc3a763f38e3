"""Evaluation analytics: classification reports, comparisons, CV score statistics, box plots.

Every function takes the full prediction / score table and an optional
``by`` key (experiment, fold, ...), so one job reports on any number of
experiments.  Per-class counts come from a single partially-aggregated
``groupBy``; the summary rows are computed from that small per-class table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsight.operators.quantiles import quantiles
from augsight.operators.small import small_table

SUMMARY_LABELS = ("accuracy", "macro avg", "weighted avg")
METRICS = ("precision", "recall", "f1")


def _div(a: Column, b: Column) -> Column:
    # 0 when the denominator is 0 (ANSI mode would raise on x/0).
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, tp, predicted, support, precision, recall, f1) over labels(y) U labels(y_hat)."""
    k = list(by)
    ev = pred.select(*k, F.explode(F.array(
        F.struct(F.col(y_true).cast("string").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col(y_true).cast("string") == F.col(y_pred).cast("string")).cast("int").alias("tp")),
        F.struct(F.col(y_pred).cast("string").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp")))).alias("e"))
    counts = ev.groupBy(*k, F.col("e.label").alias("label")).agg(
        F.sum("e.tp").cast("long").alias("tp"), F.sum("e.p").cast("long").alias("predicted"),
        F.sum("e.t").cast("long").alias("support"))
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return counts.select(*k, "label", "tp", "predicted", "support",
                         p.alias("precision"), r.alias("recall"), f.alias("f1"))


def summary_rows(pc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy / macro avg / weighted avg rows from a per-class table."""
    k = list(by)
    n = F.sum("support")
    agg = pc.groupBy(*k).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("wf"),
        n.cast("long").alias("n"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1")))
    return agg.select(*k, "n", F.explode(rows).alias("s")).select(
        *k, "s.label", "s.precision", "s.recall", "s.f1", F.col("n").alias("support"))


def classification_report(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                          by: Sequence[str] = ()) -> DataFrame:
    """Long report: per class and the three summary rows, columns (by..., label, precision, recall, f1, support)."""
    pc = per_class(pred, y_true, y_pred, by)
    cls = pc.select(*by, "label", "precision", "recall", "f1", "support")
    return cls.unionByName(summary_rows(pc, by))


def macro_metrics(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  by: Sequence[str] = ()) -> DataFrame:
    """Macro precision / recall / F1 and accuracy per ``by`` group."""
    s = summary_rows(per_class(pred, y_true, y_pred, by), by)
    return (s.groupBy(*by).agg(
        F.max(F.when(F.col("label") == "macro avg", F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("label") == "macro avg", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("f1_macro"),
        F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy")))


def _long(report: DataFrame, by: Sequence[str]) -> DataFrame:
    return report.select(*by, "label", "support", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    ).select(*by, "label", "support", "m.metric", "m.value")


def compare_reports(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, metric, old, new, delta, support) for every key of ``old`` except accuracy.

    Support comes from ``old``; a key missing from ``new`` raises, keys only in ``new`` are ignored.
    """
    k = list(by)
    o = _long(old.where(F.col("label") != "accuracy"), k).withColumnRenamed("value", "old")
    n = _long(new, k).select(*k, "label", "metric", F.col("value").alias("new"), F.lit(True).alias("_seen"))
    j = o.join(n, [*k, "label", "metric"], "left")
    checked = F.when(F.col("_seen").isNull(),
                     F.raise_error(F.concat(F.lit("label missing from new results: "), F.col("label"))))
    return j.select(*k, "label", "metric", "old",
                    F.coalesce(checked.cast("double"), F.col("new")).alias("new"),
                    (F.col("new") - F.col("old")).alias("delta"), "support")


def delta_by_support(comparison: DataFrame, metric: str = "f1") -> DataFrame:
    """Per-class deltas of one metric, largest support first (summary rows excluded)."""
    c = comparison.where((F.col("metric") == metric) & ~F.col("label").isin(*SUMMARY_LABELS))
    return c.select("label", "support", "old", "new", "delta",
                    F.row_number().over(Window.orderBy(F.desc("support"), "label")).alias("position"))


def score_stats(scores: DataFrame, by: Sequence[str] = ("experiment",), value: str = "score") -> DataFrame:
    """Mean, population variance and population std of fold scores."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(value).alias("mean"),
                                   F.var_pop(value).alias("var"), F.stddev_pop(value).alias("std"))


# Experiment groupings by file-name tags (all substrings must occur).
TITLE_GROUPS = {
    "BOTH_TITLES": (".title", "spacytitle"),
    "TITLE_SUMMARY_ONLY": (".title", "spacynotitle"),
    "TITLE_SPACY_ONLY": (".notitle", "spacytitle"),
    "NO_TITLES": (".notitle", "spacynotitle"),
}
DECODING_GROUPS = {d: (d,) for d in ("greedy", "beam", "contrastive", "top_p", "top_k")}


def tag_groups(df: DataFrame, name_col: str = "experiment", groups: dict | None = None,
               grouping: str = "title") -> DataFrame:
    """Explode each experiment into every group whose tags its name contains (groups may overlap)."""
    groups = groups if groups is not None else (TITLE_GROUPS if grouping == "title" else DECODING_GROUPS)
    tags = []
    for g, subs in groups.items():
        cond = None
        for s in subs:
            c = F.col(name_col).contains(s)
            cond = c if cond is None else cond & c
        tags.append(F.when(cond, F.lit(g)))
    return (df.withColumn("group_name", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
            .withColumn("grouping", F.lit(grouping)))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Box-plot statistics: quartiles, whiskers (extreme points within 1.5 IQR) and flier count."""
    k = list(by)
    q = quantiles(df, value, [0.25, 0.5, 0.75], k)
    q = q.withColumn("iqr", F.col("q75") - F.col("q25"))
    lo_fence = F.col("q25") - 1.5 * F.col("iqr")
    hi_fence = F.col("q75") + 1.5 * F.col("iqr")
    v = F.col(value)
    inside = (v >= lo_fence) & (v <= hi_fence)
    return (df.join(small_table(q), k)
            .groupBy(*k, "q25", "q50", "q75", "iqr")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                 F.count(F.when(~inside, 1)).alias("n_fliers")))


def consistency(runs: DataFrame, key: Sequence[str], output: str, run_col: str = "run") -> DataFrame:
    """Per key: do all runs agree on the output?  One summary row."""
    per_key = runs.groupBy(*key).agg(F.count_distinct(F.md5(F.col(output))).alias("_d"),
                                     F.count_distinct(run_col).alias("_r"))
    return per_key.agg(F.count(F.lit(1)).alias("n_outputs"),
                       F.count(F.when(F.col("_d") == 1, 1)).alias("n_consistent"),
                       F.min("_r").alias("n_runs"),
                       F.bool_and(F.col("_d") == 1).alias("all_consistent"))


def length_profile(df: DataFrame, text: str = "text", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per class: count, min / mean / max and quartiles of the text length."""
    k = list(by)
    L = df.select(*k, F.length(text).alias("length"))
    basic = L.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("min_len"),
                              F.avg("length").alias("mean_len"), F.max("length").alias("max_len"))
    return basic.join(quantiles(L, "length", [0.25, 0.5, 0.75], k), k)
