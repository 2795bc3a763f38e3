"""Result files: metric reports and cross-validation score directories (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a (long) report / comparison / score table as JSON lines."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def read_score_dir(spark: SparkSession, path: str) -> DataFrame:
    """Directory with one JSON document per experiment -> (experiment, fold, score).

    A document is ``{"test_score": [...], ...}``.  Its experiment is the
    folder ``experiment=...`` that :func:`write_score_dir` puts it in, or else
    its file name; both carry the tags used for grouping.
    """
    raw = (spark.read.option("multiLine", True).schema("test_score array<double>, experiment string").json(path)
           .select(F.coalesce("experiment", F.col("_metadata.file_name")).alias("experiment"), F.posexplode("test_score")))
    return raw.select("experiment", F.col("pos").cast("int").alias("fold"), F.col("col").alias("score"))


def write_score_dir(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document ``{"test_score": [...]}`` per experiment, in fold order, in a folder of its name."""
    per = scores.groupBy("experiment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]).alias("test_score"))
    per.write.mode(mode).partitionBy("experiment").json(path)


def read_nested_report(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One report out of a nested JSON file, as a long table (label, precision, recall, f1, support).

    ``keys`` is the path to an object ``{label: {"precision": ..., "recall":
    ..., "f1-score": ..., "support": ...}, ..., "accuracy": x}``.
    """
    doc = spark.read.option("multiLine", True).json(path)
    node = doc
    for k in keys:
        if k not in node.columns:
            raise KeyError(f"{k} is not in the report; it has {node.columns}")
        node = node.select(F.col(f"`{k}`.*"))
    rows = []
    for f in node.schema.fields:
        at = {x.name: F.col(f"`{f.name}`.`{x.name}`") for x in f.dataType.fields} if hasattr(f.dataType, "fields") else {"f1-score": F.col(f"`{f.name}`")}
        f1 = at.get("f1-score", at.get("f1", F.lit(None)))
        rows.append(F.struct(F.lit(f.name).alias("label"), *[at.get(m, F.lit(None)).cast("double").alias(m) for m in ("precision", "recall")],
                             f1.cast("double").alias("f1"), at.get("support", F.lit(None)).cast("long").alias("support")))
    return node.select(F.inline(F.array(*rows)))


def navigate(df: DataFrame, keys: list[str], section_cols: list[str]) -> DataFrame:
    """Drill into nested results by a key path: ``keys[i]`` selects rows whose ``section_cols[i]`` equals it."""
    for k, c in zip(keys, section_cols):
        df = df.where(F.col(c) == k).drop(c)
    return df
