"""End-to-end jobs: read -> transform -> write, one lazy plan per output.

Each job mirrors one of the original command-line scripts, with Parquet
(or CSV) in and out, explicit ids, and the output guards expressed as save
modes (``errorifexists`` to refuse overwriting, ``ignore`` to skip an
existing output).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsight.functions import text as tx
from augsight.operators import augment, classify, imbalance, metrics, plugins, splits, trainset
from augsight.sources import scores as sc
from augsight.sources.corpus import write_corpus, write_params


def augment_job(spark: SparkSession, corpus: DataFrame, out: str, n: int = 3,
                cutoff: int | float | None = None, generator=None, mode: str = "errorifexists") -> DataFrame:
    """L1: originals + n generated variants of the (low-resource) sources, written with parameters."""
    result = augment.augment_corpus(corpus, n, cutoff, generator)
    write_corpus(result, out, mode=mode)
    # An output that was kept keeps its parameters too.
    write_params(spark, {"n": n, "low_resource_cutoff": cutoff}, out.rstrip("/") + ".params",
                 mode="ignore" if mode == "ignore" else "overwrite")
    written = spark.read.parquet(out)
    augment.check_augmented_count(written, n)  # invariant: every source has exactly n variants
    return written


def _written(df: DataFrame, out: str, mode: str) -> DataFrame:
    """Write once and return what was written, so that a model runs once."""
    sc.write_json(df, out, mode=mode)
    return sc.read_json(df.sparkSession, out, df.schema)


def extract_low_resource_job(corpus: DataFrame, out: str, cutoff: int | float, news_only: bool = False,
                             mode: str = "errorifexists") -> None:
    """L9: low-resource rows (optionally news only: filter first, then count)."""
    df = imbalance.news_only(corpus) if news_only else corpus
    write_corpus(imbalance.low_resource_slice(df, cutoff), out, mode=mode)


def split_job(corpus: DataFrame, out: str, names: Sequence[str], sizes: Sequence[float], seed: int = 42,
              stratify: bool = False, mode: str = "ignore") -> None:
    """L10: n-way split written once, partitioned by ``split`` (an existing output is skipped)."""
    f = splits.split_stratified if stratify else splits.split_plain
    write_corpus(f(corpus, names, sizes, seed), out, mode=mode, partition_by=["split"])


def preprocess_job(corpus: DataFrame, out: str, use_title: bool = True, n_sentences: int | None = 25,
                   tokenizer: Callable | None = None, mode: str = "errorifexists") -> None:
    """L8: title + text -> first N sentences -> tokens (SQL tokenizer or a plug-in)."""
    lead = tx.first_sentences(tx.assemble(F.col("title") if use_title else None, F.col("text")), n_sentences)
    toks = plugins.tokenize_with(lead, tokenizer) if tokenizer else tx.tokens(lead)
    write_corpus(corpus.withColumn("tokens", toks), out, mode=mode)


def translate_job(corpus: DataFrame, out: str, columns: Sequence[str], translator: Callable,
                  max_length: int = 5000, chunk: bool = False, mode: str = "errorifexists") -> None:
    """L11: translate selected columns; long documents truncated (default) or chunked and re-joined."""
    df = corpus
    for c in columns:
        if chunk:
            df = df.withColumn(c, plugins.translate_chunks(c, translator, max_length - 1))
        else:
            df = df.withColumn(c, plugins.translate_chunks(tx.truncate_chars(c, max_length), translator, max_length))
    write_corpus(df, out, mode=mode)


def inference_job(test: DataFrame, mapping: DataFrame, model: Callable, out: str, use_title: bool = True,
                  mode: str = "errorifexists") -> DataFrame:
    """L6: assemble -> batch inference plug-in -> decode labels -> report (JSON)."""
    doc = tx.assemble(F.col("title") if use_title else None, F.col("text"))
    raw = plugins.classify_with(test.withColumn("_doc", doc), model, "_doc")
    pred = plugins.decode_predictions(raw, mapping)
    report = metrics.classification_report(pred, "event_type", "y_pred")
    return _written(report, out, mode)


def compare_job(spark: SparkSession, old_path: str, new_path: str, out: str,
                keys: Sequence[str] = (), section_cols: Sequence[str] = (), mode: str = "errorifexists") -> DataFrame:
    """L7: two reports -> delta table (JSON).

    Long reports are filtered by ``keys`` in ``section_cols``; without
    ``section_cols`` the keys are a path into nested report files.
    """
    def read(path: str) -> DataFrame:
        if keys and not section_cols:
            return sc.read_nested_report(spark, path, list(keys))
        return sc.navigate(spark.read.json(path), list(keys), list(section_cols))
    return _written(metrics.compare_reports(read(old_path), read(new_path)), out, mode)


def svm_job(train: DataFrame, others: dict[str, DataFrame], out: str, min_df=3, max_df=1.0, C: float = 1.0,
            mode: str = "errorifexists") -> DataFrame:
    """L3: TF-IDF + one-vs-rest linear SVM; report per split (JSON)."""
    pred = classify.fit_predict(train, others, min_df=min_df, max_df=max_df, C=C)
    return _written(metrics.classification_report(pred, "label_id", "pred_id", by=["split"]), out, mode)


def svm_cv_job(docs: DataFrame, k: int, out: str, seed: int = 18091999, subsample: str | None = None,
               min_df=3, max_df=1.0, mode: str = "errorifexists", experiment: str = "svm") -> DataFrame:
    """L4: (optionally augmented + subsampled) corpus -> leakage-safe folds -> per-fold macro F1 -> stats.

    The fold scores are written as a score directory that :func:`experiment_analysis` reads.
    """
    if subsample:
        docs = augment.subsample_augmented(docs, subsample)
    mapping = trainset.label_mapping(docs)
    enc = trainset.encode_labels(docs, mapping).withColumn("tokens", tx.tokens("text"))
    folds = splits.fold_assignment(docs.select("id", "event_type", "source_doc_id"), k, seed)
    pred = classify.cross_validate(enc.select("id", "label_id", "tokens"), folds, k, min_df=min_df, max_df=max_df)
    scores = metrics.macro_metrics(pred, "label_id", "pred_id", by=["fold"]).select(
        F.lit(experiment).alias("experiment"), "fold", F.col("f1_macro").alias("score"))
    sc.write_score_dir(scores, out, mode=mode)
    return metrics.score_stats(sc.read_score_dir(docs.sparkSession, out))


def experiment_analysis(spark: SparkSession, score_dir: str, grouping: str = "title",
                        keep: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """L12: score files -> filter -> per-experiment stats -> groups -> (group members, box stats)."""
    s = sc.read_score_dir(spark, score_dir)
    if keep is not None:
        s = s.where(keep(F.col("experiment")))
    stats = metrics.score_stats(s)
    members = metrics.tag_groups(stats.select("experiment", "mean"), grouping=grouping)
    return members, metrics.box_stats(members, "mean", ["grouping", "group_name"])
