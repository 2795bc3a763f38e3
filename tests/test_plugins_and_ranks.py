"""Plug-ins that keep their promises, ranks at awkward sizes, and each writer with its reader."""

import json
import os

import pytest
from pyspark.sql import functions as F

from augsight.functions.keys import hash_key
from augsight.operators import augment, features, imbalance, plugins, ranks, rouge, splits, svm, trainset
from augsight.plans import jobs
from augsight.sources import scores as sc
from augsight.sources.corpus import corpus, named_splits, read_corpus_csv, write_corpus

SF = "/root/testdata/sf0.001"


# --- plug-ins ---------------------------------------------------------------------------------

class CountedModel:
    """Appends a line to a file for every time it is made."""

    def __init__(self, log):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

    def __call__(self, texts):
        return [{"label": "LABEL_0"} for _ in texts]


def test_model_is_made_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "made")
    model = plugins.worker_cached(lambda: CountedModel(log), key=f"counted-{tmp_path}")
    df = spark.range(64).select("id", F.lit("x").alias("text")).repartition(16)
    assert plugins.classify_with(df, model).where("model_label = 'LABEL_0'").count() == 64
    assert plugins.classify_with(df, model).where("model_label = 'LABEL_0'").count() == 64
    made = open(log).read().split()
    assert len(made) == len(set(made))  # 32 tasks, one model per process


def test_cached_generator_and_exact_count(spark):
    df = corpus(spark, SF)
    cached = plugins.worker_cached(lambda: plugins.lead_generator, key="lead")
    plain = augment.augment_corpus(df, 2, None).select("id", "text")
    got = augment.augment_corpus(df, 2, None, generator=augment.generate_with(cached, 2)).select("id", "text")
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()
    for wrong in (lambda t, n: [["a"] * (n + 1) for _ in t], lambda t, n: [[] for _ in t], lambda t, n: []):
        with pytest.raises(Exception, match="the generator must give"):
            augment.augment_corpus(df, 2, None, generator=augment.generate_with(wrong, 2)).collect()


def test_null_texts_and_unknown_labels(spark):
    df = spark.createDataFrame([(1, "a the b"), (2, None), (3, "")], "id long, text string")
    out = df.select("id", plugins.translate_chunks("text", plugins.dictionary_translator({" the ": " le "}), 3).alias("t"))
    assert {r.id: r.t for r in out.collect()} == {1: "a the b", 2: None, 3: ""}
    mapping = spark.createDataFrame([("en", 0)], "event_type string, label_id int")
    for bad in ("LABEL_7", "junk", None):
        raw = spark.createDataFrame([(1, "en", bad)], "id long, event_type string, model_label string")
        with pytest.raises(Exception, match="not in the mapping"):
            plugins.decode_predictions(raw, mapping).collect()


# --- ranks ------------------------------------------------------------------------------------

def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_of_sparse_ids(spark):
    df = spark.range(0, 300_000).select((F.col("id") * 65_536 * 1000 - 7).alias("id"))
    out, ids = ranks.dense_ids(df)
    assert ids.rows == 300_000
    assert "SinglePartition" not in final_plan(out)
    a = out.agg(F.sum(F.abs((F.col("id") + 7) / (65_536 * 1000) - F.col("new_id"))), F.count_distinct("new_id")).first()
    assert tuple(a) == (0.0, 300_000)


def test_folds_of_many_classes(spark):
    df = spark.range(0, 300_000).select("id", F.concat(F.lit("c"), (F.col("id") % 80).cast("string")).alias("event_type"))
    folds = splits.kfold_stratified(df, 5, seed=3)
    assert "SinglePartition" not in final_plan(folds)
    per = folds.groupBy("event_type", "fold").count().groupBy("event_type").agg(F.max("count") - F.min("count")).collect()
    assert len(per) == 80 and all(r[1] <= 1 for r in per)
    all_sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert all_sizes == [60_000] * 5


def test_ranks_refuse_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, event_type string")
    with pytest.raises(ValueError, match="without a event_type"):
        splits.split_stratified(df, ["a", "b"], [0.5, 0.5])
    with pytest.raises(ValueError, match="have no id"):
        ranks.dense_ids(spark.createDataFrame([(1,), (None,)], "id long"))
    assert ranks.dense_ids(spark.createDataFrame([], "id long"))[0].count() == 0


def test_rank_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.xxhash64("id") % 100_000).alias("id"), (F.col("id") % 3 == 0).cast("int").alias("late"))
    df = df.dropDuplicates(["id"])
    got = ranks.id_rank(df, ranks.id_range(df), before=F.col("late")).collect()
    want = sorted((r["late"], r["id"]) for r in got)
    assert [(r["late"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(len(want)))


def test_share_of_one_keeps_every_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(5)], "id long, event_type string")
    assert imbalance.low_resource_slice(df, 1.0).count() == 5
    assert imbalance.low_resource_slice(df, 1).count() == 1
    with pytest.raises(ValueError, match="share"):
        imbalance.low_resource_slice(df, 2.5)


def test_one_row_per_group_moves_no_text(spark):
    df = spark.range(0, 900).select("id", (F.col("id") % 7).alias("source_doc_id"), F.lit("x" * 100).alias("text"))
    out = augment.subsample_one_per_source(df, 5)
    assert out.count() == 7 and "SortAggregate" not in final_plan(out)
    first = {}
    for r in df.withColumn("h", hash_key(5, "id")).collect():
        if r.source_doc_id not in first or r.h < first[r.source_doc_id][0]:
            first[r.source_doc_id] = (r.h, r.id)
    assert {r.id for r in out.collect()} == {i for _, i in first.values()}


# --- round trips ------------------------------------------------------------------------------

def test_augmented_csv_comes_back(spark, tmp_path):
    aug = augment.augment_corpus(corpus(spark, SF), 2, None).withColumn("tokens", F.split("title", " "))
    out = str(tmp_path / "aug")
    write_corpus(aug, out, fmt="csv")
    back = read_corpus_csv(spark, out)
    pairs = lambda df: df.select("id", "source_doc_id")
    assert pairs(back).exceptAll(pairs(aug)).count() == 0 and back.count() == aug.count()
    assert back.where("arguments is not null").count() == 0
    tokens = back.select("id", F.from_json("tokens", "array<string>").alias("t"))
    assert tokens.join(aug.select("id", "tokens"), "id").where("not (t <=> tokens)").count() == 0


def test_csv_splits(spark, tmp_path):
    c = corpus(spark, SF).withColumn("date", F.col("date").cast("string"))
    for part, cond in (("train", "id % 2 = 0"), ("dev", "id % 2 = 1")):
        write_corpus(c.where(cond), str(tmp_path / part), fmt="csv")
    back = named_splits(spark, {p: str(tmp_path / p) for p in ("train", "dev")}, fmt="csv")
    assert {(r["split"], r["n"]) for r in back.groupBy("split").agg(F.count("id").alias("n")).collect()} == {
        ("train", c.where("id % 2 = 0").count()), ("dev", c.where("id % 2 = 1").count())}


def test_cv_scores_reach_the_analysis(spark, tmp_path):
    rows = [(i, "t", ("red sun " if i % 2 else "blue sea ") * 3 + f"w{i % 4}", "a" if i % 2 else "b", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, title string, text string, event_type string, source_doc_id long")
    out = str(tmp_path / "scores")
    stats = jobs.svm_cv_job(docs, 2, out, min_df=1, experiment="svm.title.greedy.spacytitle").collect()
    assert [(r.experiment, r.n_folds) for r in stats] == [("svm.title.greedy.spacytitle", 2)]
    members, box = jobs.experiment_analysis(spark, out)
    assert [(r.group_name, r.experiment) for r in members.collect()] == [("BOTH_TITLES", "svm.title.greedy.spacytitle")]
    assert box.first().n == 1


def test_nested_reports(spark, tmp_path):
    def write(name, f1):
        doc = {"runs": {"dev": {"a": {"precision": 1.0, "recall": 0.5, "f1-score": f1, "support": 4}, "accuracy": 0.5,
                                "macro avg": {"precision": 1.0, "recall": 0.5, "f1-score": f1, "support": 4}}}}
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)
    old, new = write("old.json", 0.25), write("new.json", 0.75)
    assert sc.read_nested_report(spark, old, ["runs", "dev"]).where("label = 'accuracy'").first().f1 == 0.5
    cmp = jobs.compare_job(spark, old, new, str(tmp_path / "cmp"), keys=["runs", "dev"])
    assert {(r.label, r.delta) for r in cmp.where("metric = 'f1'").collect()} == {("a", 0.5), ("macro avg", 0.5)}
    with pytest.raises(KeyError, match="test is not in the report"):
        sc.read_nested_report(spark, old, ["runs", "test"])


def test_kept_output_keeps_its_parameters(spark, tmp_path):
    out = str(tmp_path / "aug")
    jobs.augment_job(spark, corpus(spark, SF), out, n=2, mode="ignore")
    before = spark.read.parquet(out).count()
    jobs.augment_job(spark, corpus(spark, SF), out, n=2, cutoff=0.5, mode="ignore")
    assert spark.read.json(out + ".params").first()["n"] == "2" and "low_resource_cutoff" not in spark.read.json(out + ".params").columns
    assert spark.read.parquet(out).count() == before


def test_job_runs_its_model_once(spark, tmp_path):
    log = tmp_path / "rows"

    class Logged(plugins.RuleModel):
        def __call__(self, texts):
            with open(str(log), "a") as f:
                f.write("x" * len(texts))
            return super().__call__(texts)

    c = corpus(spark, SF)
    mapping = trainset.label_mapping(c)
    labels = [r[0] for r in mapping.orderBy("label_id").collect()]
    report = jobs.inference_job(c, mapping, Logged(labels), str(tmp_path / "report"))
    report.count()
    report.collect()
    assert len(log.read_text()) == c.count()


# --- models and metrics -----------------------------------------------------------------------

def test_svm_features_are_the_tfidf_table(spark):
    rows = [(i, [f"t{(i * j) % 7}" for j in range(1, 9)]) for i in range(25)] + [(99, [])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(docs, min_df=2, max_df=0.9)[0].collect()}
    members = docs.select(F.lit(0).alias("model"), F.lit("train").alias("role"), "id")
    tf = features.term_frequencies(docs)
    vocab = svm.numbered(svm.training_idf(tf, members, 2, 0.9), 2)
    got = {(r["id"], r["term"]): r["weight"] for r in svm.weights(tf, members, vocab).join(vocab, ["model", "block", "place"]).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rouge_lsum_by_hand(spark):
    pairs = spark.createDataFrame([(1, "the cat sat. the dog ran", "the dog sat. a cat ran"), (2, "", "x"), (3, "same words. here", "same words. here")],
                                  "k long, prediction string, reference string")
    out = {r.k: r for r in rouge.rouge_lsum(pairs, ["k"]).collect()}
    assert out[2].fmeasure == 0.0 and out[3].fmeasure == 1.0
    assert rouge.summary_lcs([["a", "b", "c"], ["d"]], [["a", "x", "c"], ["b", "d"]]) == 4
    assert rouge.summary_lcs([["a", "a"]], [["a"]]) == 1
    n = rouge.rouge_n(pairs, 1, ["k"]).collect()
    assert {r.k: round(r.fmeasure, 6) for r in n}[3] == 1.0 and len(n) == 3
