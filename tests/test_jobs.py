"""End-to-end jobs on the sf0.001 tables, writing to fresh temporary folders."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from augsight.operators import plugins, trainset
from augsight.plans import jobs
from augsight.sources import scores as sc
from augsight.sources.corpus import bounded, corpus, drop_unnamed, named_splits, read_corpus_csv, write_corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="augsight-test-")


def test_augment_job_and_guards(spark, tmp):
    c = corpus(spark, SF)
    out = os.path.join(tmp, "aug")
    got = jobs.augment_job(spark, c, out, n=2, cutoff=0.2)
    n_orig = c.count()
    assert got.where("source_doc_id is null").count() == n_orig
    assert got.count() == n_orig + 2 * got.where("source_doc_id is not null").select("source_doc_id").distinct().count()
    assert spark.read.json(out + ".params").first()["n"] == "2"
    with pytest.raises(Exception):  # output guard: never overwrite
        jobs.augment_job(spark, c, out, n=2, cutoff=0.2)


def test_split_job_skips_existing(spark, tmp):
    c = corpus(spark, SF)
    out = os.path.join(tmp, "split")
    jobs.split_job(c, out, ["train", "dev", "test"], [0.8, 0.1, 0.1], stratify=True)
    first = spark.read.parquet(out).count()
    jobs.split_job(c, out, ["train", "dev", "test"], [0.8, 0.1, 0.1], seed=99)  # ignored: exists
    assert spark.read.parquet(out).count() == first == c.count()
    parts = named_splits(spark, {s: f"{out}/split={s}" for s in ("train", "dev")})
    assert set(r.split for r in parts.select("split").distinct().collect()) == {"train", "dev"}


def test_extract_and_preprocess_jobs(spark, tmp):
    c = corpus(spark, SF)
    jobs.extract_low_resource_job(c, os.path.join(tmp, "lr"), 0.2, news_only=True)
    lr = spark.read.parquet(os.path.join(tmp, "lr"))
    assert lr.where("date is null").count() == 0
    jobs.preprocess_job(c, os.path.join(tmp, "pp"), tokenizer=plugins.regex_tokenizer)
    pp = spark.read.parquet(os.path.join(tmp, "pp"))
    assert pp.where(F.size("tokens") > 0).count() > 0


def test_csv_round_trip(spark, tmp):
    c = corpus(spark, SF).select("id", "title", "text", "event_type", F.col("date").cast("string").alias("date"),
                                 F.lit(None).cast("string").alias("arguments"))
    out = os.path.join(tmp, "csv")
    write_corpus(c, out, fmt="csv")
    back = read_corpus_csv(spark, out)
    assert back.count() == c.count()
    assert back.join(c, ["id", "text"]).count() == c.count()  # multi-line texts survive
    assert drop_unnamed(back.withColumn("Unnamed: 0", F.lit(1))).columns == back.columns
    assert [r.id for r in bounded(back, 3).collect()] == [0, 1, 2]


def test_inference_compare_and_analysis(spark, tmp):
    c = corpus(spark, SF)
    mapping = trainset.label_mapping(c)
    labels = [r[0] for r in mapping.orderBy("label_id").collect()]
    r1 = os.path.join(tmp, "r1")
    r2 = os.path.join(tmp, "r2")
    jobs.inference_job(c, mapping, plugins.RuleModel(labels), r1, use_title=False)
    jobs.inference_job(c.withColumn("text", F.substring("text", 1, 40)), mapping, plugins.RuleModel(labels), r2,
                       use_title=False)
    cmp = jobs.compare_job(spark, r1, r2, os.path.join(tmp, "cmp"))
    assert cmp.where("label = 'accuracy'").count() == 0
    assert cmp.where("label = 'macro avg'").count() == 3
    # score directory -> analysis
    sdir = os.path.join(tmp, "scores")
    os.makedirs(sdir)
    for name, vals in {"a.title.greedy.spacytitle.json": [0.5, 0.6], "b.notitle.beam.spacynotitle.json": [0.4, 0.4],
                       "c.title.beam.spacytitle.json": [0.7, 0.9]}.items():
        with open(os.path.join(sdir, name), "w") as f:
            json.dump({"test_score": vals, "fit_time": [1.0, 1.0]}, f)
    members, box = jobs.experiment_analysis(spark, sdir)
    groups = {(r.group_name, r.experiment) for r in members.collect()}
    assert ("BOTH_TITLES", "a.title.greedy.spacytitle.json") in groups
    assert ("NO_TITLES", "b.notitle.beam.spacynotitle.json") in groups
    assert {r.group_name: r.n for r in box.collect()} == {"BOTH_TITLES": 2, "NO_TITLES": 1}
    kept, _ = jobs.experiment_analysis(spark, sdir, grouping="decoding", keep=lambda e: ~e.startswith("b"))
    assert {r.group_name for r in kept.collect()} == {"greedy", "beam"}
    s = sc.read_score_dir(spark, sdir)
    assert s.count() == 6
