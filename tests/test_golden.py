"""Hand-made golden tables for the edge cases of each operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsight.functions import arrays
from augsight.functions import text as tx
from augsight.operators import augment, dedup, features, imbalance, metrics, plugins, rouge, splits, trainset
from augsight.operators.ranks import bucketed_rank, dense_reindex
from augsight.functions.keys import hash_bucket, hash_key

CORPUS = "id long, title string, text string, event_type string, date date, source_doc_id long"


def corpus(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def test_low_resource_cutoff_is_inclusive(spark):
    rows = [(i, "t", f"x{i}", "a", None, None) for i in range(3)] + \
           [(10 + i, "t", f"y{i}", "b", None, None) for i in range(4)]
    df = corpus(spark, rows)
    got = {r.event_type for r in imbalance.low_resource_slice(df, 3).select("event_type").distinct().collect()}
    assert got == {"a"}
    assert imbalance.low_resource_slice(df, 0).count() == 0
    assert imbalance.low_resource_slice(df, 0, none_means_all=True).count() == 7


def test_low_resource_share_and_parts(spark):
    from datetime import date
    rows = [(i, "t", "x", "a" if i < 2 else "b", date(2024, 1, 1) if i % 2 else None, None) for i in range(10)]
    df = corpus(spark, rows)
    # 0.3 * 10 = 3 -> class a (2 rows) is low-resource, b (8) is not
    assert {r[0] for r in imbalance.low_resource_classes(df, 0.3).select("event_type").collect()} == {"a"}
    by_part = imbalance.split_before_extracting(df, 1).groupBy("part", "event_type").count().collect()
    assert {(r.part, r.event_type) for r in by_part} == {("news", "a"), ("wiki", "a")}


def test_keep_none_dedup(spark):
    rows = [(1, "t", "dup2", "a", None, None), (2, "t", "dup2", "a", None, None),
            (3, "t", "dup3", "a", None, None), (4, "t", "dup3", "b", None, None), (5, "t", "dup3", "c", None, None),
            (6, "t", None, "a", None, None), (7, "t", None, "a", None, None),
            (8, "t", "single", "a", None, None)]
    df = corpus(spark, rows)
    assert [r.id for r in dedup.keep_none(df).collect()] == [8]
    sizes = {r.id: r.n_copies for r in dedup.duplicates(df).collect()}
    assert sizes == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3, 6: 2, 7: 2}
    conflicts = dedup.label_conflicts(df).collect()
    assert len(conflicts) == 1 and conflicts[0].n_rows == 3 and conflicts[0].n_labels == 3


def _aug_fixture(spark):
    rows = [(i, "t", f"doc {i}", "a" if i < 5 else "b", None, None) for i in range(10)]
    rows += [(100 + 2 * i + j, "t", f"aug {i} {j}", "a" if i < 5 else "b", None, i) for i in range(10) for j in range(2)]
    rows += [(999, "t", "orphan", "a", None, 42)]
    return corpus(spark, rows)


def test_leakage_safe_kfold(spark):
    df = _aug_fixture(spark)
    a = splits.kfold_leakage_safe(df, 2, seed=7).collect()
    test = [(r.fold, r.id) for r in a if r.role == "test"]
    assert sorted(i for _, i in test) == list(range(10))           # each original tested once
    assert all(i < 10 for _, i in test)                            # never an augmentation
    src = {r.id: r.source_doc_id for r in df.collect()}
    tested = {(f, i) for f, i in test}
    for r in a:
        if r.role == "train" and src[r.id] is not None:
            assert (r.fold, src[r.id]) not in tested               # no leakage
    assert sum(1 for r in a if r.id == 999) == 2                   # orphan in every train set
    folds = {}
    for f, i in test:
        folds.setdefault(("a" if i < 5 else "b", f), 0)
        folds[("a" if i < 5 else "b", f)] += 1
    assert sorted(folds.values()) == [2, 2, 3, 3]                  # per class sizes differ by <= 1
    audit = splits.leakage_audit(spark.createDataFrame(a), df).collect()
    assert all(r.n_leaks == 0 for r in audit)


def test_kfold_rejects_tiny_classes(spark):
    df = corpus(spark, [(i, "t", "x", "a", None, None) for i in range(2)])
    with pytest.raises(ValueError):
        splits.kfold_stratified(df, 5)


@pytest.mark.parametrize("n,expected", [(10, (8, 1, 1)), (11, (8, 1, 2)), (3, (2, 0, 1))])
def test_split_sizes(spark, n, expected):
    df = spark.range(n).withColumnRenamed("id", "id")
    got = splits.split_plain(df, ["train", "dev", "test"], [0.8, 0.1, 0.1], seed=1)
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "dev", "test")) == expected


def test_split_validation_and_stratified_errors(spark):
    with pytest.raises(ValueError):
        splits.validate_sizes(["a", "b"], [0.5, 0.4])
    with pytest.raises(ValueError):
        splits.validate_sizes(["a"], [0.5, 0.5])
    df = corpus(spark, [(0, "t", "x", "solo", None, None)] + [(i, "t", "x", "a", None, None) for i in range(1, 6)])
    with pytest.raises(ValueError):
        splits.split_stratified(df, ["train", "test"], [0.5, 0.5])


def test_stratified_split_is_proportional(spark):
    df = corpus(spark, [(i, "t", "x", "a" if i < 60 else "b", None, None) for i in range(100)])
    got = splits.split_stratified(df, ["train", "dev", "test"], [0.8, 0.1, 0.1], seed=3)
    c = {(r.event_type, r.split): r["count"] for r in got.groupBy("event_type", "split").count().collect()}
    assert (c[("a", "train")], c[("b", "train")]) == (48, 32)
    assert c[("a", "dev")] + c[("b", "dev")] == 10


def test_augment_ids_and_provenance(spark):
    rows = [(i, f"T{i}", f"One. Two. Three. Four{i}.", "a" if i < 3 else "b", None, None) for i in range(5)]
    out = augment.augment_corpus(corpus(spark, rows), n=3, cutoff=2).orderBy("id").collect()
    assert [r.id for r in out] == list(range(5 + 2 * 3))
    gen = [r for r in out if r.source_doc_id is not None]
    assert [r.source_doc_id for r in gen] == [3, 3, 3, 4, 4, 4]
    assert gen[0].text == "One." and gen[2].text == "One. Two. Three."
    assert all(r.event_type == "b" for r in gen)


def test_subsample_and_reindex(spark):
    df = _aug_fixture(spark)
    one = augment.subsample_one_per_source(augment.augmented(df))
    assert one.count() == 11 and one.select("source_doc_id").distinct().count() == 11
    kept = augment.subsample_augmented(df, "one_per_source")
    c = augment.id_contiguity(kept, "new_id").first()
    assert c.contiguous and c.n_rows == 21
    first = kept.orderBy("new_id").limit(10).collect()
    assert [r.id for r in first] == list(range(10))  # originals first


def test_bucketed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("g"))
    h = df.withColumn("h", hash_key(5, "id"))
    r = bucketed_rank(h, hash_bucket(F.col("h"), 2), [F.col("h"), F.col("id")], partition=["g"], out="r")
    got = {(x.g, x.id): x.r for x in r.collect()}
    for g in map(str, range(7)):
        ids = sorted((x.h, x.id) for x in h.where(F.col("g") == g).collect())
        for pos, (_, i) in enumerate(ids):
            assert got[(g, i)] == pos
    d = dense_reindex(spark.range(0, 300000, 7), ["id"]).collect()
    assert sorted(x.new_id for x in d) == list(range(len(d)))
    assert all(x.new_id == x.id // 7 for x in d)


def test_ngrams(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4", "5"],), (["x"],), ([],)], "t array<string>")
    r = df.select(tx.ngrams("t", 2).alias("b"), tx.ngram_range("t", 1, 3).alias("r")).collect()
    assert r[0].b == ["1 2", "2 3", "3 4", "4 5"] and len(r[0].r) == 12
    assert r[1].b == [] and r[1].r == ["x"]
    assert r[2].b == [] and r[2].r == []


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello world. It's me!  Again?No split\nhere",)], "s string")
    r = df.select(tx.sentences("s").alias("s"), tx.first_sentences("s", 2).alias("f"),
                  tx.tokens("s").alias("t"), tx.normalise_summary(F.lit("  a. b\n c  ")).alias("n"),
                  tx.assemble(F.lit(None).cast("string"), F.lit("body")).alias("a"),
                  tx.truncate_chars(F.lit("abcdef"), 4).alias("tr")).first()
    assert r.s == ["Hello world.", "It's me!", "Again?No split\nhere"]
    assert r.f == "Hello world. It's me!"
    assert r.t[:3] == ["hello", "world", "it"]
    assert r.n == "a.\nb  c" and r.a == "body" and r.tr == "abc"


def test_rouge_worked_pair(spark):
    pairs = spark.createDataFrame([(1, "I absolutely loved reading the Hunger Games",
                                    "I loved reading the Hunger Games")], "k long, prediction string, reference string")
    r1 = rouge.rouge_n(pairs, 1, ["k"]).first()
    assert math.isclose(r1.precision, 6 / 7) and math.isclose(r1.recall, 1.0)
    rl = rouge.rouge_l(pairs, ["k"]).first()
    assert math.isclose(rl.precision, 6 / 7) and math.isclose(rl.recall, 1.0)


def test_lcs_against_dp():
    rng = np.random.default_rng(0)

    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]
    for _ in range(300):
        a = list(rng.choice(list("abcd"), rng.integers(0, 20)))
        b = list(rng.choice(list("abcd"), rng.integers(0, 20)))
        assert rouge.lcs_length(a, b) == dp(a, b)


def test_isin_semi_join(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    keep = spark.createDataFrame([("a",), ("b",)], "key string")
    assert sorted(r.key for r in df.join(keep, "key", "left_semi").collect()) == ["a", "b"]


def test_classification_report_edges(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a"), ("b", "b")], "y_true string, y_pred string")
    rep = {r.label: r for r in metrics.classification_report(pred).collect()}
    assert set(rep) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert rep["c"].precision == 0.0 and rep["c"].support == 0           # predicted, absent from truth
    assert rep["a"].precision == 0.5 and rep["a"].recall == 0.5
    assert rep["accuracy"].f1 == 0.5
    assert math.isclose(rep["macro avg"].f1, (0.5 + 2 / 3 + 0.0) / 3)
    perfect = spark.createDataFrame([("a", "a"), ("b", "b")], "y_true string, y_pred string")
    assert all(r.f1 == 1.0 for r in metrics.classification_report(perfect).collect())
    never = spark.createDataFrame([("a", "b"), ("b", "b")], "y_true string, y_pred string")
    r = {x.label: x for x in metrics.classification_report(never).collect()}
    assert r["a"].precision == 0.0 and r["a"].f1 == 0.0                  # never predicted


def test_compare_reports(spark):
    pred_old = spark.createDataFrame([("a", "a"), ("b", "a")], "y_true string, y_pred string")
    pred_new = spark.createDataFrame([("a", "a"), ("b", "b"), ("z", "z")], "y_true string, y_pred string")
    old = metrics.classification_report(pred_old)
    new = metrics.classification_report(pred_new)
    c = metrics.compare_reports(old, new).collect()
    assert {r.label for r in c} == {"a", "b", "macro avg", "weighted avg"}  # 'z' only in new is ignored
    f1b = [r for r in c if r.label == "b" and r.metric == "f1"][0]
    assert f1b.old == 0.0 and f1b.new == 1.0 and f1b.delta == 1.0 and f1b.support == 1
    missing = metrics.classification_report(spark.createDataFrame([("a", "a")], "y_true string, y_pred string"))
    with pytest.raises(Exception):
        metrics.compare_reports(old, missing).collect()


def test_quantiles_and_box(spark):
    rng = np.random.default_rng(1)
    vals = [float(x) for x in rng.integers(0, 50, 101)] + [500.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    q = metrics.quantiles(df, "v", [0.25, 0.5, 0.75], ["g"]).first()
    assert np.allclose([q.q25, q.q50, q.q75], np.percentile(vals, [25, 50, 75]))
    b = metrics.box_stats(df, "v", ["g"]).first()
    assert b.n_fliers == 1 and b.whisker_high < 500


def test_score_stats_population(spark):
    df = spark.createDataFrame([("e", 0.5), ("e", 0.7)], "experiment string, score double")
    r = metrics.score_stats(df).first()
    assert math.isclose(r.var, np.var([0.5, 0.7])) and math.isclose(r.std, np.std([0.5, 0.7]))


def test_tag_groups_overlap(spark):
    df = spark.createDataFrame([("x.title.beam.spacytitle", 0.5)], "experiment string, mean double")
    assert [r.group_name for r in metrics.tag_groups(df).collect()] == ["BOTH_TITLES"]
    assert [r.group_name for r in metrics.tag_groups(df, grouping="decoding").collect()] == ["beam"]


def test_literal_decoding(spark):
    vals = ["['a', \"it's\", 'say \"x\"']", "['\\xa0x', 'y']", "['a', None]", "[]", "not a literal", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.v for r in df.select(plugins.decode_token_literal("s").alias("v")).collect()]
    assert got[0] == ["a", "it's", 'say "x"']
    assert got[1] == ["\xa0x", "y"]
    assert got[2] == ["a", None]
    assert got[3] == [] and got[4] is None and got[5] is None
    args = spark.createDataFrame([("[{'start': 1, 'end': 3, 'type': 2, 'text': \"O'Neil\"}]",)], "s string")
    a = args.select(plugins.decode_argument_literal("s").alias("a")).first().a
    assert (a[0].start, a[0].end, a[0].type, a[0].text) == (1, 3, 2, "O'Neil")
    rep = spark.createDataFrame([("it's",), ('say "x"',), ("both ' and \"",), ("back\\slash\nnl",)], "s string")
    for r in rep.select("s", plugins.py_repr_string(F.col("s")).alias("r")).collect():
        assert r.r == repr(r.s)


def test_label_encoding_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "event_type string")
    m = {r.event_type: r.label_id for r in trainset.label_mapping(train).collect()}
    assert m == {"a": 0, "b": 1, "c": 2}
    dev = spark.createDataFrame([(1, "z")], "id long, event_type string")
    with pytest.raises(Exception):
        trainset.encode_labels(dev, trainset.label_mapping(train)).collect()


def test_interleave_cycles(spark):
    a = spark.range(5)
    b = spark.range(2)
    s = sorted((r.step, r.task, r.cycle, r.batch) for r in trainset.interleave(a, b, 1, 1).collect())
    assert [(x[2], x[3]) for x in s if x[1] == "B"] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert [x[0] for x in s] == list(range(1, 11))
    s2 = sorted((r.step, r.task, r.batch) for r in trainset.interleave(spark.range(2), spark.range(5), 1, 1).collect())
    assert [x[1] for x in s2] == ["A", "B", "A", "B"]


def test_pad_and_arrays(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "id long, t array<int>").withColumn("batch", F.lit(0))
    p = {r.id: r.padded for r in trainset.pad_batch(df, "t", 0).collect()}
    assert p == {0: [1, 2, 3], 1: [4, 0, 0]}
    r = spark.createDataFrame([([0.1, 0.9, 0.9],)], "v array<double>").select(
        arrays.argmax("v").alias("a"), arrays.replace_ignore_index(F.array(F.lit(-100), F.lit(5)), 1).alias("r"),
        arrays.decode_model_label(F.lit("LABEL_7")).alias("d")).first()
    assert r.a == 1 and r.r == [1, 5] and r.d == 7


def test_tfidf_matches_formula(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["a", "c", "c", "d"], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, tokens array<string>")
    w, vocab, n = features.tfidf(df, n_min=1, n_max=1, min_df=1, max_df=1.0)
    got = {(r.id, r.term): r.weight for r in w.collect()}
    assert n == 4
    dfreq = {}
    for t in docs:
        for x in set(t):
            dfreq[x] = dfreq.get(x, 0) + 1
    for i, t in enumerate(docs):
        raw = {x: t.count(x) * (math.log((1 + n) / (1 + dfreq[x])) + 1) for x in set(t)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for x, v in raw.items():
            assert math.isclose(got[(i, x)], v / norm, rel_tol=1e-9)


def test_generator_plugin(spark):
    df = spark.createDataFrame([(0, "t", "Abc. Def.", "a", None, None)], CORPUS)
    gen = augment.generate_with(lambda texts, n: [[t.upper()] * n for t in texts], 2)
    out = augment.augment_corpus(df, n=2, generator=lambda c: gen(c)).where("source_doc_id is not null").collect()
    assert [r.text for r in out] == ["ABC. DEF.", "ABC. DEF."]


def test_keep_none_exact_mode_agrees(spark):
    rows = [(i, "t", f"text {i % 7}" if i % 3 else f"u{i}", "a", None, None) for i in range(60)]
    df = corpus(spark, rows)
    fast = sorted(r.id for r in dedup.keep_none(df).collect())
    exact = sorted(r.id for r in dedup.keep_none(df, exact=True).collect())
    assert fast == exact and len(fast) == 20


def test_augment_with_sparse_ids(spark):
    rows = [(10 * i + 5, "t", f"A{i}. B{i}.", "a", None, None) for i in range(4)]
    out = augment.augment_corpus(corpus(spark, rows), n=2).orderBy("id").collect()
    assert [r.id for r in out] == list(range(12))
    assert [r.source_doc_id for r in out[4:]] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert out[0].text == "A0. B0." and out[4].text == "A0." and out[5].text == "A0. B0."


def test_map_batches_and_case(spark):
    df = spark.createDataFrame([(1, "Ab cD"), (2, "x")], "id long, text string")
    out = plugins.map_batches(df, lambda p: p.assign(n=p.text.str.len())[["id", "n"]], "id long, n long",
                              columns=["id", "text"])
    assert sorted((r.id, r.n) for r in out.collect()) == [(1, 5), (2, 1)]
    r = df.select(tx.tokens("text", lowercase=False).alias("t")).orderBy("t").collect()
    assert [x.t for x in r] == [["Ab", "cD"], ["x"]]


def test_assignment_is_partitioning_independent(spark):
    """Permutation test: a different physical layout gives the same splits, folds and samples."""
    from hypothesis import given, settings, strategies as st
    base = spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("string").alias("event_type"))

    def answer(df):
        s = {r.id: r.split for r in splits.split_stratified(df, ["a", "b"], [0.7, 0.3], seed=9).collect()}
        f = {r.id: r.fold for r in splits.kfold_stratified(df, 4, seed=9).collect()}
        o = sorted(r.id for r in trainset.random_subset(df, 17, seed=9).collect())
        return s, f, o

    ref = answer(base)

    @settings(max_examples=3, deadline=None)
    @given(st.integers(min_value=1, max_value=13))
    def check(n):
        assert answer(base.repartition(n).sortWithinPartitions(F.rand(n))) == ref

    check()


def test_leakage_property_random_provenance(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.integers(min_value=0, max_value=39), min_size=1, max_size=60), st.integers(2, 5))
    def check(sources, k):
        rows = [(i, "t", "x", "ab"[i % 2], None, None) for i in range(40)]
        rows += [(100 + j, "t", "y", "ab"[s % 2], None, s) for j, s in enumerate(sources)]
        df = corpus(spark, rows)
        a = splits.kfold_leakage_safe(df, k, seed=3).collect()
        src = {r[0]: r[5] for r in rows}
        tested = {(r.fold, r.id) for r in a if r.role == "test"}
        assert sorted(i for _, i in tested) == list(range(40))
        assert not any(r.role == "train" and src[r.id] is not None and (r.fold, src[r.id]) in tested for r in a)
        assert len([r for r in a if r.id >= 100]) == len(sources) * (k - 1)

    check()


def test_hot_group_of_a_third(spark):
    """One text / one class holds a third of all rows: results stay whole and exact."""
    n = 3000
    rows = [(i, "t", "HOT" if i % 3 == 0 else f"doc {i}", "hot" if i % 3 == 0 else "c%d" % (i % 7), None, None)
            for i in range(n)]
    df = corpus(spark, rows)
    assert dedup.keep_none(df).count() == n - n // 3
    assert dedup.duplicates(df).where("n_copies = 1000").count() == 1000
    aug = corpus(spark, rows[:30] + [(10000 + i, "t", "HOT", "hot", None, i % 30) for i in range(900)])
    one = augment.subsample_unique_text(augment.augmented(aug)).collect()
    assert len(one) == 1 and one[0].text == "HOT"
    f = splits.kfold_stratified(df.select("id", "event_type"), 5, seed=1)
    sizes = sorted(r["count"] for r in f.where("event_type = 'hot'").groupBy("fold").count().collect())
    assert sizes == [200] * 5
    s = splits.split_stratified(df.select("id", "event_type"), ["a", "b"], [0.5, 0.5], seed=1)
    assert s.where("event_type = 'hot' and split = 'a'").count() == 500


def test_worker_cached_model(spark):
    c = corpus(spark, [(i, "t", "é" if i % 2 else "plain", "fr" if i % 2 else "en", None, None) for i in range(50)])
    model = plugins.worker_cached(lambda: plugins.RuleModel(["en", "fr"]), key="rule-en-fr")
    out = plugins.classify_with(c, model).groupBy("model_label").count().collect()
    assert {r.model_label: r["count"] for r in out} == {"LABEL_0": 25, "LABEL_1": 25}


def test_svm_fit_and_cv_properties(spark):
    """SVM scores are checked by property: near-perfect on separable train data, better than majority."""
    from augsight.operators import classify
    words = {0: "alpha beta gamma", 1: "delta epsilon zeta", 2: "eta theta iota"}
    rows = [(i, ["w%d" % (i % 5)] + words[i % 3].split() * 2, i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>, label_id int")
    train, test = docs.where("id < 45"), docs.where("id >= 45")
    pred = classify.fit_predict(train, {"test": test}, min_df=1, max_df=1.0, max_iter=10)
    rep = {(r.split, r.label): r for r in metrics.classification_report(pred, "label_id", "pred_id", by=["split"]).collect()}
    assert rep[("train", "accuracy")].f1 == 1.0
    assert rep[("test", "macro avg")].f1 > 1 / 3
    folds = splits.kfold_leakage_safe(docs.select("id", F.col("label_id").cast("string").alias("event_type"),
                                                  F.lit(None).cast("long").alias("source_doc_id")), 2, seed=1)
    cv = classify.cross_validate(docs, folds, 2, min_df=1, max_df=1.0, max_iter=10)
    assert cv.count() == 60
    assert metrics.macro_metrics(cv, "label_id", "pred_id").first().f1_macro > 0.9


def test_tfidf_ngrams_and_pruning_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [[str(x) for x in rng.choice(list("abcde"), rng.integers(0, 9))] for _ in range(25)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, tokens array<string>")
    w, vocab, n = features.tfidf(df, n_min=1, n_max=3, min_df=2, max_df=0.8)
    got = {(r.id, r.term): r.weight for r in w.collect()}

    def grams(t):
        return [" ".join(t[i:i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    dfreq = {}
    for t in docs:
        for g in set(grams(t)):
            dfreq[g] = dfreq.get(g, 0) + 1
    keep = {g for g, c in dfreq.items() if 2 <= c <= 0.8 * len(docs)}
    expected = {}
    for i, t in enumerate(docs):
        gs = [g for g in grams(t) if g in keep]
        raw = {g: gs.count(g) * (math.log((1 + len(docs)) / (1 + dfreq[g])) + 1) for g in set(gs)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected.update({(i, g): v / norm for g, v in raw.items()})
    assert set(got) == set(expected)
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in expected)
    assert {r.term for r in vocab.collect()} == keep


def test_rouge_n_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = ["the", "cat", "sat", "on", "mat", "A", "dog."]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 12))), " ".join(rng.choice(vocab, rng.integers(0, 12))))
            for i in range(40)]
    pairs = spark.createDataFrame(rows, "k long, prediction string, reference string")
    import re as _re
    from collections import Counter

    def toks(s):
        return [t for t in _re.split("[^a-z0-9]+", s.lower()) if t]
    for n in (1, 2):
        got = {r.k: r for r in rouge.rouge_n(pairs, n, ["k"]).collect()}
        for k, p, r in rows:
            gp = Counter(tuple(toks(p)[i:i + n]) for i in range(len(toks(p)) - n + 1))
            gr = Counter(tuple(toks(r)[i:i + n]) for i in range(len(toks(r)) - n + 1))
            ov = sum((gp & gr).values())
            P = ov / max(sum(gp.values()), 1)
            R = ov / max(sum(gr.values()), 1)
            F1 = 2 * P * R / (P + R) if P + R else 0.0
            assert math.isclose(got[k].precision, P) and math.isclose(got[k].recall, R)
            assert math.isclose(got[k].fmeasure, F1)


def test_split_sizes_formula(spark):
    for n in (1, 2, 7, 19, 50):
        got = splits.split_plain(spark.range(n), ["a", "b", "c"], [0.6, 0.25, 0.15], seed=2)
        c = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
        rem, exp = n, []
        for f in splits.stage_fractions([0.6, 0.25, 0.15]):
            take = math.floor(f * rem)
            exp.append(take)
            rem -= take
        exp.append(rem)
        assert [c.get(s, 0) for s in "abc"] == exp


def test_compact_assignment_equals_long_table(spark):
    df = _aug_fixture(spark)
    long_ = splits.kfold_leakage_safe(df, 3, seed=5).collect()
    compact = splits.fold_assignment(df, 3, seed=5)
    for f in range(3):
        train, test = splits.fold_members(compact, f)
        assert sorted(r.id for r in train.collect()) == sorted(r.id for r in long_ if r.fold == f and r.role == "train")
        assert sorted(r.id for r in test.collect()) == sorted(r.id for r in long_ if r.fold == f and r.role == "test")
