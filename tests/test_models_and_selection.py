"""Distributed solver, selection of ranks, positions of rows, count-table classifier: against plain numpy and Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsight.operators import bayes, classify, features, metrics, positions, quantiles, ranks, rouge, splits, svm, trainset
from augsight.sources.corpus import bounded


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


# --- linear SVM ---------------------------------------------------------------------------------

def newton(x, y, C):
    """Plain minimiser of |w|^2 / 2 + C * sum(max(0, 1 - y * x.w)^2)."""
    w = np.zeros(x.shape[1])
    value = lambda v: v @ v / 2 + C * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(100):
        on = y * (x @ w) < 1
        slope = w - 2 * C * x[on].T @ (y[on] - x[on] @ w)
        step = np.linalg.solve(np.eye(len(w)) + 2 * C * x[on].T @ x[on], slope)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-10:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-12:
            break
    return w, value(w)


def svm_tables(spark, seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, [f"c{i % 3}x{rng.randrange(6)}" if rng.random() < 0.4 else f"w{rng.randrange(25)}" for _ in range(rng.randrange(12))], i % 3) for i in range(n)]
    docs = features.materialize(spark.createDataFrame(rows, "id long, tokens array<string>, label_id int"))
    return rows, docs, features.materialize(features.term_frequencies(docs))


@pytest.mark.parametrize("parts,numbers", [(1, 1 << 17), (5, 40)])
def test_svm_reaches_the_optimum(spark, monkeypatch, parts, numbers):
    """One block, and five blocks of documents with many blocks of coefficients."""
    monkeypatch.setattr(svm, "NUMBERS", numbers)
    monkeypatch.setattr(svm, "SUMMED", 2)
    rows, docs, tf = svm_tables(spark)
    members = docs.select(F.lit(0).alias("model"), F.lit("train").alias("role"), "id", "label_id")
    vocab = features.materialize(svm.numbered(svm.training_idf(tf, members, 2, 1.0), 3))
    vectors = features.materialize(svm.weights(tf, members, vocab))
    blocks = features.materialize(svm.document_blocks(members, vectors, parts))
    needs = features.materialize(blocks.mapInPandas(svm._needs, "model int, role string, part int, block int, batch int, at int, places array<int>"))
    sizes = vocab.groupBy("model", "block").agg(F.count(F.lit(1)).cast("int").alias("size")).unionByName(
        spark.createDataFrame([(0, svm.INTERCEPT, 1)], "model int, block int, size int"))
    w = svm.fit(blocks, needs, sizes, 3, parts, tol=5e-4)
    column = {}
    found = {}
    for r in w.collect():
        table = np.frombuffer(bytes(r["w"]), np.float64).reshape(-1, 3)
        for place in range(r["size"]):
            found[r["block"], place] = table[place]
            column.setdefault((r["block"], place), len(column))
    x = np.zeros((len(rows), len(column)))
    x[:, column[svm.INTERCEPT, 0]] = 1
    for r in vectors.collect():
        x[r["id"], column[r["block"], r["place"]]] = r["weight"]
    mine = np.array([found[k] for k in column])
    for k in range(3):
        y = np.where(np.array([r[2] for r in rows]) == k, 1.0, -1.0)
        best = newton(x, y, 1.0)[1]
        own = mine[:, k] @ mine[:, k] / 2 + (np.maximum(0, 1 - y * (x @ mine[:, k])) ** 2).sum()
        assert own <= best * (1 + 1e-3)


def test_svm_products_read_the_documents_inside_the_margin(spark):
    """The others add nothing to them; a class that is there already asks for no document."""
    rows, docs, tf = svm_tables(spark, 4, 80)
    members = docs.select(F.lit(0).alias("model"), F.lit("train").alias("role"), "id", "label_id")
    vocab = features.materialize(svm.numbered(svm.training_idf(tf, members, 2, 1.0), 3))
    blocks = features.materialize(svm.document_blocks(members, svm.weights(tf, members, vocab), 4))
    rng = np.random.default_rng(5)
    kept, states = {}, []
    for b in blocks.collect():
        margins = rng.normal(0, 2, (len(b.ids), 3))
        y = np.where(np.array(b.labels)[:, None] == np.arange(3), 1, -1)
        kept |= {(i, k): y[n, k] * margins[n, k] < 1 for n, i in enumerate(b.ids) for k in range(3)}
        states.append((b.model, b.role, b.part, bytearray(margins.tobytes())))
    state = spark.createDataFrame(states, "model int, role string, part int, data binary")
    whole = {i: (b.labels[n], dict(zip((b.terms[c] for c in b.columns[b.first[n]:b.first[n + 1]]), b.entries[b.first[n]:b.first[n + 1]])))
             for b in blocks.collect() for n, i in enumerate(b.ids)}
    for going in ([True] * 3, [False, True, False], [False] * 3):
        found = {}
        for b in svm._inside(blocks, state, 3, {0: np.array(going)}).collect():
            assert len(b.margins) == 24 * len(b.ids) and sorted(set(b.columns)) == list(range(len(b.terms)))
            found |= {i: (b.labels[n], dict(zip((b.terms[c] for c in b.columns[b.first[n]:b.first[n + 1]]), b.entries[b.first[n]:b.first[n + 1]])))
                      for n, i in enumerate(b.ids)}
        assert found == {i: whole[i] for i in whole if any(kept[i, k] and going[k] for k in range(3))}


def test_svm_is_the_same_twice_and_predicts_every_row(spark):
    rows, docs, _ = svm_tables(spark, 2, 90)
    train, test = docs.where("id < 60"), docs.where("id >= 60").unionByName(spark.createDataFrame([(500, [], 1), (501, ["never seen"], 2)], docs.schema))
    one, two = (sorted(map(tuple, classify.fit_predict(train, {"test": test}, min_df=1).collect())) for _ in range(2))
    assert one == two and len(one) == 92
    assert np.mean([r[2] == r[3] for r in one if r[0] == "train"]) > 0.9


def test_svm_folds_in_one_fit(spark):
    """Models fitted together are those fitted alone; an augmentation without a source is in every training set."""
    rows, docs, _ = svm_tables(spark, 3, 60)
    a = spark.createDataFrame([(i, i >= 50, None if i >= 55 else i % 2) for i in range(60)], "id long, is_augmented boolean, test_fold int")
    roles = {(r.model, r.id): r.role for r in classify.fold_roles(a, 2).collect()}
    assert roles[0, 57] == roles[1, 57] == "train" and (0, 50) not in roles and roles[1, 50] == "train" and roles[0, 2] == "test"
    both = {(r.fold, r.id): r.pred_id for r in classify.cross_validate(docs, a, 2, min_df=1).collect()}
    ids = [{i for (m, i), role in roles.items() if m == 0 and role == want} for want in ("train", "test")]
    one = classify.fit_predict(docs.where(F.col("id").isin(ids[0])), {"test": docs.where(F.col("id").isin(ids[1]))}, min_df=1)
    assert {r.id: r.pred_id for r in one.where("split = 'test'").collect()} == {i: p for (f, i), p in both.items() if f == 0}
    assert set(both) == {(f, i) for f in (0, 1) for i in range(50) if i % 2 == f}


# --- ranks --------------------------------------------------------------------------------------

def test_ranks_with_an_outlier(spark):
    """Ids close together and one far away: ranges hold about equally many rows."""
    ids = spark.range(0, 60_000).select((F.col("id") * 3 + F.col("id") % 2).alias("id")).unionByName(spark.createDataFrame([(9 * 10 ** 18,), (-5,)], "id long"))
    df = features.materialize(ids)
    span = ranks.id_range(df)
    sizes = [r["count"] for r in df.groupBy(span.bucket("id")).count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 5 * 60_002 / len(sizes)
    out = ranks.id_rank(df, span)
    assert "SinglePartition" not in plan_of(out)
    got = {r["id"]: r["rank"] for r in out.collect()}
    assert [got[i] for i in sorted(got)] == list(range(60_002))


def test_bucket_of_cuts(spark):
    rng = random.Random(1)
    values = [rng.randrange(100) for _ in range(300)] + [None]
    df = spark.createDataFrame([(v, None if v is None else f"k{v:03d}") for v in values], "v long, s string")
    for n in (1, 2, 7, 16, 33):
        cuts = sorted(rng.sample(range(100), n))
        for r in df.select("v", ranks.cut_bucket("v", cuts).alias("b"), ranks.cut_bucket("s", [f"k{c:03d}" for c in cuts]).alias("t")).collect():
            want = 0 if r.v is None else sum(c <= r.v for c in cuts)
            assert r.b == want == r.t


def test_first_rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([rng.randrange(30_000), 777, None])) for i in range(30_000)]
    df = features.materialize(spark.createDataFrame(data, "id long, k long"))
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for n in (0, 1, 9_000, 10_500, 15_000, 29_999, 30_000, 40_000):
        out = ranks.first_rows(df, n, "k", ["id"])
        assert sorted(r.id for r in out.collect()) == sorted(i for i, _ in order[:n]), n
    assert "SinglePartition" not in plan_of(ranks.first_rows(df, 10_000, "k", ["id"]))
    subset = trainset.random_subset(df, 10_000)
    assert "SinglePartition" not in plan_of(subset) and subset.count() == 10_000
    assert sorted(r.id for r in bounded(df, 10_000).collect()) == list(range(10_000))


# --- quantiles ----------------------------------------------------------------------------------

def test_quantiles_of_odd_values(spark):
    rng = random.Random(3)
    groups = {"one": [5.0], "two": [1.0, 4.0], "same": [2.5] * 50, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(501)],
              "close": [1 + k * 2.0 ** -52 for k in range(300)], "ends": [math.inf, -math.inf, 0.0, -0.0, 1.7e308, 5e-324, -5e-324],
              "many": [rng.gauss(0, 1) for _ in range(3000)], None: [1.0, 2.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("two", None), ("two", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], ["g"]).collect()}
    assert set(got) == set(groups) | {"none"} and got["none"].q50 is None
    for g, vs in groups.items():
        s = sorted(vs)
        for p, q in zip((0.0, 0.1, 0.5, 0.9, 1.0), list(got[g])[1:]):
            h = (len(s) - 1) * p
            lo, hi = s[math.floor(h)], s[math.ceil(h)]
            want = lo if lo == hi else lo * (1 - h % 1) + hi * (h % 1)
            assert q == want or math.isclose(q, want, rel_tol=1e-12), (g, p)
    whole = quantiles.quantiles(df.where("g in ('one', 'two')"), "v", [0.5]).first()
    assert whole.q50 == 4.0


def test_quantiles_of_ten_million_values(spark):
    df = spark.range(0, 10_000_000, 1, 16).select(F.when(F.col("id") % 10 == 0, "few").otherwise("most").alias("g"),
                                                  ((F.col("id") * 7919) % 10_000_019 + F.lit(0.25)).alias("v"))
    out = quantiles.quantiles(df, "v", [0.25, 0.5], ["g"])
    assert "percentile" not in plan_of(out)
    ids = np.arange(10_000_000, dtype=np.int64)
    v = (ids * 7919) % 10_000_019 + 0.25
    got = {r.g: (r.q25, r.q50) for r in out.collect()}
    for g, on in (("few", ids % 10 == 0), ("most", ids % 10 != 0)):
        assert np.allclose(got[g], np.percentile(v[on], [25, 50]), rtol=1e-12)


# --- positions ----------------------------------------------------------------------------------

def test_positions_do_not_follow_the_packing(spark, tmp_path):
    rows = spark.range(0, 5000).select("id", F.concat(F.lit("text\n"), "id").alias("text"))
    rows.repartitionByRange(13, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "docs"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").select(F.concat(F.lit("made "), "id").alias("made")).write.json(str(tmp_path / "made"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").select(F.concat(F.lit("line "), "id").alias("value")).write.text(str(tmp_path / "lines"))
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        for limit, cost, parts in (("128m", "4m", "1"), ("10k", "1", "20")):
            for k, v in zip(sizes, (limit, cost, parts)):
                spark.conf.set(k, v)
            both = positions.positional_join(spark.read.parquet(str(tmp_path / "docs")), spark.read.schema("made string").json(str(tmp_path / "made")))
            assert all(r.made == f"made {r.id}" and r.position == r.id for r in both.collect()) and both.count() == 5000
            lines = positions.with_positions(spark.read.text(str(tmp_path / "lines")))
            assert all(r.value == f"line {r.position}" for r in lines.collect()) and lines.count() == 5000
            with pytest.raises(ValueError, match="5000 rows cannot be joined with 4999"):
                positions.positional_join(spark.read.parquet(str(tmp_path / "docs")), spark.read.text(str(tmp_path / "lines")).where("value <> 'line 7'"))
    finally:
        for k in sizes:
            spark.conf.unset(k)


# --- naive Bayes --------------------------------------------------------------------------------

def plain_bayes(train, texts, n_max, a):
    grams = lambda t: [" ".join(t[i:i + n]) for n in range(1, n_max + 1) for i in range(len(t) - n + 1)]
    counts, docs = {}, Counter(label for _, label in train)
    for tokens, label in train:
        counts.setdefault(label, Counter()).update(grams(tokens))
    known = set().union(*counts.values()) if counts else set()
    out = []
    for tokens in texts:
        g = [x for x in grams(tokens) if x in known]
        out.append(min((-(math.log(docs[c] / len(train)) + sum(math.log((counts[c][x] + a) / (sum(counts[c].values()) + a * len(known))) for x in g)), c)
                       for c in docs)[1])
    return out


def test_naive_bayes(spark):
    rng = random.Random(4)
    words = {c: [f"{c}{i}" for i in range(6)] + ["both", "all"] for c in "abc"}
    rows = [(i, [rng.choice(words[rng.choice("abc")] if rng.random() < 0.4 else words["abc"[i % 3]]) for _ in range(rng.randrange(9))], "abc"[i % 3]) for i in range(150)]
    docs = features.materialize(spark.createDataFrame(rows, "id long, tokens array<string>, label string"))
    for n_max, a in ((1, 1.0), (2, 0.1)):
        got = {r.id: r.y_pred for r in bayes.predict(docs, "tokens", bayes.fit(docs.where("id < 100"), "tokens", "label", n_max, a), n_max).collect()}
        assert [got[i] for i in range(150)] == plain_bayes([(t, c) for i, t, c in rows if i < 100], [t for _, t, _ in rows], n_max, a)
    folded = features.materialize(docs.select("id", "label", (F.col("id") % 4).cast("int").alias("fold")))
    grams = features.materialize(bayes.gram_counts(docs.withColumn("run", F.lit("x")), "tokens", 2, ["run", "id"])
                                 .unionByName(bayes.gram_counts(docs.withColumn("run", F.lit("y")), "tokens", 1, ["run", "id"])))
    got = {(r.run, r.smoothing, r.id): r.y_pred for r in bayes.cross_validate(grams, folded, [0.5, 2.0]).collect()}
    for run, n_max in (("x", 2), ("y", 1)):
        for a in (0.5, 2.0):
            for f in range(4):
                own = [(i, t) for i, t, _ in rows if i % 4 == f]
                want = plain_bayes([(t, c) for i, t, c in rows if i % 4 != f], [t for _, t in own], n_max, a)
                assert [got[run, a, i] for i, _ in own] == want
    assert len(got) == 600


# --- ROUGE-Lsum ---------------------------------------------------------------------------------

def table_lcs(ref, cand):
    rows = [[0] * (len(cand) + 1)]
    for x in ref:
        row = [0]
        for j, y in enumerate(cand):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    i, j, out = len(ref), len(cand), []
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_common_subsequence_is_that_of_the_full_table():
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        assert rouge._lcs_places(a, b) == table_lcs(a, b)
    a, b = ([rng.choice("abcdefgh") for _ in range(100_000)] for _ in range(2))
    assert len(rouge._lcs_places(a, b)) == rouge.lcs_length(a, b)


# --- interleaved tasks --------------------------------------------------------------------------

def test_permutation_of_any_size(spark):
    from augsight.functions.permute import permuted, unpermuted
    for n in (1, 2, 3, 10, 101, 1024):
        rows = spark.range(n).select("id", permuted(F.col("id"), n, F.lit("7")).alias("p"), permuted(F.col("id"), n, F.lit("8")).alias("q"))
        back = rows.select("*", unpermuted(F.col("p"), n, F.lit("7")).alias("back")).collect()
        assert sorted(r.p for r in back) == sorted(r.q for r in back) == list(range(n)) and all(r.back == r.id for r in back)
        assert n < 10 or [r.p for r in back] != [r.q for r in back]


def test_interleave_of_a_thousand_cycles(spark):
    a, b = spark.range(4000), spark.range(100, 110)
    every = trainset.interleave(a, b, 2, 5)  # 2 000 batches of A, 2 of B
    rows = sorted(map(tuple, every.collect()))
    assert len(rows) == 4000 + 2000 * 5 and {r[2] for r in rows if r[1] == "B"} == set(range(1000))
    by_cycle = {}
    for step, task, cycle, batch, key in rows:
        if task == "B":
            assert step == 2 * (2 * cycle + batch) + 2
            by_cycle.setdefault(cycle, []).append(key)
    assert all(sorted(k) == [str(i) for i in range(100, 110)] for k in by_cycle.values())
    assert len({tuple(k[:5]) for k in by_cycle.values()}) > 100  # shuffled anew
    for span in ((1, 1), (2, 2), (1501, 1520), (3999, 5000)):
        part = trainset.interleave(a, b, 2, 5, steps=span)
        assert sorted(map(tuple, part.collect())) == [r for r in rows if span[0] <= r[0] <= span[1]]


# --- sentences, dictionary, summaries -----------------------------------------------------------

def test_abbreviations_do_not_end_sentences(spark):
    from augsight.operators import sentences
    rng = random.Random(6)
    text = lambda i: (f"We met Dr. Alba{i} near the river. She saw e.g. stones and the sea. Mr. Cole went home! "
                      + " ".join(f"Here the river and the sea were home to word{rng.randrange(300)}." for _ in range(4)))
    docs = spark.createDataFrame([(i, text(i)) for i in range(60)] + [(100, None), (101, ""), (102, "no stop"), (103, "Dr. Dr. river. End")], "id long, text string")
    found = sentences.abbreviations(docs)
    words = {r.word for r in found.collect()}
    assert {"dr", "mr", "e.g"} <= words and not words & {"river", "sea", "here", "home"}
    got = {r.id: r.sentences for r in sentences.split_sentences(docs, found).collect()}
    assert got[0][:3] == ["We met Dr. Alba0 near the river.", "She saw e.g. stones and the sea.", "Mr. Cole went home!"] and len(got[0]) == 7
    assert got[100] is None and got[101] == [""] and got[102] == ["no stop"] and got[103] == ["Dr. Dr. river.", "End"]


def test_dictionary_of_a_hundred_thousand_entries():
    import time
    from augsight.operators.plugins import dictionary_translator

    def plain(text, mapping, whole):
        out, i = "", 0
        ok = lambda j: not (0 <= j < len(text) and text[j].isascii() and text[j].isalnum())
        while i < len(text):
            hit = max((k for k in mapping if k and text.startswith(k, i) and (not whole or ok(i - 1) and ok(i + len(k)))), key=len, default=None)
            out, i = (out + mapping[hit], i + len(hit)) if hit else (out + text[i], i + 1)
        return out
    rng = random.Random(7)
    for _ in range(300):
        mapping = {"".join(rng.choice("ab é") for _ in range(rng.randrange(1, 5))): rng.choice(["X", "", "ab"]) for _ in range(rng.randrange(6))}
        text = "".join(rng.choice("ab éA1") for _ in range(rng.randrange(40)))
        for whole in (False, True):
            assert dictionary_translator(mapping, whole)([text, None]) == [plain(text, mapping, whole), None]
    assert dictionary_translator({"a": "b", "b": "a"})(["abba"]) == ["baab"]  # what an entry puts in stays
    translate = dictionary_translator({f"w{i}": f"v{i}" for i in range(100_000)}, whole_words=True)
    text = " ".join(f"w{rng.randrange(200_000)}" for _ in range(100_000))
    translate([text])
    start = time.time()
    assert translate([text])[0].split() == [f"v{w[1:]}" if int(w[1:]) < 100_000 else w for w in text.split()]
    assert time.time() - start < 10


def test_sentence_graph():
    from augsight.operators.extract import SentenceGraph, rank_generator
    rng = random.Random(8)
    sents = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8))] for _ in range(30)]
    graph = SentenceGraph(sents)
    m = np.array([[s.count(t) for t in "abcdefgh"] for s in sents], float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    cos = m @ m.T
    rank = np.full(30, 1 / 30)
    for _ in range(20):
        rank = 0.15 / 30 + 0.85 * cos @ np.divide(rank, cos.sum(1), out=np.zeros(30), where=cos.sum(1) > 0)
    assert np.allclose(graph.ranks(), rank)
    assert np.allclose(graph.cosines(3), cos[3])
    assert rank_generator(["The cat sat. The cat sat. A dog ran far! Cat and dog sat.", "", "x"], 2)[0][1] == "The cat sat. Cat and dog sat."
    assert rank_generator(["", "x"], 2) == [["", ""], ["x", "x"]]
