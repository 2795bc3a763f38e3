"""n-grams of blocks of documents: exact counts, and models and weights that do not follow the blocks."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augsight.operators import bayes, features, plugins, sentences
from augsight.operators import grams as gr

TEXTS = [["a", "b", "a", "b", "a"], [], ["b"], ["é", "a\x00", "a", "b", "x" * 5000], ["a", "b"] * 40, None]


def test_block_counts_are_exact():
    tokens = gr.tokens_of(pa.array([None if t is None else gr.SEP.join(t) for t in TEXTS]))
    for n in (1, 2, 3):
        c = gr.counted(tokens, n)
        spelled = c.names.tolist() and gr.Tokens.spelled(tokens, c.at, n).to_pylist()
        got = {(int(d), spelled[t]): int(k) for t, d, k in zip(c.term, c.doc, c.tf)}
        want = Counter((d, " ".join(t[i:i + n])) for d, t in enumerate(TEXTS) if t for i in range(len(t) - n + 1))
        assert got == dict(want)
        assert len(set(spelled)) == len(c.names) and [hi - lo for _, lo, hi in gr.ranges(c.names, 1)] == [len(c.names)]
        assert sum(hi - lo for _, lo, hi in gr.ranges(c.names, 7)) == len(c.names)


def test_colliding_names_raise():
    import numpy as np
    with pytest.raises(ValueError):
        gr.merged([np.array([5], np.uint64), np.array([5], np.uint64)], [np.array([1], np.uint16), np.array([2], np.uint16)])


def test_models_of_one_view_share_its_grams(spark, monkeypatch):
    monkeypatch.setattr(gr, "LEAST_BYTES", 64)
    rows = [(i, "ab"[i % 2], i % 3, [f"{'ab'[i % 2]}{j % (i % 4 + 1)}" for j in range(i % 5)] + ["z"]) for i in range(40)]
    docs = features.materialize(spark.createDataFrame(rows, "id long, label string, fold int, tokens array<string>"))
    grams = bayes.gram_counts(docs.withColumn("run", F.lit("v")), "tokens", 2, ["run", "id"])
    assert grams.count() == 40  # a row for each text, not one for each of its grams
    shared = bayes.cross_validate(grams, docs, [0.1, 1.0], {"one": ("v", 1), "two": ("v", 2)}).collect()
    for name, n in (("one", 1), ("two", 2)):
        alone = bayes.cross_validate(grams.withColumn("n_max", F.lit(n)), docs, [0.1, 1.0]).collect()
        assert {(r.smoothing, r.id): r.y_pred for r in shared if r.run == name} == {(r.smoothing, r.id): r.y_pred for r in alone}
    assert len(shared) == 160


def test_a_model_is_counted_and_looked_up_in_blocks(spark, monkeypatch):
    """No row for each occurrence of a term; labels in the rows or beside them, tokens as arrays or joined, few blocks or many."""
    rows = [(i, "abc"[i % 3] if i < 30 else None, [f"{'abc'[i % 3]}{(i * j) % 5}" for j in range(i % 6)] + ["z"]) for i in range(45)] + [(50, None, None), (51, "c", [])]
    docs = features.materialize(spark.createDataFrame(rows, "id long, label string, tokens array<string>"))
    one = bayes.predict(docs, "tokens", bayes.fit(docs, "tokens", "label", 2, 0.5), 2)
    want = {r.id: r.y_pred for r in one.collect()}
    assert len(want) == 47 and want[50] == want[51] == "c"
    monkeypatch.setattr(gr, "LEAST_BYTES", 64)
    joined = features.materialize(docs.select("id", gr.joined("tokens").alias("tokens")))
    many = bayes.fit(joined, "tokens", "label", 2, 0.5, labels=docs.select("id", "label"))
    assert many.terms.count() > 2
    for fitted in (many, bayes.fit(docs, "tokens", "label", 2, 0.5)):
        pred = bayes.predict(joined, "tokens", fitted, 2)
        assert {r.id: r.y_pred for r in pred.collect()} == want
        assert "Generate" not in pred._jdf.queryExecution().executedPlan().toString()
    assert bayes.predict(docs, "tokens", bayes.fit(docs.where("id < 0"), "tokens", "label")).count() == 0


def test_terms_stay_in_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(gr, "LEAST_BYTES", 64)
    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 6)]) for i in range(30)] + [(3, ["w0", "w1"])]  # an id twice is one document
    docs = features.materialize(spark.createDataFrame(rows, "id long, tokens array<string>"))
    weights, vocab, n = features.tfidf(docs, n_max=2, min_df=2)
    assert not [x for x in weights._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "term" in x]
    tf = features.term_frequencies(docs, n_max=2)
    want = {(r.term, r.df) for r in features.document_frequency(tf, n, 2).collect()}
    assert {(r.term, r.df) for r in vocab.collect()} == want == {tuple(r) for r in features.document_frequencies(docs, n, 2, n_max=2).collect()}
    got = {(r.id, r.term): (r.tf, round(r.weight, 12)) for r in weights.collect()}
    assert {k: v[0] for k, v in got.items()} == {(r.id, r.term): r.tf for r in tf.collect() if r.term in dict(want)}
    again = features.tfidf(docs, n_max=2, vocab=vocab, n_docs=n)[0]
    assert {(r.id, r.term): (r.tf, round(r.weight, 12)) for r in again.collect()} == got


def test_plugins_get_small_batches(spark):
    import __spark_entry__ as e
    from augsight import session
    e._shipped(lambda s, d: None)(spark, "")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == session.ARROW_BYTES

    def tokenizer(texts):
        return [[str(sum(map(len, texts)))] for _ in texts]
    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("a"), 100_000).alias("text"))
    sizes = [int(r[0][0]) for r in long.select(plugins.tokenize_with("text", tokenizer).alias("t")).collect()]
    assert len(sizes) == 400 and max(sizes) < 6 << 20  # 40 MB in one batch before


def test_argument_literals_are_written_once(spark):
    import __spark_entry__ as e
    said = ["it's", 'say "x"', "a'b\"c", "tab\t\\n\nx", ""]
    rows = spark.createDataFrame([(said,)], "s array<string>").select(plugins.py_repr_strings(F.col("s")).alias("r"), F.transform("s", plugins.py_repr_string).alias("one"))
    got = rows.first()
    assert got["r"] == got["one"] and [eval(x) for x in got["r"]] == said
    plan = e.queries()["literal_arguments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1  # a place is looked for once, not for every column that reads it


def test_sentences_are_joined_without_windows(spark):
    docs = spark.createDataFrame([(1, "Dr. A went. He etc. left."), (2, None), (3, ""), (4, "A. b"), (5, "end dr.")], "id long, text string")
    found = sentences.split_sentences(docs, spark.createDataFrame([("dr",), ("etc",)], "word string"))
    assert {r.id: r.sentences for r in found.collect()} == {1: ["Dr. A went.", "He etc. left."], 2: None, 3: [""], 4: ["A.", "b"], 5: ["end dr."]}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
