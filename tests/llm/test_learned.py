"""Operators that learn, on tables made so that the right answer is known; and the pipeline against plain steps."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsight.llm import language, pii, token_store, toxicity
from augsight.llm.common import staged

from .test_exact import plain_contamination, plain_groups, plain_targets
from .util import crc, odd_rows, table, words

VOCAB = {"en": "the and that with have this from they were which would there".split(),
         "de": "der und dass mit haben diese von sie waren welche würde dort".split(),
         "ru": "и что с иметь это из они были который бы там слово".split(),
         "el": "και ότι με έχουν αυτό από αυτοί ήταν οποίο εκεί λέξη".split()}


def sentences(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) for _ in range(n))


def language_table(spark, extra=False):
    rng = random.Random(1)
    rows = [(i, sentences(rng, lang, rng.randrange(3, 60)), lang, "s") for i, lang in
            enumerate(rng.choice(list(VOCAB)) for _ in range(300))]
    odd = [(1000 + i, t, None, None) for i, t in enumerate(["", None, "12 34 !!", "   "])]
    return table(spark, rows + odd, extra)


def test_language_of_held_out_documents(spark):
    docs = language_table(spark, extra=True)
    got = language.language_digest(docs).collect()
    assert len(got) == docs.count()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    for r in got:
        assert r["held_out"] == (crc(str(r["doc_id"])) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == (lang[r["doc_id"]] or "und")


def test_language_labels_of_held_out_rows_are_not_used(spark):
    docs = language_table(spark)
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.language_digest(d).fillna(-1, "doc_id").collect())) for d in (docs, wrong))
    assert a == b


def test_mixed_text_falls_into_spans(spark):
    rng = random.Random(2)
    model = language.fit(language_table(spark))
    text = sentences(rng, "en", 30) + ". " + sentences(rng, "de", 50) + " -- " + sentences(rng, "ru", 20)
    out = language.predictions(table(spark, [(1, text, None, None), (2, None, None, None)]), model, with_spans=True).collect()
    one = next(r for r in out if r["doc_id"] == 1)
    assert [s["lang"] for s in one["spans"]] == ["en", "de", "ru"] and one["lang_pred"] == "de"
    starts = [s["start"] for s in one["spans"]]
    assert starts[0] == 0 and text[starts[1]:].split()[0] in VOCAB["de"] and text[starts[2]:].split()[0] in VOCAB["ru"]
    assert next(r for r in out if r["doc_id"] == 2)["spans"] == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 3, 0, 7, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 2, (first[-1], 3)).astype(np.float32)
    got = language.viterbi(scores, first, penalty=1.5)

    def value(d, path):
        own = scores[first[d]:first[d + 1]]
        return sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    import itertools
    for d, n in enumerate(sizes):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: value(d, p))
        assert value(d, got[first[d]:first[d + 1]].tolist()) == pytest.approx(value(d, best), abs=1e-4)


def test_language_without_training_rows(spark):
    docs = table(spark, [(i, "words in here", None, None) for i in range(5)])
    assert {(r["lang_pred"], r["score"]) for r in language.language_digest(docs).collect()} == {("und", 0.0)}
    assert language.language_digest(table(spark, [])).count() == 0
    kept = language.identified(language_table(spark, extra=True))
    assert kept.count() == 300 and "_hit_id" in kept.columns


# --- toxicity ---------------------------------------------------------------------------------

def toxic_table(spark, n=900, seed=4):
    """Toxic only where an insult meets a group, or where a slur with a changing ending stands."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 40))]
        insult, group, slur = rng.random() < 0.35, rng.random() < 0.35, rng.random() < 0.1
        text += ["Insult!"] * insult + ["grouped,"] * group + [f"slurr{rng.choice('abcdefghij')}{rng.choice('xyz')}q"] * slur
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int((insult and group) or slur)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark):
    rows, labels = toxic_table(spark)
    marks = spark.createDataFrame(labels + [(5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(2000, "", None, None), (2001, None, None, None)], extra=True)
    got = toxicity.toxicity_digest(docs, marks).collect()
    assert len(got) == len(rows) + 2
    toxic = dict((i, t) for i, _, t in labels)
    right = Counter()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (crc(str(r["doc_id"])) % 3 == 1)
        if r["held_out"] and r["doc_id"] in toxic:
            right[toxic[r["doc_id"]], r["predicted"]] += 1
    assert right[1, 1] >= 0.9 * (right[1, 0] + right[1, 1])
    assert right[0, 0] >= 0.95 * (right[0, 0] + right[0, 1])
    assert {r["predicted"] for r in got if r["doc_id"] in (2000, 2001)} == {0}


def test_pair_weight_of_the_machine():
    """Exclusive or of two terms: no sum of term weights separates it, the pair does."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    text = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    at = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    label = (a ^ b).astype(float)
    m = toxicity.train(np.arange(2, dtype=np.uint64), text, at, label, epochs=600)
    raw, _ = m.raw(text, at, 400)
    assert ((raw > 0) == (label == 1)).mean() == 1.0


def test_exclusive_or_through_the_fit(spark):
    """Two words that are toxic only one without the other, among words that say nothing."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"noise{rng.randrange(20)}" for _ in range(20)] + ["ampel"] * a + ["brücke"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, 1, int(a != b)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity_digest(table(spark, rows), marks).collect() if r["held_out"]]
    assert len(got) > 500
    assert sum((r["score"] >= 0.5) == bool(labels[r["doc_id"]][2]) for r in got) >= 0.95 * len(got)


def test_toxicity_without_two_classes(spark):
    rows, labels = toxic_table(spark, 30)
    marks = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_digest(table(spark, rows + odd_rows()), marks).collect()
    assert {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity_digest(table(spark, []), marks).count() == 0
    assert toxicity.toxicity_digest(table(spark, rows), marks.filter("false")).count() == 30


# --- PII --------------------------------------------------------------------------------------

def test_personal_data_that_no_base_pattern_meets(spark):
    """Few base spans teach: national phone numbers and e-mails with a letter beyond ASCII before the @ are added."""
    rng = random.Random(14)
    rows, wrong = [], ["2023-11-05", "05.11.2023", "1990-2000", "12345.6789", "1234567890", "name@host", "4111.1111.1111.1112", "1.2.3.400"]
    for i in range(160):
        near = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        planted = rng.choice([f"+1 {near}", f"who.{i}@mail{i % 7}.example.com", rng.choice(wrong)])
        rows.append((i, f"{sentences(rng, 'en', 5)} {planted} {sentences(rng, 'en', 5)}", "en", "a"))
    unseen = {1000: ("phone", "(555) 123-4567"), 1001: ("phone", "743-555-3824"), 1002: ("email", "josé@firma.es"), 1003: ("email", "rené@mail.example.com")}
    rows += [(i, f"{sentences(rng, 'en', 4)} {x} {sentences(rng, 'en', 4)}", "en", "a") for i, (_, x) in unseen.items()]
    rows += [(2000 + i, f"{sentences(rng, 'en', 4)} {x} {sentences(rng, 'en', 4)}", "en", "a") for i, x in enumerate(wrong)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(table(spark, rows)).collect()}
    for i, text, _, _ in rows:
        if i in unseen:
            kind, x = unseen[i]
            assert got[i] == f"{kind}:{text.index(x)}:{text.index(x) + len(x)}"
        if i >= 2000:
            assert got[i] == ""


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_against_plain_steps(spark, tmp_path):
    import corpus_pipeline
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = staged(stage(spark, docs, sf_dir), name)
        after = [tuple(r) for r in docs.collect()]
        kept.append((name, len(after)))
        if name != "token_output":
            assert docs.columns == columns
        if name == "language_id":
            assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
        if name == "jaccard_join":
            named = plain_groups([r[:2] for r in before])
            assert Counter(after) == Counter(r for r, (i, _, c) in zip(before, named) if i == c)
        if name == "decontamination":
            hit = plain_contamination([r[:2] for r in before], items)
            assert Counter(after) == Counter(r for r, h in zip(before, hit) if not h[-1])
        if name == "mixing":
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r[3]] += len(words(r[1]))
            for r in after:
                got[r[3]] += len(words(r[1]))
            for s, t in plain_targets(dict(sizes)).items():
                assert abs(got[s] - t) <= 1
            whole = {r[0]: r for r in before}
            cut = [r for r in after if r != whole[r[0]]]
            assert len(cut) <= len(sizes) and max(Counter(r[0] for r in after).values()) <= 3
            for r in cut:
                assert words(whole[r[0]][1])[:len(words(r[1]))] == words(r[1])
        if name == "token_output":
            encoder, _ = token_store._encoder(token_store.TOKENIZER, token_store.PATTERN)
            tokens = Counter()
            for r in before:
                tokens[r[0]] += len(encoder.encode_ordinary(r[1])) + 1
            got = defaultdict(int)
            for r in docs.collect():
                got[r["doc_id"]] += r["n_tokens"]
            assert dict(got) == dict(tokens)
            assert sorted(r["slot"] for r in docs.collect()) == list(range(len(after)))
    assert all(n for _, n in kept)


def test_pipeline_keeps_texts_without_doc_id(spark, tmp_path):
    """A group of copies with a null doc_id goes by its smallest doc_id; a text that is there with a null one only is written."""
    import corpus_pipeline
    rng = random.Random(15)
    rows = [(i, sentences(rng, "en", 40) + f" only{i}", "en", "s") for i in range(40)]
    copies, alone = sentences(rng, "en", 40) + " copies", sentences(rng, "en", 40) + " alone"
    rows += [(None, copies, "en", "s"), (71, copies, "en", "s"), (70, copies, "en", "s"), (None, alone, "en", "s")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, "nothing of this stands in any of the documents at all today")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["n_tokens"]
    encoder, _ = token_store._encoder(token_store.TOKENIZER, token_store.PATTERN)
    want = {i: len(encoder.encode_ordinary(t)) + 1 for i, t, _, _ in rows if i != 71 and t != copies}
    assert got == want | {70: len(encoder.encode_ordinary(copies)) + 1}
