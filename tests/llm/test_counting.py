"""Operators 11 to 13 against plain Python, and results that must not follow the packing of files."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from augsight.llm import collocations, decontaminate, divergence, grams, nearest, pii, substring_dedup, token_store
from augsight.llm import common

from .util import lower, odd_rows, stored, table


# --- 11 nearest vectors -------------------------------------------------------------------------

def brute(rows, nearest_n, every):
    """Every query's nearest among all usable rows."""
    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            if (i, tuple(v)) not in usable:
                usable.append((i, tuple(v)))
    out = {}
    for i, v in usable:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in usable if j != i and len(w) == len(v))
            out.setdefault(i, []).append(near[:nearest_n])
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, list string, k1 int")


def test_nearest_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1.0, 1.0]), (101, [1.0, 2.0]), (102, [-3.0, 0.0]), (None, [1.0, 2.0, 3.0]), (103, None), (104, []), (105, [0.0, 0.0, -0.0]),
             (106, [1.0, None, 2.0]), (107, [float("nan"), 1.0, 1.0]), (110, [float("inf"), 1.0, 1.0]), (7, rows[7][1]), (7, rows[7][1]),
             (200, [9.0, 9.0, 9.0, 9.0])]
    want = brute(rows, 10, 10)
    got = defaultdict(list)
    for r in nearest.search(vectors(spark, rows), every=10).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    for i, answers in want.items():
        assert [x[1:] for x in sorted(got[i])] == answers[0], i
        assert [x[0] for x in sorted(got[i])] == list(range(1, len(answers[0]) + 1))
    assert {i for i, a in got.items() if a} == {i for i, a in want.items() if a[0]}
    assert nearest.search(vectors(spark, []), every=10).count() == 0


def test_nearest_in_lists(spark, monkeypatch):
    """Clustered vectors, a third of them one vector, many lists and chunks: recall against brute force."""
    monkeypatch.setattr(nearest, "CHUNK", 64)  # the driver's own; workers keep theirs
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((30, 24))
    m = middle[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 24))
    m[::3] = m[0]
    rows = [(i, v) for i, v in enumerate(m.tolist())]
    got = defaultdict(list)
    for r in nearest.search(vectors(spark, rows), sample=1500).collect():
        got[r.query_id].append((r.score, r.vec_id))
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        total += 10
        hit += len(set(want.tolist()) & {j for _, j in got[q]})
        assert all(abs(s - d[j]) < 1e-12 for s, j in got[q]) and len(got[q]) == 10
    assert hit / total >= 0.95


def test_adaptive_scan_gives_up_early():
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((32, 64))
    m, asked = middle[rng.integers(0, 32, 2048)] + 0.4 * rng.standard_normal((2048, 64)), middle[:8] + 0.4 * rng.standard_normal((8, 64))
    turned = nearest.rotated(m).astype(np.float32)
    blocks = [np.ascontiguousarray(turned[:, lo:lo + nearest.BLOCK]) for lo in range(0, 64, nearest.BLOCK)]
    best, place, read = nearest.scan(asked, np.full(8, np.inf), blocks, m, np.arange(2048), 11)
    d = np.sqrt(((m[None] - asked[:, None]) ** 2).sum(2))
    hit = sum(len(set(np.argsort(d[q])[:11]) & set(place[q])) for q in range(8))
    assert hit >= 0.95 * 88 and np.allclose(best[0], np.sort(d[0])[:11])
    assert read < 0.5 * m.size * 8  # many candidates are given up before their last columns


# --- 12 collocations ----------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        rows_ = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * c >= 50 * a for q, c in counts.items() if len(q) > len(p) and c >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "été", "中文", "x y", "e-mail", *("w%d" % i for i in range(60))]
    text = lambda: "".join(rng.choice(words[:rng.choice([4, 8, len(words)])]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
    return [(i, text(), rng.choice(["en", "en", "de", None, "und"]), "a") for i in range(n)] + odd_rows()


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations(spark, tmp_path, shards):
    rows = phrase_rows(6)
    docs = stored(spark, table(spark, rows, extra=True), tmp_path / "docs")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=50, shards=shards).collect())
    assert got == plain_collocations(rows, 4, 50)


def test_collocations_slots_that_all_share(spark, monkeypatch):
    """With few slots nearly every phrase starts early; counts are the same."""
    monkeypatch.setattr(collocations, "SLOTS", (1 << 15, 1 << 15))
    rows = phrase_rows(7, 500)
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least=3, top=30).collect())
    assert got == plain_collocations(rows, 3, 30)
    assert collocations.collocations(table(spark, [])).count() == 0


# --- 13 divergence ------------------------------------------------------------------------------

def plain_divergence(rows, least, top):
    found = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(lang or "", source or "", [lower(w) for w in found.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, c in df.items() if c >= least), key=str.encode)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, w in own:
            counts[s].update(t for t in w if df[t] >= least)
        p_of = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: p_of(c) for s, c in counts.items()}
        q = p_of(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, i) for i, (v, x) in enumerate(listed, 1)]
    return sorted(out)


def source_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["Straße", "ÉTÉ", "中文", "and", "An", "ant", "ants", "a", *("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60))]
    return [(i, " ".join(rng.choice(words[:rng.choice([9, len(words)])]) + rng.choice(["", "1", "-x"]) for _ in range(rng.randrange(30))),
             rng.choice(["en", "de", "", None, "lonely%d" % i if i % 97 == 0 else "en"]), rng.choice(["s1", "s2", "s3", None, "S"])) for i in range(n)] + odd_rows()


@pytest.mark.parametrize("range_terms,group_bytes", [(200_000, 1 << 26), (7, 1 << 26), (5, 1)])
def test_divergence(spark, tmp_path, range_terms, group_bytes):
    """One transducer, several in one group, and a group for each."""
    rows = source_rows(8)
    docs = stored(spark, table(spark, rows, extra=True), tmp_path / "docs")
    got = sorted(tuple(r) for r in divergence.divergence(docs, least=3, range_terms=range_terms, group_bytes=group_bytes).collect())
    assert got == plain_divergence(rows, 3, 10)


def test_divergence_of_many_sources(spark):
    """More sources than a block holds, and more terms than one."""
    rng = random.Random(9)
    rows = [(i, " ".join("t" + "abcdefghij"[rng.randrange(10)] + "klmno"[rng.randrange(5)] for _ in range(20)), "en", "s%d" % (i % 300)) for i in range(1200)]
    got = sorted(tuple(r) for r in divergence.divergence(table(spark, rows), least=2).collect())
    assert got == plain_divergence(rows, 2, 10)
    assert divergence.divergence(table(spark, [])).count() == 0


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(10)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7))) for _ in range(400)})
    machine = divergence.Transducer.load(divergence.Transducer.of(iter(words)).dump())
    assert list(machine.words()) == words and machine.size == len(words)
    tried = words + [w + b"d" for w in words[:20]] + [b"abcabcabc", b"zz"]
    data = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(w) for w in tried])
    starts = ends - [len(w) for w in tried]
    got = machine.ordinals(data, starts, ends, np.full(len(tried), machine.root), np.zeros(len(tried), np.int64))
    assert got.tolist() == [words.index(w) if w in words else -1 for w in tried]
    # Minimal: no two states accept the same rest.
    edges = defaultdict(list)
    for k, t in zip(machine.key.tolist(), machine.target.tolist()):
        edges[k >> 8].append((k & 255, t))
    rests = {}

    def rest(state):
        if state not in rests:
            rests[state] = frozenset(([b""] if machine.final[state] else []) + [bytes([b]) + r for b, t in edges[state] for r in rest(t)])
        return rests[state]
    assert len({rest(s) for s in range(len(machine.final))}) == len(machine.final)


def test_spelled_phrases():
    import pyarrow as pa
    from augsight.llm.words import slices
    texts = ["One  two\tthree", "", None, "é  中文"]
    for part, data, bounds in slices(iter([pa.record_batch({"text": pa.array(texts)})])):
        words = grams.named_words(data, bounds, collocations.KIND, np.zeros(4, np.uint64))
        spelled = grams.Spelled(words, collocations.KIND[1])
        assert spelled.phrases(np.array([0, 1, 3]), 2).to_pylist() == ["one two", "two three", "é 中文"]
        assert spelled.phrases(np.array([], np.int64), 1).to_pylist() == []


# --- packing of files and long runs -------------------------------------------------------------

@pytest.fixture
def moving(spark, monkeypatch):
    """After every table that an operator writes, files are packed into partitions another way."""
    sizes, key = itertools.cycle(["1", "7", "2", "40"]), "spark.sql.files.minPartitionNum"

    def packed(inner):
        def run(*args):
            out = inner(*args)
            spark.conf.set(key, next(sizes))
            return out
        return run
    for module in (substring_dedup, pii, decontaminate):
        monkeypatch.setattr(module, "staged", packed(common.staged))
    yield
    spark.conf.unset(key)


def test_results_do_not_follow_the_packing(spark, tmp_path, moving):
    rng = random.Random(11)
    passage = " ".join("p%d" % i for i in range(40))
    rows = [(i, " ".join(["w%d" % rng.randrange(50) for _ in range(rng.randrange(60))] + [passage] * (i % 5 == 0)
                         + ["mail a%d@example.org or +1 555 0100 %04d" % (i, i)] * (i % 3 == 0)), "en", "a") for i in range(400)]
    docs = stored(spark, table(spark, rows).repartition(23), tmp_path / "docs")
    bench = stored(spark, spark.createDataFrame([("b1", passage)], "item_id string, text string"), tmp_path / "bench")

    def results():
        return [sorted(map(str, x.collect())) for x in (substring_dedup.without_repeats(docs), pii.pii_digest(docs),
                                                        decontaminate.contamination_digest(docs, bench))]
    spark.conf.set("spark.sql.files.minPartitionNum", "23")
    first = results()
    assert first == results()
    removed = {r.doc_id for r in substring_dedup.without_repeats(docs).collect() if r.n_removed}
    assert removed >= set(range(5, 400, 5))
    assert {r.doc_id for r in pii.pii_digest(docs).collect() if r.n_email} == set(range(0, 400, 3))


def test_token_ids_of_long_runs(spark, tmp_path):
    encoder, end = token_store._encoder(token_store.TOKENIZER, token_store.PATTERN)
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B1", " ", "\n", "\t", "\xa0", "é", "'s", "!", "\x1c"]) * rng.choice([1, 1, 3, 1001, 1500]) for _ in range(12))
        assert token_store.encode(encoder, text) == encoder.encode_ordinary(text)
    runs = [" " * 5_000_000, "x" + " " * 5_000_000 + "y", "z" * 5_000_000, "a\n" + "\n" * 1_000_000]
    docs = stored(spark, table(spark, [(i, t, "en", "a") for i, t in enumerate(runs)]), tmp_path / "docs")
    out = token_store.training_order(docs, str(tmp_path / "shards"))
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert n == {i: len(token_store.encode(encoder, t)) + 1 for i, t in enumerate(runs)}
    assert b"".join(encoder.decode_single_token_bytes(x) for x in token_store.encode(encoder, runs[1])).decode() == runs[1]


def test_token_numbers_do_not_follow_the_cores(spark, tmp_path, monkeypatch):
    """The number of cores changes between the two reads."""
    docs = stored(spark, table(spark, [(i, "w%d " % i * (i % 9), "en", "a") for i in range(200)]).repartition(12), tmp_path / "docs")
    key = "spark.sql.leafNodeDefaultParallelism"
    inner = token_store._records

    def later(*args):
        spark.conf.set(key, "2")
        return inner(*args)
    spark.conf.set(key, "30")
    try:
        want = sorted(map(str, token_store.training_order(docs, str(tmp_path / "a")).drop("crc32").collect()))
        spark.conf.set(key, "30")
        monkeypatch.setattr(token_store, "_records", later)
        assert want == sorted(map(str, token_store.training_order(docs, str(tmp_path / "b")).drop("crc32").collect()))
    finally:
        spark.conf.unset(key)
