"""Operators with one right answer, against plain Python on random and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from augsight.llm import common, decontaminate, jaccard_join, mixing, pii, quality, sharding, substring_dedup, token_store
from augsight.llm.words import ALNUM_FOLDED, AS_IS, FOLDED, slices, split_words

from .util import lower, odd_rows, stored, table, words


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- words ------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind,pattern,fold", [
    (AS_IS, r"[^\x20\x09-\x0D]+", False), (FOLDED, r"[^\x20\x09-\x0D]+", True),
    (ALNUM_FOLDED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words_are_the_patterns_matches(kind, pattern, fold):
    import pyarrow as pa
    rng = random.Random(1)
    texts = [None, "", " ", "a", *("".join(rng.choice("abAZ09 .\n\t\x0bé中ß-@[`{~\x7f") for _ in range(rng.randrange(60)))
                                   for _ in range(400)), "x" * 3_000_000 + " y"]
    seen = {}
    for part, data, bounds in slices(iter([pa.record_batch({"text": pa.array(texts)}).slice(1), ])):
        w = split_words(data, bounds, kind)
        joined, ends = w.joined()
        for d, text in enumerate(part.column("text").to_pylist()):
            text = text or ""
            plain = re.findall(pattern, lower(text) if fold else text)
            i, j = w.first[d], w.first[d + 1]
            assert j - i == len(plain)
            for x, h in zip(plain, w.hash[i:j].tolist()):
                assert seen.setdefault(x, h) == h
            if not fold:
                assert joined[ends[d]:ends[d + 1]].tobytes().decode() == " ".join(plain)
    assert len(set(seen.values())) == len(seen)


# --- 1 sharding -------------------------------------------------------------------------------

def check_shards(rows, out, n_shards):
    assert len(out) == len(rows)
    home, slots = {}, defaultdict(list)
    text_of = Counter((r[0], None if r[1] is None else len(r[1].encode()) + 1 if r[1] is not None else 1) for r in rows)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        if r["text_crc32"] is not None:
            assert home.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
    assert text_of
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sharding(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, "t" * rng.randrange(1, 400) + str(i % 300), "en", "a") for i in range(900)]
    out = sharding.lpt_shards(table(spark, rows, extra=True), 4).collect()
    check_shards(rows, out, 4)
    sizes = sorted(((0 if r[1] is None else len(r[1].encode())) + 1 for r in rows))
    assert sorted(r["size"] for r in out) == sizes
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    largest_group = max(2 * len(r[1].encode()) + 2 for r in rows if r[1])
    assert max(load.values()) - min(load.values()) <= largest_group
    assert sharding.lpt_shards(table(spark, []), 4).count() == 0


def test_schedule_is_longest_first():
    assert sharding.schedule([(7, "a"), (5, "b"), (4, "c"), (4, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


# --- 2 decontamination ------------------------------------------------------------------------

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(docs, items):
    wins = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        if i is not None and w:
            n = min(10, len(w))
            for p in range(len(w) - n + 1):
                wins[tuple(w[p:p + n])].add(i)
    lengths = {len(k) for k in wins}
    out = []
    for doc_id, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p:p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= wins[k]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 6, 9, 10, 11, 25, 40, 40, 2, 17])]
    items += [(20, items[6][1]), (21, None), (22, ""), (None, items[5][1]), (23, items[5][1].upper()), (20, items[6][1])]
    rows = odd_rows()
    for d in range(150):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            text[rng.randrange(len(text) + 1):0] = src[a:a + rng.randrange(1, 30)]
        rows.append((1000 + d, rng.choice([" ", ", ", "\n"]).join(text), "en", "a"))
    docs = table(spark, rows, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_digest(docs, bench).drop("text_key").collect()
    want = plain_contamination([r[:2] for r in rows], items)
    assert Counter(map(tuple, got)) == Counter(want)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        (r[0], r[1]) for r, w in zip(rows, want) if not w[-1])
    assert decontaminate.contamination_digest(table(spark, []), bench).count() == 0
    none = decontaminate.contamination_digest(docs, bench.filter("false")).filter("contaminated or n_items > 0 or n_hit > 0")
    assert none.count() == 0


# --- 3 quality --------------------------------------------------------------------------------

def plain_base(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def buckets(text):
    import xxhash
    w = words(text)

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed % quality.BUCKETS if seed < 1 << 63 else (seed - (1 << 64)) % quality.BUCKETS
    return [h(x) for x in w] + [h(a, b) for a, b in zip(w, w[1:])]


def test_quality(spark):
    rng = random.Random(4)
    rows = odd_rows()
    for d in range(80):
        text = " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "#x", "a|b", "été"]) + rng.choice(["", "s"])
                        for _ in range(rng.randrange(0, 130)))
        rows.append((100 + d, text.replace("sats", "sat\n"), "en", "a"))
    rows.append((300, "same line here\n" * 30, "en", "a"))
    marks = [(100 + d, d % 2, 0) for d in range(80)] + [(101, None, 0), (None, 1, 0), (103, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.quality(table(spark, rows, extra=True), labels, threshold=0.01).collect()
    trusted = {m[0] for m in marks if m[1] == 1 and m[0] is not None}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r[1]))
        if r[0] in trusted:
            target.update(buckets(r[1]))
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), quality.PRIOR
    weight = {b: float(np.log((target[b] + prior * n / n_raw) / (n_target + prior) / (n / n_raw))) for b, n in raw.items()}
    want = []
    for r in rows:
        base = plain_base(r[1])
        b = buckets(r[1])
        score = sum(weight[x] for x in b) / len(b) if b else 0.0
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert abs(score - 0.01) > 1e-9
        want.append((r[0], *base, failed, not failed and score >= 0.01))
    assert Counter(tuple(r)[:-1] for r in got) == Counter(want)
    assert {w[-1] for w in want} == {True, False}
    assert quality.quality(table(spark, []), labels).count() == 0
    none = quality.quality(table(spark, rows), labels.filter("false"))
    assert none.filter("kept = base_failed").count() == 0


# --- 5 n-gram Jaccard join --------------------------------------------------------------------

def plain_groups(rows):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(r[0], len(s), least.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def near_copies(rng):
    rows = []
    for g in range(24):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 4, 7, 9, 10, 12, 25, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):  # a list of 40 is a long one
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(own))
                own[at:at + rng.randrange(2)] = [f"n{rng.randrange(10 ** 6)}"]
            rows.append((rng.randrange(10 ** 6), rng.choice([" ", "\n"]).join(own).title() if rng.random() < 0.2 else " ".join(own), "en", "a"))
    passage = " ".join(f"p{i}" for i in range(20))  # a passage in very many texts
    rows += [(2_000_000 + i, f"{passage} " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(2, 30))), "en", "a") for i in range(60)]
    return rows


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("boundary", [None, 30])
def test_jaccard_groups(spark, monkeypatch, seed, boundary):
    if boundary:
        monkeypatch.setattr(jaccard_join, "boundary_size", lambda _: boundary)
    rows = odd_rows() + near_copies(random.Random(seed))
    got = jaccard_join.group_digest(table(spark, rows, extra=True)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_groups([r[:2] for r in rows]))


def test_one_of_each(spark):
    rows = odd_rows() + near_copies(random.Random(7))
    docs = table(spark, rows, extra=True)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    group = {}
    for r, (doc_id, n, c) in zip(rows, plain_groups([r[:2] for r in rows])):
        digest = "null" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        key = (c, None if c is not None else digest)
        order = (doc_id is not None, doc_id or 0, digest)
        if key not in group or order < group[key][0]:
            group[key] = (order, r[:2])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(v[1] for v in group.values())
    assert jaccard_join.group_digest(table(spark, [])).count() == 0
    assert jaccard_join.one_of_each(table(spark, [(1, None, None, None)])).count() == 1


@pytest.mark.parametrize("boundary", [None, 30])
def test_similar_documents_of_the_pipeline(spark, monkeypatch, boundary):
    """Five words and 80 % for the stage, four and 85 for operator 5, against all pairs."""
    import corpus_pipeline
    if boundary:
        monkeypatch.setattr(jaccard_join, "boundary_size", lambda _: boundary)
    rng = random.Random(16)
    rows = [(5_000_000 + i, *r[1:]) for i, r in enumerate(near_copies(random.Random(9)))]
    for g in range(30):  # a text, with a fifth to a quarter appended, or with scattered changes
        base = [f"t{rng.randrange(10 ** 6)}" for _ in range(200)]
        appended = base + [f"t{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30, 60))]
        changed = [f"t{rng.randrange(10 ** 6)}" if i % rng.choice([43, 47, 51]) == 20 else w for i, w in enumerate(base)]
        rows += [(10 * g + i, " ".join(w), "en", "a") for i, w in enumerate((base, appended, changed))]
    docs = table(spark, rows)

    def names(shingle, j):
        sets, root = [], list(range(len(rows)))
        for r in rows:
            w = words(lower(r[1]))
            sets.append({tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))})

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, a in enumerate(sets):
            for k in range(i):
                n = len(a & sets[k])
                if n and 100 * n >= j * (len(a) + len(sets[k]) - n):
                    root[max(find(i), find(k), key=lambda x: rows[x][0])] = min(find(i), find(k), key=lambda x: rows[x][0])
        return [rows[find(i)][0] for i in range(len(rows))]

    wide, narrow = names(5, 80), names(4, 85)
    assert wide != narrow
    kept = corpus_pipeline.similar_documents(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wide))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.group_digest(docs).collect()}
    assert got == {r[0]: c for r, c in zip(rows, narrow)}


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links = [x for x in links if x[0] != x[1]]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)


# --- 6 substring dedup ------------------------------------------------------------------------

def plain_repeats(rows):
    least = {}
    split = [words(t) for _, t in rows]
    for (doc_id, _), w in zip(rows, split):
        for p in range(len(w) - 12):
            k = tuple(w[p:p + 13])
            if doc_id is not None:
                least[k] = min(doc_id, least.get(k, doc_id))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for p in range(len(w) - 12):
            if doc_id is not None and least[tuple(w[p:p + 13])] < doc_id:
                gone.update(range(p, p + 13))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize("seed", [9, 10])
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice(["a", "b", "c", "d", f"u{rng.randrange(99)}"]) for _ in range(rng.choice([12, 13, 14, 20, 50, 90]))] for _ in range(14)]
    passages += [["run"] * 40, ["x", "y"] * 25, ["x", "y", "z"] * 15]
    rows = odd_rows()
    for d in range(120):
        text = []
        for _ in range(rng.randrange(5)):
            text += [rng.choice("abcd") for _ in range(rng.randrange(12))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:a + rng.randrange(1, 60)] if rng.random() < 0.5 else p
        rows.append((rng.randrange(60), rng.choice([" ", "\t\n "]).join(text), "en", "a"))
    got = substring_dedup.without_repeats(table(spark, rows, extra=True))
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(plain_repeats([r[:2] for r in rows]))
    assert substring_dedup.without_repeats(table(spark, [])).count() == 0


# --- 7 mixing ---------------------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if share[s] > 3 * sizes[s]}
        if not over - capped:
            return share
        capped |= over


def test_mixing(spark):
    rng = random.Random(11)
    rows = odd_rows()[:8] + [(100 + i, "w " * rng.randrange(0, 90), "en", rng.choice(["b", "b", "b", "b", "é", "z", None, "tiny"]))
                             for i in range(500)]
    rows += [(900, None, "en", "empty"), (901, "", "en", "empty")]
    docs = table(spark, rows, extra=True)
    got = mixing.mix_digest(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = plain_targets(dict(sizes))
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[r["source_size"], r["target"]] += r["taken"]
    assert sorted((n, round(t, 6)) for n, t in by_target) == sorted({(sizes[s], round(t, 6)) for s, t in targets.items()})
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 2 * sum(abs(target - t) < 1e-6 for t in targets.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_digest(docs.repartition(7)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    words_of = Counter()
    for r in mix.collect():
        words_of[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    for s, t in targets.items():
        assert abs(words_of[s] - t) <= 1
    assert mixing.mix_digest(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0


# --- 8 token output ---------------------------------------------------------------------------

def test_permutation_is_one():
    for n in (1, 2, 3, 17, 4096, 50_001):
        x = token_store.permute(np.arange(n), n, 5)
        assert sorted(x.tolist()) == list(range(n))
    assert token_store.permute(np.arange(9999), 9999, 5).tolist() != token_store.permute(np.arange(9999), 9999, 6).tolist()


def test_token_round_trip(spark, tmp_path):
    rng = random.Random(12)
    rows = odd_rows() + [(100 + i, "".join(rng.choice("ab é\n中#") for _ in range(rng.randrange(900))), "en", "a") for i in range(150)]
    docs = stored(spark, table(spark, rows, extra=True).repartition(5), tmp_path / "docs")
    path = str(tmp_path / "shards")
    layout = token_store.write_shards(docs, path, seq_len=64, shard_bytes=20_000)
    assert layout["shards"] > 3
    encoder, end = token_store._encoder(token_store.TOKENIZER, token_store.PATTERN)
    files = {r["shard"]: r for r in token_store.shard_files(spark, path, layout).collect()}
    ids, order, at = defaultdict(list), [], 0
    for shard in sorted(files):
        raw = open(files[shard]["file"].removeprefix("file:"), "rb").read()
        assert len(raw) == files[shard]["records"] * layout["stride"] and files[shard]["first_slot"] == at
        for i in range(files[shard]["records"]):  # any record by its place
            key, doc_id, piece, tokens = token_store.decode(raw[i * layout["stride"]:(i + 1) * layout["stride"]], layout)
            assert key // layout["width"] == shard
            order.append(key)
            ids[doc_id].append((piece, tokens))
        at += files[shard]["records"]
    assert order == sorted(set(order))
    texts = Counter()
    for doc_id, pieces in ids.items():
        for tokens in _documents(pieces, end):
            assert tokens[-1] == end
            texts[doc_id, encoder.decode(tokens[:-1])] += 1
    assert texts == Counter((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)


def _documents(pieces, end):
    """Whole token lists of a doc_id; repeated rows have equal pieces."""
    by_piece = defaultdict(list)
    for piece, tokens in pieces:
        by_piece[piece].append(tokens)
    copies = len(by_piece[0])
    for c in range(copies):
        yield [t for p in sorted(by_piece) for t in by_piece[p][c]]


def test_training_order(spark, tmp_path):
    docs = stored(spark, table(spark, odd_rows()), tmp_path / "docs")
    out = token_store.training_order(docs, str(tmp_path / "shards"), seq_len=128, shard_bytes=30_000).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    assert [r["shard"] for r in sorted(out, key=lambda r: r["slot"])] == sorted(r["shard"] for r in out)
    empty = stored(spark, table(spark, []), tmp_path / "none")
    assert token_store.training_order(empty, str(tmp_path / "no_shards")).count() == 0


# --- 10 PII -----------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(x):
    return re.sub("[^0-9]", "", x)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only_digits(m)) <= 15),
)


def plain_spans(text):
    out = []
    for place, (kind, pattern, ok) in enumerate(PLAIN):
        out += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group(0))]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_pii_base_spans(spark):
    rng = random.Random(13)
    parts = ["a@b.c", "x.y+z@mail.example.com", "a@b", "@", "a@b.c_d@e.f", "é@b.co", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.000.1.255",
             "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "++12345678901", "+123456789", "12345",
             "中文", "+49 30 123456 78", "3782 822463 10005", "a@b.c.d.e.f", "00000000000000", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"]
    rows = odd_rows() + [(100 + i, rng.choice(["", "é ", "x"]).join(rng.choice(parts) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randrange(12))), "en", "a")
                         for i in range(250)]
    rows.append((999, "1.2.3.4 " * 3000 + "9" * 20_000 + "." + "q" * 20_000, "en", "a"))
    got = pii.pii_digest(table(spark, rows, extra=True)).collect()
    want = Counter()
    for r in rows:
        spans = plain_spans(r[1])
        kinds = Counter(s.split(":")[0] for s in spans)
        want[(r[0], *(kinds[k] for k in ("email", "ip", "card", "phone")), sha(",".join(spans)))] += 1
    assert Counter(tuple(r)[:-1] for r in got) == want
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] not in (None, 5):
            spans = [s for s in r["spans"].split(",") if s]
            assert set(plain_spans(text_of[r["doc_id"]])) <= set(spans)
            assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), [k for k, _, _ in PLAIN].index(s.split(":")[0])))
    assert pii.pii_digest(table(spark, [])).count() == 0
    clean = pii.pii_digest(table(spark, [(1, "no data here", "en", "a"), (2, None, None, None)])).collect()
    assert {(r["spans"], r["n_email"]) for r in clean} == {("", 0)}


def test_no_python_in_native_operators(spark):
    docs = table(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (quality.quality(docs, labels), mixing.mix_digest(docs), pii.pii_digest(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert F
