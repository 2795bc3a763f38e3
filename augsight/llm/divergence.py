"""Source divergence audit over a transducer vocabulary.

One scan counts in how many documents of its language each term occurs.  The
kept terms are sorted by language and spelling and dealt into ranges, and each
range is built, in one task and in sorted order, into a minimal acyclic
transducer that gives a term its place in the order (its ordinal).  The texts
are then streamed through the transducers, which recount the kept terms by
source.  Ordinals stand for terms from there on: blocks of ordinals are the
unit in which sources are compared, and equal values rank by ordinal.

Transducers go to the tasks in groups of at most ``GROUP_BYTES``; texts are
streamed once for each group, so a vocabulary of any size is handled in
bounded memory.  A language's sources are compared in blocks of ``SOURCES``
by blocks of ``ORDINALS`` terms; a task holds two such blocks.

Null texts, languages and sources are the empty string.  Repeated rows count
each time.  Texts without terms still make their group occur; a language
without kept terms has pairs of value 0 and no terms.  An empty table gives no
rows.  Other columns of the documents are not read.  A text of any length is
worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsight.llm import grams
from augsight.llm.common import staged
from augsight.llm.words import FOLDED, slices

#: Documents of a language that a kept term is in, and terms of a group's report.
LEAST, TOP = 10, 10
#: Terms of one transducer, and bytes of those that are in a task at once.
RANGE_TERMS, GROUP_BYTES = 200_000, 64 << 20
#: Terms and sources of a block.
ORDINALS, SOURCES = 1024, 128
SCALE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased.
KIND = (_LETTER, FOLDED[1])


# --- the transducer --------------------------------------------------------------------------

class Transducer:
    """Minimal acyclic automaton over bytes whose edges carry the number of smaller accepted words.

    Edges are sorted by state and byte: ``key`` is state * 256 + byte,
    ``target`` the next state, ``skip`` the words that are accepted before any
    that take this edge from this state.
    """

    def __init__(self, key: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, root: int, size: int):
        self.key, self.target, self.skip, self.final, self.root, self.size = key, target, skip, final, root, size

    @classmethod
    def of(cls, words: Iterator[bytes]) -> Transducer:
        """From sorted, distinct words: what follows the common prefix with the next word is finished and shared."""
        known: dict[tuple, int] = {}
        final, edges, sizes = [], [], []
        open_states: list[list] = [[False, []]]  # final, finished edges (byte, state), along the last word
        last = b""

        def finish(state: list) -> int:
            signature = (state[0], tuple(state[1]))
            if signature not in known:
                known[signature] = len(final)
                final.append(state[0])
                edges.append(signature[1])
                sizes.append(state[0] + sum(sizes[t] for _, t in signature[1]))
            return known[signature]

        def close(depth: int) -> None:
            while len(open_states) - 1 > depth:
                done = finish(open_states.pop())
                open_states[-1][1].append((last[len(open_states) - 1], done))

        for word in words:
            same, limit = 0, min(len(word), len(last))
            while same < limit and word[same] == last[same]:
                same += 1
            close(same)
            open_states.extend([False, []] for _ in range(len(word) - same))
            open_states[-1][0] = True
            last = word
        close(0)
        root = finish(open_states[0])
        key, target, skip = [], [], []
        for state, own in enumerate(edges):
            before = int(final[state])
            for byte, to in own:
                key.append(state * 256 + byte)
                target.append(to)
                skip.append(before)
                before += sizes[to]
        return cls(np.array(key, np.int64), np.array(target, np.int32), np.array(skip, np.int64), np.array(final, bool), root, sizes[root])

    def nbytes(self) -> int:
        return self.key.nbytes + self.target.nbytes + self.skip.nbytes + self.final.nbytes

    def dump(self) -> bytes:
        head = np.array([len(self.key), len(self.final), self.root, self.size], np.int64)
        return b"".join(x.tobytes() for x in (head, self.key, self.target, self.skip, self.final))

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        n, states, root, size = np.frombuffer(raw, np.int64, 4).tolist()
        at = 32
        parts = []
        for kind, count in ((np.int64, n), (np.int32, n), (np.int64, n), (bool, states)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        return cls(*parts, root, size)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which walkers have such an edge, where it leads, and what it skips."""
        key = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        there = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        return there, self.target[at[there]], self.skip[at[there]]

    def enter(self, prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """State (-1: none) and words skipped after each prefix."""
        states, skipped = [], []
        for prefix in prefixes:
            state, total = self.root, 0
            for byte in prefix:
                there, to, skip = self.step(np.array([state]), np.array([byte]))
                if not there[0]:
                    state = -1
                    break
                state, total = int(to[0]), total + int(skip[0])
            states.append(state)
            skipped.append(total)
        return np.array(states, np.int64), np.array(skipped, np.int64)

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Ordinals of the words ``data[start[i]:end[i]]`` read on from ``state[i]``; -1 for a word that is not accepted."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.key):
            return out
        alive = np.flatnonzero(state >= 0)
        state, total, place = state[alive], skipped[alive].copy(), start[alive]
        while len(alive):
            ended = place == end[alive]
            if ended.any():
                out[alive[ended]] = np.where(self.final[state[ended]], total[ended], -1)
                go = ~ended
                alive, state, total, place = alive[go], state[go], total[go], place[go]
            there, to, skip = self.step(state, data[place])
            alive, total, place, state = alive[there], total[there] + skip, place[there] + 1, to
        return out

    def words(self) -> Iterator[bytes]:
        """The accepted words in order."""
        first = np.searchsorted(self.key, np.arange(len(self.final) + 1) * 256).tolist()
        labels, targets = (self.key & 255).astype(np.uint8).tolist(), self.target.tolist()
        stack = [(self.root, b"")]
        while stack:
            state, word = stack.pop()
            if self.final[state]:
                yield word
            for e in range(first[state + 1] - 1, first[state] - 1, -1):
                stack.append((targets[e], word + bytes([labels[e]])))


# --- vocabulary ------------------------------------------------------------------------------

def _lang_key(lang: str) -> bytes:
    """Sixteen bytes before a term: terms of a language stay together, in the order of their spelling."""
    import hashlib
    return hashlib.md5(lang.encode()).digest()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task by language and term."""
    salts: dict[str, int] = {}
    langs, sums = grams.Codes(), grams.SpelledSums()

    def sent() -> Iterator[pa.RecordBatch]:
        names, counts, lang, spelled = sums.rest()
        yield from grams.rows({"lang": pa.array(langs.values(), pa.string()).take(pa.array(lang)), "term": spelled, "n": counts})

    for part, data, bounds in slices(batches):
        own = part.column("lang").to_pylist()
        lang = langs(own)
        words = grams.named_words(data, bounds, KIND, np.array([salts.setdefault(x, grams.salt(x)) for x in own], np.uint64))
        order = np.lexsort((words.doc, words.hash))
        name, doc = words.hash[order], words.doc[order]
        new_doc = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if len(name) else np.empty(0, bool)
        name, place = name[new_doc], order[new_doc]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, np.int64)
        at = place[first]
        sums.add(name[first], np.diff(np.append(first, len(name))), lang[words.doc[at]],
                 lambda new: grams.Spelled(words, KIND[1]).phrases(at[new], 1))
        if sums.ready():
            yield from sent()
    yield from sent()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, term)`` of the terms in at least ``least`` documents of their language."""
    counted = docs.select("text", "lang").mapInArrow(_document_counts, "lang string, term string, n long")
    return staged(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"), "kept")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transducer of the sorted keys of one range."""
    first: list[bytes] = []

    def keys() -> Iterator[bytes]:
        for batch in batches:
            for key in batch.column("key").to_pylist():
                if not first:
                    first.append(key)
                yield key

    built = Transducer.of(keys())
    if built.size:
        yield pa.RecordBatch.from_pydict({"first": pa.array(first, pa.binary()), "n": pa.array([built.size], pa.int64()),
                                          "bytes": pa.array([built.nbytes()], pa.int64()), "machine": pa.array([built.dump()], pa.binary())})


def transducers(kept: DataFrame, range_terms: int = RANGE_TERMS) -> tuple[DataFrame, list]:
    """The machines as a stored table, and their ``(first, n, bytes, offset)`` in the order of their keys (one row per range)."""
    ranges = max(1, -(-kept.count() // range_terms))
    key = F.concat(F.unhex(F.md5(F.col("lang").cast("binary"))), F.col("term").cast("binary"))
    keys = kept.select(key.alias("key")).repartitionByRange(ranges, "key").sortWithinPartitions("key")
    table = staged(keys.mapInArrow(_build, "first binary, n long, bytes long, machine binary"), "machines")
    listed, offset = [], 0
    for r in sorted(table.select("first", "n", "bytes").collect(), key=lambda r: bytes(r["first"])):
        listed.append((bytes(r["first"]), r["n"], r["bytes"], offset))
        offset += r["n"]
    return table, listed


def _groups(listed: list, group_bytes: int) -> Iterator[list]:
    group, size = [], 0
    for x in listed:
        if group and size + x[2] > group_bytes:
            yield group
            group, size = [], 0
        group.append(x)
        size += x[2]
    if group:
        yield group


def _recount(machines: list[tuple[bytes, int]]):
    """Occurrences by language, source and ordinal; ``machines`` are (dump, first ordinal)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [(Transducer.load(raw), offset) for raw, offset in machines]
        salts: dict[str, int] = {}
        groups, sums, entry = grams.Codes(), grams.Sums(), {}

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = sums.rest()
            who = keys >> np.uint64(40)
            lang, source = (pa.array([g[i] for g in groups.values()], pa.string()).take(pa.array(who.astype(np.int64))) for i in (0, 1))
            yield from grams.rows({"lang": lang, "source": source, "ord": base + (keys & np.uint64((1 << 40) - 1)).astype(np.int64), "n": counts})

        base = loaded[0][1]
        for part, data, bounds in slices(batches):
            langs = part.column("lang").to_pylist()
            own = groups(list(zip(langs, part.column("source").to_pylist())))
            words = grams.named_words(data, bounds, KIND, np.array([salts.setdefault(x, grams.salt(x)) for x in langs], np.uint64))
            # Equal spellings of a slice walk through the machine once.
            order = np.lexsort((own[words.doc], words.hash))
            name, who = words.hash[order], own[words.doc[order]]
            fresh = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.empty(0, bool)
            one = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (who[1:] != who[:-1])])) if len(name) else np.empty(0, np.int64)
            spelling = (np.cumsum(fresh) - 1)[one]
            at = order[np.flatnonzero(fresh)]
            counts = np.diff(np.append(one, len(name)))
            folded, lang_of = KIND[1][data], [langs[d] for d in words.doc[at].tolist()]
            for m, (machine, offset) in enumerate(loaded):
                missing = sorted({x for x in lang_of} - {k[1] for k in entry if k[0] == m})
                for x, state, skip in zip(missing, *machine.enter([_lang_key(x) for x in missing])):
                    entry[m, x] = int(state), int(skip)
                enter = np.array([entry[m, x] for x in lang_of], np.int64).reshape(-1, 2)
                ordinal = machine.ordinals(folded, words.start[at], words.end[at], enter[:, 0], enter[:, 1])
                hit = ordinal[spelling] >= 0
                sums.add((who[one[hit]].astype(np.uint64) << np.uint64(40)) + (ordinal[spelling[hit]] + offset - base).astype(np.uint64), counts[hit])
            if sums.ready():
                yield from sent()
        yield from sent()
    return run


def _spelled(offsets: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column("first").to_pylist(), batch.column("machine").to_pylist()):
                keys, at = [], offsets[first]
                for key in Transducer.load(raw).words():
                    keys.append(key)
                    if len(keys) == grams.ROWS:
                        yield _spellings(keys, at)
                        keys, at = [], at + grams.ROWS
                if keys:
                    yield _spellings(keys, at)
    return run


def _spellings(keys: list[bytes], at: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang_key": pa.array([k[:16].hex() for k in keys], pa.string()), "ord": pa.array(range(at, at + len(keys)), pa.int64()),
                                       "term": pa.array([k[16:].decode() for k in keys], pa.string())})


# --- comparison ------------------------------------------------------------------------------

def _value(p, q):
    """floor((p - q)² / (p + q)) of numpy arrays of longs: p and q are at most 10^9 + 1, so nothing passes 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of values between the sources of two blocks, over one block of terms.

    Rows with ``ord`` -1 name the sources with their ``p`` of a term that
    they do not have and the number of the block's terms; the others give
    the ``p`` of terms that occur.
    """
    heads, cells = rows[rows["ord"] < 0], rows[rows["ord"] >= 0]
    heads = heads.drop_duplicates("number").sort_values("number")
    numbers, names = heads["number"].to_numpy(), heads["source"].to_numpy()
    terms = int(heads["width"].iloc[0])
    columns = np.unique(cells["ord"].to_numpy())
    p = np.repeat(heads["p"].to_numpy()[:, None], len(columns), 1)
    p[np.searchsorted(numbers, cells["number"].to_numpy()), np.searchsorted(columns, cells["ord"].to_numpy())] = cells["p"].to_numpy()
    none, block = heads["p"].to_numpy(), numbers // SOURCES
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out = []
    for i in left:
        totals = _value(p[i], p[right]).sum(1) + _value(none[i], none[right]) * (terms - len(columns))
        other = right != i
        out.append(pd.DataFrame({"source": names[i], "item": names[right][other], "value": totals[other]}))
        if a != b:
            out.append(pd.DataFrame({"source": names[right], "item": names[i], "value": totals}))
    both = pd.concat(out)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": both["source"], "item": both["item"], "value": both["value"].astype("int64")})


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, range_terms: int = RANGE_TERMS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: the sources of each language against one another, and each group's own terms."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(rows, least)
    table, listed = transducers(kept, range_terms)
    counted = spark.createDataFrame([], "lang string, source string, ord long, n long")
    for group in _groups(listed, group_bytes):
        lo, hi = group[0][0], group[-1][0]
        raw = {bytes(r["first"]): bytes(r["machine"]) for r in table.filter(F.col("first").between(F.lit(lo), F.lit(hi))).collect()}
        part = rows.mapInArrow(_recount([(raw[first], offset) for first, _, _, offset in group]), "lang string, source string, ord long, n long")
        counted = counted.unionByName(staged(part.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "recounted"))

    d = lambda c: F.col(c).cast("decimal(20, 0)")
    share = lambda n, total: (F.expr(f"(({n} + 2) * cast({SCALE} as decimal(10, 0))) div ({total})") + 1).cast("long")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    by_group = counted.groupBy("lang", "source").agg(F.sum(d("n")).alias("total"))
    groups = (rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(by_group, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
                      (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).cast("decimal(30, 0)").alias("whole"))
              .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    groups = staged(groups.withColumn("none", F.when(F.col("v") > 0, share("cast(0 as decimal(20, 0))", "whole"))), "groups")
    cells = (counted.withColumn("n", d("n")).join(groups.select("lang", "source", "whole", "number"), ["lang", "source"])
             .select("lang", "source", "ord", "n", "number", share("n", "whole").alias("p")))
    cells = staged(cells, "cells")

    terms = staged(table.select("first", "machine").mapInArrow(_spelled({x[0]: x[3] for x in listed}), "lang_key string, ord long, term string"), "terms")
    lang_key = F.md5(F.col("lang").cast("binary"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).withColumn("lang_key", lang_key)

    # Pairs: every block of terms, with a head row for each source, goes to every two blocks of sources.
    widths = (terms.groupBy("lang_key", F.floor(F.col("ord") / ORDINALS).alias("block")).agg(F.count(F.lit(1)).alias("width")))
    blocks = (langs.join(widths, "lang_key", "left")
              .select("lang", "sources", F.coalesce("block", F.lit(-1).cast("long")).alias("block"), F.coalesce("width", F.lit(0).cast("long")).alias("width")))
    heads = (blocks.join(groups.select("lang", "source", "number", F.coalesce("none", F.lit(1).cast("long")).alias("p")), "lang")
             .select("lang", "sources", "block", "width", "source", "number", "p", F.lit(-1).cast("long").alias("ord")))
    inside = (cells.join(langs.select("lang", "sources"), "lang")
              .select("lang", "sources", F.floor(F.col("ord") / ORDINALS).alias("block"), F.lit(0).cast("long").alias("width"), "source", "number", "p", "ord"))
    own, last = F.floor(F.col("number") / SOURCES).cast("int"), F.floor((F.col("sources") - 1) / SOURCES).cast("int")
    dealt = (heads.unionByName(inside).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
             .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("own", "other", "sources"))
    pairs = (dealt.groupBy("lang", "block", "a", "b").applyInPandas(_compare, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))

    # Terms: the language's own p from the sums over its sources.
    whole = groups.groupBy("lang").agg(F.sum(F.col("whole") - 2 * F.col("v")).alias("total"), F.max("v").alias("v"))
    of_lang = (cells.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(whole, "lang")
               .select("lang", "ord", share("n", "total + 2 * v").alias("q")))
    value = F.expr("cast(((p - q) * (p - q)) div (p + q) as long)")
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    own_terms = (cells.join(of_lang, ["lang", "ord"]).filter("p > q").select("lang", "source", "ord", value.alias("value"))
                 .withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top)
                 .join(terms.select("ord", "term"), "ord")
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
    return pairs.unionByName(own_terms)
