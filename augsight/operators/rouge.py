"""ROUGE between generated and reference texts, keyed by a pair id.

ROUGE-1/2 are relational: n-gram counts per (pair, side, gram), one
partially-aggregated shuffle, then sum(least(count_pred, count_ref)).
ROUGE-L needs a longest common subsequence, computed by an Arrow-batched
pandas UDF on the two token arrays of each pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augsight.functions import text as tx


def _f(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rouge_n(pairs: DataFrame, n: int, key: Sequence[str], pred: str = "prediction",
            ref: str = "reference") -> DataFrame:
    """(key..., precision, recall, fmeasure) of ROUGE-n per pair."""
    k = list(key)
    # Partitioned by pair once: both aggregates below then stay in place.
    toks = (pairs.select(*k, pred, ref).repartition(*k)
            .select(*k, tx.tokens(tx.normalise_summary(F.col(pred))).alias("_tp"),
                    tx.tokens(tx.normalise_summary(F.col(ref))).alias("_tr"))
            .select(*k, tx.ngrams("_tp", n).alias("_gp"), tx.ngrams("_tr", n).alias("_gr")))
    side = lambda a, i: F.transform(a, lambda g: F.struct(F.lit(i).alias("side"), g.alias("gram")))
    grams = toks.select(*k, F.explode_outer(F.concat(side("_gp", 0), side("_gr", 1))).alias("s"))
    counts = (grams.groupBy(*k, F.col("s.gram").alias("gram"))
              .agg(F.count_if(F.col("s.side") == 0).alias("cp"), F.count_if(F.col("s.side") == 1).alias("cr"))
              .groupBy(*k).agg(F.sum(F.least("cp", "cr")).alias("overlap"), F.sum("cp").alias("n_pred"), F.sum("cr").alias("n_ref")))
    p = _ratio(F.col("overlap"), F.col("n_pred"))
    r = _ratio(F.col("overlap"), F.col("n_ref"))
    return counts.select(*k, p.alias("precision"), r.alias("recall"), _f(p, r).alias("fmeasure"))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``.

    Each token of ``b`` gets a bitmask of its positions; one pass over ``a``
    updates a len(b)-bit vector with integer add/or/and, so the cost is
    O(len(a) * len(b) / machine word) instead of a Python double loop.
    """
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, key: Sequence[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """(key..., precision, recall, fmeasure) of ROUGE-L per pair."""
    k = list(key)
    toks = pairs.select(*k, tx.tokens(tx.normalise_summary(F.col(pred))).alias("_tp"),
                        tx.tokens(tx.normalise_summary(F.col(ref))).alias("_tr"))
    out = toks.select(*k, _lcs_udf("_tp", "_tr").alias("lcs"),
                      F.size("_tp").alias("n_pred"), F.size("_tr").alias("n_ref"))
    p = _ratio(F.col("lcs"), F.col("n_pred"))
    r = _ratio(F.col("lcs"), F.col("n_ref"))
    return out.select(*k, p.alias("precision"), r.alias("recall"), _f(p, r).alias("fmeasure"))


def _lcs_places(ref: Sequence[str], cand: Sequence[str]) -> list[int]:
    """Places in ``ref`` of one longest common subsequence with ``cand``.

    Of several the one is taken that reading back from both ends gives: equal
    last tokens belong to it; else the last token of ``cand`` goes if that is
    the only way to keep the length, and the last token of ``ref`` if not.

    Lengths are kept as bit vectors over ``cand``, one for a token of ``ref``
    (a clear bit where the length grows), but only every so many of them;
    the vectors between are made again on the way back, so memory is the
    square root of ``ref`` times ``cand`` bits.
    """
    full, masks = (1 << len(cand)) - 1, {}
    for j, x in enumerate(cand):
        masks[x] = masks.get(x, 0) | (1 << j)

    def after(v: int, token: str) -> int:
        u = v & masks.get(token, 0)
        return ((v + u) | (v - u)) & full

    every = math.isqrt(len(ref)) + 1
    kept, v = [full], full
    for i, x in enumerate(ref, 1):
        v = after(v, x)
        if i % every == 0:
            kept.append(v)

    def length(row: int, j: int) -> int:
        return j - (row & ((1 << j) - 1)).bit_count()

    i, j, out, first, rows = len(ref), len(cand), [], len(ref) + 1, []
    while i and j:
        if i - 1 < first:  # the vectors of the stretch that ends with token i
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for x in ref[first:i]:
                rows.append(after(rows[-1], x))
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - first] >> (j - 1) & 1 and length(rows[i - 1 - first], j) < length(rows[i - first], j):
            j -= 1
        else:
            i -= 1
    return out


def summary_lcs(ref_sentences: Sequence[Sequence[str]], cand_sentences: Sequence[Sequence[str]]) -> int:
    """Tokens of the reference in the union, per sentence, of its common subsequences with all candidate sentences.

    A token counts at most as often as either whole text has it.
    """
    left_r, left_c = (Counter(t for s in side for t in s) for side in (ref_sentences, cand_sentences))
    hits = 0
    for r in ref_sentences:
        for i in sorted({i for c in cand_sentences for i in _lcs_places(r, c)}):
            if left_r[r[i]] > 0 and left_c[r[i]] > 0:
                hits += 1
                left_r[r[i]] -= 1
                left_c[r[i]] -= 1
    return hits


@F.pandas_udf(T.LongType())
def _summary_lcs_udf(ref: pd.Series, cand: pd.Series) -> pd.Series:
    return pd.Series([summary_lcs([list(s) for s in r], [list(s) for s in c]) for r, c in zip(ref, cand)], dtype="int64")


def rouge_lsum(pairs: DataFrame, key: Sequence[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """(key..., precision, recall, fmeasure) of ROUGE-Lsum: one sentence per line, longest subsequences per sentence."""
    k = list(key)

    def lines(c: str):
        return F.transform(F.split(tx.normalise_summary(F.col(c)), "\n"), lambda x: tx.tokens(x))
    s = pairs.select(*k, lines(pred).alias("_p"), lines(ref).alias("_r"))
    n = s.select(*k, _summary_lcs_udf("_r", "_p").alias("hits"), F.size(F.flatten("_p")).alias("n_pred"),
                 F.size(F.flatten("_r")).alias("n_ref"))
    p, r = _ratio(F.col("hits"), F.col("n_pred")), _ratio(F.col("hits"), F.col("n_ref"))
    return n.select(*k, p.alias("precision"), r.alias("recall"), _f(p, r).alias("fmeasure"))


def rouge_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus score: mean per-pair F x 100, rounded to 4 decimals."""
    return scores.groupBy(*by).agg(F.round(F.avg("fmeasure") * 100, 4).alias("score"))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prediction, reference): each assistant turn against the user turn before it.

    A self-join on (conv_id, turn) — unique keys, so even a conversation
    holding a third of all turns spreads over many tasks.
    """
    a = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("prediction"))
    u = conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"])
