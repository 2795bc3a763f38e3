"""Registered queries of the operators (whole tables, production parameters) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from augsight.llm import (collocations, decontaminate, divergence, jaccard_join, language, mixing, nearest, pii, quality, sharding,
                          substring_dedup, token_store, toxicity)
from augsight.llm.common import documents, scratch

Query = Callable[[SparkSession, str], DataFrame]

N_SHARDS = 16


def op1_sharding(spark, d):
    return sharding.lpt_shards(documents(spark, d), N_SHARDS)


def op2_decontamination(spark, d):
    bench = spark.read.parquet(f"{d.rstrip('/')}/benchmark.parquet")
    return decontaminate.contamination_digest(documents(spark, d), bench).drop("text_key")


def op3_quality(spark, d):
    return quality.quality(documents(spark, d), spark.read.parquet(f"{d.rstrip('/')}/labels.parquet"))


def op4_language_id(spark, d):
    return language.language_digest(documents(spark, d))


def op5_jaccard_join(spark, d):
    return jaccard_join.group_digest(documents(spark, d))


def op6_substring_dedup(spark, d):
    return substring_dedup.without_repeats(documents(spark, d)).drop("text")


def op7_mixing(spark, d):
    return mixing.mix_digest(documents(spark, d))


def op8_token_output(spark, d):
    return token_store.training_order(documents(spark, d), scratch(spark, "shards"))


def op9_toxicity(spark, d):
    return toxicity.toxicity_digest(documents(spark, d), spark.read.parquet(f"{d.rstrip('/')}/labels.parquet"))


def op10_pii(spark, d):
    return pii.pii_digest(documents(spark, d))


def op11_nearest(spark, d):
    return nearest.search(spark.read.parquet(f"{d.rstrip('/')}/embeddings.parquet"))


def op12_collocations(spark, d):
    return collocations.collocations(documents(spark, d))


def op13_divergence(spark, d):
    return divergence.divergence(documents(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_sharding, op2_decontamination, op3_quality, op4_language_id, op5_jaccard_join, op6_substring_dedup, op7_mixing,
        op8_token_output, op9_toxicity, op10_pii, op11_nearest, op12_collocations, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op7_mixing": OP7_SQL,
            "op12_collocations": OP12_SQL, "op13_divergence": OP13_SQL}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
                        row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
        FROM i, range(1, greatest(len(w) - 9, 1) + 1) AS x(p) WHERE len(w) > 0),
occ AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM win), range(1, greatest(len(w) - n + 1, 0) + 1) AS x(p)),
hits AS (SELECT r, p, occ.n AS n, item_id FROM occ JOIN win USING (n, s)),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, n FROM hits), range(p, p + n) AS y(q) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM d, range(1, greatest(len(w) - 12, 0) + 1) AS x(p)),
least_of AS (SELECT s, min(doc_id) AS least_id FROM win GROUP BY s),
hit AS (SELECT DISTINCT r, q FROM win JOIN least_of USING (s), range(p, p + 13) AS y(q) WHERE least_id < doc_id),
gone AS (SELECT r, list(q) AS q FROM hit GROUP BY r),
kept AS (SELECT doc_id, w, coalesce(len(q), 0) AS n_removed,
                CASE WHEN q IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(q, x[2])), lambda x: x[1]) END AS k
         FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP7_SQL = rf"""
WITH RECURSIVE s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
                            md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS stop,
               [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
        FROM s GROUP BY source),
lv AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS level, CAST(-1 AS DOUBLE) AS old
       UNION ALL
       SELECT step + 1, greatest(level, coalesce((SELECT CAST(sum(source_size) - coalesce(sum(stop) FILTER (stop < level * weight), 0) AS DOUBLE)
              / sum(weight) FILTER (NOT (stop < level * weight)) FROM src), level)), level
       FROM lv WHERE level > old AND step < 1000),
top AS (SELECT max(level) AS level FROM lv),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs,
             CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
      FROM (SELECT *, CASE WHEN stop < level * weight THEN CAST(stop AS DOUBLE) ELSE level * weight END AS target FROM src, top)),
unit AS (SELECT source, k, sum(size) AS unit_size, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) - sum(size) AS before
         FROM s GROUP BY source, k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN unit_size = 0 THEN 0 ELSE size * least(greatest(rest - before, 0), unit_size) // unit_size END AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source JOIN unit ON s.source IS NOT DISTINCT FROM unit.source AND s.k = unit.k
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
occ AS (SELECT lang, len, unnest(list_transform(range(1, greatest(len(w) - len + 1, 0) + 1), lambda p: array_to_string(w[p:p + len - 1], ' '))) AS phrase
        FROM w, (VALUES (1), (2), (3)) AS v(len)),
f AS (SELECT lang, len, phrase, count(*) AS f FROM occ GROUP BY lang, len, phrase HAVING count(*) >= 10),
cut AS (SELECT lang, len, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:len], ' ') AS y
        FROM f, (VALUES (1), (2)) AS v(k) WHERE k < len),
scored AS (SELECT cut.lang, cut.len, cut.phrase, a, k, p.f AS l, q.f AS r,
                  CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
           FROM cut JOIN f p ON p.lang = cut.lang AND p.phrase = x JOIN f q ON q.lang = cut.lang AND q.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(string_split(phrase, ' ')[k:k + 1], ' ') AS phrase, max(f) AS longest
         FROM f, (VALUES (1), (2)) AS v(k) WHERE len = 3 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held ON best.lang = held.lang AND best.phrase = held.phrase
         WHERE len = 3 OR longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 50 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN total ON ranked.lang = total.lang WHERE rank <= 2000
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT g.lang, CAST(count(term) AS HUGEINT) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept ON kept.lang = g.lang GROUP BY g.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS size FROM c GROUP BY lang, source),
full_table AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                      CAST(1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (coalesce(size.size, 0) + 2 * v.v) AS BIGINT) AS p
               FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN size ON size.lang = g.lang AND size.source = g.source
               LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
          FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
own AS (SELECT lang, term, CAST(1 + 1000000000 * (CAST(sum(n) AS HUGEINT) + 2) // (sum(CAST(sum(n) AS HUGEINT)) OVER (PARTITION BY lang) + 2 * any_value(v.v)) AS BIGINT) AS q
        FROM full_table JOIN v USING (lang) GROUP BY lang, term),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM full_table JOIN own USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
