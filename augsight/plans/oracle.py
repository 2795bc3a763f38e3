"""Independent DuckDB SQL for every registered query (same names, same columns).

Written directly from the operator definitions, not from the Spark code:
whole tables, ``ROW_NUMBER`` windows where Spark uses bucketed ranks, plain
``IN`` sub-queries where Spark uses size-checked broadcast joins.
"""

from __future__ import annotations

LOW_RESOURCE_SHARE = "CAST(0.129 AS DOUBLE)"

CORPUS = """
corpus AS (
  SELECT CAST(d.doc_id AS BIGINT) AS id,
         split_part(d.text, chr(10), 1) AS title,
         d.text AS text,
         d.lang AS event_type,
         CASE WHEN d.doc_id IN (SELECT doc_id FROM labels)
              THEN DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) END AS date,
         CAST(NULL AS BIGINT) AS source_doc_id
  FROM documents d WHERE d.lang IS NOT NULL
)"""

COUNTS = """
counts AS (SELECT event_type, COUNT(*) AS n FROM corpus GROUP BY event_type),
lowres AS (SELECT event_type, n FROM counts
           WHERE n <= floor(%s * (SELECT SUM(n) FROM counts)))""" % LOW_RESOURCE_SHARE


def w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["corpus"] = w(CORPUS) + """
SELECT id, title, text, event_type, CAST(date AS VARCHAR) AS date FROM corpus"""

SQL["class_counts"] = w(CORPUS) + """
SELECT event_type, COUNT(*) AS n,
       CAST(COUNT(*) OVER () AS BIGINT) AS n_classes,
       CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
FROM corpus GROUP BY event_type"""

SQL["class_distribution"] = w(CORPUS) + """
SELECT event_type, COUNT(*) AS n,
       CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, event_type) AS INTEGER) AS position
FROM corpus GROUP BY event_type"""

SQL["distinct_counts"] = w(CORPUS) + """
SELECT COUNT(DISTINCT event_type) AS n_event_type, COUNT(DISTINCT text) AS n_text,
       COUNT(DISTINCT title) AS n_title, COUNT(DISTINCT date) AS n_date,
       COUNT(DISTINCT source_doc_id) AS n_source_doc_id, CAST(NULL AS BIGINT) AS n_arguments
FROM corpus"""

SQL["low_resource"] = w(CORPUS, COUNTS) + """
SELECT id, event_type FROM corpus WHERE event_type IN (SELECT event_type FROM lowres)"""

SQL["low_resource_classes"] = w(CORPUS, COUNTS) + """
SELECT event_type, n FROM lowres"""

SQL["low_resource_news"] = w(CORPUS) + """,
news AS (SELECT * FROM corpus WHERE date IS NOT NULL),
ncounts AS (SELECT event_type, COUNT(*) AS n FROM news GROUP BY event_type)
SELECT id, event_type FROM news WHERE event_type IN (
  SELECT event_type FROM ncounts WHERE n <= floor(%s * (SELECT SUM(n) FROM ncounts)))""" % LOW_RESOURCE_SHARE

SQL["low_resource_by_part"] = w(CORPUS, COUNTS) + """,
tagged AS (SELECT *, CASE WHEN date IS NULL THEN 'wiki' ELSE 'news' END AS part FROM corpus),
pcounts AS (SELECT part, event_type, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY part) AS tot
            FROM tagged GROUP BY part, event_type),
before AS (SELECT 'extract_then_split' AS strategy, part, event_type FROM tagged
           WHERE event_type IN (SELECT event_type FROM lowres)),
after AS (SELECT 'split_then_extract' AS strategy, t.part, t.event_type FROM tagged t
          JOIN pcounts p ON t.part = p.part AND t.event_type = p.event_type
          WHERE p.n <= floor(%s * p.tot))
SELECT strategy, part, event_type, COUNT(*) AS n_rows
FROM (SELECT * FROM before UNION ALL SELECT * FROM after) GROUP BY ALL""" % LOW_RESOURCE_SHARE

SQL["news_wiki_counts"] = w(CORPUS) + """
SELECT CASE WHEN date IS NULL THEN 'wiki' ELSE 'news' END AS part, event_type, COUNT(*) AS n
FROM corpus GROUP BY ALL"""

SQL["dedup_keep_none"] = w(CORPUS) + """
SELECT id, event_type FROM corpus
WHERE text IN (SELECT text FROM corpus GROUP BY text HAVING COUNT(*) = 1)"""

SQL["duplicates"] = w(CORPUS) + """
SELECT c.id, g.n AS n_copies FROM corpus c
JOIN (SELECT text, COUNT(*) AS n FROM corpus GROUP BY text HAVING COUNT(*) > 1) g ON c.text = g.text"""

SQL["duplicate_label_conflicts"] = """
SELECT md5(text) AS text_md5, COUNT(*) AS n_rows, COUNT(DISTINCT source) AS n_labels
FROM documents WHERE text IS NOT NULL GROUP BY text HAVING COUNT(DISTINCT source) > 1"""



# --- M2/M3: splits, folds, augmentation, ids ------------------------------------------------
# Stage fractions of the 0.8 / 0.1 / 0.1 split: size_i / sum(sizes[i:]).
F1 = "CAST(%r AS DOUBLE)" % (0.8 / (0.8 + 0.1 + 0.1))
F2 = "CAST(%r AS DOUBLE)" % (0.1 / (0.1 + 0.1))


def hkey(seed, col="id"):
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


SENTS = r"string_split(regexp_replace({c}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))"

SQL["split_plain"] = w(CORPUS) + f""",
r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1 AS rk FROM corpus),
n AS (SELECT COUNT(*) AS n FROM corpus),
b AS (SELECT floor({F1} * n) AS b1, n FROM n),
b2 AS (SELECT b1, b1 + floor({F2} * (n - b1)) AS b2 FROM b)
SELECT id, CASE WHEN rk < b1 THEN 'train' WHEN rk < b2 THEN 'dev' ELSE 'test' END AS split
FROM r, b2"""

SQL["split_stratified"] = w(CORPUS) + f""",
cnt AS (SELECT event_type, COUNT(*) AS c FROM corpus GROUP BY 1),
s1 AS (SELECT event_type, c, floor({F1} * SUM(c) OVER ()) AS take, SUM(c) OVER () AS tot FROM cnt),
a1 AS (SELECT *, CAST(c * take AS DOUBLE) / tot AS cont FROM s1),
a1b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a1),
a1c AS (SELECT event_type, c, fl + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, event_type)
                                         <= take - SUM(fl) OVER () THEN 1 ELSE 0 END AS alloc1 FROM a1b),
s2 AS (SELECT event_type, alloc1, c - alloc1 AS r, floor({F2} * SUM(c - alloc1) OVER ()) AS take,
              SUM(c - alloc1) OVER () AS tot FROM a1c),
a2 AS (SELECT *, CAST(r * take AS DOUBLE) / tot AS cont FROM s2),
a2b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a2),
bounds AS (SELECT event_type, alloc1 AS b1,
                  alloc1 + fl + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, event_type)
                                     <= take - SUM(fl) OVER () THEN 1 ELSE 0 END AS b2 FROM a2b),
r AS (SELECT id, event_type,
             ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY {hkey(42)}, id) - 1 AS rk FROM corpus)
SELECT r.id, r.event_type,
       CASE WHEN rk < b1 THEN 'train' WHEN rk < b2 THEN 'dev' ELSE 'test' END AS split
FROM r JOIN bounds USING (event_type)"""

SPLIT_PLAIN_LABELLED = f"""
sp AS (SELECT id, event_type,
              CASE WHEN rk < b1 THEN 'train' WHEN rk < b2 THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT id, event_type, ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1 AS rk FROM corpus),
            (SELECT b1, b1 + floor({F2} * (n - b1)) AS b2
             FROM (SELECT floor({F1} * COUNT(*)) AS b1, COUNT(*) AS n FROM corpus)))"""

SQL["split_label_coverage"] = w(CORPUS, SPLIT_PLAIN_LABELLED) + """
SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT event_type) AS n_labels,
       (SELECT COUNT(DISTINCT event_type) FROM sp) - COUNT(DISTINCT event_type) AS n_missing_labels
FROM sp GROUP BY split"""

SQL["kfold_stratified"] = w(CORPUS) + f"""
SELECT id, event_type,
       CAST((ROW_NUMBER() OVER (ORDER BY event_type, {hkey(18091999)}, id) - 1) % 5 AS INTEGER) AS fold
FROM corpus"""


def augmented(lowres: bool) -> str:
    """CTE ``aug`` = originals (dense ids) + 3 lead-sentence variants of every source."""
    where = "WHERE event_type IN (SELECT event_type FROM lowres)" if lowres else ""
    sents = SENTS.format(c="text")
    return f"""
orig AS (SELECT ROW_NUMBER() OVER (ORDER BY id) - 1 AS nid, title, text, event_type, date FROM corpus),
src AS (SELECT *, ROW_NUMBER() OVER (ORDER BY nid) - 1 AS srank, {sents} AS s FROM orig {where}),
gen AS (SELECT (SELECT COUNT(*) FROM orig) + srank * 3 + j AS id, title,
               array_to_string(s[1:j + 1], ' ') AS text, event_type, date, nid AS source_doc_id
        FROM src, (SELECT range AS j FROM range(3))),
aug AS (SELECT nid AS id, title, text, event_type, date, CAST(NULL AS BIGINT) AS source_doc_id FROM orig
        UNION ALL SELECT * FROM gen)"""


AUG_ALL = augmented(False)
AUG_LOW = augmented(True)

SQL["augment_lead_k"] = w(CORPUS, AUG_ALL) + """
SELECT id, title, text, event_type, CAST(date AS VARCHAR) AS date, source_doc_id FROM aug"""

SQL["augment_low_resource"] = w(CORPUS, COUNTS, AUG_LOW) + """
SELECT id, title, text, event_type, CAST(date AS VARCHAR) AS date, source_doc_id FROM aug"""

KFOLD_SAFE = f"""
f AS (SELECT id, CAST((ROW_NUMBER() OVER (ORDER BY event_type, {hkey(18091999)}, id) - 1) % 5 AS INTEGER) AS fold
      FROM aug WHERE source_doc_id IS NULL),
a AS (SELECT x.id, f.fold AS src_fold FROM aug x LEFT JOIN f ON x.source_doc_id = f.id
      WHERE x.source_doc_id IS NOT NULL),
folds AS (SELECT CAST(range AS INTEGER) AS k FROM range(5)),
assign AS (
  SELECT folds.k AS fold, f.id, CASE WHEN folds.k = f.fold THEN 'test' ELSE 'train' END AS role
  FROM f, folds
  UNION ALL
  SELECT folds.k AS fold, a.id, 'train' AS role FROM a, folds
  WHERE a.src_fold IS NULL OR folds.k <> a.src_fold)"""

SQL["kfold_leakage_safe"] = w(CORPUS, COUNTS, AUG_LOW, KFOLD_SAFE) + """
SELECT fold, id, role FROM assign"""

SQL["kfold_leakage_audit"] = w(CORPUS, COUNTS, AUG_LOW, KFOLD_SAFE) + """,
x AS (SELECT s.fold, s.id, s.role, g.source_doc_id FROM assign s JOIN aug g USING (id)),
leaks AS (SELECT t.fold, COUNT(*) AS n FROM x t JOIN x e
            ON t.fold = e.fold AND t.role = 'train' AND e.role = 'test' AND t.source_doc_id = e.id
          GROUP BY t.fold)
SELECT x.fold,
       COUNT(*) FILTER (WHERE role = 'test') AS n_test,
       COUNT(*) FILTER (WHERE role = 'train' AND source_doc_id IS NULL) AS n_train_original,
       COUNT(*) FILTER (WHERE role = 'train' AND source_doc_id IS NOT NULL) AS n_train_augmented,
       COALESCE(MAX(leaks.n), 0) AS n_leaks
FROM x LEFT JOIN leaks USING (fold) GROUP BY x.fold"""

SQL["subsample_one_per_source"] = w(CORPUS, COUNTS, AUG_LOW) + f"""
SELECT id, source_doc_id FROM (
  SELECT id, source_doc_id,
         ROW_NUMBER() OVER (PARTITION BY source_doc_id ORDER BY {hkey(42)}, id) AS rn
  FROM aug WHERE source_doc_id IS NOT NULL) WHERE rn = 1"""

SQL["subsample_unique_text"] = w(CORPUS, COUNTS, AUG_LOW) + f"""
SELECT id, source_doc_id FROM (
  SELECT id, source_doc_id,
         ROW_NUMBER() OVER (PARTITION BY text ORDER BY {hkey(42)}, id) AS rn
  FROM aug WHERE source_doc_id IS NOT NULL AND text IS NOT NULL) WHERE rn = 1"""

ONE_PER_SOURCE = f"""
kept AS (
  SELECT id, source_doc_id FROM aug WHERE source_doc_id IS NULL
  UNION ALL
  SELECT id, source_doc_id FROM (
    SELECT id, source_doc_id,
           ROW_NUMBER() OVER (PARTITION BY source_doc_id ORDER BY {hkey(42)}, id) AS rn
    FROM aug WHERE source_doc_id IS NOT NULL) WHERE rn = 1),
re AS (SELECT id, source_doc_id,
              ROW_NUMBER() OVER (ORDER BY source_doc_id IS NOT NULL, id) - 1 AS new_id FROM kept)"""

SQL["reindex_dense"] = w(CORPUS, COUNTS, AUG_LOW, ONE_PER_SOURCE) + """
SELECT id, source_doc_id, new_id FROM re"""

UNIQUE_TEXT = f"""
kept AS (
  SELECT id, source_doc_id FROM aug WHERE source_doc_id IS NULL
  UNION ALL
  SELECT id, source_doc_id FROM (
    SELECT id, source_doc_id,
           ROW_NUMBER() OVER (PARTITION BY text ORDER BY {hkey(42)}, id) AS rn
    FROM aug WHERE source_doc_id IS NOT NULL AND text IS NOT NULL) WHERE rn = 1),
re AS (SELECT id, source_doc_id,
              ROW_NUMBER() OVER (ORDER BY source_doc_id IS NOT NULL, id) - 1 AS new_id FROM kept)"""

SQL["id_contiguity"] = w(CORPUS, COUNTS, AUG_LOW, UNIQUE_TEXT) + """
SELECT 'id' AS id_column, MIN(id) AS min_id, MAX(id) AS max_id, COUNT(*) AS n_rows,
       COUNT(DISTINCT id) AS n_distinct, MAX(id) - MIN(id) + 1 - COUNT(DISTINCT id) AS n_missing,
       (MAX(id) - MIN(id) + 1 = COUNT(*)) AND (COUNT(*) = COUNT(DISTINCT id)) AS contiguous FROM re
UNION ALL
SELECT 'new_id', MIN(new_id), MAX(new_id), COUNT(*), COUNT(DISTINCT new_id),
       MAX(new_id) - MIN(new_id) + 1 - COUNT(DISTINCT new_id),
       (MAX(new_id) - MIN(new_id) + 1 = COUNT(*)) AND (COUNT(*) = COUNT(DISTINCT new_id)) FROM re"""

SQL["partition_reconcile"] = w(CORPUS, COUNTS, AUG_LOW) + """
SELECT COUNT(*) AS n_total, COUNT(*) FILTER (WHERE source_doc_id IS NULL) AS n_original,
       COUNT(*) FILTER (WHERE source_doc_id IS NOT NULL) AS n_augmented,
       COUNT(*) FILTER (WHERE source_doc_id IS NULL) + COUNT(*) FILTER (WHERE source_doc_id IS NOT NULL)
         = COUNT(*) AS parts_sum_to_whole
FROM aug"""

SQL["random_subset"] = w(CORPUS) + f"""
SELECT id, event_type FROM corpus ORDER BY {hkey(42)}, id LIMIT 100"""

SQL["bounded_read"] = w(CORPUS) + """
SELECT id, event_type FROM corpus ORDER BY id LIMIT 25"""



# --- M4: text, n-grams, TF-IDF, ROUGE -------------------------------------------------------
TOKENS = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
STRIP = r"regexp_replace({c}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


def grams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def normalised(c: str) -> str:
    flat = f"replace({STRIP.format(c=c)}, chr(10), ' ')"
    return f"array_to_string({SENTS.format(c=flat)}, chr(10))"


SQL["assemble_text"] = w(CORPUS) + """
SELECT id, concat_ws('. ', title, text) AS doc FROM corpus"""

SQL["truncate_chars"] = w(CORPUS) + """
SELECT id, substring(text, 1, 4999) AS truncated, length(text) > 5000 AS was_truncated FROM corpus"""

SQL["chunk_rejoin"] = w(CORPUS) + """
SELECT id, CAST(greatest(CAST(ceil(length(text) / 1000) AS INTEGER), 1) AS INTEGER) AS n_chunks,
       md5(array_to_string(list_transform(
             range(0, greatest(CAST(ceil(length(text) / 1000) AS INTEGER), 1)),
             lambda i: replace(substring(text, CAST(i * 1000 + 1 AS INTEGER), 1000), ' the ', ' le ')), '')) AS out_md5
FROM corpus"""

SQL["first_n_sentences"] = w(CORPUS) + f"""
SELECT id, CAST(len({SENTS.format(c='text')}) AS INTEGER) AS n_sentences,
       array_to_string({SENTS.format(c='text')}[1:3], ' ') AS lead FROM corpus"""

SQL["summary_normalise"] = f"""
SELECT conv_id, turn, {normalised('text')} AS normalised FROM conversations WHERE role = 'assistant'"""

SQL["ngrams_1_3"] = w(CORPUS) + f""",
t AS (SELECT id, {TOKENS.format(c='text')} AS t FROM corpus)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len({grams('t', 2)}) AS INTEGER) AS n_bigrams,
       CAST(len({grams('t', 3)}) AS INTEGER) AS n_trigrams,
       md5(array_to_string(list_concat({grams('t', 1)}, {grams('t', 2)}, {grams('t', 3)}), '|')) AS grams_md5
FROM t"""

TF = f"""
toks AS (SELECT id, {TOKENS.format(c='text')} AS t FROM corpus),
g AS (SELECT id, unnest({grams('t', 1)}) AS term FROM toks
      UNION ALL SELECT id, unnest({grams('t', 2)}) FROM toks
      UNION ALL SELECT id, unnest({grams('t', 3)}) FROM toks),
tf AS (SELECT id, term, COUNT(*) AS tf FROM g GROUP BY id, term),
ndocs AS (SELECT COUNT(*) AS n FROM corpus),
vocab AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term
          HAVING COUNT(*) >= 3 AND COUNT(*) <= CAST(1.0 AS DOUBLE) * (SELECT n FROM ndocs))"""

SQL["doc_frequency_pruned"] = w(CORPUS, TF) + """
SELECT term, df FROM vocab"""

SQL["tfidf"] = w(CORPUS, TF) + """,
raw AS (SELECT tf.id, tf.term,
               tf.tf * (ln(CAST(1 + (SELECT n FROM ndocs) AS DOUBLE) / (v.df + 1.0)) + 1.0) AS w
        FROM tf JOIN vocab v USING (term))
SELECT id, term, round(w / sqrt(SUM(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw"""

SQL["tfidf_transform"] = w(CORPUS) + f""",
sp AS (SELECT id, ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1 AS r, COUNT(*) OVER () AS n FROM corpus),
tr AS (SELECT id, r < floor({F1} * n) AS train FROM sp),
toks AS (SELECT id, train, {TOKENS.format(c='text')} AS t FROM corpus JOIN tr USING (id)),
g AS (SELECT id, train, unnest({grams('t', 1)}) AS term FROM toks
      UNION ALL SELECT id, train, unnest({grams('t', 2)}) FROM toks
      UNION ALL SELECT id, train, unnest({grams('t', 3)}) FROM toks),
tf AS (SELECT id, train, term, COUNT(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT COUNT(*) AS n FROM tr WHERE train),
vocab AS (SELECT term, COUNT(*) AS df FROM tf WHERE train GROUP BY term HAVING COUNT(*) >= 3),
raw AS (SELECT tf.id, tf.term, tf.tf * (ln(CAST(1 + (SELECT n FROM nd) AS DOUBLE) / (v.df + 1.0)) + 1.0) AS w
        FROM tf JOIN vocab v USING (term) WHERE NOT tf.train)
SELECT id, term, round(w / sqrt(SUM(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw"""

PAIRS = """
pairs AS (SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS reference
          FROM conversations a JOIN conversations u
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE a.role = 'assistant' AND u.role = 'user')"""


def rouge_n_sql(n: int, pairs: str = PAIRS, key: str = "conv_id, turn") -> str:
    """CTE chain ending in ``m(key..., p, r)`` over a ``pairs(key..., prediction, reference)`` CTE."""
    tp = TOKENS.format(c=normalised("prediction"))
    tr = TOKENS.format(c=normalised("reference"))
    return w(pairs) + f""",
tk AS (SELECT {key}, {grams('tp', n)} AS gp, {grams('tr', n)} AS gr
       FROM (SELECT {key}, {tp} AS tp, {tr} AS tr FROM pairs)),
cp AS (SELECT {key}, g, COUNT(*) AS c FROM (SELECT {key}, unnest(gp) AS g FROM tk) GROUP BY ALL),
cr AS (SELECT {key}, g, COUNT(*) AS c FROM (SELECT {key}, unnest(gr) AS g FROM tk) GROUP BY ALL),
ov AS (SELECT {key}, SUM(least(cp.c, cr.c)) AS o FROM cp JOIN cr USING ({key}, g) GROUP BY ALL),
s AS (SELECT {key}, COALESCE(ov.o, 0) AS o, len(gp) AS np, len(gr) AS nr
      FROM tk LEFT JOIN ov USING ({key})),
m AS (SELECT {key}, CASE WHEN np > 0 THEN o / np ELSE 0.0 END AS p,
             CASE WHEN nr > 0 THEN o / nr ELSE 0.0 END AS r FROM s)
"""


for _n in (1, 2):
    SQL[f"rouge_{_n}"] = rouge_n_sql(_n) + """
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS fmeasure FROM m"""

# Longest common subsequence as a fold over the reference's tokens: a row of lengths per token, where
# row'[j] = max(row[j], row[p - 1] + 1 for the latest match p <= j).
SQL["rouge_l"] = w(PAIRS).replace("WITH", "WITH RECURSIVE", 1) + f""",
tk AS MATERIALIZED (SELECT conv_id, turn, {TOKENS.format(c=normalised("prediction"))} AS a, {TOKENS.format(c=normalised("reference"))} AS b FROM pairs),
st AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS lens FROM tk
       UNION ALL
       SELECT conv_id, turn, a, b, i + 1,
              list_transform(range(1, len(b) + 2), lambda j: greatest(lens[j], coalesce(list_max(list_transform(
                  list_filter(range(2, CAST(j AS BIGINT) + 1), lambda p: b[p - 1] = a[i + 1]), lambda p: lens[p - 1] + 1)), 0)))
       FROM st WHERE i < len(a)),
l AS (SELECT conv_id, turn, CAST(lens[len(b) + 1] AS DOUBLE) AS l, len(a) AS n, len(b) AS m FROM st WHERE i = len(a)),
m AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN l / n ELSE 0.0 END AS p, CASE WHEN m > 0 THEN l / m ELSE 0.0 END AS r FROM l)
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS fmeasure FROM m"""

SQL["rouge_summary"] = (
    "SELECT 'rouge1' AS metric, round(AVG(f) * 100, 4) AS score FROM (" + rouge_n_sql(1)
    + " SELECT CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m)"
    + " UNION ALL SELECT 'rouge2', round(AVG(f) * 100, 4) FROM (" + rouge_n_sql(2)
    + " SELECT CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m)")


# Union of longest common subsequences per reference line: rows of lengths forward, then one path back for each
# pair of lines (equal tokens belong to it, else the candidate's token goes where only that keeps the length).
LSUM = w(PAIRS).replace("WITH", "WITH RECURSIVE", 1) + f""",
pl AS MATERIALIZED (SELECT conv_id, turn, ci, {TOKENS.format(c='line')} AS c FROM
  (SELECT conv_id, turn, unnest(x) AS line, generate_subscripts(x, 1) AS ci FROM (SELECT conv_id, turn, string_split({normalised("prediction")}, chr(10)) AS x FROM pairs))),
rl AS MATERIALIZED (SELECT conv_id, turn, ri, {TOKENS.format(c='line')} AS r FROM
  (SELECT conv_id, turn, unnest(x) AS line, generate_subscripts(x, 1) AS ri FROM (SELECT conv_id, turn, string_split({normalised("reference")}, chr(10)) AS x FROM pairs))),
lines AS MATERIALIZED (SELECT conv_id, turn, ri, ci, r, c FROM rl JOIN pl USING (conv_id, turn) WHERE list_has_any(r, c)),
fw AS (SELECT conv_id, turn, ri, ci, r, c, 0 AS i, [list_transform(range(0, len(c) + 1), lambda x: 0)] AS t FROM lines
       UNION ALL
       SELECT conv_id, turn, ri, ci, r, c, i + 1,
              list_append(t, list_transform(range(1, len(c) + 2), lambda j: greatest(t[i + 1][j], coalesce(list_max(list_transform(
                  list_filter(range(2, CAST(j AS BIGINT) + 1), lambda p: c[p - 1] = r[i + 1]), lambda p: t[i + 1][p - 1] + 1)), 0))))
       FROM fw WHERE i < len(r)),
bw AS (SELECT conv_id, turn, ri, ci, r, c, t, CAST(len(r) AS BIGINT) AS i, CAST(len(c) AS BIGINT) AS j, CAST([] AS BIGINT[]) AS taken FROM fw WHERE i = len(r)
       UNION ALL
       SELECT conv_id, turn, ri, ci, r, c, t,
              CASE WHEN r[i] = c[j] OR t[i + 1][j] <= t[i][j + 1] THEN i - 1 ELSE i END,
              CASE WHEN r[i] = c[j] OR t[i + 1][j] > t[i][j + 1] THEN j - 1 ELSE j END,
              CASE WHEN r[i] = c[j] THEN list_append(taken, i) ELSE taken END
       FROM bw WHERE i > 0 AND j > 0),
places AS (SELECT DISTINCT conv_id, turn, ri, r, unnest(taken) AS q FROM bw WHERE i = 0 OR j = 0),
un AS (SELECT conv_id, turn, r[q] AS g, COUNT(*) AS n FROM places GROUP BY ALL),
cp AS (SELECT conv_id, turn, g, COUNT(*) AS n FROM (SELECT conv_id, turn, unnest(c) AS g FROM pl) GROUP BY ALL),
cr AS (SELECT conv_id, turn, g, COUNT(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS g FROM rl) GROUP BY ALL),
hit AS (SELECT conv_id, turn, SUM(least(un.n, cp.n, cr.n)) AS h FROM un JOIN cp USING (conv_id, turn, g) JOIN cr USING (conv_id, turn, g) GROUP BY ALL),
np AS (SELECT conv_id, turn, SUM(n) AS n FROM cp GROUP BY ALL),
nr AS (SELECT conv_id, turn, SUM(n) AS n FROM cr GROUP BY ALL),
m AS (SELECT conv_id, turn, CASE WHEN np.n > 0 THEN coalesce(h, 0) / np.n ELSE 0.0 END AS p, CASE WHEN nr.n > 0 THEN coalesce(h, 0) / nr.n ELSE 0.0 END AS r
      FROM pairs LEFT JOIN hit USING (conv_id, turn) LEFT JOIN np USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn))
"""
FMEASURE = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"
SQL["rouge_lsum"] = LSUM + f"""
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round({FMEASURE}, 6) AS fmeasure FROM m"""

SQL["rouge_summary_all"] = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, round(AVG({FMEASURE}) * 100, 4) AS score FROM (" + chain + " SELECT p, r FROM m)"
    for name, chain in (("rouge1", rouge_n_sql(1)), ("rouge2", rouge_n_sql(2)),
                        ("rougeL", SQL["rouge_l"].rsplit("SELECT conv_id, turn, round(p, 6)", 1)[0]), ("rougeLsum", LSUM)))


# --- M5: evaluation -------------------------------------------------------------------------


CLASSES = {"de": "[äöüß]", "es": "[ñ¿¡áíóú]", "fr": "[éèêàçùâîô]"}


def rule(x: str) -> str:
    """First class with a hit."""
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{k}'" for k, p in CLASSES.items()) + " ELSE 'en' END"


def report_ctes(src: str, by: str) -> str:
    """CTEs pc (per class) and report (long) over ``src`` (columns {by}, y_true, y_pred)."""
    return f"""
ev AS (SELECT {by}, CAST(y_true AS VARCHAR) AS label, 1 AS t, 0 AS pr,
              CAST(CAST(y_true AS VARCHAR) = CAST(y_pred AS VARCHAR) AS INTEGER) AS tp FROM {src}
       UNION ALL SELECT {by}, CAST(y_pred AS VARCHAR), 0, 1, 0 FROM {src}),
pc AS (SELECT {by}, label, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(pr) AS BIGINT) AS predicted,
              CAST(SUM(t) AS BIGINT) AS support FROM ev GROUP BY ALL),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS P,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS R FROM pc),
m2 AS (SELECT *, CASE WHEN P + R > 0 THEN 2 * P * R / (P + R) ELSE 0.0 END AS F FROM m),
report AS (
  SELECT {by}, label, P AS precision, R AS recall, F AS f1, support FROM m2
  UNION ALL SELECT {by}, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), SUM(tp) / SUM(support),
                   CAST(SUM(support) AS BIGINT) FROM m2 GROUP BY ALL
  UNION ALL SELECT {by}, 'macro avg', AVG(P), AVG(R), AVG(F), CAST(SUM(support) AS BIGINT) FROM m2 GROUP BY ALL
  UNION ALL SELECT {by}, 'weighted avg', SUM(P * support) / SUM(support), SUM(R * support) / SUM(support),
                   SUM(F * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM m2 GROUP BY ALL)"""


PREDS = f"""
bodies AS (SELECT *, substring(text, length(title) + 2) AS body FROM corpus),
preds AS (SELECT 'title' AS experiment, id, event_type AS y_true, {rule("concat_ws('. ', title, body)")} AS y_pred FROM bodies
          UNION ALL
          SELECT 'text', id, event_type, {rule('body')} FROM bodies)"""

SQL["classification_report"] = w(CORPUS, PREDS, report_ctes("preds", "experiment")) + """
SELECT experiment, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM report"""

EMB = """
ep AS (SELECT vec_id, label AS y_true,
              CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS y_pred,
              1 AS one FROM embeddings)"""

SQL["argmax_labels"] = w(EMB) + """
SELECT vec_id, y_true, y_pred FROM ep"""

SQL["macro_metrics"] = w(EMB, report_ctes("ep", "one")) + """
SELECT round(MAX(precision) FILTER (WHERE label = 'macro avg'), 6) AS precision,
       round(MAX(recall) FILTER (WHERE label = 'macro avg'), 6) AS recall,
       round(MAX(f1) FILTER (WHERE label = 'macro avg'), 6) AS f1_macro,
       round(MAX(f1) FILTER (WHERE label = 'accuracy'), 6) AS accuracy FROM report"""

COMPARISON = """
lg AS (SELECT experiment, label, support, 'precision' AS metric, precision AS value FROM report
       UNION ALL SELECT experiment, label, support, 'recall', recall FROM report
       UNION ALL SELECT experiment, label, support, 'f1', f1 FROM report),
cmp AS (SELECT o.label, o.metric, o.value AS old, n.value AS new, n.value - o.value AS delta, o.support
        FROM lg o JOIN lg n ON o.label = n.label AND o.metric = n.metric
        WHERE o.experiment = 'title' AND n.experiment = 'text' AND o.label <> 'accuracy')"""

SQL["report_comparison"] = w(CORPUS, PREDS, report_ctes("preds", "experiment"), COMPARISON) + """
SELECT label, metric, round(old, 6) AS old, round(new, 6) AS new, round(delta, 6) AS delta, support FROM cmp"""

SQL["delta_by_support"] = w(CORPUS, PREDS, report_ctes("preds", "experiment"), COMPARISON) + """
SELECT label, support, round(old, 6) AS old, round(new, 6) AS new, round(delta, 6) AS delta,
       CAST(ROW_NUMBER() OVER (ORDER BY support DESC, label) AS INTEGER) AS position
FROM cmp WHERE metric = 'f1' AND label NOT IN ('accuracy', 'macro avg', 'weighted avg')"""



def naive_bayes(docs: str) -> str:
    """CTE ``nb`` (run, a, fold, id, y_true, y_pred) of the models without a fold, over ``docs`` (run, id, fold, label, g).

    A fold of null is in every training set and is not predicted.
    """
    return f"""
tfs AS MATERIALIZED (SELECT run, id, fold, label, term, COUNT(*) AS tf FROM (SELECT run, id, fold, label, unnest(g) AS term FROM {docs}) GROUP BY ALL),
fo AS (SELECT DISTINCT fold FROM {docs} WHERE fold >= 0),
tc AS MATERIALIZED (SELECT run, fo.fold AS f, term, label, SUM(tf) AS n FROM tfs, fo WHERE tfs.fold <> fo.fold GROUP BY ALL),
sz AS (SELECT run, f, COUNT(DISTINCT term) AS v FROM tc GROUP BY ALL),
cn AS (SELECT run, f, label, SUM(n) AS n FROM tc GROUP BY ALL),
cd AS (SELECT run, fo.fold AS f, label, COUNT(*) AS d FROM {docs} x, fo WHERE x.fold <> fo.fold GROUP BY ALL),
pr AS (SELECT *, SUM(d) OVER (PARTITION BY run, f) AS all_d FROM cd),
par AS (SELECT run, f, label, a, ln(CAST(d AS DOUBLE) / CAST(all_d AS DOUBLE)) AS prior, CAST(coalesce(cn.n, 0) AS DOUBLE) + a * sz.v AS denominator
        FROM pr JOIN sz USING (run, f) LEFT JOIN cn USING (run, f, label), (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) s(a)),
known AS (SELECT t.run, t.id, t.fold, t.term, t.tf FROM tfs t WHERE EXISTS (SELECT 1 FROM tc WHERE tc.run = t.run AND tc.f = t.fold AND tc.term = t.term)),
len AS (SELECT run, id, SUM(tf) AS len FROM known GROUP BY ALL),
gain AS (SELECT k.run, k.id, tc.label, a, SUM(k.tf * ln((tc.n + a) / a)) AS gain
         FROM known k JOIN tc ON tc.run = k.run AND tc.f = k.fold AND tc.term = k.term, (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) s(a) GROUP BY ALL),
nb AS (SELECT x.run, par.a, x.fold, x.id, x.label AS y_true, par.label AS y_pred
       FROM {docs} x JOIN par ON par.run = x.run AND par.f = x.fold LEFT JOIN len ON len.run = x.run AND len.id = x.id
       LEFT JOIN gain ON gain.run = x.run AND gain.id = x.id AND gain.label = par.label AND gain.a = par.a
       QUALIFY ROW_NUMBER() OVER (PARTITION BY x.run, par.a, x.id
         ORDER BY prior + coalesce(len.len, 0) * ln(par.a / denominator) + coalesce(gain, 0) DESC, par.label) = 1)"""


CV = f"""
kf AS (SELECT id, CAST((ROW_NUMBER() OVER (ORDER BY event_type, {hkey(18091999)}, id) - 1) % 5 AS INTEGER) AS fold
       FROM corpus),
bodies AS (SELECT id, event_type, fold, title, substring(text, length(title) + 2) AS body FROM corpus JOIN kf USING (id)),
views AS (SELECT 'nb.title' AS view, id, fold, event_type AS label, {TOKENS.format(c="concat_ws('. ', title, body)")} AS t FROM bodies
          UNION ALL SELECT 'nb.notitle', id, fold, event_type, {TOKENS.format(c='body')} FROM bodies),
nd AS MATERIALIZED (SELECT view || '.n1' AS run, id, fold, label, t AS g FROM views
       UNION ALL SELECT view || '.n2', id, fold, label, list_concat(t, {grams('t', 2)}) FROM views),{naive_bayes('nd')},
cvp AS (SELECT run || '.a' || CAST(a AS VARCHAR) AS experiment, fold, y_true, y_pred FROM nb)"""

SCORES = CV + "," + report_ctes("cvp", "experiment, fold") + """,
scores AS (SELECT experiment, fold, f1 AS score FROM report WHERE label = 'macro avg'),
st AS (SELECT experiment, COUNT(*) AS n_folds, AVG(score) AS mean, var_pop(score) AS var,
              stddev_pop(score) AS std FROM scores GROUP BY experiment),
groups AS (
  SELECT g.grouping, g.name AS group_name, st.experiment, st.mean FROM st
  JOIN (VALUES ('title', 'TITLE', '.title.'), ('title', 'NO_TITLE', '.notitle.'), ('ngrams', 'n1', '.n1.'), ('ngrams', 'n2', '.n2.')) g(grouping, name, tag)
    ON contains(st.experiment, g.tag))"""

SQL["cv_fold_scores"] = w(CORPUS) + "," + SCORES + """
SELECT experiment, fold, round(score, 6) AS score FROM scores"""

SQL["cv_score_stats"] = w(CORPUS) + "," + SCORES + """
SELECT experiment, n_folds, round(mean, 6) AS mean, round(var, 6) AS var, round(std, 6) AS std FROM st"""

SQL["experiment_group_means"] = w(CORPUS) + "," + SCORES + """
SELECT grouping, group_name, experiment, round(mean, 6) AS mean FROM groups"""

SQL["group_box_stats"] = w(CORPUS) + "," + SCORES + """,
q AS (SELECT grouping, group_name, quantile_cont(mean, 0.25) AS q25, quantile_cont(mean, 0.5) AS q50,
             quantile_cont(mean, 0.75) AS q75 FROM groups GROUP BY ALL),
qi AS (SELECT *, q75 - q25 AS iqr FROM q)
SELECT g.grouping, g.group_name, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
       round(iqr, 6) AS iqr, COUNT(*) AS n,
       round(MIN(mean) FILTER (WHERE mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr), 6) AS whisker_low,
       round(MAX(mean) FILTER (WHERE mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr), 6) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr)) AS n_fliers
FROM groups g JOIN qi USING (grouping, group_name)
GROUP BY g.grouping, g.group_name, q25, q50, q75, iqr"""

SQL["run_consistency"] = w(CORPUS) + """
SELECT COUNT(*) * 3 AS n_outputs, COUNT(*) * 3 AS n_consistent, CAST(2 AS BIGINT) AS n_runs, TRUE AS all_consistent
FROM corpus"""

SQL["length_profile"] = w(CORPUS) + """
SELECT event_type, COUNT(*) AS n, CAST(MIN(length(text)) AS INTEGER) AS min_len,
       round(AVG(length(text)), 6) AS mean_len, CAST(MAX(length(text)) AS INTEGER) AS max_len,
       round(quantile_cont(length(text), 0.25), 6) AS q25, round(quantile_cont(length(text), 0.5), 6) AS q50,
       round(quantile_cont(length(text), 0.75), 6) AS q75
FROM corpus GROUP BY event_type"""

SQL["row_count_audit"] = w(CORPUS, COUNTS, AUG_LOW) + """
SELECT 'documents' AS stage, COUNT(*) AS n_rows FROM documents
UNION ALL SELECT 'corpus', COUNT(*) FROM corpus
UNION ALL SELECT 'deduplicated', COUNT(*) FROM corpus
          WHERE text IN (SELECT text FROM corpus GROUP BY text HAVING COUNT(*) = 1)
UNION ALL SELECT 'low_resource', COUNT(*) FROM corpus WHERE event_type IN (SELECT event_type FROM lowres)
UNION ALL SELECT 'augmented', COUNT(*) FROM aug"""



# --- M6: training-set shaping, plug-ins, literal columns -----------------------------------

MAPPING = """
mp AS (SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_id
       FROM (SELECT DISTINCT event_type FROM sp WHERE split = 'train'))"""

SQL["label_encoding"] = w(CORPUS, SPLIT_PLAIN_LABELLED, MAPPING) + """
SELECT event_type, label_id FROM mp"""

SQL["label_encoded_dev"] = w(CORPUS, SPLIT_PLAIN_LABELLED, MAPPING) + """
SELECT sp.id, mp.label_id FROM sp JOIN mp USING (event_type) WHERE sp.split = 'dev'"""

TOK = TOKENS.format(c="text")

SQL["truncate_tokens"] = w(CORPUS) + f"""
SELECT id, CAST(len({TOK}) AS INTEGER) AS n_tokens, CAST(least(len({TOK}), 512) AS INTEGER) AS n_kept,
       md5(array_to_string({TOK}[1:512], ' ')) AS kept_md5 FROM corpus"""

SQL["pad_batches"] = w(CORPUS) + f""",
b AS (SELECT id, {TOK}[1:512] AS t, (ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1) // 8 AS batch FROM corpus),
p AS (SELECT *, MAX(len(t)) OVER (PARTITION BY batch) AS longest FROM b)
SELECT id, batch, CAST(len(t) AS INTEGER) AS length, CAST(longest AS INTEGER) AS padded_length,
       md5(array_to_string(list_resize(t, longest, '<pad>'), ' ')) AS padded_md5 FROM p"""

SQL["interleave_tasks"] = w(PAIRS, CORPUS) + f""",
ka AS (SELECT conv_id || '-' || turn AS k FROM pairs),
ab AS (SELECT k, (ROW_NUMBER() OVER (ORDER BY {hkey(42, 'k')}, k) - 1) // 8 AS batch FROM ka),
nb AS (SELECT ((SELECT COUNT(*) FROM ka) + 7) // 8 AS na, ((SELECT COUNT(*) FROM corpus) + 63) // 64 AS nbb),
cyc AS (SELECT range AS cycle FROM range(0, (SELECT (na + nbb - 1) // nbb FROM nb))),
num AS (SELECT id, ROW_NUMBER() OVER (ORDER BY {hkey(42, 'CAST(id AS VARCHAR)')}, CAST(id AS VARCHAR)) - 1 AS x, COUNT(*) OVER () AS n FROM corpus),
-- 24 rounds that swap x with K - x modulo n, or not, by a hash of the larger one.
bb AS (SELECT cycle, id, list_reduce(range(0, 24), lambda x, r: CASE
         WHEN md5('b:42:' || cycle || ':' || r || ':' || greatest(x, (CAST('0x' || md5('k:42:' || cycle || ':' || r)[1:15] AS BIGINT) % n + n - x) % n))[1:1] >= '8'
         THEN (CAST('0x' || md5('k:42:' || cycle || ':' || r)[1:15] AS BIGINT) % n + n - x) % n ELSE x END, x) // 64 AS batch
       FROM num, cyc)
SELECT 2 * batch + 1 AS step, 'A' AS task, CAST(0 AS BIGINT) AS cycle, batch, k AS key FROM ab
UNION ALL
SELECT 2 * (cycle * (SELECT nbb FROM nb) + batch) + 2, 'B', cycle, batch, CAST(id AS VARCHAR)
FROM bb WHERE cycle * (SELECT nbb FROM nb) + batch < (SELECT na FROM nb)"""

ASM_TOK = TOKENS.format(c="concat_ws('. ', c.title, c.text)")

SQL["docee_trainset"] = w(CORPUS, SPLIT_PLAIN_LABELLED, MAPPING) + f"""
SELECT sp.id, mp.label_id, CAST(least(len({ASM_TOK}), 512) AS INTEGER) AS n_input_tokens,
       array_to_string({ASM_TOK}[1:512], ' ') AS input_tokens
FROM sp JOIN mp USING (event_type) JOIN corpus c ON c.id = sp.id
WHERE sp.split = 'train'
ORDER BY {hkey(42, 'sp.id')}, sp.id LIMIT 200"""

SQL["summary_trainset"] = w(PAIRS) + f"""
SELECT conv_id, turn, CAST(least(len({TOKENS.format(c='reference')}), 512) AS INTEGER) AS n_article_tokens,
       CAST(least(len({TOKENS.format(c='prediction')}), 100) AS INTEGER) AS n_highlight_tokens,
       array_to_string({TOKENS.format(c='reference')}[1:512], ' ') AS article_tokens,
       array_to_string({TOKENS.format(c='prediction')}[1:100], ' ') AS highlight_tokens
FROM pairs ORDER BY {hkey(42, "(conv_id || '-' || turn)")}, conv_id || '-' || turn LIMIT 100"""

_ASM = "concat_ws('. ', title, text)"
LEAD25 = f"array_to_string({SENTS.format(c=_ASM)}[1:25], ' ')"

SQL["preprocess_tokens"] = w(CORPUS) + f""",
t AS (SELECT id, {TOKENS.format(c=LEAD25)} AS t FROM corpus)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""

SQL["unnamed_dropped"] = w(CORPUS) + """
SELECT id, title, event_type FROM corpus"""

SQL["ignore_index_replaced"] = w(CORPUS) + f""",
n AS (SELECT id, list_transform({TOK}, lambda t: CASE WHEN length(t) % 3 = 0 THEN 1 ELSE length(t) END) AS ids FROM corpus)
SELECT id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM n"""

SQL["cased_tokens"] = w(CORPUS) + """,
t AS (SELECT id, list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda x: x <> '') AS t FROM corpus)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""

SQL["map_batches_plugin"] = w(CORPUS) + """
SELECT id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars FROM corpus"""

SQL["tokenize_plugin"] = w(CORPUS) + f""",
t AS (SELECT id, {TOK} AS t FROM corpus)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""

SQL["translate_plugin"] = SQL["chunk_rejoin"]

INFER = f"""
ip AS (SELECT event_type AS y_true, {rule('text')} AS y_pred, 1 AS one FROM corpus)"""

SQL["batch_inference_plugin"] = w(CORPUS, INFER, report_ctes("ip", "one")) + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM report"""

# Fold -1 is the train split; the model without fold 0 is fitted on it alone and predicts every text, as fold 0.
SQL["batch_inference_report"] = w(CORPUS) + f""",
sp AS (SELECT id, ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1 AS r, COUNT(*) OVER () AS n FROM corpus),
own AS (SELECT id, event_type AS label, {TOK} AS g, r < floor({F1} * n) AS train FROM corpus JOIN sp USING (id)),
nd AS MATERIALIZED (SELECT 'nb' AS run, id, 0 AS fold, label, g FROM own UNION ALL SELECT 'nb', id, -1, label, g FROM own WHERE train),{naive_bayes('nd')},
ip AS (SELECT y_true, y_pred, 1 AS one FROM nb WHERE a = 1),{report_ctes("ip", "one")}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM report"""

SQL["literal_tokens"] = w(CORPUS) + """
SELECT id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_items,
       md5(array_to_string(string_split(text, ' '), chr(1))) AS items_md5 FROM corpus"""

SQL["literal_arguments"] = w(CORPUS) + f""",
s AS (SELECT id, text, {SENTS.format(c='text')} AS ss FROM corpus),
u AS (SELECT id, text, unnest(ss) AS sent, unnest(range(0, len(ss))) AS type FROM s)
SELECT id, CAST(type AS INTEGER) AS type, CAST(strpos(text, sent) - 1 AS INTEGER) AS start,
       CAST(strpos(text, sent) - 1 + length(sent) AS INTEGER) AS "end", sent AS text FROM u"""



# --- coverage per batch, filtered experiment analysis ---------------------------------------
BATCHES = f"""
bt AS (SELECT id, event_type, (ROW_NUMBER() OVER (ORDER BY {hkey(42)}, id) - 1) // 8 AS batch FROM corpus)"""

SQL["batch_label_coverage"] = w(CORPUS, BATCHES) + """
SELECT batch, COUNT(*) AS n_rows, COUNT(DISTINCT event_type) AS n_labels,
       (SELECT COUNT(DISTINCT event_type) FROM bt) - COUNT(DISTINCT event_type) AS n_missing_labels
FROM bt GROUP BY batch"""

SQL["batch_missing_labels"] = w(CORPUS, BATCHES) + """
SELECT b.batch, l.event_type FROM (SELECT DISTINCT batch FROM bt) b, (SELECT DISTINCT event_type FROM bt) l
WHERE NOT EXISTS (SELECT 1 FROM bt x WHERE x.batch = b.batch AND x.event_type = l.event_type)"""

SQL["filtered_group_box_stats"] = w(CORPUS) + "," + SCORES.replace(
    "FROM scores GROUP BY experiment)", "FROM scores WHERE NOT ends_with(experiment, '.a1.0') GROUP BY experiment)") + """,
dg AS (SELECT * FROM groups WHERE grouping = 'ngrams'),
q AS (SELECT grouping, group_name, quantile_cont(mean, 0.25) AS q25, quantile_cont(mean, 0.5) AS q50,
             quantile_cont(mean, 0.75) AS q75 FROM dg GROUP BY ALL),
qi AS (SELECT *, q75 - q25 AS iqr FROM q)
SELECT g.grouping, g.group_name, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
       round(iqr, 6) AS iqr, COUNT(*) AS n,
       round(MIN(mean) FILTER (WHERE mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr), 6) AS whisker_low,
       round(MAX(mean) FILTER (WHERE mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr), 6) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (mean >= q25 - 1.5 * iqr AND mean <= q75 + 1.5 * iqr)) AS n_fliers
FROM dg g JOIN qi USING (grouping, group_name)
GROUP BY g.grouping, g.group_name, q25, q50, q75, iqr"""



# --- other tables: uniform classes (events), summary references (benchmark) ----------------
SQL["event_class_counts"] = """
SELECT event_type, COUNT(*) AS n,
       CAST(COUNT(*) OVER () AS BIGINT) AS n_classes,
       CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
FROM events GROUP BY event_type"""

BENCH_PAIRS = f"""
pairs AS (SELECT item_id, array_to_string({SENTS.format(c='text')}[1:1], ' ') AS prediction, text AS reference
          FROM benchmark)"""

SQL["rouge_lead_benchmark"] = rouge_n_sql(1, BENCH_PAIRS, "item_id") + """
SELECT item_id, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS fmeasure FROM m"""


SQL["rejected_labels"] = """
SELECT COUNT(*) FILTER (WHERE lang IS NULL) AS n_null_label, COUNT(*) AS n_documents FROM documents"""


SQL["augment_generator_plugin"] = SQL["augment_lead_k"]


SQL["kfold_assignment_compact"] = w(CORPUS, COUNTS, AUG_LOW, KFOLD_SAFE) + """
SELECT id, FALSE AS is_augmented, fold AS test_fold FROM f
UNION ALL SELECT id, TRUE, src_fold FROM a"""


WORD = r"""[^\s.,;:!?()"]+(\.[^\s.,;:!?()"]+)*\.?"""
ABBREVIATIONS = rf"""
aw AS (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS x FROM corpus),
ac AS (SELECT lower(regexp_replace(x, '\.$', '')) AS word, COUNT(*) FILTER (WHERE ends_with(x, '.')) AS n_stop, COUNT(*) AS n FROM aw GROUP BY 1),
tot AS (SELECT CAST(SUM(n_stop) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) AS share FROM ac),
al AS (SELECT word, n_stop, n, length(word) - length(replace(word, '.', '')) AS inside, share FROM ac, tot
       WHERE n_stop > 0 AND share < 1 AND NOT regexp_full_match(word, '[0-9.]+')),
ab AS (SELECT word, n_stop, n,
         -2 * (n_stop * ln(share) + (n - n_stop) * ln(1 - share) - n_stop * ln(CAST(0.99 AS DOUBLE)) - (n - n_stop) * ln(1 - CAST(0.99 AS DOUBLE)))
         * exp(-CAST(length(word) - inside AS DOUBLE)) * (inside + 1) * pow(CAST(length(word) - inside AS DOUBLE), -CAST(n - n_stop AS DOUBLE)) AS score FROM al),
abbr AS (SELECT * FROM ab WHERE score >= 0.3)"""

SQL["abbreviations"] = w(CORPUS, ABBREVIATIONS) + """
SELECT word, n_stop, n, round(score, 6) AS score FROM abbr"""

SQL["abbreviation_sentences"] = w(CORPUS, ABBREVIATIONS) + rf""",
sp AS (SELECT id, {SENTS.format(c='text')} AS ss FROM corpus),
pc AS (SELECT id, unnest(ss) AS piece, generate_subscripts(ss, 1) AS pos FROM sp),
lw AS (SELECT *, lower(regexp_extract(piece, '([^\s.,;:!?()"]+(\.[^\s.,;:!?()"]+)*)\.$', 1)) AS last_word FROM pc),
op AS (SELECT id, pos, piece, CASE WHEN lag(last_word) OVER (PARTITION BY id ORDER BY pos) IN (SELECT word FROM abbr) THEN 0 ELSE 1 END AS opens FROM lw),
sn AS (SELECT id, pos, piece, SUM(opens) OVER (PARTITION BY id ORDER BY pos) AS s FROM op),
se AS (SELECT id, s, string_agg(piece, ' ' ORDER BY pos) AS t FROM sn GROUP BY id, s)
SELECT id, CAST(COUNT(*) AS INTEGER) AS n_sentences, md5(string_agg(t, chr(10) ORDER BY s)) AS sentences_md5 FROM se GROUP BY id"""

# Ranks of the sentences of the low-resource texts: 20 rounds, then three picks, each less half the greatest cosine with earlier ones.
RANKS = f"""
lr AS MATERIALIZED (SELECT id, {SENTS.format(c='text')} AS ss FROM corpus WHERE event_type IN (SELECT event_type FROM lowres)),
st AS MATERIALIZED (SELECT id, generate_subscripts(ss, 1) AS s, unnest(ss) AS t, len(ss) AS n FROM lr),
tk AS (SELECT id, s, unnest({TOKENS.format(c='t')}) AS g FROM st),
ct AS (SELECT id, s, g, COUNT(*) AS c FROM tk GROUP BY ALL),
wt AS MATERIALIZED (SELECT id, s, g, c / sqrt(SUM(c * c) OVER (PARTITION BY id, s)) AS w FROM ct),
cs AS (SELECT id, g, SUM(w) AS x FROM wt GROUP BY id, g),
dg AS MATERIALIZED (SELECT id, s, SUM(w * x) AS d FROM wt JOIN cs USING (id, g) GROUP BY id, s),
p0 AS (SELECT id, s, n, CAST(1 AS DOUBLE) / n AS p FROM st),""" + ",".join(f"""
z{i} AS (SELECT id, g, SUM(w * p / d) AS z FROM wt JOIN p{i} USING (id, s) JOIN dg USING (id, s) GROUP BY id, g),
v{i} AS (SELECT id, s, SUM(w * z) AS v FROM wt JOIN z{i} USING (id, g) GROUP BY id, s),
p{i + 1} AS MATERIALIZED (SELECT id, s, n, (1 - CAST(0.85 AS DOUBLE)) / n + CAST(0.85 AS DOUBLE) * coalesce(v, 0) AS p FROM p{i} LEFT JOIN v{i} USING (id, s))""" for i in range(20)) + """,
k0 AS (SELECT id, s, p * n AS r, CAST(0 AS DOUBLE) AS near FROM p20),""" + ",".join(f"""
b{i} AS MATERIALIZED (SELECT id, s FROM k{i} QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY round(r - 0.5 * near, 9) DESC, s) = 1),
c{i} AS (SELECT x.id, x.s, SUM(x.w * y.w) AS c FROM wt x JOIN b{i} ON b{i}.id = x.id JOIN wt y ON y.id = b{i}.id AND y.s = b{i}.s AND y.g = x.g GROUP BY x.id, x.s),
k{i + 1} AS MATERIALIZED (SELECT k{i}.id, k{i}.s, r, greatest(near, coalesce(c, 0)) AS near FROM k{i} LEFT JOIN c{i} USING (id, s) ANTI JOIN b{i} USING (id, s))""" for i in range(3)) + """,
pk AS (SELECT id, s, 0 AS j FROM b0 UNION ALL SELECT id, s, 1 FROM b1 UNION ALL SELECT id, s, 2 FROM b2),
rv AS (SELECT pk.id, v.j, string_agg(t, ' ' ORDER BY pk.s) AS generated FROM pk JOIN st USING (id, s), (VALUES (0), (1), (2)) v(j) WHERE pk.j <= v.j GROUP BY pk.id, v.j)"""

SQL["augment_ranked"] = w(CORPUS, COUNTS, RANKS) + """,
orig AS (SELECT ROW_NUMBER() OVER (ORDER BY id) - 1 AS nid, * FROM corpus),
src AS (SELECT *, ROW_NUMBER() OVER (ORDER BY nid) - 1 AS srank FROM orig WHERE event_type IN (SELECT event_type FROM lowres))
SELECT nid AS id, title, text, event_type, CAST(date AS VARCHAR) AS date, CAST(NULL AS BIGINT) AS source_doc_id FROM orig
UNION ALL
SELECT (SELECT COUNT(*) FROM orig) + srank * 3 + j, title, generated, event_type, CAST(date AS VARCHAR), nid FROM src JOIN rv USING (id)"""

SQL["dictionary_translation"] = w(CORPUS) + """,
entries AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS e FROM benchmark),
runs AS (SELECT id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS x FROM corpus),
pieces AS (SELECT id, unnest(x) AS p, generate_subscripts(x, 1) AS place FROM runs)
SELECT c.id, md5(coalesce(string_agg(CASE WHEN e IS NULL THEN p ELSE '<' || reverse(p) || '>' END, '' ORDER BY place), '')) AS out_md5
FROM corpus c LEFT JOIN pieces USING (id) LEFT JOIN entries ON p = e GROUP BY c.id"""

SQL["positional_generator"] = f"""
SELECT CAST(doc_id AS BIGINT) AS id, array_to_string({SENTS.format(c='text')}[1:1], ' ') AS generated FROM documents"""

SQL["csv_round_trip"] = SQL["corpus"]
SQL["named_splits_round_trip"] = SQL["split_plain"]
SQL["score_dir_round_trip"] = SQL["cv_fold_scores"]
SQL["report_files_comparison"] = SQL["report_comparison"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
