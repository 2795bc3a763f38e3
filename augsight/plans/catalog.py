"""Query catalog: every registered query as ``fn(spark, data_dir) -> DataFrame``.

Parameters are fixed here (and mirrored in :mod:`augsight.plans.oracle`).
Cutoffs are expressed as a share of the corpus so the work and the answer
scale with the tables.  Every query reads whole tables and whole texts; the
only limits and truncations are the operators themselves (top-k bounded
read, hash-ordered random subsets, first-N sentences, character / token
truncation).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsight.functions import text as tx
from augsight.functions import arrays
from augsight.functions.rules import predict_language
from augsight.operators import (augment, bayes, classify, dedup, extract, features, grams, imbalance, metrics, plugins, positions, rouge, sentences,
                                splits, trainset)
from augsight.sources.tables import table
from augsight.operators.small import collect_small
from augsight.session import checkpoint_dir
from augsight.sources import scores as sc
from augsight.sources.corpus import corpus, named_splits, read_corpus_csv, rejected_labels, write_corpus, write_params

# Fixed parameters shared with the oracle SQL.
LOW_RESOURCE_SHARE = 0.129     # classes with <= 12.9 % of the rows are low-resource
SEED = 42
CV_SEED = 18091999

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _date_str(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string")) if "date" in df.columns else df


# --- M1: corpus, class counts, low-resource, dedup ------------------------------------------

@register("corpus")
def q_corpus(spark, d):
    return _date_str(corpus(spark, d).select("id", "title", "text", "event_type", "date"))


@register("class_counts")
def q_class_counts(spark, d):
    return imbalance.class_counts(corpus(spark, d))


@register("class_distribution")
def q_class_distribution(spark, d):
    return imbalance.class_distribution(corpus(spark, d))


@register("distinct_counts")
def q_distinct_counts(spark, d):
    return imbalance.distinct_counts(corpus(spark, d),
                                     ["event_type", "text", "title", "date", "source_doc_id", "arguments"])


@register("low_resource")
def q_low_resource(spark, d):
    return imbalance.low_resource_slice(corpus(spark, d), LOW_RESOURCE_SHARE).select("id", "event_type")


@register("low_resource_classes")
def q_low_resource_classes(spark, d):
    return imbalance.low_resource_classes(corpus(spark, d), LOW_RESOURCE_SHARE)


@register("low_resource_news")
def q_low_resource_news(spark, d):
    news = imbalance.news_only(corpus(spark, d))
    return imbalance.low_resource_slice(news, LOW_RESOURCE_SHARE).select("id", "event_type")


@register("low_resource_by_part")
def q_low_resource_by_part(spark, d):
    c = corpus(spark, d)
    before = imbalance.extract_before_splitting(c, LOW_RESOURCE_SHARE).withColumn("strategy", F.lit("extract_then_split"))
    after = imbalance.split_before_extracting(c, LOW_RESOURCE_SHARE).withColumn("strategy", F.lit("split_then_extract"))
    return (before.unionByName(after).groupBy("strategy", "part", "event_type")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("news_wiki_counts")
def q_news_wiki_counts(spark, d):
    return imbalance.news_wiki(corpus(spark, d)).groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("dedup_keep_none")
def q_dedup_keep_none(spark, d):
    return dedup.keep_none(corpus(spark, d)).select("id", "event_type")


@register("duplicates")
def q_duplicates(spark, d):
    return dedup.duplicates(corpus(spark, d)).select("id", "n_copies")


@register("duplicate_label_conflicts")
def q_duplicate_label_conflicts(spark, d):
    """Equal texts that come from several sources (the label whose copies differ here)."""
    docs = table(spark, d, "documents", "text", "source").where("text is not null")
    return dedup.label_conflicts(docs, subset=["text"], label="source")


# --- M2/M3: splits, folds, augmentation, ids ------------------------------------------------

SPLIT_NAMES = ["train", "dev", "test"]
SPLIT_SIZES = [0.8, 0.1, 0.1]
K = 5
VARIANTS = 3
SUBSET_N = 100


@register("split_plain")
def q_split_plain(spark, d):
    return splits.split_plain(corpus(spark, d).select("id"), SPLIT_NAMES, SPLIT_SIZES, SEED)


@register("split_stratified")
def q_split_stratified(spark, d):
    return splits.split_stratified(corpus(spark, d).select("id", "event_type"), SPLIT_NAMES, SPLIT_SIZES, SEED)


@register("split_label_coverage")
def q_split_label_coverage(spark, d):
    return imbalance.label_coverage(q_split_plain_labelled(spark, d), whole=corpus(spark, d))


def q_split_plain_labelled(spark, d):
    return splits.split_plain(corpus(spark, d).select("id", "event_type"), SPLIT_NAMES, SPLIT_SIZES, SEED)


@register("kfold_stratified")
def q_kfold_stratified(spark, d):
    return splits.kfold_stratified(corpus(spark, d).select("id", "event_type"), K, CV_SEED)


def augmented_corpus(spark, d, cutoff=LOW_RESOURCE_SHARE):
    return augment.augment_corpus(corpus(spark, d), VARIANTS, cutoff)


@register("augment_lead_k")
def q_augment_lead_k(spark, d):
    return _date_str(augment.augment_corpus(corpus(spark, d), VARIANTS, None))


@register("augment_low_resource")
def q_augment_low_resource(spark, d):
    return _date_str(augmented_corpus(spark, d))


@register("kfold_leakage_safe")
def q_kfold_leakage_safe(spark, d):
    return splits.kfold_leakage_safe(augmented_corpus(spark, d).select("id", "event_type", "source_doc_id"), K, CV_SEED)


@register("kfold_leakage_audit")
def q_kfold_leakage_audit(spark, d):
    aug = augmented_corpus(spark, d).select("id", "event_type", "source_doc_id")
    return splits.leakage_audit(splits.kfold_leakage_safe(aug, K, CV_SEED), aug)


@register("subsample_one_per_source")
def q_subsample_one_per_source(spark, d):
    aug = augment.augmented(augmented_corpus(spark, d))
    return augment.subsample_one_per_source(aug, SEED).select("id", "source_doc_id")


@register("subsample_unique_text")
def q_subsample_unique_text(spark, d):
    aug = augment.augmented(augmented_corpus(spark, d))
    return augment.subsample_unique_text(aug, SEED).select("id", "source_doc_id")


@register("reindex_dense")
def q_reindex_dense(spark, d):
    kept = augment.subsample_augmented(augmented_corpus(spark, d), "one_per_source")
    return kept.select("id", "source_doc_id", "new_id")


@register("id_contiguity")
def q_id_contiguity(spark, d):
    kept = augment.subsample_augmented(augmented_corpus(spark, d), "unique_text")
    a = augment.id_contiguity(kept, "id").withColumn("id_column", F.lit("id"))
    b = augment.id_contiguity(kept, "new_id").withColumn("id_column", F.lit("new_id"))
    return a.unionByName(b)


@register("partition_reconcile")
def q_partition_reconcile(spark, d):
    return augment.partition_reconcile(augmented_corpus(spark, d))


@register("random_subset")
def q_random_subset(spark, d):
    from augsight.operators.trainset import random_subset
    return random_subset(corpus(spark, d).select("id", "event_type"), SUBSET_N, SEED)


@register("bounded_read")
def q_bounded_read(spark, d):
    from augsight.sources.corpus import bounded
    return bounded(corpus(spark, d).select("id", "event_type"), 25)


# --- M4: text, n-grams, TF-IDF, ROUGE -------------------------------------------------------

MAX_CHARS = 5000
CHUNK_CHARS = 1000
LEAD_SENTENCES = 3
MIN_DF = 3
MAX_DF = 1.0
NB_SMOOTHING = 1.0


@register("assemble_text")
def q_assemble_text(spark, d):
    c = corpus(spark, d)
    return c.select("id", tx.assemble(F.col("title"), F.col("text")).alias("doc"))


@register("truncate_chars")
def q_truncate_chars(spark, d):
    c = corpus(spark, d)
    return c.select("id", tx.truncate_chars("text", MAX_CHARS).alias("truncated"),
                    (F.length("text") > MAX_CHARS).alias("was_truncated"))


def dictionary_stub(chunk):
    """Per-chunk stand-in translator (Column -> Column): a fixed word substitution."""
    return F.replace(chunk, F.lit(" the "), F.lit(" le "))


@register("chunk_rejoin")
def q_chunk_rejoin(spark, d):
    c = corpus(spark, d).select("id", tx.chunks("text", CHUNK_CHARS).alias("parts"))
    return c.select("id", F.size("parts").alias("n_chunks"),
                    F.md5(F.array_join(F.transform("parts", dictionary_stub), "")).alias("out_md5"))


@register("first_n_sentences")
def q_first_n_sentences(spark, d):
    c = corpus(spark, d).select("id", tx.sentences("text").alias("s"))
    return c.select("id", F.size("s").alias("n_sentences"),
                    F.array_join(F.slice("s", 1, LEAD_SENTENCES), " ").alias("lead"))


@register("summary_normalise")
def q_summary_normalise(spark, d):
    conv = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", tx.normalise_summary("text").alias("normalised"))


@register("ngrams_1_3")
def q_ngrams_1_3(spark, d):
    c = corpus(spark, d).select("id", tx.tokens("text").alias("t"))
    return c.select("id", F.size("t").alias("n_tokens"),
                    F.size(tx.ngrams("t", 2)).alias("n_bigrams"),
                    F.size(tx.ngrams("t", 3)).alias("n_trigrams"),
                    F.md5(F.array_join(tx.ngram_range("t", 1, 3), "|")).alias("grams_md5"))


def _token_docs(spark, d):
    return corpus(spark, d).select("id", tx.tokens("text").alias("tokens"))


@register("doc_frequency_pruned")
def q_doc_frequency_pruned(spark, d):
    docs = _token_docs(spark, d)
    return features.document_frequencies(docs, docs.count(), MIN_DF, MAX_DF)


@register("tfidf")
def q_tfidf(spark, d):
    weights, _, _ = features.tfidf(_token_docs(spark, d), min_df=MIN_DF, max_df=MAX_DF)
    return weights.select("id", "term", F.round("weight", 6).alias("weight"))


@register("tfidf_transform")
def q_tfidf_transform(spark, d):
    """Weights of the dev and test documents under the training documents' vocabulary and idf."""
    docs = _token_docs(spark, d).join(q_split_plain(spark, d), "id")
    train = docs.where(F.col("split") == "train").select("id", "tokens")
    _, vocab, n_docs = features.tfidf(train, min_df=MIN_DF, max_df=MAX_DF)
    rest = docs.where(F.col("split") != "train").select("id", "tokens")
    weights, _, _ = features.tfidf(rest, vocab=vocab, n_docs=n_docs)
    return weights.select("id", "term", F.round("weight", 6).alias("weight"))


def _pairs(spark, d):
    return rouge.conversation_pairs(table(spark, d, "conversations", "conv_id", "turn", "role", "text"))


def _rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@register("rouge_1")
def q_rouge_1(spark, d):
    return _rounded(rouge.rouge_n(_pairs(spark, d), 1, ["conv_id", "turn"]), ["precision", "recall", "fmeasure"])


@register("rouge_2")
def q_rouge_2(spark, d):
    return _rounded(rouge.rouge_n(_pairs(spark, d), 2, ["conv_id", "turn"]), ["precision", "recall", "fmeasure"])


@register("rouge_summary")
def q_rouge_summary(spark, d):
    p = _pairs(spark, d)
    r1 = rouge.rouge_summary(rouge.rouge_n(p, 1, ["conv_id", "turn"])).withColumn("metric", F.lit("rouge1"))
    r2 = rouge.rouge_summary(rouge.rouge_n(p, 2, ["conv_id", "turn"])).withColumn("metric", F.lit("rouge2"))
    return r1.unionByName(r2)


@register("rouge_l")
def q_rouge_l(spark, d):
    return _rounded(rouge.rouge_l(_pairs(spark, d), ["conv_id", "turn"]), ["precision", "recall", "fmeasure"])


@register("rouge_lsum")
def q_rouge_lsum(spark, d):
    return _rounded(rouge.rouge_lsum(_pairs(spark, d), ["conv_id", "turn"]), ["precision", "recall", "fmeasure"])


@register("rouge_summary_all")
def q_rouge_summary_all(spark, d):
    """Corpus score of every ROUGE variant: 1, 2, L and Lsum."""
    p, key = _pairs(spark, d), ["conv_id", "turn"]
    tables = {"rouge1": rouge.rouge_n(p, 1, key), "rouge2": rouge.rouge_n(p, 2, key),
              "rougeL": rouge.rouge_l(p, key), "rougeLsum": rouge.rouge_lsum(p, key)}
    out = None
    for name, scores in tables.items():
        one = rouge.rouge_summary(scores).withColumn("metric", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- M5: evaluation -------------------------------------------------------------------------

# Experiments of the score analysis: naive Bayes with or without the title, n-grams up to 1 or 2, three smoothings.
EXPERIMENT_GRAMS, EXPERIMENT_SMOOTHING = (1, 2), (0.01, 0.1, 1.0)
# Groups of the experiments by what their names hold.
EXPERIMENT_GROUPS = {"title": {"TITLE": (".title.",), "NO_TITLE": (".notitle.",)},
                     "ngrams": {f"n{n}": (f".n{n}.",) for n in EXPERIMENT_GRAMS}}


def _round(df, cols=("precision", "recall", "f1", "old", "new", "delta", "mean", "var", "std", "score")):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def _body():
    """The text after its lead line, which is the title."""
    return F.expr("substring(text, length(title) + 2)")


def predictions(spark, d):
    """Rule-classifier predictions of two experiments (title and text, text alone) from one scan."""
    c = corpus(spark, d)
    both = tx.assemble(F.col("title"), _body())
    runs = F.array(F.struct(F.lit("title").alias("experiment"), predict_language(both).alias("y_pred")),
                   F.struct(F.lit("text").alias("experiment"), predict_language(_body()).alias("y_pred")))
    return (c.select("id", F.col("event_type").alias("y_true"), F.explode(runs).alias("r"))
            .select("r.experiment", "id", "y_true", "r.y_pred"))


@register("classification_report")
def q_classification_report(spark, d):
    return _round(metrics.classification_report(predictions(spark, d), by=["experiment"]))


def _embedding_preds(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", F.col("label").alias("y_true"), arrays.argmax("embedding").alias("y_pred"))


@register("argmax_labels")
def q_argmax_labels(spark, d):
    return _embedding_preds(spark, d)


@register("macro_metrics")
def q_macro_metrics(spark, d):
    return _round(metrics.macro_metrics(_embedding_preds(spark, d)), ("precision", "recall", "f1_macro", "accuracy"))


def _comparison(spark, d):
    rep = metrics.classification_report(predictions(spark, d), by=["experiment"])
    old = rep.where(F.col("experiment") == "title").drop("experiment")
    new = rep.where(F.col("experiment") == "text").drop("experiment")
    return metrics.compare_reports(old, new)


@register("report_comparison")
def q_report_comparison(spark, d):
    return _round(_comparison(spark, d))


@register("delta_by_support")
def q_delta_by_support(spark, d):
    return _round(metrics.delta_by_support(_comparison(spark, d)))


def cv_fold_scores(spark, d):
    """(experiment, fold, score): macro F1 of every experiment on every stratified test fold."""
    c = corpus(spark, d)
    folds = splits.kfold_stratified(c.select("id", "event_type"), K, CV_SEED)
    docs = features.materialize(folds.select("id", F.col("event_type").alias("label"), "fold"), "augsight-folds")
    views = F.array(*[F.struct(F.lit(f"nb.{name}").alias("name"), tx.tokens(view).alias("tokens"))
                      for name, view in (("title", tx.assemble(F.col("title"), _body())), ("notitle", _body()))])
    grams = bayes.gram_counts(c.select("id", F.inline(views)).withColumnRenamed("name", "run"), "tokens", max(EXPERIMENT_GRAMS), ["run", "id"])
    runs = {f"nb.{name}.n{n}": (f"nb.{name}", n) for name in ("title", "notitle") for n in EXPERIMENT_GRAMS}
    pred = bayes.cross_validate(grams, docs, EXPERIMENT_SMOOTHING, runs)
    pred = pred.withColumn("experiment", F.concat("run", F.lit(".a"), F.col("smoothing").cast("string")))
    m = metrics.macro_metrics(features.materialize(pred, "augsight-predictions"), by=["experiment", "fold"])
    return m.select("experiment", "fold", F.col("f1_macro").alias("score"))


@register("cv_fold_scores")
def q_cv_fold_scores(spark, d):
    return _round(cv_fold_scores(spark, d))


@register("cv_score_stats")
def q_cv_score_stats(spark, d):
    return _round(metrics.score_stats(cv_fold_scores(spark, d)))


def _experiment_means(spark, d):
    s = metrics.score_stats(cv_fold_scores(spark, d)).select("experiment", "mean")
    title, ngrams = (metrics.tag_groups(s, groups=groups, grouping=name) for name, groups in EXPERIMENT_GROUPS.items())
    return title.unionByName(ngrams)


@register("experiment_group_means")
def q_experiment_group_means(spark, d):
    return _round(_experiment_means(spark, d).select("grouping", "group_name", "experiment", "mean"))


@register("group_box_stats")
def q_group_box_stats(spark, d):
    b = metrics.box_stats(_experiment_means(spark, d), "mean", ["grouping", "group_name"])
    return _round(b, ("q25", "q50", "q75", "iqr", "whisker_low", "whisker_high"))


@register("run_consistency")
def q_run_consistency(spark, d):
    """Do the SQL generator and the Arrow plug-in generator give the same texts for every (source, variant)?"""
    c = corpus(spark, d).select("id", "text")
    gen = augment.generate_with(plugins.lead_generator, VARIANTS)

    def run(out, r):
        return c.select("id", F.lit(r).alias("run"), F.posexplode(out).alias("variant", "out"))
    runs = run(augment.lead_variants(F.col("text"), VARIANTS), 0).unionByName(run(gen(F.col("text")), 1))
    return metrics.consistency(runs, ["id", "variant"], "out")


@register("length_profile")
def q_length_profile(spark, d):
    return _round(metrics.length_profile(corpus(spark, d)), ("mean_len", "q25", "q50", "q75"))


@register("row_count_audit")
def q_row_count_audit(spark, d):
    c = corpus(spark, d)
    stages = [("documents", table(spark, d, "documents", "doc_id")), ("corpus", c),
              ("deduplicated", dedup.keep_none(c)),
              ("low_resource", imbalance.low_resource_slice(c, LOW_RESOURCE_SHARE)),
              ("augmented", augmented_corpus(spark, d))]
    out = None
    for name, df in stages:
        a = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = a if out is None else out.unionByName(a)
    return out


# --- M6: training-set shaping, plug-ins, literal columns, ML --------------------------------

MAX_INPUT_TOKENS = 512
MAX_TARGET_TOKENS = 100
BATCH_A, BATCH_B = 8, 64
PAD_ID = 1
KEEP_SENTENCES = 25
DOCEE_N, CNN_N = 200, 100
TRANSLATIONS = {" the ": " le "}


def _split_plain(spark, d):
    return q_split_plain_labelled(spark, d)


@register("label_encoding")
def q_label_encoding(spark, d):
    sp = _split_plain(spark, d)
    return trainset.label_mapping(sp.where(F.col("split") == "train"))


@register("label_encoded_dev")
def q_label_encoded_dev(spark, d):
    sp = _split_plain(spark, d)
    mapping = trainset.label_mapping(sp.where(F.col("split") == "train"))
    return trainset.encode_labels(sp.where(F.col("split") == "dev"), mapping).select("id", "label_id")


@register("truncate_tokens")
def q_truncate_tokens(spark, d):
    t = corpus(spark, d).select("id", tx.tokens("text").alias("t"))
    kept = t.select("id", F.size("t").alias("n_tokens"), arrays.truncate("t", MAX_INPUT_TOKENS).alias("k"))
    return kept.select("id", "n_tokens", F.size("k").alias("n_kept"), F.md5(F.array_join("k", " ")).alias("kept_md5"))


@register("pad_batches")
def q_pad_batches(spark, d):
    t = corpus(spark, d).select("id", arrays.truncate(tx.tokens("text"), MAX_INPUT_TOKENS).alias("t"))
    b = trainset.pad_batch(trainset.batches(t, BATCH_A, SEED), "t", "<pad>")
    return b.select("id", "batch", F.size("t").alias("length"), F.size("padded").alias("padded_length"),
                    F.md5(F.array_join("padded", " ")).alias("padded_md5"))


def _pair_keys(spark, d):
    """Pairs with one text key for (conversation, turn): no arithmetic that could collide."""
    return _pairs(spark, d).withColumn("pair_key", F.concat_ws("-", "conv_id", "turn"))


@register("interleave_tasks")
def q_interleave_tasks(spark, d):
    """Training rows of both tasks in the order of their batches: which row a step reads."""
    a = _pair_keys(spark, d).select("pair_key")
    b = corpus(spark, d).select(F.col("id").cast("string").alias("id"))
    return trainset.interleave(a, b, BATCH_A, BATCH_B, SEED, key_a="pair_key", key_b="id")


@register("docee_trainset")
def q_docee_trainset(spark, d):
    """Encoded classification rows: input tokens and label id of the sampled training documents."""
    sp = _split_plain(spark, d)
    train = sp.where(F.col("split") == "train")
    # Ids are sampled before any text is read for tokens; only they are encoded.
    ids = trainset.random_subset(trainset.encode_labels(train, trainset.label_mapping(train)).select("id", "label_id"),
                                 DOCEE_N, SEED)
    c = corpus(spark, d).select("id", "title", "text")
    return c.join(ids, "id").select(
        "id", "label_id",
        arrays.truncate(tx.tokens(tx.assemble(F.col("title"), F.col("text"))), MAX_INPUT_TOKENS).alias("t")).select(
        "id", "label_id", F.size("t").alias("n_input_tokens"), F.array_join("t", " ").alias("input_tokens"))


@register("summary_trainset")
def q_summary_trainset(spark, d):
    """Encoded summarisation rows: article and highlight tokens of the sampled pairs."""
    p = _pair_keys(spark, d)
    keys = trainset.random_subset(p.select("pair_key"), CNN_N, SEED, id_col="pair_key")
    return p.join(keys, "pair_key").select(
        "conv_id", "turn",
        arrays.truncate(tx.tokens("reference"), MAX_INPUT_TOKENS).alias("a"),
        arrays.truncate(tx.tokens("prediction"), MAX_TARGET_TOKENS).alias("h")).select(
        "conv_id", "turn", F.size("a").alias("n_article_tokens"), F.size("h").alias("n_highlight_tokens"),
        F.array_join("a", " ").alias("article_tokens"), F.array_join("h", " ").alias("highlight_tokens"))


@register("preprocess_tokens")
def q_preprocess_tokens(spark, d):
    c = corpus(spark, d)
    lead = tx.first_sentences(tx.assemble(F.col("title"), F.col("text")), KEEP_SENTENCES)
    t = c.select("id", tx.tokens(lead).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("unnamed_dropped")
def q_unnamed_dropped(spark, d):
    """A corpus that was saved with an index column, without it."""
    from augsight.sources.corpus import drop_unnamed
    c = corpus(spark, d).select(F.col("id").alias("Unnamed: 0"), "id", "title", "event_type")
    return drop_unnamed(c)


@register("ignore_index_replaced")
def q_ignore_index_replaced(spark, d):
    """Word lengths as label ids, every third length ignored (-100), with the pad id in its place."""
    n = F.transform(tx.tokens("text"), lambda t: F.when(F.length(t) % 3 == 0, -100).otherwise(F.length(t)))
    c = corpus(spark, d).select("id", arrays.replace_ignore_index(n, PAD_ID).alias("ids"))
    return c.select("id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@register("cased_tokens")
def q_cased_tokens(spark, d):
    """Tokens of the text as it is written, without lower-casing."""
    t = corpus(spark, d).select("id", tx.tokens("text", lowercase=False).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("map_batches_plugin")
def q_map_batches_plugin(spark, d):
    """Batched preprocessing plug-in: words and characters of every text."""
    def count(pdf):
        text = pdf["text"].fillna("")
        return pdf[["id"]].assign(n_words=text.str.split(" ").str.len().astype("int64"), n_chars=text.str.len().astype("int64"))
    return plugins.map_batches(corpus(spark, d), count, "id long, n_words long, n_chars long", columns=["id", "text"])


@register("tokenize_plugin")
def q_tokenize_plugin(spark, d):
    t = corpus(spark, d).select("id", plugins.tokenize_with("text", plugins.regex_tokenizer).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("translate_plugin")
def q_translate_plugin(spark, d):
    c = corpus(spark, d)
    out = plugins.translate_chunks("text", plugins.dictionary_translator(TRANSLATIONS), CHUNK_CHARS)
    return c.select("id", F.size(tx.chunks("text", CHUNK_CHARS)).alias("n_chunks"), F.md5(out).alias("out_md5"))


@register("batch_inference_report")
def q_batch_inference_report(spark, d):
    """Every text by naive Bayes fitted on the train split."""
    train = _split_plain(spark, d).where(F.col("split") == "train")
    docs = features.materialize(_token_docs(spark, d).select("id", grams.joined("tokens").alias("tokens")), "augsight-docs")
    mapping = trainset.label_mapping(train)
    fitted = bayes.fit(docs, "tokens", "event_type", smoothing=NB_SMOOTHING, labels=train.select("id", "event_type"))
    pred = bayes.predict(docs, "tokens", fitted).join(trainset.small_table(mapping), F.col("y_pred") == F.col("event_type"))
    raw = pred.select("id", F.concat(F.lit("LABEL_"), F.col("label_id")).alias("model_label"))
    named = plugins.decode_predictions(corpus(spark, d).select("id", F.col("event_type").alias("y_true")).join(raw, "id"), mapping)
    return _round(metrics.classification_report(features.materialize(named, "augsight-predictions")))


@register("batch_inference_plugin")
def q_batch_inference_plugin(spark, d):
    """The same report for a model that runs as a plug-in, in Arrow batches."""
    c = corpus(spark, d)
    train = _split_plain(spark, d).where(F.col("split") == "train")
    mapping = trainset.label_mapping(train)
    labels = [r[0] for r in mapping.orderBy("label_id").collect()]
    raw = plugins.classify_with(c.select("id", "text", "event_type"), plugins.RuleModel(labels))
    pred = plugins.decode_predictions(raw, mapping)
    return _round(metrics.classification_report(pred, "event_type", "y_pred"))


def _literal_words(text):
    """A whole text as Python writes its list of words; as a tuple where the text has an even length."""
    words = F.array_join(F.transform(F.split(text, " "), plugins.py_repr_string), ", ")
    return (F.when(F.length(text) % 2 == 0, F.concat(F.lit("("), words, F.lit(",)")))
            .otherwise(F.concat(F.lit("["), words, F.lit("]"))))


@register("literal_tokens")
def q_literal_tokens(spark, d):
    """Lists go through the JSON parser, tuples through the literal-only Python fallback."""
    c = corpus(spark, d).select("id", _literal_words(F.col("text")).alias("lit"))
    dec = c.select("id", plugins.decode_token_literal("lit").alias("v"))
    return dec.select("id", F.size("v").alias("n_items"), F.md5(F.array_join("v", "\u0001")).alias("items_md5"))


@register("literal_arguments")
def q_literal_arguments(spark, d):
    """Every sentence of a text as an argument (where it first starts, its place as type)."""
    c = corpus(spark, d).select("id", "text", tx.sentences("text").alias("s"))
    # Columns of their own: a start is looked for once, and a literal is written once for all that read it.
    starts = F.transform("s", lambda s: F.instr(F.col("text"), s) - 1)
    c = c.select("id", "s", starts.alias("starts"), plugins.py_repr_strings(F.col("s")).alias("written"))

    def arg(x, i):
        return F.concat(F.lit("{'start': "), x["starts"].cast("string"), F.lit(", 'end': "),
                        (x["starts"] + F.length(x["s"])).cast("string"), F.lit(", 'type': "), i.cast("string"),
                        F.lit(", 'text': "), x["written"], F.lit("}"))
    lit = F.concat(F.lit("["), F.array_join(F.transform(F.arrays_zip("s", "starts", "written"), arg), ", "), F.lit("]"))
    dec = c.select("id", lit.alias("lit")).select("id", plugins.decode_argument_literal("lit").alias("a"))
    # Without "outer" Spark infers a filter on the decoded array, which decodes everything once more.
    each = dec.select("id", F.posexplode_outer("a").alias("pos", "a")).where("pos is not null")
    return each.select("id", "a.type", "a.start", "a.end", "a.text")


@register("svm_report")
def q_svm_report(spark, d):
    sp = _split_plain(spark, d)
    mapping = trainset.label_mapping(sp.where(F.col("split") == "train"))
    docs = features.materialize(trainset.encode_labels(sp, mapping).join(_token_docs(spark, d), "id")
                                .select("id", "split", "label_id", "tokens"), "augsight-docs")
    parts = {s: docs.where(F.col("split") == s).drop("split") for s in ("train", "dev", "test")}
    pred = classify.fit_predict(parts.pop("train"), parts, min_df=MIN_DF, max_df=MAX_DF)
    return _round(metrics.classification_report(features.materialize(pred, "augsight-predictions"),
                                                "label_id", "pred_id", by=["split"]))


@register("svm_cv")
def q_svm_cv(spark, d):
    aug = features.materialize(augment.subsample_augmented(augmented_corpus(spark, d), "one_per_source"), "augsight-docs")
    mapping = trainset.label_mapping(aug)
    docs = trainset.encode_labels(aug, mapping).select("id", "label_id", tx.tokens("text").alias("tokens"))
    folds = splits.fold_assignment(aug.select("id", "event_type", "source_doc_id"), K, CV_SEED)
    pred = classify.cross_validate(docs, folds, K, min_df=MIN_DF, max_df=MAX_DF)
    scores = metrics.macro_metrics(pred, "label_id", "pred_id", by=["fold"]).select(
        F.lit("svm").alias("experiment"), "fold", F.col("f1_macro").alias("score"))
    return _round(metrics.score_stats(scores))



# --- coverage per batch, filtered experiment analysis ---------------------------------------

@register("batch_label_coverage")
def q_batch_label_coverage(spark, d):
    b = trainset.batches(corpus(spark, d).select("id", "event_type"), BATCH_A, SEED)
    return imbalance.label_coverage(b, split_col="batch", whole=corpus(spark, d))


@register("batch_missing_labels")
def q_batch_missing_labels(spark, d):
    b = trainset.batches(corpus(spark, d).select("id", "event_type"), BATCH_A, SEED)
    return imbalance.missing_labels(b, split_col="batch")


@register("filtered_group_box_stats")
def q_filtered_group_box_stats(spark, d):
    """Experiment analysis with a filter first: drop the runs with the strongest smoothing, then groups by n-grams."""
    s = metrics.score_stats(cv_fold_scores(spark, d).where(~F.col("experiment").endswith(".a1.0")))
    m = metrics.tag_groups(s.select("experiment", "mean"), groups=EXPERIMENT_GROUPS["ngrams"], grouping="ngrams")
    b = metrics.box_stats(m, "mean", ["grouping", "group_name"])
    return _round(b, ("q25", "q50", "q75", "iqr", "whisker_low", "whisker_high"))



# --- other tables: uniform classes (events), summary references (benchmark) ----------------

@register("event_class_counts")
def q_event_class_counts(spark, d):
    return imbalance.class_counts(table(spark, d, "events", "event_type"))


@register("rouge_lead_benchmark")
def q_rouge_lead_benchmark(spark, d):
    """ROUGE-1 of an extractive lead-sentence summary against the full benchmark passage."""
    b = table(spark, d, "benchmark", "item_id", "text")
    pairs = b.select("item_id", tx.first_sentences("text", 1).alias("prediction"), F.col("text").alias("reference"))
    return _rounded(rouge.rouge_n(pairs, 1, ["item_id"]), ["precision", "recall", "fmeasure"])



@register("rejected_labels")
def q_rejected_labels(spark, d):
    """How many documents the corpus boundary rejects for a null label."""
    return rejected_labels(spark, d)



@register("augment_generator_plugin")
def q_augment_generator_plugin(spark, d):
    """L1 through the generator plug-in path (Arrow UDF) with a Python lead-sentence generator."""
    gen = augment.generate_with(plugins.lead_generator, VARIANTS)
    return _date_str(augment.augment_corpus(corpus(spark, d), VARIANTS, None, generator=gen))



@register("kfold_assignment_compact")
def q_kfold_assignment_compact(spark, d):
    """X1 as one row per document: (id, is_augmented, test_fold)."""
    aug = augmented_corpus(spark, d).select("id", "event_type", "source_doc_id")
    return splits.fold_assignment(aug, K, CV_SEED)


# --- learned abbreviations, dictionary at size, sentence graph -------------------------------

@register("abbreviations")
def q_abbreviations(spark, d):
    """Words that the corpus nearly always follows with a full stop."""
    return sentences.abbreviations(corpus(spark, d)).select("word", "n_stop", "n", F.round("score", 6).alias("score"))


@register("abbreviation_sentences")
def q_abbreviation_sentences(spark, d):
    """Sentences of every text that do not end after a learned abbreviation."""
    c = corpus(spark, d).select("id", "text")
    found = features.materialize(sentences.abbreviations(c), "augsight-abbreviations")
    split = sentences.split_sentences(c, found)
    return split.select("id", F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))


@register("augment_ranked")
def q_augment_ranked(spark, d):
    """The low-resource classes augmented with summaries by the graph of a text's sentences."""
    gen = augment.generate_with(extract.rank_generator, VARIANTS)
    return _date_str(augment.augment_corpus(corpus(spark, d), VARIANTS, LOW_RESOURCE_SHARE, generator=gen))


@register("dictionary_translation")
def q_dictionary_translation(spark, d):
    """Every text with the words of the benchmark's dictionary replaced, whole words only."""
    words = table(spark, d, "benchmark", "text").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    entries = {r["w"]: f"<{r['w'][::-1]}>" for r in collect_small(words.distinct())}
    translate = plugins.dictionary_translator(entries, whole_words=True)
    c = corpus(spark, d)
    return c.select("id", F.md5(plugins.translate_chunks("text", translate, 1 << 30)).alias("out_md5"))


# --- files: outputs without a key, and what is written comes back ----------------------------

def _folder(spark, name: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/augsight-{name}-{uuid.uuid4().hex}"


@register("positional_generator")
def q_positional_generator(spark, d):
    """Texts that a generator wrote to files in the order of its inputs, without ids, attached by position."""
    docs = spark.read.parquet(f"{d.rstrip('/')}/documents.parquet").select("doc_id", "text")
    made = positions.with_positions(docs).select("position", tx.first_sentences("text", 1).alias("generated"))
    path = _folder(spark, "generated")
    positions.in_position_order(made).write.json(path)  # the generator's own files
    both = positions.positional_join(docs, spark.read.schema("generated string").json(path))
    return both.select(F.col("doc_id").cast("long").alias("id"), "generated")


@register("csv_round_trip")
def q_csv_round_trip(spark, d):
    """The corpus as CSV with header and quotes, read back by name with its types."""
    path = _folder(spark, "csv")
    write_corpus(_date_str(corpus(spark, d)), path, fmt="csv")
    back = read_corpus_csv(spark, path)
    return back.select("id", "title", "text", "event_type", F.col("date").cast("string").alias("date"))


@register("named_splits_round_trip")
def q_named_splits_round_trip(spark, d):
    """Splits written to a file set each, the second time skipped, and read back by name."""
    sp = q_split_plain(spark, d)
    paths = {name: _folder(spark, name) for name in SPLIT_NAMES}
    for name, path in paths.items():
        write_corpus(sp.where(F.col("split") == name).drop("split"), path)
        write_corpus(sp.where("false").drop("split"), path, mode="ignore")
    return named_splits(spark, paths)


@register("score_dir_round_trip")
def q_score_dir_round_trip(spark, d):
    """Fold scores as one JSON document per experiment, read back."""
    path = _folder(spark, "scores")
    sc.write_score_dir(cv_fold_scores(spark, d), path)
    return _round(sc.read_score_dir(spark, path))


@register("report_files_comparison")
def q_report_files_comparison(spark, d):
    """Reports of two experiments in one JSON file, each found by its key, compared from the files, with parameters beside them."""
    path = _folder(spark, "reports")
    sc.write_json(metrics.classification_report(predictions(spark, d), by=["experiment"]), path)
    write_params(spark, {"old": "title", "new": "text"}, path + ".params")
    keys = spark.read.json(path + ".params").first()
    old, new = (sc.navigate(spark.read.json(path), [keys[k]], ["experiment"]) for k in ("old", "new"))
    return _round(metrics.compare_reports(old, new))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def flagship(spark: SparkSession, data_dir: str) -> DataFrame:
    """Augmentation job: originals + 3 lead-sentence variants of every low-resource document."""
    return q_augment_low_resource(spark, data_dir)
