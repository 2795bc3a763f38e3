"""Plug points for user models: generator, classifier, translator, tokenizer.

Each plug-in is a plain Python callable over a *batch* of strings.  It is
wrapped in an Arrow-batched pandas UDF and called once per Arrow batch, never
per row; :class:`worker_cached` makes a model once per worker process.  The
defaults are small deterministic stand-ins.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augsight.functions import arrays
from augsight.functions import text as tx
from augsight.functions.rules import DEFAULT, RULES
from augsight.operators.small import small_table


_WORKER_MODELS: dict = {}


def worker_model(key: str, factory: Callable[[], Callable]) -> Callable:
    """The model of ``key`` in this process, made on first use."""
    if key not in _WORKER_MODELS:
        _WORKER_MODELS[key] = factory()
    return _WORKER_MODELS[key]


class worker_cached:  # noqa: N801 - used like a decorator
    """Wrap a model factory so that each Python worker makes the model once.

    The wrapper pickles to its key and factory; the cache is this imported
    module's, so all tasks that a worker process runs share it.  ``key``
    names the model: two factories with one key are one model.  Works for
    every plug-in, whatever its arguments.
    """

    def __init__(self, factory: Callable[[], Callable], key: str):
        self.factory, self.key = factory, key

    def __call__(self, *args):
        from augsight.operators.plugins import worker_model as shared  # the worker's own module, not a pickled copy
        return shared(self.key, self.factory)(*args)


class RuleModel:
    """Stand-in text classifier with a model-hub-like output (``LABEL_<k>``)."""

    def __init__(self, labels: Sequence[str]):
        self.index = {lab: i for i, lab in enumerate(labels)}
        self.rules = [(lab, re.compile(p)) for lab, p in RULES]

    def _one(self, text: str) -> str:
        for lab, rx in self.rules:
            if text is not None and rx.search(text):
                return lab
        return DEFAULT

    def __call__(self, texts: list[str]) -> list[dict]:
        return [{"label": f"LABEL_{self.index.get(self._one(t), -1)}", "score": 1.0} for t in texts]


def classify_with(df: DataFrame, model: Callable[[list[str]], list[dict]], text_col: str = "text",
                  out: str = "model_label") -> DataFrame:
    """Batch inference: append the model's raw label for every row (Arrow batches)."""
    @F.pandas_udf(T.StringType())
    def _predict(texts: pd.Series) -> pd.Series:
        return pd.Series([o["label"] for o in model(texts.tolist())])

    return df.withColumn(out, _predict(F.col(text_col)))


def decode_predictions(df: DataFrame, mapping: DataFrame, raw: str = "model_label",
                       out: str = "y_pred", label: str = "event_type") -> DataFrame:
    """``LABEL_7`` -> label id 7 -> label name via the training mapping; a label it does not have raises."""
    names = mapping.select(F.col("label_id").alias("_pid"), F.col(label).alias(out))
    named = df.withColumn("_pid", arrays.decode_model_label(raw)).join(small_table(names), "_pid", "left")
    unknown = F.raise_error(F.concat(F.lit("the model's label is not in the mapping: "), F.coalesce(F.col(raw), F.lit("null"))))
    return named.withColumn(out, F.coalesce(F.when(F.col(out).isNull(), unknown).cast("string"), F.col(out))).drop("_pid")


class DictionaryTranslator:
    """Translator that replaces dictionary entries: of entries that begin at one place the longest, the leftmost first.

    Every text is read once by an automaton over all entries, so the time
    does not grow with their number, and what one entry puts in is never
    replaced by another.  The automaton is made once per worker process.
    ``whole_words`` takes an entry only where no ASCII letter or digit adjoins
    it.  Null texts stay null; an empty entry is none.
    """

    def __init__(self, mapping: dict[str, str], whole_words: bool = False):
        self.mapping, self.whole_words = {k: v for k, v in mapping.items() if k}, whole_words
        self.key = "dictionary:" + hashlib.md5(repr(sorted(self.mapping.items())).encode()).hexdigest()

    def _automaton(self):
        import ahocorasick
        made = ahocorasick.Automaton()
        for entry in self.mapping:
            made.add_word(entry, len(entry))
        made.make_automaton()
        return made

    def _one(self, text: str, automaton) -> str:
        inside = (lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()) if self.whole_words else lambda i: False
        longest: dict[int, int] = {}
        for last, size in automaton.iter(text):
            if not inside(last - size) and not inside(last + 1):
                longest[last - size + 1] = max(size, longest.get(last - size + 1, 0))
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                end = start + longest[start]
                out += text[at:start], self.mapping[text[start:end]]
                at = end
        return "".join(out) + text[at:]

    def __call__(self, texts: list[str]) -> list[str]:
        if not self.mapping:
            return texts
        from augsight.operators.plugins import worker_model as shared  # the worker's own module, not a pickled copy
        automaton = shared(self.key, self._automaton)
        return [None if t is None else self._one(t, automaton) for t in texts]


def dictionary_translator(mapping: dict[str, str], whole_words: bool = False) -> Callable[[list[str]], list[str]]:
    return DictionaryTranslator(mapping, whole_words)


def translate_chunks(text: str | Column, translator: Callable[[list[str]], list[str]], chunk_chars: int) -> Column:
    """Long-document strategy: split into chunks, translate each, re-join in order.

    The chunk array travels as one Arrow value per document, so re-joining
    needs no shuffle (no explode / collect_list round trip).
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _tr(parts: pd.Series) -> pd.Series:
        flat, sizes = [], []
        for p in parts:
            flat.extend([] if p is None else p)
            sizes.append(None if p is None else len(p))
        done = translator(flat) if flat else []
        out, i = [], 0
        for n in sizes:  # a null text has no chunks and stays null
            out.append(None if n is None else done[i:i + n])
            i += n or 0
        return pd.Series(out, dtype=object)

    return F.array_join(_tr(tx.chunks(text, chunk_chars)), "")


_SENTENCE_END = re.compile(r"([.!?])[ \t\n\r\f]+")


def split_lead(text: str) -> list[str]:
    """The sentences of a text (same rule as SQL)."""
    return _SENTENCE_END.sub("\\1\x01", text).split("\x01")


def lead_generator(texts: list[str], n: int) -> list[list[str]]:
    """Stand-in generator plug-in: variant j = the first j+1 sentences (same rule as SQL)."""
    out = []
    for t in texts:
        sents = split_lead(t)
        out.append([" ".join(sents[:j + 1]) for j in range(n)])
    return out


def regex_tokenizer(texts: list[str]) -> list[list[str]]:
    """Stand-in tokenizer plug-in (same token definition as the SQL default)."""
    return [[t for t in re.split("[^a-z0-9]+", (x or "").lower()) if t] for x in texts]


def tokenize_with(text: str | Column, tokenizer: Callable[[list[str]], list[list[str]]]) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _tok(texts: pd.Series) -> pd.Series:
        return pd.Series([list(t) for t in tokenizer(texts.tolist())])
    return _tok(text if isinstance(text, Column) else F.col(text))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Batched preprocessing plug-in: ``fn(pandas batch) -> pandas batch`` over Arrow batches.

    Only ``columns`` are shipped to Python; the output has exactly ``schema``
    (raw columns not in it are dropped, like ``remove_columns``).
    """
    src = df.select(*columns) if columns else df

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return src.mapInPandas(run, schema)


# --- literal columns (Python repr text) -----------------------------------------------------

def _safe_literal(s: str | None):
    if s is None:
        return None
    try:
        return ast.literal_eval(s)  # literals only, never eval
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(s: pd.Series) -> pd.Series:
    out = []
    for v in s:
        x = _safe_literal(v)
        out.append([None if e is None else str(e) for e in x] if isinstance(x, (list, tuple)) else None)
    return pd.Series(out)


ARGUMENT_TYPE = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("type", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(ARGUMENT_TYPE)
def _literal_arguments(s: pd.Series) -> pd.Series:
    out = []
    for v in s:
        x = _safe_literal(v)
        if isinstance(x, (list, tuple)) and all(isinstance(e, dict) for e in x):
            out.append([{"start": e.get("start"), "end": e.get("end"), "type": e.get("type"),
                         "text": e.get("text")} for e in x])
        else:
            out.append(None)
    return pd.Series(out)


_JSON_OPTS = {"allowSingleQuotes": "true"}


def decode_token_literal(col: str | Column) -> Column:
    """``"['a', "it's"]"`` -> array<string>: JSON parser first, literal-only Python fallback
    for the rows it cannot read (Python escapes such as \\xa0, ``None``)."""
    c = F.col(col) if isinstance(col, str) else col
    fast = F.from_json(c, T.ArrayType(T.StringType()), _JSON_OPTS)
    # Spark evaluates a Python UDF for every input row even inside CASE WHEN, so the fallback
    # receives NULL for rows the JSON parser already read: Python work ~ rows that need it.
    return F.coalesce(fast, _literal_list(F.when(fast.isNull(), c)))


def decode_argument_literal(col: str | Column) -> Column:
    """Argument literal -> array<struct<start, end, type, text>> (same two-step decoding)."""
    c = F.col(col) if isinstance(col, str) else col
    fast = F.from_json(c, ARGUMENT_TYPE, _JSON_OPTS)
    return F.coalesce(fast, _literal_arguments(F.when(fast.isNull(), c)))


def _escaped(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def _quoted(s: Column) -> Column:
    dq = F.concat(F.lit('"'), s, F.lit('"'))
    sq = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(s.contains("'") & ~s.contains('"'), dq).otherwise(sq)


def py_repr_string(s: Column) -> Column:
    """Column rendering of Python's ``repr(str)`` (backslash, newline, tab, CR escaped)."""
    return _quoted(_escaped(s))


def py_repr_strings(strings: Column) -> Column:
    """The same of every string of an array; each is escaped once, however often its quotes are looked at."""
    return F.transform(F.transform(strings, _escaped), _quoted)
