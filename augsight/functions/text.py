"""Text expressions: assembly, truncation, sentences, tokens, n-grams.

All of these compile to JVM expressions (regexp, split, higher-order
array functions) and stay inside whole-stage code generation.  The
sentence splitter and tokenizer are portable stand-ins for the model-based
ones; the same regular expressions run in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence boundary = . ! or ? followed by whitespace; token = run of [a-z0-9]
# after lower-casing; whitespace class used for Python-style strip().
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
SENTENCE_MARK = "\u0001"
TOKEN_SPLIT = "[^a-z0-9]+"
WS = r"[ \t\n\r\f]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_of(text: str | Column) -> Column:
    """Lead line of a document."""
    return F.substring_index(_c(text), "\n", 1)


def assemble(title: str | Column | None, text: str | Column, joiner: str = ". ") -> Column:
    """``title + joiner + text``; a null or absent title is skipped (no dangling joiner)."""
    if title is None:
        return _c(text)
    return F.concat_ws(joiner, _c(title), _c(text))


def strip(s: str | Column) -> Column:
    """Python ``str.strip()``: removes leading/trailing spaces, tabs and newlines."""
    return F.regexp_replace(_c(s), rf"^{WS}+|{WS}+$", "")


def truncate_chars(text: str | Column, max_length: int = 5000) -> Column:
    """Keep the first ``max_length - 1`` characters (the translator's input bound)."""
    return F.substring(_c(text), 1, max_length - 1)


def sentences(text: str | Column) -> Column:
    """array<string> of sentences: split after . ! ? followed by whitespace."""
    marked = F.regexp_replace(_c(text), SENTENCE_END, "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def first_sentences(text: str | Column, n: int | None, joiner: str = " ") -> Column:
    """First ``n`` sentences joined by ``joiner``; ``n`` of 0/None keeps all."""
    s = sentences(text)
    if n:
        s = F.slice(s, 1, n)
    return F.array_join(s, joiner)


def normalise_summary(s: str | Column) -> Column:
    """Strip, newlines to spaces, then one sentence per line (ROUGE-L sentence markup)."""
    flat = F.regexp_replace(strip(s), "\n", " ")
    return F.array_join(sentences(flat), "\n")


def tokens(text: str | Column, lowercase: bool = True) -> Column:
    """Alphanumeric tokens (empty pieces removed); ``lowercase=False`` keeps the case and
    splits on anything outside [A-Za-z0-9]."""
    if lowercase:
        return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda t: t != F.lit(""))
    return F.filter(F.split(_c(text), "[^A-Za-z0-9]+"), lambda t: t != F.lit(""))


def ngrams(toks: str | Column, n: int) -> Column:
    """All contiguous n-grams joined by one space; empty when fewer than n tokens.

    Built by zipping n shifted slices (``zip_with``), so the token array is
    referenced a constant number of times per row, never once per gram.
    Pass a column (not an expression) so the tokens are computed once.
    """
    t = _c(toks)
    if n == 1:
        return t
    k = F.greatest(F.size(t) - n + 1, F.lit(0))
    acc = F.slice(t, 1, k)
    for j in range(1, n):
        acc = F.zip_with(acc, F.slice(t, j + 1, k), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(t) >= n, acc).otherwise(F.array().cast("array<string>"))


def ngram_range(toks: str | Column, n_min: int = 1, n_max: int = 3) -> Column:
    """Concatenation of the n-grams for n in [n_min, n_max]."""
    return F.flatten(F.array(*[ngrams(toks, n) for n in range(n_min, n_max + 1)]))


def chunks(text: str | Column, size: int) -> Column:
    """Consecutive ``size``-character pieces of a text (empty text -> one empty piece, null -> null)."""
    t = _c(text)
    n = F.greatest(F.ceil(F.length(t) / F.lit(size)).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * size + 1, size))
    return F.when(t.isNotNull(), pieces)
