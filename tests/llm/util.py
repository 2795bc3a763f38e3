"""Small fixtures and plain Python versions that the operators are compared with."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Columns whose names the operators use inside.
EXTRA = ("row", "key", "size", "shard", "text_key", "cut", "copy", "hits", "_hit_id", "target", "n_words", "last")


def table(spark, rows, extra=False):
    """A documents table of (doc_id, text, lang, source) rows, maybe with clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    if extra:
        schema += "".join(f", `{c}` string" for c in EXTRA)
        data = [(*r, *("x" for _ in EXTRA)) for r in data]
    return spark.createDataFrame(data, schema)


def stored(spark, df, path):
    """The table read back from files, as a table of documents is."""
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    return [(1, "alpha beta gamma", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "en", None),
            (5, "alpha beta gamma", "en", "b"), (5, "alpha beta gamma", "en", "b"), (None, "delta epsilon", "en", "a"),
            (None, None, None, None), (6, long, "en", "b"), (7, long, None, None), (8, "Été ß 中文 слово", "en", "c"),
            (9, "1234567890 +1 (555) 123-4567 a@b.co 10.0.0.1", "en", "c")]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def crc(x):
    return zlib.crc32(x.encode())
