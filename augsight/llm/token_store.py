"""Operator 8, token-ID output: training-order materialisation in fixed-stride shards.

Every document is tokenised, closed by an end token and cut into sequences
of ``SEQ_LEN`` ids (the last one padded).  A keyed Feistel network with
cycle-walking permutes the sequences' numbers; permuted numbers in order are
the training order.  Shard k holds the k-th range of permuted numbers as one
file of records of one fixed length, so record i of a shard is at byte ``i *
stride`` and a reader can resume anywhere.

Numbers are given before tokenising, from byte lengths: a text of n bytes
has at most n tokens, so it reserves ``ceil((n + 1) / SEQ_LEN)`` numbers and
uses the first ones.  The permutation runs over all reserved numbers; unused
ones leave no hole, because a shard's file holds only sequences that exist,
and a sequence's global slot is its shard's first slot plus its place there.
That spares tokenising twice, or storing the tokens once more, only to count
them.  One count per input partition makes the numbers global.  Both reads
pack the files alike: what the packing follows besides the files, the number
of cores, is held for both (:func:`same_packing`).

A run of white space is a token's text but for its last character, and is cut
out before the tokenizer's pattern sees it if it is longer than ``RUN``
characters: the pattern looks ahead once for each character of a run, which
overflows its stack on a million of them.  The ids are those of the whole text.

A record is, little-endian: permuted number (8 bytes), doc_id (8), piece
(4), ids that are not padding (4; its highest bit is set for a null doc_id,
whose field is 0), ``SEQ_LEN`` ids of 2 bytes (4 if the vocabulary needs it),
and a line feed, which Spark's text writer puts after each record.  Its commit protocol keeps the parts of lost tasks out.

Defined results: an empty text is one sequence with the end token only; a
null text has no sequence; rows with a null doc_id are written like others by
``training_order``, and by ``write_shards`` if ``unnamed`` is set; repeated rows are rows; equal
permuted numbers cannot occur; an empty table gives no shard with records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augsight.llm.words import mix, slices

#: Vocabulary of a public tokenizer, as ranks; the end token is the first free id.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the white space of that pattern; a run of more characters is cut out.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUN = 1000
LONG_RUN = re.compile(f"{SPACE}{{{RUN + 1},}}")
SEQ_LEN = 512
SHARD_BYTES = 64 << 20
KEY = 2024
FEISTEL_ROUNDS = 6
#: Bit of the header's last field that stands for a null doc_id.
UNNAMED = 1 << 31
HEADER = np.dtype([("key", "<u8"), ("doc_id", "<i8"), ("piece", "<u4"), ("n", "<u4")])


def permute(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of the numbers below ``size``: Feistel on the next even power of two, walked back into it."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(2 * key + 1))
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= size]
    return x


@lru_cache(1)
def _encoder(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(encoder, text: str) -> list[int]:
    """The ids of a text of any length."""
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        # Before other characters a run's last one starts the next token.
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at:run.start()])
        out += encoder._encode_single_piece(text[run.start():end])
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


@contextmanager
def same_packing(spark: SparkSession):
    """Reads of files inside see the same partitions, also if executors come or go meanwhile."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def _id_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def stride(seq_len: int, end: int) -> int:
    return HEADER.itemsize + seq_len * np.dtype(_id_type(end)).itemsize + 1


def _records(tokenizer: str, seq_len: int, offsets: dict[int, tuple[int, int]], size: int, width: int, key: int,
             unnamed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, PATTERN)
        start, reserved = offsets.get(TaskContext.get().partitionId(), (0, 0))
        used = 0
        for part, data, bounds in slices(batches):
            ids = part.column("doc_id").to_pylist()
            numbers, rows, tokens = [], [], []
            for i, (doc_id, text) in enumerate(zip(ids, part.column("text").to_pylist())):
                if text is None or (doc_id is None and not unnamed):
                    continue
                own = encode(encoder, text)
                own.append(end)
                pieces = -(-len(own) // seq_len)
                numbers.append(np.arange(start + used, start + used + pieces, dtype=np.uint64))
                used += -(-(int(bounds[i + 1] - bounds[i]) + 1) // seq_len)
                block = np.zeros(pieces * seq_len, _id_type(end))
                block[:len(own)] = own
                head = np.zeros(pieces, HEADER)
                head["doc_id"], head["piece"], head["n"] = doc_id or 0, np.arange(pieces), seq_len
                head["n"][-1] = len(own) - (pieces - 1) * seq_len
                if doc_id is None:
                    head["n"] |= np.uint32(UNNAMED)
                rows.append(head)
                tokens.append(block.reshape(pieces, seq_len))
            if not rows:
                continue
            head = np.concatenate(rows)
            head["key"] = permute(np.concatenate(numbers), size, key)
            body = np.concatenate(tokens)
            record = np.concatenate([head.view(np.uint8).reshape(len(head), -1), body.view(np.uint8).reshape(len(head), -1)], 1)
            ends = np.arange(len(head) + 1, dtype=np.int32) * record.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array((head["key"] // np.uint64(width)).astype(np.int32)), pa.array(head["key"].astype(np.int64)),
                 pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(record.tobytes())])],
                ["shard", "key", "record"])
        if used != reserved:
            raise RuntimeError(f"a partition has {used} numbers in this read and had {reserved}: the files have changed, "
                               "or the documents do not come straight from files")
    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN,
                 shard_bytes: int = SHARD_BYTES, key: int = KEY, unnamed: bool = False) -> dict:
    """Write the shards below ``path``; ``docs`` must come straight from files.

    Rows with a null doc_id are written if ``unnamed`` is set.

    Returns what a reader needs: the stride, the number of shards and of
    reserved numbers, and how many of them a shard spans.
    """
    with same_packing(docs.sparkSession):
        texts = docs.select("doc_id", "text")
        most = F.ceil((F.octet_length("text") + 1) / F.lit(seq_len))
        counted = (texts.filter("text is not null" + ("" if unnamed else " and doc_id is not null")).groupBy(F.spark_partition_id().alias("p"))
                   .agg(F.sum(most).alias("n")).orderBy("p").collect())  # one row for each input partition
        offsets, size = {}, 0
        for r in counted:
            offsets[r["p"]] = (size, r["n"])
            size += r["n"]
        _, end = _encoder(tokenizer, PATTERN)
        length = stride(seq_len, end)
        # About two in five reserved numbers are used.
        shards = max(1, -(-size * length * 2 // (5 * shard_bytes)))
        width = max(1, -(-size // shards))
        records = texts.mapInArrow(_records(tokenizer, seq_len, offsets, size, width, key, unnamed), "shard int, key long, record binary")
        (records.repartitionById(shards, F.col("shard")).sortWithinPartitions("key")
         .select(F.col("record").cast("string").alias("value"))
         .write.option("lineSep", "\n").option("compression", "none").text(path))
    return {"stride": length, "seq_len": seq_len, "shards": shards, "size": size, "width": width, "end": end, "key": key}


def shard_files(spark: SparkSession, path: str, layout: dict) -> DataFrame:
    """``(shard, file, records, first_slot)``, from the files' names and lengths; one row per shard."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.regexp_extract("path", r"part-([0-9]+)-", 1).cast("int").alias("shard"), F.col("path").alias("file"),
                     F.expr(f"length div {layout['stride']}").alias("records")).filter("records > 0"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file
    return files.select("*", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first_slot"))


def decode(record: bytes, layout: dict) -> tuple[int, int | None, int, list[int]]:
    """(permuted number, doc_id or None, piece, ids) of one record."""
    head = np.frombuffer(record, HEADER, 1)[0]
    ids = np.frombuffer(record, _id_type(layout["end"]), int(head["n"]) & ~UNNAMED, HEADER.itemsize)
    return int(head["key"]), None if int(head["n"]) & UNNAMED else int(head["doc_id"]), int(head["piece"]), ids.tolist()


def read_sequences(spark: SparkSession, path: str, layout: dict) -> DataFrame:
    """``(key, doc_id, piece, n_tokens, crc32)`` of every record as it is in the files."""
    def parse(records: Iterator[bytes]) -> Iterator[tuple]:
        for r in records:
            if r[-1] != 10:
                raise RuntimeError("a record does not end where the stride says")
            key, doc_id, piece, n = struct.unpack_from("<qqII", r)
            yield key, None if n & UNNAMED else doc_id, piece, n & ~UNNAMED, zlib.crc32(r)

    rows = spark.sparkContext.binaryRecords(path, layout["stride"]).mapPartitions(parse)
    return spark.createDataFrame(rows, "key long, doc_id long, piece int, n_tokens int, crc32 long", verifySchema=False)


def training_order(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards and return what is in them.

    ``(slot, doc_id, piece, n_tokens, shard, record, crc32)``: the global
    place in training order, and where it is: record ``record`` of shard
    ``shard``.
    """
    spark = docs.sparkSession
    layout = write_shards(docs, path, unnamed=True, **options)
    sequences = read_sequences(spark, path, layout)
    sequences = sequences.withColumn("shard", F.expr(f"key div {layout['width']}").cast("int"))
    files = shard_files(spark, path, layout).select("shard", "first_slot")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("key")) - 1  # a shard is one file
    return (sequences.withColumn("record", place.cast("long")).join(files, "shard")
            .select((F.col("first_slot") + F.col("record")).cast("long").alias("slot"), "doc_id", "piece", "n_tokens",
                    "shard", "record", "crc32"))
