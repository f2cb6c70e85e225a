"""Operator 8, packing: power-of-two decomposition.

Each document becomes token ids plus one end id. Its length is split into its
binary digits (whole sequences of ``max_length`` first, then descending powers
of two); each piece is a sequence of its own whose length is a power of two, so
equal lengths form buckets without padding and no sequence crosses documents.
The work is one narrow pass over the documents: no shuffle, no state. Pieces
leave a task bucket by bucket (numbered in that order), some MB of text at a
time, and `write_buckets` lays them down in a folder for each length.

Ids are those of the ``tokenizers`` file named by ``tokenizer``. Where the same
vocabulary exists as ``.tiktoken`` ranks, plain text is encoded through those,
which gives the same ids several times faster; a text that holds one of the
tokenizer's special strings, or a run of blanks too long for the ranks' pattern
matcher, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, short_batches

#: Documents encoded together; bounds the memory of a task.
CHUNK_CHARS = 2_000_000
#: A run that the matcher of the ranks' pattern may not survive.
LONG_BLANK = re.compile(r"\s{50000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """text -> numpy uint32 ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    special = [str(x.content) for x in slow.get_added_tokens_decoder().values()]
    ranks = tokenizer.removesuffix(".json") + ".tiktoken"
    fast = None
    if tokenizer.endswith("byte_bpe_50k.json") and os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is None or any(x in text for x in special) or (len(text) > 50_000 and LONG_BLANK.search(text)):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Binary decomposition of n: max_length as often as it fits, then the set bits of the rest, largest first."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def pack(docs: DataFrame, tokenizer: str | None = None, max_length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece of (doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, unless with_ids is false, ids. ``length`` is the bucket: every sequence
    is one piece of power-of-two length, offset 0, never padded. max_length must
    be a power of two. A null or empty text is the end id alone (one piece of
    length 1). Repeated rows and null ids are packed row by row; sequence_id
    (input partition and running number, in bucket order for each stretch of
    documents) stays unique. Other columns are ignored; an empty table gives an
    empty table.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    short_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    schema = PIECES if with_ids else T.StructType(PIECES.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        out: dict[str, list] = {f.name: [] for f in PIECES.fields if f.name not in ("sequence_id", "offset")}
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text), np.uint32(end_id))
                start = 0
                for length in piece_lengths(len(ids), max_length):
                    piece = ids[start : start + length]
                    for name, value in zip(out, (doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if with_ids else None), strict=True):
                        out[name].append(value)
                    start += length
                chars += len(text)
                if chars > CHUNK_CHARS:
                    yield bucketed(out, number, with_ids)
                    number += len(out["doc_id"])
                    out, chars = {name: [] for name in out}, 0
        yield bucketed(out, number, with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def bucketed(out: dict[str, list], number: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces by length, longest first, as sequences numbered from `number`."""
    order = np.argsort(-np.array(out["length"], dtype=np.int64), kind="stable")
    columns = {name: pa.array(values, pa.int64()).take(pa.array(order)) for name, values in out.items() if name != "ids"}
    columns["sequence_id"] = pa.array(number + np.arange(len(order)), pa.int64())
    columns["offset"] = pa.array(np.zeros(len(order), dtype=np.int64))
    if with_ids:
        columns["ids"] = pa.array([out["ids"][i] for i in order], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in PIECES.fields if f.name in columns})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Packed pieces as Parquet, a folder for each length; long and common lengths are dealt over many files."""
    packed.repartitionByRange("length", "sequence_id").sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False)
