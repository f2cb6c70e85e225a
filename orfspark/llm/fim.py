"""Operator 13, fill-in-middle transformation: a piece table.

A document is never cut as a string. It is a list of descriptors (buffer, start,
length) over two immutable buffers, its text and the sentinels. Cutting splits a
descriptor, an arrangement permutes descriptors, and the inverse permutation of
the descriptors of an output gives the document back. Hashes are fed from the
descriptors, a stretch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, short_batches

#: Buffers of a piece table.
TEXT, MARKS = 0, 1
#: Sentinels of prefix, suffix and middle, in one buffer.
SENTINELS = ("<P>", "<S>", "<M>")
#: Pieces are prefix, middle, suffix, then the three sentinels; an arrangement is an order of them.
ORDERS = {"plain": (0, 1, 2), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
STRETCH = 1 << 16

Piece = tuple[int, int, int]
SHAPE = "struct<n:bigint,form:string,pieces:array<struct<buffer:int,start:bigint,length:bigint>>,text:string,sha256:string>"


def token_ends(text: str) -> np.ndarray:
    """Offsets behind each token: a run of other signs with the blanks ahead of it, or the blanks at the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(codes))


def split(piece: Piece, at: int) -> tuple[Piece, Piece]:
    """A descriptor as two, the first of them `at` long."""
    buffer, start, length = piece
    return (buffer, start, at), (buffer, start + at, length - at)


def stretches(pieces: list[Piece], buffers: tuple[str, str]) -> Iterator[str]:
    for buffer, start, length in pieces:
        for at in range(start, start + length, STRETCH):
            yield buffers[buffer][at : min(at + STRETCH, start + length)]


def digest(pieces: list[Piece], buffers: tuple[str, str]) -> str:
    sha = hashlib.sha256()
    for part in stretches(pieces, buffers):
        sha.update(part.encode("utf-8"))
    return sha.hexdigest()


def choices(key: str, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    head = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(head[4 * i : 4 * i + 4], "big") for i in range(4))


def table_of(key: str, text: str, seed: int, rate: int, spm: int, sentinels: tuple[str, ...]) -> tuple[int, str, list[Piece]]:
    """(tokens, form, descriptors of the output) of a document."""
    ends = token_ends(text)
    n = len(ends)
    one, two, whether, which = choices(key, seed)
    if not text or any(s in text for s in sentinels) or whether % 100 >= rate:
        return n, "plain", [(TEXT, 0, len(text))]
    form = "spm" if which % 100 < spm else "psm"
    places = sorted((one % (n + 1), two % (n + 1)))
    first, second = (int(ends[p - 1]) if p else 0 for p in places)
    prefix, rest = split((TEXT, 0, len(text)), first)
    middle, suffix = split(rest, second - first)
    marks, at = [], 0
    for s in sentinels:
        marks.append((MARKS, at, len(s)))
        at += len(s)
    pieces = [prefix, middle, suffix, *marks]
    return n, form, [pieces[i] for i in ORDERS[form]]


def original(output: str, form: str, sentinels: tuple[str, ...]) -> list[Piece]:
    """Descriptors over an output that give its document: the output's own pieces by the inverse of its form's order."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order, found, left = ORDERS[form], [], (TEXT, 0, len(output))
    for i in order[::2]:
        mark = sentinels[i - 3]
        ahead, left = split(left, output.index(mark, left[1]) - left[1])
        found.append(ahead)
        found.append(split(left, len(mark))[0])
        left = split(left, len(mark))[1]
    found = [*found[1:], left]  # nothing stands ahead of the first sentinel
    back = {piece: found[place] for place, piece in enumerate(order)}
    return [back[i] for i in range(3)]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fim",
    seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """docs with `into`: struct(n tokens, form, pieces, text, sha256 of the text).

    A document is cut behind two tokens that the hash of seed and key names; rate of
    100 are transformed, spm of 100 of these begin with the suffix. A text that is
    null, empty or holds a sentinel is plain. Null texts are empty, a null key is an
    empty one; repeated rows give equal rows. A column called like `into` is
    replaced, all others stay, whatever their names; an empty table gives an empty one.
    """
    marks = "".join(sentinels)

    @F.arrow_udf(SHAPE)
    def arranged(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for k, t in zip(keys, texts, strict=True):
            body = t.as_py()
            n, form, pieces = table_of(k.as_py(), body, seed, rate, spm, sentinels)
            buffers = (body, marks)
            named = [{"buffer": b, "start": s, "length": m} for b, s, m in pieces]
            rows.append({"n": n, "form": form, "pieces": named, "text": "".join(stretches(pieces, buffers)), "sha256": digest(pieces, buffers)})
        return pa.array(rows, type=ARROW_SHAPE)

    short_batches(docs.sparkSession)
    name = F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))
    return docs.withColumn(into, arranged(name, F.coalesce(F.col(quoted(text)), F.lit(""))))


PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
ARROW_SHAPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("pieces", pa.list_(PIECE)), ("text", pa.string()), ("sha256", pa.string())])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of a document, from its output and form alone; null where either is."""

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        rows = []
        for o, f in zip(outputs, forms, strict=True):
            body, kind = o.as_py(), f.as_py()
            rows.append(None if body is None or kind is None else "".join(stretches(original(body, kind, sentinels), (body, ""))))
        return pa.array(rows, type=pa.string())

    return back(output, form)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    chars = lambda piece: F.when(fim["form"] != "plain", fim["pieces"][piece]["length"])
    prefix = F.when(fim["form"] == "psm", chars(1)).otherwise(chars(3))
    return rows.select(
        "doc_id", fim["n"].alias("n"), fim["form"].alias("form"), prefix.alias("prefix_chars"), chars(5).alias("middle_chars"),
        fim["sha256"].alias("output_sha256"), F.sha2(restored(fim["text"], fim["form"]), 256).alias("restored_sha256"),
    )
