"""Operator 9, substring dedup with a count-min prefilter.

A window is ``size`` consecutive words. Every window is counted under a smaller
gram inside it (the one with the least hash), so equal windows fall on the same
counters and a counter never says less than the number of rows in which a window
starts.

Documents are written once, in blocks of about ``BLOCK_BYTES`` of text; all that
follows is dealt by block or by shard, and both grow in number with the input.

1. Each block sends its sparse sketch (the distinct grams of its windows) to the
   sketch's shards. A shard merges the blocks' sketches by addition in two rows
   of saturating counters and answers each block: which grams were counted twice.
2. Each block sends its distinct windows with such grams, and the least doc_id it
   has of each, to the shards of the exact grouping. A shard answers whether
   some block has a smaller doc_id.
3. Each block removes its words.

So no sketch goes through the driver, none is broadcast, the text is passed over
three times at every size, and a block sends one entry for a window, however
often the block has it. A shard keeps its distinct windows alone; the blocks'
entries are folded as they come and read again from a spool, so a passage in
a third of all documents costs an entry a block. Windows are told apart by 128
bits of hash of their words.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, read_table, short_batches, stored

#: Odd multipliers of the rolling hashes and of the two sketch rows (arbitrary).
ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Text of a block (a longer document is a block of its own), and of a shard.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 50 << 20
LEAST_SHARDS = 64
#: Counters of a row of a shard's sketch (a power of two).
LOG_WIDTH = 23
#: Entries folded together in a shard.
FOLD = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` values; runs are built by doubling."""
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    out, done, block, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, done = block, width
            else:
                n = len(h) - done - width + 1
                out, done = out[:n] + power(done) * block[done : done + n], done + width
        if done == size:
            return out
        n = len(block) - width
        block = block[:n] + power(width) * block[width:]
        width *= 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bytes, payload): the documents' rows, packed, about BLOCK_BYTES of text in each."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []
    size = 0

    def emit() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "payload"])

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(batch):
            before = ends[a - 1] if a else 0
            z = min(int(np.searchsorted(ends, before + BLOCK_BYTES - size)) + 1, len(batch))
            held.append(batch.slice(a, z - a))
            size += int(ends[z - 1] - before)
            a = z
            if size >= BLOCK_BYTES:
                yield emit()
                held, size, number = [], 0, number + 1
    if held:
        yield emit()


class Block:
    """A block's rows and the windows of its named documents, in order: start (in all words), row, gram."""

    def __init__(self, payload: pa.Scalar, size: int):
        self.rows = pa.ipc.open_stream(payload.as_buffer()).read_all()
        self.size = size
        texts = self.rows.column("text").cast(pa.binary()).to_pylist()
        words = [t.split() if t else [] for t in texts]
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.words = list(itertools.chain.from_iterable(words))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        ids = self.rows.column("doc_id").combine_chunks()
        self.number = pc.fill_null(ids, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(words)), self.counts)
        gram = size // 2 + 1
        if len(self.hashes) < size:
            self.start, self.row, self.gram = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        low = sliding_min(mix(rolled(self.hashes, gram, ROLL[0])), size - gram + 1)
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.hashes))
        self.start = np.flatnonzero((left >= size) & named[self.owner])
        self.row = self.owner[self.start]
        self.gram = low[self.start]

    def grams(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (shard << 32 | code) of the grams, whether two rows have it, and each window's place among them."""
        h = mix(self.gram * np.uint64(ROWS[0]))
        key = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
        twice = np.zeros(len(distinct), dtype=bool)
        twice[at[self.row != self.row[first][at]]] = True
        return distinct, twice, at

    def windows(self, picked: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the picked windows: start and doc_id by window hash, the group of each, and the groups' two hashes and least doc_id."""
        start, number = self.start[picked], self.number[self.row[picked]]
        k1, k2 = (mix(rolled(self.hashes, self.size, base)[start]) if len(start) else np.zeros(0, np.uint64) for base in ROLL)
        order = np.lexsort((number, k2, k1))
        start, number, k1, k2 = start[order], number[order], k1[order], k2[order]
        head = np.ones(len(k1), dtype=bool)
        head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        return start, number, np.cumsum(head) - 1, k1[head], k2[head], number[head]


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary for each stretch of values between cuts."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and how many each row has."""
    width = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if ends[0] == ends[-1]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].copy().view(kind), np.diff(ends) // width


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shards of sorted ones, and the cuts between them."""
    new = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    return shard[new], np.append(new, len(shard))


def sketches(size: int, shards: int):
    """(block, payload) -> (shard, block, codes): the block's sparse sketch; a code stands twice if two rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                distinct, twice, _ = Block(payload, size).grams(shards)
                if not len(distinct):
                    continue
                code = np.repeat(distinct, 1 + twice)
                shard, cuts = by_shard((code >> np.uint64(32)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(shard), number)), binaries(code.astype(np.uint32), cuts)], names=["shard", "block", "codes"])

    return run


class Spool:
    """Record batches that are read twice; those of the first reading wait in an unnamed file of the task."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        if self.batches is None:
            if self.out is not None:
                self.file.seek(0)
                yield from pa.ipc.open_stream(self.file)
                self.file.close()
            return
        self.out = None
        for batch in self.batches:
            if self.out is None:
                self.file = tempfile.TemporaryFile()
                self.out = pa.ipc.new_stream(self.file, batch.schema)
            self.out.write_batch(batch)
            yield batch
        if self.out is not None:
            self.out.close()
        self.batches = None


def merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sparse sketches, merged by addition -> (block, part, shard, flags): which codes were counted twice or more."""
    counters = np.zeros((len(ROWS), 1 << LOG_WIDTH), dtype=np.uint8)
    place = lambda code, k: (mix((code.astype(np.uint64) + np.uint64(k)) * np.uint64(ROWS[k])) >> np.uint64(64 - LOG_WIDTH)).astype(np.int64)
    spool = Spool(batches)
    for batch in spool:
        code, _ = flat(batch.column("codes"), "<u4")
        for k in range(len(ROWS)):
            at, n = np.unique(place(code, k), return_counts=True)
            counters[k][at] += np.minimum(n, 2).astype(np.uint8)
            counters[k][at] = np.minimum(counters[k][at], 2)
    for batch in spool:
        code, n = flat(batch.column("codes"), "<u4")
        row = np.repeat(np.arange(len(n)), n)
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        code = code[new]
        flags = np.minimum(*(counters[k][place(code, k)] for k in range(len(ROWS)))) >= 2
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])
        yield answers(batch, 1, flags, cuts)


def answers(batch: pa.RecordBatch, part: int, flags: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("block"), pa.array(np.full(len(batch), part, dtype=np.int32)), batch.column("shard"), binaries(flags.astype(np.uint8), cuts)], names=["block", "part", "shard", "flags"])


ANSWERS = "block long, part int, shard int, flags binary"


def answer_of(table: pa.Table, part: int) -> np.ndarray:
    """The flags of a block's answers of one part, in the order of its requests."""
    own = table.filter(pc.equal(table.column("part"), part)).sort_by("shard").column("flags").combine_chunks()
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    return flat(own, "u1")[0].astype(bool)


def estimated(block: Block, shards: int, found: pa.Table) -> np.ndarray:
    """The windows whose gram the merged sketch holds for repeated."""
    distinct, _, at = block.grams(shards)
    flags = answer_of(found, 1)
    if len(flags) != len(distinct):
        raise RuntimeError("a block and its answers differ")
    return flags[at] if len(distinct) else np.zeros(0, dtype=bool)


def repeated_windows(size: int, shards: int):
    """(a block, its answers) -> (shard, block, k1, k2, base, low): its distinct windows that are estimated repeated."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary()), ("base", pa.int64()), ("low", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        block = Block(rows.column("payload")[0], size)
        *_, k1, k2, low = block.windows(np.flatnonzero(estimated(block, shards, found)))
        if not len(k1):
            return schema.empty_table()
        shard, cuts = by_shard(((k1 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32))
        base = int(low.min())
        low = low - base
        low = low.astype(np.uint32) if low.max() >> 32 == 0 else low
        return pa.table([pa.array(shard), pa.array(np.full(len(shard), rows.column("block")[0].as_py())), binaries(k1, cuts), binaries(k2, cuts), pa.array(np.full(len(shard), base)), binaries(low, cuts)], schema=schema)

    return run


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k1, k2, least doc_id of all entries, and how many each row has."""
    (k1, n), (k2, _) = (flat(batch.column(c), "<u8") for c in ("k1", "k2"))
    base = np.repeat(batch.column("base").to_numpy(), n)
    low = np.zeros(len(k1), np.int64)
    width = np.repeat(pc.binary_length(batch.column("low")).to_numpy() // np.maximum(n, 1), n)
    for size, kind in ((4, "<u4"), (8, "<i8")):
        if (width == size).any():
            rows = pa.array(pc.binary_length(batch.column("low")).to_numpy() // np.maximum(n, 1) == size)
            low[width == size] = flat(batch.column("low").filter(rows), kind)[0]
    return k1, k2, base + low, n


def least_of(k1: np.ndarray, k2: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (k1, k2), sorted, with the least low of each."""
    order = np.lexsort((low, k2, k1))
    k1, k2, low = k1[order], k2[order], low[order]
    head = np.ones(len(k1), dtype=bool)
    head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return k1[head], k2[head], low[head]


def group_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's entries -> (block, part, shard, flags): which windows some other block has of a smaller doc_id."""
    known = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    waiting, size = [], 0
    spool = Spool(batches)
    for batch in spool:
        waiting.append(entries(batch)[:3])
        size += len(waiting[-1][0])
        if size > FOLD:
            known = least_of(*(np.concatenate(x) for x in zip(known, *waiting, strict=True)))
            waiting, size = [], 0
    known = least_of(*(np.concatenate(x) for x in zip(known, *waiting, strict=True)))
    for batch in spool:
        k1, k2, low, n = entries(batch)
        at = np.searchsorted(known[0], k1)
        while (off := known[1][at] != k2).any():  # equal first halves
            at[off] += 1
        yield answers(batch, 2, known[2][at] < low, np.concatenate([[0], np.cumsum(n)]))


def cut_words(columns: list[str], size: int, shards: int, schema: pa.Schema):
    """(a block, its answers) -> its rows with kept_text, n_words, n_removed."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        block = Block(rows.column("payload")[0], size)
        start, number, group, k1, _, low = block.windows(np.flatnonzero(estimated(block, shards, found)))
        smaller = answer_of(found, 2)
        if len(smaller) != len(k1):
            raise RuntimeError("a block and its answers differ")
        gone = start[smaller[group] | (number > low[group])] if len(k1) else start
        edge = np.zeros(len(block.words) + 1, dtype=np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + size, -1)
        out = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(block.owner[out], minlength=len(block.counts))
        kept, ends = [], np.cumsum(block.counts)
        for z, n, less in zip(ends.tolist(), block.counts.tolist(), removed.tolist(), strict=True):
            words = block.words[z - n : z]
            kept.append(b" ".join(itertools.compress(words, (~out[z - n : z]).tolist()) if less else words))
        made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(block.counts), pa.array(removed)]
        return pa.table([*(block.rows.column(c) for c in columns), *made], schema=schema)

    return run


def dedup(docs: DataFrame, size: int = 13, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """All columns of docs, and kept_text, n_words, n_removed (columns of docs with these names, in capitals or not, are replaced).

    A word goes if some window over it also starts in a document with a smaller
    doc_id. Words are separated by ASCII blanks and otherwise unchanged; kept
    words are joined by one space. Windows are judged on the input. A null text
    has no words and gives the empty text. Rows with one doc_id never remove
    each other's words; rows without doc_id stay whole and remove nothing. An
    empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(docs.sparkSession)
    columns = others(docs, "kept_text", "n_words", "n_removed")
    docs = docs.select(*quoted(columns))
    plain = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(columns)]  # mapInArrow takes no dots in names
    blocks = stored(docs.toDF(*plain).mapInArrow(to_blocks, "block long, bytes long, payload binary"))
    shards = max(least_shards, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    blocks = blocks.select("block", "payload")
    sketch = blocks.mapInArrow(sketches(size, shards), "shard int, block long, codes binary")
    told = stored(sketch.groupBy("shard").applyInArrow(merge_sketches, ANSWERS))
    asked = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(repeated_windows(size, shards), "shard int, block long, k1 binary, k2 binary, base long, low binary")
    told = told.unionByName(stored(asked.groupBy("shard").applyInArrow(group_windows, ANSWERS)))
    schema = docs.schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_words(plain, size, shards, to_arrow_schema(schema)), schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
