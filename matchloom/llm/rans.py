"""Token ids in files coded by a static range asymmetric numeral system.

All blocks share one frequency table, counted over the whole corpus. A block holds whole documents and is coded on its
own: its ids are dealt to LANES coders that step together and write 32-bit words into one stream. The block keeps the
coders' states at checkpoints and a CRC-32 of the ids from each to the next, so that parts of a block are read by
different tasks: each decodes the documents that begin after its checkpoint.

Payload of a block, little-endian: n_ids u32, lanes u32, steps between checkpoints u32, n_checkpoints u32, n_words u32,
word offset of each checkpoint u32[], states of each checkpoint u64[][lanes], words u32[].
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import shared_dir, staged

LANES, CHECKPOINT_STEPS, BLOCK_IDS, SCALE = 2048, 128, 1 << 19, 20
#: Most files whose starts are broadcast; with more, they are joined.
BROADCAST_FILES = 1 << 20
LOW = np.uint64(1 << 31)


class Frequencies:
    """Shared table: share of every id in 2**SCALE slots; each id that occurs has one slot at least."""

    def __init__(self, counts: np.ndarray):
        slots, total = 1 << SCALE, counts.sum()
        share = np.maximum(counts > 0, counts * slots // max(total, 1)).astype(np.int64)
        while (rest := slots - int(share.sum())) != 0:  # the most frequent ids take what rounding left, or give it back
            top = np.argsort(-share, kind="stable")[:256]
            if rest > 0:
                share[top[0]] += rest
            else:
                give = np.minimum(share[top] - 1, np.maximum(1, -rest // len(top)))
                give = np.where(np.cumsum(give) <= -rest, give, 0)
                share[top] -= np.maximum(give, 0)
        self.share = share.astype(np.uint64)
        self.start = (np.cumsum(share) - share).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint32), share)


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    steps = -(-len(ids) // LANES)
    grid = np.full(steps * LANES, ids[-1] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    out, marks, written = [], [], 0
    scale, low_bits, shift = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        f, c = table.share[grid[t]], table.start[grid[t]]
        full = state >= (f << low_bits)
        words = state[full].astype(np.uint32)
        state = np.where(full, state >> shift, state)
        quotient = state // f
        state = (quotient << scale) + (state - quotient * f) + c
        out.append(words)
        written += len(words)
        if t % CHECKPOINT_STEPS == 0:
            marks.append((written, state))
    marks.reverse()
    head = np.array([len(ids), LANES, CHECKPOINT_STEPS, len(marks), written, *(written - w for w, _ in marks)], np.uint32)
    states = np.concatenate([s for _, s in marks]) if marks else np.empty(0, np.uint64)
    return b"".join([head.tobytes(), states.tobytes(), np.concatenate(out[::-1]).tobytes() if out else b""])


def decode_block(payload: bytes, table: Frequencies, checkpoint: int = 0, most: int | None = None) -> np.ndarray:
    """Ids of a block from a checkpoint on, `most` of them at most."""
    n, lanes, every, marks, n_words = np.frombuffer(payload, np.uint32, 5).tolist()
    at = np.frombuffer(payload, np.uint32, marks, 20)
    states = np.frombuffer(payload, np.uint64, marks * lanes, 20 + 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(payload, np.uint32, n_words, 20 + 4 * marks + 8 * marks * lanes).astype(np.uint64)
    if not n:
        return np.empty(0, np.uint32)
    first = checkpoint * every
    most = n if most is None else most
    last = min(-(-n // lanes), first + -(-most // lanes))
    state, p = states[checkpoint].copy(), int(at[checkpoint])
    mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    out = np.empty((last - first, lanes), np.uint32)
    for t in range(last - first):
        slot = state & mask
        ids = table.symbol[slot]
        out[t] = ids
        state = table.share[ids] * (state >> scale) + slot - table.start[ids]
        low = np.flatnonzero(state < LOW)
        state[low] = (state[low] << shift) | words[p : p + len(low)]
        p += len(low)
    return out.ravel()[: min(n - first * lanes, most)]


def part_checksums(ids: np.ndarray) -> list[int]:
    each = LANES * CHECKPOINT_STEPS
    return [zlib.crc32(ids[i : i + each].tobytes()) for i in range(0, len(ids), each)]


def _ids_of(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from matchloom.llm.words import added_words

    words = added_words(vocabulary)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            ids, counts = words.texts(part.column(1).to_pylist())
            ends = np.cumsum(counts)
            out = np.insert(ids, ends, end_id).astype("<u4")
            ends += np.arange(1, len(ends) + 1)
            small = out.astype("<u2") if vocabulary_fits(out) else out
            data, size = small.tobytes(), small.itemsize
            begin = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - begin), pa.array([data[a * size : b * size] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["doc_id", "n_tokens", "ids"])


def vocabulary_fits(ids: np.ndarray) -> bool:
    return not len(ids) or int(ids.max()) < 1 << 16


def unpacked(data: bytes, n: int) -> np.ndarray:
    """Ids of a document, kept in two bytes each where all of its batch fit, else in four."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, data in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            more = np.bincount(unpacked(data, n))
            if len(more) > len(total):
                total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
            total[: len(more)] += more
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = Frequencies(counts)
    docs, sizes, parts, held, block, first, file = [], [], [], 0, 0, 0, None

    def flush() -> pa.RecordBatch:
        ids = np.concatenate(parts).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([part_checksums(ids)], pa.list_(pa.int64())), pa.array([encode_block(ids, table)], pa.binary())], names=["file", "block", "first", "n_ids", "doc_ids", "sizes", "crc32", "payload"])

    for batch in batches:
        for f, d, n, data in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "n_tokens", "ids")), strict=True):
            file = f
            docs.append(d)
            sizes.append(n)
            parts.append(unpacked(data, n))
            held += n
            if held >= BLOCK_IDS:
                yield flush()
                block, first, docs, sizes, parts, held = block + 1, first + held, [], [], [], 0
    if docs:
        yield flush()


def write_ids(docs: DataFrame, path: str, *, vocabulary: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", ids_per_file: int = 1 << 23) -> None:
    """Writes the ids of all texts under path: path/table (the shared frequencies), path/blocks and path/files (starts).

    Documents follow each other by ascending id (null ids first; equal ids by a hash of their text's ids, which spreads
    rows without id over files, then by those), each with end_id appended; null texts count as empty. An empty table gives an empty file set. Extra columns are ignored.

    Texts are encoded where they are read; only the ids (two bytes each) are staged and range-partitioned. The only
    thing that the driver sees is the frequency table, which the vocabulary bounds.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = staged(columns.mapInArrow(partial(_ids_of, vocabulary=vocabulary, end_id=end_id), "doc_id long, n_tokens long, ids binary"), "ids", compression="zstd")
    table = ids.mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table.coalesce(1).write.parquet(f"{path}/table")
    counts = counts_of(docs.sparkSession, path)
    files = max(1, -(-int(counts.sum()) // ids_per_file))
    spread = F.xxhash64("ids")
    ordered = ids.repartitionByRange(files, "doc_id", spread).sortWithinPartitions("doc_id", spread, "ids").withColumn("file", F.spark_partition_id())
    blocks = ordered.mapInArrow(partial(_blocks, counts=counts), "file int, block int, first long, n_ids long, doc_ids array<long>, sizes array<long>, crc32 array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    totals = blocks_of(docs.sparkSession, path).groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("file", before.alias("file_start")).write.parquet(f"{path}/files")


def blocks_of(spark, path: str) -> DataFrame:
    return spark.read.schema("file int, block int, first long, n_ids long, doc_ids array<long>, sizes array<long>, crc32 array<long>, payload binary").parquet(f"{path}/blocks")


def counts_of(spark, path: str) -> np.ndarray:
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"]] = rows["n"]
    return counts


def _documents(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = Frequencies(counts)
    names = ["doc_id", "start", "n_tokens", "ids"]
    for batch in batches:
        for row in range(batch.num_rows):
            cell = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            sizes = np.array(cell("sizes"), np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            # the documents that begin between this checkpoint and the next; the last one may go on beyond that
            part, each = cell("part"), LANES * CHECKPOINT_STEPS
            first, own = part * each, min(each, int(ends[-1]) - part * each)
            mine = slice(*np.searchsorted(starts, [first, first + each]))
            reach = max(own, int(ends[mine][-1]) - first) if mine.stop > mine.start else own
            ids = decode_block(cell("payload"), table, part, reach).astype("<u4")
            if zlib.crc32(ids[:own].tobytes()) != cell("crc32")[part]:
                raise ValueError(f"part {part} of block {cell('block')} of file {cell('file')} does not match its checksum")
            data, sizes = ids.tobytes(), sizes[mine]
            starts, ends = starts[mine] - first, ends[mine] - first
            docs = batch.column("doc_ids")[row].values.slice(mine.start, mine.stop - mine.start)
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts + first + cell("file_start") + cell("first")), pa.array(sizes), pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=names)


def read_ids(spark, path: str) -> DataFrame:
    """Reads what write_ids wrote: doc_id, start (ids of all documents before it), n_tokens, ids (u32, little-endian).

    The unit of work is one checkpoint of a block.
    """
    starts = spark.read.schema("file int, file_start long").parquet(f"{path}/files")
    if starts.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    blocks = blocks_of(spark, path)
    parts = blocks.join(starts, "file").withColumn("part", F.explode(F.sequence(F.lit(0), F.size("crc32") - 1)))
    return parts.mapInArrow(partial(_documents, counts=counts_of(spark, path)), "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
