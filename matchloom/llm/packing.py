"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so the driver plans on a histogram of lengths, whose size does not
depend on the data: large lengths are grouped into groups of equal cardinality and rounded up to the longest of their
group; the few lengths that remain make a small configuration programme, solved by column generation; actual pieces
take the places of the rounded ones, and what is left, with all small pieces, goes to the fullest sequence that still
holds it. The plan is a list of flows: a range of the pieces of one length goes to a range of sequences at one offset.
Tasks look their pieces up in it by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import staged

#: Plans that are made, of which the one with the fewest sequences counts: lengths above length // large are large and
#: form so many groups. Many groups waste little by rounding up; a high bar leaves more to the best fit.
SETTINGS = ((2, 32), (3, 64), (8, 48))
MAX_PLAN_BYTES = 32 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def best_configuration(sizes: np.ndarray, value: np.ndarray, length: int) -> np.ndarray:
    """How many of each size fit into length at the largest total value."""
    best, choice = np.zeros(length + 1), np.full(length + 1, -1)
    order = np.flatnonzero(value > 1e-12)
    if not len(order):
        return np.zeros(len(sizes), np.int64)
    s, v = sizes[order], value[order]
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        fit = np.where(s <= c, best[np.maximum(c - s, 0)] + v, -1.0)
        j = int(fit.argmax())
        if fit[j] > best[c] + 1e-12:
            best[c], choice[c] = fit[j], order[j]
    out, c = np.zeros(len(sizes), np.int64), length
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used: the covering programme over the rounded sizes.

    Simplex steps over a basis of one configuration a size; the next column is the configuration of largest value at
    the current prices. Stops at the optimum, or after the given rounds with a feasible solution.
    """
    basis = np.diag(length // sizes).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, prices, length).astype(float)
        if column @ prices <= 1 + 1e-7:
            break
        use, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand)
    return basis.round().astype(np.int64), np.floor(np.maximum(use, 0) + 1e-6).astype(np.int64)


class Plan:
    """Flows for a histogram of lengths; sequences is how many are used."""

    def __init__(self, histogram: np.ndarray, length: int, large: int, groups: int):
        self.length, self.large, self.groups, self.sequences = length, length // large, groups, 0
        self.flows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, count, first sequence, pieces a sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = {}  # ranges of sequences by the room they have left
        full = int(histogram[length])
        if full:
            self.flows.append((length, 0, full, self._open(full), 1, 0))
        left = self._place_large(histogram)
        for size in range(length - 1, 0, -1):
            small = [(0, int(histogram[size]))] if size <= self.large else left.get(size, [])
            for rank, n in small:
                self._best_fit(size, rank, n)

    def _open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def _give(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((first, n))

    def _place_large(self, histogram: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Places large pieces by configurations; returns the ranges of ranks, by length, that are left over."""
        sizes = np.arange(self.length - 1, self.large, -1)
        count = histogram[sizes]
        sizes, count = sizes[count > 0], count[count > 0]
        total = int(count.sum())
        if not total:
            return {}
        ends = np.cumsum(count)
        begins = ends - count
        size_at = lambda r: int(sizes[np.searchsorted(ends, r, side="right")])
        each = -(-total // min(self.groups, len(sizes)))
        heads = np.arange(0, total, each)
        rounded = np.array([size_at(r) for r in heads])
        group = np.unique(-rounded, return_inverse=True)[1]  # groups that are rounded to the same length become one
        rounded = -np.unique(-rounded)
        tails = np.append(heads[1:], total)
        demand = np.bincount(group, weights=tails - heads, minlength=len(rounded))
        starts = np.concatenate([[0], np.cumsum(demand)[:-1]]).astype(np.int64)
        nxt, stop = starts.copy(), (starts + demand).astype(np.int64)
        patterns, use = configurations(rounded, demand, self.length)
        for pattern, n in zip(patterns.T, use.tolist(), strict=True):
            n = min([n, *((stop[g] - nxt[g]) // pattern[g] for g in np.flatnonzero(pattern))])
            if n <= 0 or not pattern.any():
                continue
            bins, slots = self._open(n), []
            for g in np.flatnonzero(pattern):
                for _ in range(pattern[g]):
                    slots.append(int(nxt[g]))
                    nxt[g] += n
            cuts = sorted({0, n, *(int(e - r) for r in slots for e in ends[(ends > r) & (ends < r + n)])})
            for a, b in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for r in slots:
                    j = int(np.searchsorted(ends, r + a, side="right"))
                    self.flows.append((int(sizes[j]), r + a - int(begins[j]), b - a, bins + a, 1, offset))
                    offset += int(sizes[j])
                self._give(self.length - offset, bins + a, b - a)
        left: dict[int, list[tuple[int, int]]] = {}
        for r, end in zip(nxt.tolist(), stop.tolist(), strict=True):
            while r < end:
                j = int(np.searchsorted(ends, r, side="right"))
                to = min(end, int(ends[j]))
                left.setdefault(int(sizes[j]), []).append((r - int(begins[j]), to - r))
                r = to
        return left

    def _best_fit(self, size: int, rank: int, n: int) -> None:
        """Pieces of one length, one after the other, to the sequences with the least room that holds them."""
        while n:
            room = min((r for r in self.room if r >= size), default=0)
            if not room:
                count = -(-n // (self.length // size))
                self._give(self.length, self._open(count), count)
                continue
            ranges = self.room[room]
            first, count = ranges.pop()
            each = min(room // size, n)
            m = min(count, n // each)
            self.flows.append((size, rank, m * each, first, each, self.length - room))
            if count > m:
                ranges.append((first + m, count - m))
            if not ranges:
                del self.room[room]
            self._give(room - each * size, first, m)
            rank, n = rank + m * each, n - m * each

    def table(self) -> np.ndarray:
        """Flows by length and rank."""
        flows = np.array(self.flows, np.int64).reshape(-1, 6)
        flows = flows[np.lexsort((flows[:, 1], flows[:, 0]))]
        if flows.nbytes > MAX_PLAN_BYTES:
            raise ValueError(f"a plan of {flows.nbytes} bytes; the sequence length is too large")
        return flows


def planned(histogram: np.ndarray, length: int) -> Plan:
    """The best of the plans by SETTINGS."""
    return min((Plan(histogram, length, *x) for x in SETTINGS), key=lambda p: p.sequences)


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, length: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    from matchloom.llm.words import added_words

    words, part, seen = added_words(vocabulary), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            docs = batch.slice(i, 1000)
            ids, counts = words.texts(docs.column(1).to_pylist())
            data = np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes()
            counts = counts + 1
            n = -(-counts // length)
            owner = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            head = counts - (n - 1) * length  # the first piece takes what is over
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * length)
            size = np.where(piece == 0, head[owner], length)
            at = 4 * ((np.cumsum(counts) - counts)[owner] + start)
            order = np.argsort(size, kind="stable")
            by_size = size[order]
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.searchsorted(by_size, by_size) + seen[by_size]
            seen += np.bincount(size, minlength=length + 1)
            chunks = [data[a:b] for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array([zlib.crc32(c) for c in chunks], pa.int64()), pa.array(chunks if keep_ids else [None] * len(chunks), pa.binary()), pa.array(np.full(len(size), part), pa.int32()), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])


def _placed(batches: Iterator[pa.RecordBatch], flows: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = flows[:, 0] << 44 | flows[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    for batch in batches:
        size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        f = flows[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
        past = rank - f[:, 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), pa.array(f[:, 3] + past // f[:, 4]), pa.array(f[:, 5] + past % f[:, 4] * size)], names=names)


def pack(docs: DataFrame, *, vocabulary: str, end_id: int, length: int = 1024, keep_ids: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs all texts into sequences of at most length tokens.

    A document is its text's ids and end_id; null texts count as empty. Documents longer than length are cut into
    pieces of length tokens, of which the first may be shorter. One row a piece: doc_id, piece (from 0), start (ids of
    its document before it), length, ids_crc32, ids (u32, little-endian; null unless keep_ids), sequence_id, offset
    (its place in the sequence; sequences have no gaps). Null and repeated ids are kept, one document for each row. An
    empty table gives no rows. Extra columns are ignored.

    Texts are read once; pieces never meet in one task. Ranks come from counts by task and length; the driver sees one
    count for each length.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(columns.mapInArrow(partial(_pieces, vocabulary=vocabulary, end_id=end_id, length=length, keep_ids=keep_ids), PIECES), "pieces", compression="zstd")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(length + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    flows = planned(histogram, length).table()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_part.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.mapInArrow(partial(_placed, flows=flows), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
