"""Removal of repeated passages with a run-length index.

Whether the string of `length` bytes at a place occurs anywhere else is decided exactly, in two steps; a second, shorter
length (`passage`) may be asked for at once.

Sieve. The least hash among the GRAM-byte grams of a window (a minimiser) depends on the window's bytes alone, so equal
windows have it at the same offset. The windows (of the shorter length) of a document fall into regions, one for each
minimiser, each taken with the bytes that longer strings from its windows need; windows of different minimisers are never
equal, so regions meet only those with the same minimiser. Equal regions are one kind with a number of copies.

Index. Kinds that share a minimiser are indexed in bins of bounded size: the Burrows-Wheeler transform of the bin's
kinds, kept as runs with the suffixes sampled at both ends of every run. All kinds stream through the runs backwards at
once: a step of the last-to-first mapping raises a place's match with its neighbour in suffix order by one, but at the
head of a run, where the samples of two run ends are compared; in repetitive text there are few. A place is repeated if
its match is long enough, or if its kind has copies: then its neighbour is in the same run. A kind that is alone under
its minimiser would be an index of its own, all of whose runs are its copies, so its bytes need not be fetched.

A minimiser with very many kinds is split by the bytes that a narrower range of its windows have in common, down to
single windows, which need no index. Keys that many rows hold are joined by a broadcast that is bounded by their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, join_spread, slices, staged
from matchloom.llm.shingles import _BYTE, mixed, powers, prime_sums

#: Bytes of a gram; bytes of text that are sieved at once; bytes of regions in a bin; most different regions of one
#: minimiser in a bin; window ranges of a minimiser are split into so many.
GRAM, CHUNK_BYTES, BIN_BYTES, MOST_REGIONS, SPLIT = 32, 1 << 19, 1 << 20, 2048, 8


def regions(data: bytes, bounds: np.ndarray, window: int, length: int) -> tuple[np.ndarray, ...]:
    """The regions of texts in a row: text, first window (place in its text), windows, offset of the minimiser from the
    first window, how many of the windows have length bytes to the end of their text, hash of the minimiser, hash of the
    region. bounds: where the texts begin, and the end of the last; a region ends with the string of length bytes at its
    last window, or with its text."""
    raw = np.frombuffer(data, np.uint8)
    sizes = np.diff(bounds)
    starts = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), starts)
    if not len(owner):
        return tuple(np.empty(0, np.int64) for _ in range(7))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = place + bounds[:-1][owner]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:-1], dtype=np.uint64)])
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])
    width = window - GRAM + 1
    low = np.uint64((1 << 28) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    rows = -(-len(key) // width)
    blocks = np.full(rows * width, np.uint64(2**64 - 1))
    blocks[: len(key)] = key
    blocks = blocks.reshape(rows, width)
    # least key of every window: the end of one block and the beginning of the next
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    least = (np.minimum(ahead[at], behind[at + width - 1]) & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    begin, stop = at[first], bounds[1:][owner[first]]
    end = np.minimum(begin + windows - 1 + length, stop)
    whole = np.clip(stop - begin - length + 1, 0, windows)
    offset = least[first] - begin
    shape = mixed((offset << 42 | windows << 21 | (end - begin)).astype(np.uint64))
    content = mixed((sums[end] - sums[begin]) * down[begin] + shape) + prime_sums(raw, begin, end)
    return owner[first], place[first], windows, offset, whole, gram[least[first]].view(np.int64), content.view(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of numbers from 1 to 257; what follows its end is smaller than any of them.

    Doubles the compared length; only suffixes that are still tied are sorted again.
    """
    n, bits, step = len(text), 9, 7
    padded = np.concatenate([text, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(step):
        key = key << bits | padded[j : n + j]
    order = np.argsort(key)
    slots, ranked = np.arange(n), key[order]
    rank = np.zeros(n + 1, np.int64)
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads] + 1, lengths)
        slots = slots[np.repeat(lengths > 1, lengths)]
        if not len(slots):
            return order
        places = order[slots]
        key = rank[places] << 32 | rank[np.minimum(places + step, n)]
        sort = np.argsort(key, kind="stable")  # the ranks are in order, only what is tied in them is not
        order[slots], ranked = places[sort], key[sort]
        step *= 2


def inverse(order: np.ndarray) -> np.ndarray:
    """Where each number stands in a permutation."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with the suffixes sampled at both ends of every run."""

    def __init__(self, contents: list[bytes]):
        self.sizes = np.array([len(c) for c in contents], np.int64)
        self.ends = np.cumsum(self.sizes + 1) - 1  # where each text's separator stands
        self.begins = self.ends - self.sizes
        raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
        self.raw = raw
        letters = raw.astype(np.int64) + 2
        letters[self.ends] = 1  # separators are smaller than bytes; matches never go beyond them
        order = suffix_array(letters)
        before = letters[order - 1]
        head = np.ones(len(order), bool)
        head[1:] = before[1:] != before[:-1]
        #: where runs begin, the run of every rank, letters and lengths, and the suffixes at their heads and tails
        self.starts = np.flatnonzero(head)
        self.run = np.cumsum(head, dtype=np.int32) - 1
        self.letters, self.lengths = before[self.starts], np.diff(np.append(self.starts, len(order)))
        self.heads, self.tails = order[self.starts], order[self.starts + self.lengths - 1]
        self.stops = inverse(order)[self.ends]  # the ranks of the separators, where texts begin to stream

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, not beyond their regions."""
        raw = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(raw, 8)
        most = np.minimum(self._left(a), self._left(b))
        out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            x = np.ascontiguousarray(words[a[live] + done]).view("<u8").ravel() ^ np.ascontiguousarray(words[b[live] + done]).view("<u8").ravel()
            equal = np.where(x == 0, 8, np.bitwise_count(~x & (x - np.uint64(1))) // 8)
            out[live] += equal
            done += 8
            live = live[(equal == 8) & (done < most[live])]
        return np.minimum(out, most)

    def _left(self, at: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, at)] - at

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """rank: the place of every suffix in suffix order; common: for every rank, the bytes that its suffix has in
        common with the one before it. From the runs and their samples alone, all texts from their ends at once."""
        by_letter = np.argsort(self.letters, kind="stable")
        size, letter = self.lengths[by_letter], self.letters[by_letter]
        base, earlier = np.empty(len(size), np.int64), np.full(len(size), -1)
        base[by_letter] = np.cumsum(size) - size  # what the head of each run is mapped to
        again = np.flatnonzero(letter[1:] == letter[:-1]) + 1
        earlier[by_letter[again]] = by_letter[again - 1]
        # the head of a run follows the tail of the run of its letter before: their suffixes are sampled
        jump = np.zeros(len(size), np.int64)
        some = np.flatnonzero((earlier >= 0) & (self.heads > 0))
        some = some[self.tails[earlier[some]] > 0]
        jump[some] = self.common(self.heads[some] - 1, self.tails[earlier[some]] - 1)
        rank, shift = np.zeros(len(self.raw), np.int64), base - self.starts
        texts = np.argsort(-self.sizes, kind="stable")
        at, ends = self.stops[texts], self.ends[texts]
        rank[ends] = at
        left = -np.sort(-self.sizes)
        for step in range(1, int(left[0]) + 1 if len(left) else 1):
            live = int(np.searchsorted(-left, -step, side="right"))
            at = at[:live]
            at = at + shift[self.run[at]]
            rank[ends[:live] - step] = at
        # a match is one more than that of the place behind it, but what the samples give at the head of a run, and none at
        # an end: each place counts from the nearest of these at or behind it
        place, known = np.arange(len(rank)), np.full(len(rank), -1)
        run = self.run[rank[1:]]
        known[:-1] = np.where(rank[1:] == self.starts[run], jump[run], -1)
        known[self.ends] = 0
        near = np.minimum.accumulate(np.where(known >= 0, place, len(rank))[::-1])[::-1]
        common = np.empty(len(rank), np.int64)
        common[rank] = known[near] + near - place
        return rank, common

    def statistics(self, places: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The longest match of each of the places (a mask) with any other of them, or with a copy of its text."""
        rank, common = self.stream()
        where = inverse(rank)
        where = where[places[where]]
        best = np.zeros(len(self.raw), np.int64)
        if len(where) > 1:
            # matches between neighbours among the places: the least of those in between
            ranks = rank[where]
            between = np.minimum.reduceat(common[: ranks[-1] + 1], ranks[:-1] + 1)
            best[where[1:]] = between
            best[where[:-1]] = np.maximum(best[where[:-1]], between)
        left = np.repeat(self.ends, self.sizes + 1) - np.arange(len(self.raw))
        many = np.repeat(copies > 1, self.sizes + 1)
        return np.where(many & places, left, best)


def repeated(contents: list[bytes], windows: np.ndarray, copies: np.ndarray, lengths: list[int]) -> list[list[list[tuple[int, int]]]]:
    """For each length and each kind the ranges [from, to) of its windows whose string of that length occurs elsewhere."""
    index = RunIndex(contents)
    inside = np.arange(len(index.raw)) - np.repeat(index.begins, index.sizes + 1) < np.repeat(windows, index.sizes + 1)
    inside[index.ends] = False
    best, out = index.statistics(inside, copies), []
    for length in lengths:
        hit = np.concatenate([[False], inside & (best >= length), [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        ranges: list[list[tuple[int, int]]] = [[] for _ in contents]
        for a, b in edges.reshape(-1, 2).tolist():
            i = int(np.searchsorted(index.ends, a))
            ranges[i].append((a - int(index.begins[i]), b - int(index.begins[i])))
        out.append(ranges)
    return out


SIEVED = "key long, region long, rid long, rid2 int, first int, windows int, offset int, whole int"
KINDS = "key long, region long, n long, copies long, different long, windows int, offset int, whole int, content binary"
SPANS = "array<struct<a int, b int>>"
MARKS = f"key long, region long, n long, spans {SPANS}, short {SPANS}"
RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sieved(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rid, rid2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts, i = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < CHUNK_BYTES):
                size += len(texts[j])
                j += 1
            part = texts[i:j]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            owner, first, windows, offset, whole, key, content = regions(b"".join(part), bounds, window, length)
            if len(owner):
                small = [pa.array(x, pa.int32()) for x in (first, windows, offset, whole)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(rid[i:j][owner]), pa.array(rid2[i:j][owner]), *small], names=["key", "region", "rid", "rid2", "first", "windows", "offset", "whole"])
            i = j


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions wanted of each text."""
    names = ["key", "region", "n", "copies", "different", "windows", "offset", "whole"]
    kinds = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
    for batch in slices(batches):
        rows = []
        for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            rows += [(*(w[c] for c in names), data[w["first"] : w["first"] + w["windows"] - 1 + length]) for w in want]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[*names, "content"])


def _indexed(window: int, length: int):
    def index(cell: pa.Table) -> pa.Table:
        # rows that repeat an id and a text bring the same kind again
        seen = {kind: i for i, kind in enumerate(zip(cell.column("key").to_pylist(), cell.column("region").to_pylist(), strict=True))}
        cell = cell.take(pa.array(sorted(seen.values()), pa.int64())).combine_chunks()
        numbers = lambda c: cell.column(c).to_numpy()
        spans, short = repeated(cell.column("content").to_pylist(), numbers("windows"), numbers("copies"), [length, window])
        some = pa.array([i for i, ranges in enumerate(short) if ranges], pa.int64())
        lists = [pa.array([[{"a": a, "b": b} for a, b in ranges[i]] for i in some.to_pylist()], RANGES) for ranges in (spans, short)]
        return pa.table([*(cell.column(c).take(some) for c in ("key", "region", "n")), *lists], names=["key", "region", "n", "spans", "short"])

    return index


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _split(batches: Iterator[pa.RecordBatch], window: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Regions cut to ranges of width offsets of the minimiser, keyed by the bytes that all windows of the range share."""
    names = ["key", "region", "parent", "parent_region", "parent_n", "copies", "begin", "windows", "offset", "whole", "content"]
    kinds = [*[pa.int64()] * 6, *[pa.int32()] * 4, pa.binary()]
    for batch in batches:
        rows = []
        for key, region, n, copies, windows, offset, whole, content in zip(*(batch.column(c).to_pylist() for c in ("key", "region", "n", "copies", "windows", "offset", "whole", "content")), strict=True):
            # the window that begins at i has the minimiser at offset - i
            for block in range((offset - windows + 1) // width, offset // width + 1):
                begin, last = max(0, offset - block * width - width + 1), min(windows - 1, offset - block * width)
                # negative places of the range lie before the region; its shared bytes always lie inside
                core = content[offset - block * width : offset - block * width - width + 1 + window]
                cut = content[begin : last + length]
                name = _digest(key.to_bytes(8, "little", signed=True), block.to_bytes(4, "little"), core)
                shape = (offset - block * width - begin).to_bytes(4, "little") + (last - begin).to_bytes(4, "little")
                rows.append((name, _digest(shape, cut), key, region, n, copies, begin, last - begin + 1, offset - begin, max(0, min(last + 1, whole) - begin), cut))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _whole(kinds: DataFrame, short: Column, long: Column) -> DataFrame:
    """Marks of all windows of kinds: short and long say on which of the two lengths."""
    ranges = lambda on, n: F.when(on & (n > 0), F.array(F.struct(F.lit(0).alias("a"), n.alias("b")))).otherwise(F.array()).cast(SPANS)
    return kinds.select("key", "region", "n", ranges(long, F.col("whole")).alias("spans"), ranges(short, F.col("windows")).alias("short"))


def _counted(kinds: DataFrame, label: str) -> DataFrame:
    """kinds (key, region, n, copies ...), each once, with how many different ones share the key; staged. Those whose key
    has one copy in all are left out."""
    per_key = kinds.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("total")).filter("total > 1").drop("total")
    return staged(join_spread(kinds, per_key, ["key"], "different", kinds.count()), label, compression="zstd")


def _resolved(kinds: DataFrame, window: int, length: int, width: int) -> DataFrame:
    """Marks (key, region, n, and the ranges of windows that are repeated) of kinds that share their key with others."""
    few = kinds.filter(F.col("different") <= MOST_REGIONS)
    total = few.agg(F.sum(F.length("content"))).first()[0] or 0
    bins = max(1, -(-total // BIN_BYTES) * 2)
    cells = few.select("key", "region", "n", "copies", "windows", "content", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"))
    out = cells.groupBy("bin").applyInArrow(_indexed(window, length), MARKS)
    many = kinds.filter(F.col("different") > MOST_REGIONS).dropDuplicates(["key", "region"])
    if many.isEmpty():
        return out
    narrow = max(1, -(-width // SPLIT))
    fields = "key long, region long, parent long, parent_region long, parent_n long, copies long, begin int, windows int, offset int, whole int, content binary"
    parts = staged(many.mapInArrow(partial(_split, window=window, length=length, width=narrow), fields), "parts", compression="zstd")
    same = [F.first(c).alias(c) for c in ("windows", "offset", "whole", "content")]
    below = parts.groupBy("key", "region").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), *same)
    below = _counted(staged(below, "below", compression="zstd"), "below")
    if narrow == 1:  # single windows: those of one key are equal, those of one region on all the bytes of the longer length
        marks = _whole(below, F.lit(True), F.col("copies") > 1)
    else:
        alone = _whole(below.filter("different = 1"), F.lit(True), F.lit(True))
        marks = alone.unionByName(_resolved(below.filter("different > 1"), window, length, narrow))
    marks = staged(marks, "marks", compression="zstd")
    back = join_spread(parts.select("key", "region", "parent", "parent_region", "parent_n", "begin"), marks, ["key", "region"], "n", parts.count())
    moved = [F.transform(c, lambda s: F.struct((s.a + F.col("begin")).alias("a"), (s.b + F.col("begin")).alias("b"))).alias(c) for c in ("spans", "short")]
    back = back.select(F.col("parent").alias("key"), F.col("parent_region").alias("region"), F.col("parent_n").alias("n"), *moved)
    # one row for each region: it has no more ranges than windows
    both = back.groupBy("key", "region", "n").agg(*(F.flatten(F.collect_list(c)).cast(SPANS).alias(c) for c in ("spans", "short")))
    return out.unionByName(both)


def cut(data: bytes, marks: list[int], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of data, and the maximal removed ranges; marks: from, to, from, to ... of repeated windows."""
    ranges: list[tuple[int, int]] = []
    # if windows [a, b) are repeated, bytes [a, b - 1 + length) go
    for a, b in sorted((a, b - 1 + length) for a, b in zip(marks[::2], marks[1::2], strict=True)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
        else:
            ranges.append((a, b))
    ends = [0, *(b for _, b in ranges)]
    starts = [*(a for a, _ in ranges), len(data)]
    return b"".join(data[e:s] for e, s in zip(ends, starts, strict=True)), ranges


def _removed(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_passage_bytes"]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), kind, pa.binary(), pa.int64()]
    for batch in slices(batches):
        rows = []
        for text, marks, short in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "short")), strict=True):
            data = (text or "").encode("utf-8", "replace")
            kept, ranges = cut(data, marks or [], length)
            passages = len(data) - len(cut(data, short or [], window)[0])
            rows.append((len(data), len(data) - len(kept), [{"a": a, "b": b} for a, b in ranges], kept, passages))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)


ROW = ["rid", "rid2"]


def row_key(text_col: str, id_col: str) -> list[Column]:
    """rid and rid2: 96 bits that tell rows apart; rows that repeat an id and a text share them."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.xxhash64(doc, text).alias("rid"), F.hash(text, doc).alias("rid2")]


def marks_of(docs: DataFrame, *, length: int = 400, passage: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """rid, rid2, marks, short: for each row of docs that has any, by its row_key, the repeated windows: from, to, from, to
    ... of strings of length bytes, and of those of passage bytes (length, if not given)."""
    window = length if passage is None else passage
    if not GRAM < window <= length:
        raise ValueError(f"passage is from {GRAM + 1} to length")
    texts = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    found = staged(texts.mapInArrow(partial(_sieved, window=window, length=length), SIEVED), "regions", compression="zstd")
    often = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(join_spread(found, often, ["key"], "n", found.count()).drop("n"), "shared", compression="zstd")
    # any row of a region will do: all have the same bytes
    one = [F.first(c).alias(c) for c in (*ROW, "first", "windows", "offset", "whole")]
    kinds = staged(shared.groupBy("key", "region").agg(F.count("*").alias("n"), *one), "kinds", compression="zstd")
    kinds = _counted(kinds.withColumn("copies", F.col("n")), "kinds")
    alone = _whole(kinds.filter("different = 1"), F.lit(True), F.lit(True))
    fields = ("key", "region", "n", "copies", "different", "first", "windows", "offset", "whole")
    want = kinds.filter("different > 1").groupBy(*ROW).agg(F.collect_list(F.struct(*fields)).alias("want"))
    contents = texts.join(want.hint("shuffle_hash"), ROW).select("text", "want").mapInArrow(partial(_fetched, length=length), KINDS)
    contents = staged(contents, "contents", compression="zstd")
    marks = staged(alone.unionByName(_resolved(contents, window, length, window - GRAM + 1)), "marks", compression="zstd")
    placed = join_spread(shared.select("key", "region", *ROW, "first"), marks, ["key", "region"], "n", shared.count())
    flat = [F.flatten(F.transform(c, lambda s: F.array(s.a + F.col("first"), s.b + F.col("first")))).cast("array<long>").alias(c) for c in ("spans", "short")]
    # rows with the same key give the same marks twice; a text has no more marks than windows
    return placed.select(*ROW, *flat).groupBy(*ROW).agg(F.flatten(F.collect_set("spans")).alias("marks"), F.flatten(F.collect_set("short")).alias("short"))


def remove_repeats(docs: DataFrame, *, length: int = 400, passage: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed ranges of bytes), kept (the bytes that stay), n_passage_bytes (bytes of
    the text that a repeated string of passage bytes covers; of length bytes, if not given) of every row of docs.

    Texts are UTF-8 bytes, null texts empty. A byte goes if a string of length bytes that covers it also begins
    anywhere else in the texts of docs, overlaps and the same text included; strings never cross texts, and are judged
    on the texts as they come. Texts shorter than length keep all. Null and repeated ids are kept, each row by itself;
    a repeated row repeats its text. Very long texts are taken whole. Empty tables give no rows; extra columns are
    ignored. passage is GRAM + 1 at least.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_key(text_col, id_col))
    marks = marks_of(docs, length=length, passage=passage, text_col=text_col, id_col=id_col)
    marked = texts.join(marks.hint("shuffle_hash"), ROW, "left").select("doc_id", "text", "marks", "short")
    return marked.mapInArrow(partial(_removed, window=passage or length, length=length), "doc_id long, n_bytes long, n_removed long, spans array<struct<a bigint, b bigint>>, kept binary, n_passage_bytes long")


def without_repeats(docs: DataFrame, *, length: int = 400, text_col: str = "text", id_col: str = "doc_id", count_col: str = "n_chars") -> DataFrame:
    """docs with all rows and columns, repeated bytes cut out of text_col; a character that loses a byte goes as a whole.

    count_col, if there is one, holds the characters that are left. Null texts stay null. See remove_repeats.
    """
    a, b, m = fresh(docs, "rid", "rid2", "marks")
    marks = marks_of(docs, length=length, text_col=text_col, id_col=id_col).select(F.col("rid").alias(a), F.col("rid2").alias(b), F.col("marks").alias(m))

    @F.pandas_udf("string")
    def left(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if m is None or t is None else cut(t.encode("utf-8", "replace"), list(m), length)[0].decode("utf-8", "ignore") for t, m in zip(texts, marks, strict=True)])

    rid, rid2 = row_key(text_col, id_col)
    out = docs.withColumns({a: rid, b: rid2}).join(marks.hint("shuffle_hash"), [a, b], "left").withColumn(text_col, left(F.col(text_col).cast("string"), F.col(m)))
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return out.select(*docs.columns)
