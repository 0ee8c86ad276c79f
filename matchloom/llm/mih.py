"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: iterative quantisation (a rotation of the principal components that brings vectors near the corners of a
cube), fitted on a bounded sample; every row is coded and indexed. A code is cut into substrings, each with an index of
its own. If two codes differ in at most r bits, then by the pigeonhole principle some substring differs in few bits,
so probing every substring index retrieves every code within r; the vectors of those are compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import least_by_hash, matrix, one_per_id, query_blocks, staged, usual_dimension, vectors

#: Most rows that the rotation and the radius are fitted on, and most of those that serve as trial queries.
SAMPLE_ROWS, TRIAL_QUERIES = 8192, 512
#: Most rows of one index, and queries that probe it at once.
INDEX_ROWS, INDEX_QUERIES = 8192, 256


@dataclass(frozen=True)
class Coder:
    """center and rotation: what turns a vector into bits; scale: the largest component, norm: the largest norm after division
    by it; radius: Hamming distance to search."""

    center: np.ndarray
    rotation: np.ndarray
    scale: float
    norm: float
    radius: int

    def codes(self, x: np.ndarray, *, query: bool) -> np.ndarray:
        # squares of components must not overflow: rows are divided by the largest of all, queries by their own largest
        by = np.abs(x).max(axis=1, keepdims=True) if query else self.scale
        return signs(lifted(x / by, self.norm, query=query), self.center, self.rotation)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def lifted(x: np.ndarray, norm: float, *, query: bool) -> np.ndarray:
    """Vectors with one more component, which turns the largest inner product into the smallest angle."""
    length = np.linalg.norm(x, axis=1)
    if query:
        return np.hstack([x * (norm / np.maximum(length, 1e-300))[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - length**2, 0))[:, None]])


def signs(x: np.ndarray, center: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes, 64 bits in each column."""
    bits = (x - center) @ rotation > 0
    full = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each code of a differs from each of b."""
    return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(a.shape[1]))


def fit(sample: np.ndarray, n_rows: int, scale: float, norm: float, *, k: int, target: float, bits: int = 128, rounds: int = 40) -> Coder:
    """Rotations by iterative quantisation, and the radius that holds the share target of the sample's near pairs.

    One rotation gives as many bits as there are dimensions, so longer codes take several, learned from different starts
    (two at most). Near is as deep in the sample as k neighbours are in n_rows rows, one at least, so the radius is not
    too small.
    """
    sample = sample / scale
    x = lifted(sample, norm, query=False)
    center = x.mean(axis=0)
    d = x.shape[1]
    _, basis = np.linalg.eigh(np.cov((x - center).T) if len(x) > 1 else np.eye(d))
    rng, rotations, left = np.random.default_rng(7), [], min(bits, 2 * d)
    while left > 0:
        m = min(left, d)
        part = basis[:, ::-1][:, :m]
        v = (x - center) @ part
        turn = np.linalg.qr(rng.normal(size=(m, m)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        rotations.append(part @ turn)
        left -= m
    rotation = np.hstack(rotations)
    trial = sample[:TRIAL_QUERIES]
    scores = trial @ sample.T
    scores[np.arange(len(trial)), np.arange(len(trial))] = -np.inf
    depth = min(max(1, -(-k * len(sample) // max(n_rows, 1))), max(1, len(sample) - 1))
    near = np.argpartition(-scores, depth - 1, axis=1)[:, :depth]
    q, c = signs(lifted(trial, norm, query=True), center, rotation), signs(x, center, rotation)
    distance = np.take_along_axis(apart(q, c), near, axis=1)
    return Coder(center, rotation, scale, norm, int(np.quantile(distance, target, method="higher")))


class SubstringIndex:
    """Rows by the value of one substring of their codes."""

    def __init__(self, codes: np.ndarray, start: int, width: int):
        self.word, self.shift, self.width = start // 64, np.uint64(start % 64), width
        values = self.cut(codes)
        self.order = np.argsort(values, kind="stable")
        self.keys, self.starts = np.unique(values[self.order], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))

    def cut(self, codes: np.ndarray) -> np.ndarray:
        return ((codes[:, self.word] >> self.shift) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def probe(self, codes: np.ndarray, reach: int, hits: np.ndarray) -> None:
        """Marks in hits (queries x rows) the rows whose substring is within reach bits of the query's."""
        if reach < 0:
            return
        values, inverse = np.unique(self.cut(codes), return_inverse=True)
        flips = ball(self.width, reach)
        for j, value in enumerate(values):
            if len(flips) <= len(self.keys):  # look up each value of the ball
                want = value ^ flips
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                at = at[self.keys[at] == want]
            else:  # fewer keys than the ball has values: compare the keys
                at = np.flatnonzero(np.bitwise_count(self.keys ^ value) <= reach)
            lengths = self.ends[at] - self.starts[at]
            rows = self.order[np.repeat(self.starts[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())] if len(at) else at
            for i in np.flatnonzero(inverse == j):
                hits[i, rows] = True


_BALLS: dict[tuple[int, int], np.ndarray] = {}


def ball(width: int, reach: int) -> np.ndarray:
    """All values of width bits with at most reach ones."""
    if (width, reach) not in _BALLS:
        _BALLS[width, reach] = np.array([sum(1 << b for b in c) for r in range(min(reach, width) + 1) for c in itertools.combinations(range(width), r)], np.uint32)
    return _BALLS[width, reach]


class MultiIndex:
    """Substring indexes over the codes of one block of rows."""

    def __init__(self, codes: np.ndarray, bits: int, width: int = 16):
        self.codes = codes
        self.parts = [SubstringIndex(codes, a, min(width, bits - a)) for a in range(0, bits, width)]

    def probed(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """The rows (columns) that some substring brings for each query: all within radius bits and others.

        With radius = a * pieces + b, one of the first b + 1 substrings is within a bits, or another within a - 1.
        """
        hits = np.zeros((len(queries), len(self.codes)), bool)
        a, b = divmod(radius, len(self.parts))
        for j, part in enumerate(self.parts):
            part.probe(queries, a if j <= b else a - 1, hits)
        return hits

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows have codes within radius bits of each query's: all of them, by the pigeonhole rule. Only codes of rows
        that the probes bring are compared."""
        hits = self.probed(queries, radius)
        for row, query in zip(hits, queries, strict=True):
            some = np.flatnonzero(row)
            row[some[apart(query[None], self.codes[some])[0] > radius]] = False
        return hits


def _searched(batches: Iterator[pa.RecordBatch], coder: Coder, own: np.ndarray, q: np.ndarray, k: int, radius: int) -> Iterator[pa.RecordBatch]:
    """The k best rows within radius of each query, of each part of the rows."""
    codes = coder.codes(q, query=True)
    for ids, x in _parts(batches):
        index, out = MultiIndex(coder.codes(x, query=False), coder.bits), []
        for i in range(0, len(q), INDEX_QUERIES):
            hits = index.within(codes[i : i + INDEX_QUERIES], radius)
            for j, mask in enumerate(hits, i):
                near = np.flatnonzero(mask & (ids != own[j]))
                s = (x[near] * q[j]).sum(axis=1)
                top = np.lexsort((ids[near], -s))[:k]
                out.append((np.full(len(top), own[j]), ids[near][top], s[top]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of INDEX_ROWS rows at most."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, INDEX_ROWS):
            part = batch.slice(i, INDEX_ROWS)
            if n + part.num_rows > INDEX_ROWS:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, n = [], 0
            held.append((part.column("vec_id").to_numpy(), matrix(part)))
            n += part.num_rows
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.96, bits: int = 128, block_queries: int = 4096, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k rows of largest inner product found for each query: query_id, rank (from 1), vec_id, score.

    score is the inner product of the original vectors in double precision; ties go to the smaller vec_id; a row with
    the query's own id is no candidate. Left out on both sides: null ids, vectors that are null, empty, zero, of
    another length than most rows, or with null or non-finite components. A query id in several rows is asked once,
    with its least vector; repeated rows are candidates each. Empty tables give no rows. Other columns are ignored.

    target: share of the near pairs of the fitting sample (sample_rows rows of least id hash) that the radius must
    hold. Every row is indexed, and a query's candidates are all rows within the radius, however rows and queries are
    cut into parts. Queries that find fewer than k rows are asked again with a wider radius, at last with all bits, so k
    rows come back whenever there are as many. The rows are read once for each block of queries (see query_blocks) and
    are never shuffled.
    """
    rows = vectors(rows, id_col, vector_col, allow_zero=False)
    queries = one_per_id(vectors(queries, id_col, vector_col, allow_zero=False))
    d, n = usual_dimension(rows)
    fields = "query_id long, vec_id long, score double"
    out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    if n:
        rows, todo = rows.filter(F.size("vec") == d), queries.filter(F.size("vec") == d)
        scale = rows.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))
        norm = rows.agg(F.max(length)).first()[0]
        sample = np.array([r["vec"] for r in least_by_hash(rows, "vec_id", sample_rows).collect()])
        coder = fit(sample, n, scale, norm, k=k, target=target, bits=bits)
        for radius in (coder.radius, (coder.radius + coder.bits) // 2, coder.bits):
            found = []
            for own, q in query_blocks(todo, d, block_queries):
                part = rows.mapInArrow(partial(_searched, coder=coder, own=own, q=q, k=k, radius=radius), fields)
                best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
                found.append(staged(part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "nearest"))
            if not found:
                break
            each = reduce(DataFrame.unionByName, found)
            ready = each.filter(F.col("rank") == k).select("query_id") if radius < coder.bits else each.select("query_id").distinct()
            out = out.unionByName(each.join(ready, "query_id", "left_semi"))
            todo = staged(todo.join(ready, F.col("vec_id") == F.col("query_id"), "left_anti"), "todo")
            if todo.isEmpty():
                break
    return out.select("query_id", "rank", "vec_id", "score")
