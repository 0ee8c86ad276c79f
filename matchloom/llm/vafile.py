"""Exact top-k search by vector-approximation files.

A file of cells is written once: every component of a vector as the number of its slice, one byte each. For a block of
queries the cells are scanned twice. The first scan bounds every score from below and so finds, for each query, a bound
that k rows reach; the second keeps the rows whose upper bound is not below it. Exact vectors are then read for those
alone, first of the best upper bounds, then of all that may still be above the k-th exact score, so the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import matrix, one_per_id, query_blocks, staged, usual_dimension, vectors

#: Cells and queries whose scores are bounded at once; most ids of vectors that are broadcast to read them.
SCAN_ROWS, SCAN_QUERIES, BROADCAST_IDS = 2048, 512, 1 << 20
RESULT = "query_id long, rank int, vec_id long, score long"


@dataclass(frozen=True)
class Slices:
    """Where the slices of each component begin, and how many whole numbers each holds."""

    low: np.ndarray
    width: np.ndarray

    @staticmethod
    def between(low: np.ndarray, high: np.ndarray, bits: int) -> Slices:
        return Slices(low, np.maximum(1.0, np.ceil((high - low + 1) / (1 << bits))))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) // self.width, 0, 255).astype(np.uint8)


class Bounds:
    """Lower and upper bounds of the scores of queries with cells: each component takes an end of its slice."""

    def __init__(self, slices: Slices, queries: np.ndarray):
        self.steps = queries * slices.width
        least, up, down = queries @ slices.low, np.maximum(queries, 0) @ (slices.width - 1), np.minimum(queries, 0) @ (slices.width - 1)
        # sums of doubles beyond 2**53 are rounded: bounds give way by more than that
        slack = 2.0**-40 * (np.abs(queries) @ (np.abs(slices.low) + 256 * slices.width))
        slack[slack < 2.0**12] = 0
        self.lower, self.upper = least + down - slack, least + up + slack

    def sums(self, cells: np.ndarray) -> np.ndarray:
        return self.steps @ cells.T.astype(np.float64)


def _celled(batches: Iterator[pa.RecordBatch], slices: Slices) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = slices.cells(matrix(batch))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("content"), pa.array([row.tobytes() for row in cells], pa.binary())], names=["vec_id", "content", "cells"])


def _scanned(batches: Iterator[pa.RecordBatch], bounds: Bounds, own: np.ndarray) -> Iterator[tuple[pa.RecordBatch, slice, np.ndarray]]:
    """Parts of the file of cells and of the queries with the sums of their pairs, minus infinity for a query itself."""
    for batch in batches:
        for i in range(0, batch.num_rows, SCAN_ROWS):
            part = batch.slice(i, SCAN_ROWS)
            ids, cells = part.column("vec_id").to_numpy(), np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            sums = bounds.sums(cells)
            place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            same = np.flatnonzero(own[place] == ids)
            sums[place[same], same] = -np.inf
            yield part, sums


def _reached(batches: Iterator[pa.RecordBatch], bounds: Bounds, own: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k largest lower bounds of each query."""
    best = np.full((len(own), k), -np.inf)
    for _, sums in _scanned(batches, bounds, own):
        for i in range(0, len(own), SCAN_QUERIES):
            some = slice(i, i + SCAN_QUERIES)
            both = np.concatenate([best[some], sums[some] + bounds.lower[some, None]], axis=1)
            best[some] = -np.partition(-both, k - 1, axis=1)[:, :k]
    query, place = np.nonzero(best > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(best[query, place])], names=["query_id", "bound"])


def _surviving(batches: Iterator[pa.RecordBatch], bounds: Bounds, own: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose upper bound is least at least, for each query."""
    for part, sums in _scanned(batches, bounds, own):
        query, row = np.nonzero(sums >= np.maximum(least - bounds.upper, -np.finfo(float).max)[:, None])
        upper = sums[query, row] + bounds.upper[query]
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(own[query]), part.column("vec_id").take(row), part.column("content").take(row), pa.array(upper)], names=["query_id", "vec_id", "content", "upper"])


def _whole(scale: int) -> Column:
    """vec as whole numbers floor(scale * x), which must fit 64 bits."""

    def one(x: Column) -> Column:
        y = x * F.lit(float(scale))
        wide = F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")
        # rows with components that are not finite are left out, wherever that is decided in the plan
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).when(finite, wide)

    return F.transform("vec", one)


def _product(a: str, b: str) -> Column:
    """The exact inner product of arrays of whole numbers; an error if it leaves 64 bits."""
    total = F.aggregate(F.zip_with(a, b, F.try_multiply), F.lit(0).cast("long"), F.try_add)
    return F.coalesce(total, F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))


def _ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")))


def exact_top_k(rows: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, bits: int = 8, block_queries: int = 4096) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    A component x counts as floor(scale * x). Ties go to the smaller vec_id; a row with the query's own id is no
    candidate. Left out on both sides: null ids, vectors that are null, empty, of another length than most rows, or
    with null or non-finite components. A query id that occurs in several rows is asked once, with its least vector;
    repeated rows are candidates each. Empty tables give no rows. Other columns are ignored. Components or scores that
    do not fit 64 bits are an error.

    The cells are read twice for each block of queries (see query_blocks) and stay where they are; what is shuffled is k
    bounds for each query and task, the surviving pairs, and the exact vectors that they ask for. bits is 8 at most.
    """
    usable = lambda df: vectors(df, id_col, vector_col, allow_zero=True).withColumn("vec", _whole(scale))
    rows, queries = usable(rows), one_per_id(usable(queries))
    d, n = usual_dimension(rows)
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], RESULT)
    rows, queries = rows.filter(F.size("vec") == d).withColumn("content", F.xxhash64("vec")), queries.filter(F.size("vec") == d)
    ends = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()
    slices_ = Slices.between(*(np.array([float(r[c]) for r in ends]) for c in ("low", "high")), bits)
    doubles = rows.select("vec_id", "content", F.col("vec").cast("array<double>").alias("vec"))
    cells = staged(doubles.mapInArrow(partial(_celled, slices=slices_), "vec_id long, content long, cells binary"), "cells")
    found = spark.createDataFrame([], "query_id long, vec_id long, content long, upper double")
    for own, q in query_blocks(queries, d, block_queries):
        bounds = Bounds(slices_, q)
        reached = cells.mapInArrow(partial(_reached, bounds=bounds, own=own, k=k), "query_id long, bound double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound")))
        kth = reached.withColumn("place", place).filter(F.col("place") == k).select("query_id", "bound").toPandas()
        least = np.full(len(own), -np.inf)  # fewer than k rows: all survive
        least[np.searchsorted(own, kth["query_id"])] = kth["bound"]
        survivors = cells.mapInArrow(partial(_surviving, bounds=bounds, own=own, least=least), found.schema)
        found = found.unionByName(staged(survivors, "survivors"))
    ranked = staged(_ranked(found, "upper", "place"), "survivors")
    first = staged(scores(ranked.filter(F.col("place") <= 2 * k), rows, queries), "scores")
    kth = _ranked(first, "score", "rank").filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = ranked.filter(F.col("place") > 2 * k).join(kth, "query_id", "left").filter("kth IS NULL OR upper >= kth")
    best = first.unionByName(scores(rest, rows, queries))
    return _ranked(best, "score", "rank").filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scores(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score of pairs, from exact vectors; only those of the pairs' rows are read on."""
    wanted = staged(pairs.select("vec_id", "content").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    exact = rows.join(few, ["vec_id", "content"], "left_semi").dropDuplicates(["vec_id", "content"])
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return pairs.select("query_id", "vec_id", "content").join(exact, ["vec_id", "content"]).join(asked, "query_id").select("query_id", "vec_id", _product("vec", "q").alias("score"))
