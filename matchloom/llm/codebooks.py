"""Codes of vectors by codebooks, nearest entries by slices of bitmasks.

Components become whole numbers and vectors are cut into parts; every part position has a codebook, which is fitted by rounds of
assignment and averaging over all vectors. The nearest entry of a part is found exactly, without comparing all entries: an
entry near a first guess gives a radius, and no entry outside the box of that radius can be nearer. For each dimension of
a part the entries' coordinates are sorted, and each place of the order carries a mask of the entries before it, so the
entries within a slice are the difference of two masks; the slices' masks are ANDed, and only the entries left are measured.

A round is one pass over the staged vectors: tasks send sums and counts, the driver gets one row for each entry and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from matchloom.llm.common import fresh, join_spread, slices, staged, usual_dimension

#: Squared distances of whole vectors are taken in 64 bits where they stay below this, else in numbers of any size.
MOST = 1 << 60
#: Components at this and beyond don't fit.
WIDEST = 2.0**62


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Doubles without fraction as 64-bit numbers; as Python's own where squares of differences may leave 64 bits."""
    most = float(np.abs(vectors).max(initial=0))
    if most >= WIDEST:
        raise ValueError("a scaled component does not fit 62 bits")
    out = vectors.astype(np.int64)
    return out if 4 * most * most * vectors.shape[1] < MOST else out.astype(object)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up a little."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(x)) + 1 for x in squares], dtype=object)
    return np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1


class Slices:
    """The entries of one codebook by their sorted coordinates, with the masks of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.ordered = [entries[order[:, j], j] for j in range(d)]
        words = -(-k // 64)
        # prefix[j][w, i]: word w of the mask of the i entries of least coordinate j
        self.prefix = []
        for j in range(d):
            bits = np.zeros((words, k + 1), np.uint64)
            bits[order[:, j] // 64, np.arange(1, k + 1)] = np.uint64(1) << (order[:, j] % 64).astype(np.uint64)
            self.prefix.append(np.bitwise_or.accumulate(bits, axis=1))

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (words x parts) of the entries that differ by no more than radius in any coordinate."""
        n = len(parts)
        words = -(-len(self.entries) // 64)
        out = np.full((words, n), np.uint64(2**64 - 1))
        for ordered, prefix, x in zip(self.ordered, self.prefix, parts.T, strict=True):
            low, high = np.searchsorted(ordered, x - radius, "left"), np.searchsorted(ordered, x + radius, "right")
            out &= prefix[:, high] ^ prefix[:, low]
        return out

    def guess(self, parts: np.ndarray) -> np.ndarray:
        """An entry for each part whose coordinate is next to the part's in the dimension in which entries spread most."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64)
        j = int(np.argmax([float(o[-1]) - float(o[0]) for o in self.ordered]))
        order = np.argsort(self.entries[:, j], kind="stable")
        return order[np.minimum(np.searchsorted(self.ordered[j], parts[:, j]), len(order) - 1)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the first of several, and the squared distance."""
        away = lambda x, e: ((x - e) ** 2).sum(axis=1)
        best = self.guess(parts)
        least = away(parts, self.entries[best])
        left = self.within(parts, roots(least))
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(left[e // 64] >> np.uint64(e % 64) & np.uint64(1))
            if len(rows):
                d = away(parts[rows], entry)
                better = (d < least[rows]) | ((d == least[rows]) & (e < best[rows]))
                best[rows[better]], least[rows[better]] = e, d[better]
        return best, least


@dataclass(frozen=True)
class Codebooks:
    """entries[p][e]: the whole numbers of entry e at part position p; bounds: where parts begin and end in a vector."""

    entries: list[list[list[int]]]
    bounds: list[int]

    @staticmethod
    def first(vectors: list[list[int]], parts: int) -> Codebooks:
        """Parts of equal size (the first ones one longer, if the length is no multiple), the vectors' parts as entries."""
        sizes = [len(x) for x in np.array_split(np.arange(len(vectors[0])), parts)]
        bounds = [0, *np.cumsum(sizes).tolist()]
        return Codebooks([[v[a:b] for v in vectors] for a, b in zip(bounds, bounds[1:], strict=False)], bounds)

    def slices(self) -> list[Slices]:
        out = []
        for entries, a, b in zip(self.entries, self.bounds, self.bounds[1:], strict=False):
            table = np.array(entries, dtype=object).reshape(len(entries), b - a)
            most = max((abs(int(x)) for x in table.ravel()), default=0)
            out.append(Slices(table if 4 * most * most * self.bounds[-1] >= MOST else table.astype(np.int64)))
        return out

    def averaged(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """The codebooks with each component as the floor of its average; sums: (part, entry, place): (count, sum). What
        has no sum stays."""
        place = lambda p, e, i, old: old if (p, e, i) not in sums else sums[p, e, i][1] // sums[p, e, i][0]
        return Codebooks([[[place(p, e, i, old) for i, old in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(self.entries)], self.bounds)

    def sha256(self) -> str:
        """Of the decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vec")
    return whole_numbers(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1))


def _assigned(vectors: np.ndarray, books: list[Slices], bounds: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, entries, squared distances) for each part position."""
    for book, a, b in zip(books, bounds, bounds[1:], strict=False):
        parts = vectors[:, a:b]
        parts = parts.astype(object) if book.entries.dtype == object else parts
        yield parts, *book.nearest(parts)


def _summed(batches: Iterator[pa.RecordBatch], codebooks: Codebooks) -> Iterator[pa.RecordBatch]:
    """Counts and sums of one task's vectors for each component of each entry."""
    books, bounds = codebooks.slices(), codebooks.bounds
    k = len(codebooks.entries[0])
    counts = np.zeros((len(books), k), np.int64)
    sums = [np.zeros((k, b - a), dtype=object) for a, b in zip(bounds, bounds[1:], strict=False)]
    for batch in slices(batches, 4096):
        for p, (parts, best, _) in enumerate(_assigned(_matrix(batch), books, bounds)):
            counts[p] += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            used, begin = np.unique(best[order], return_index=True)
            if parts.shape[1]:
                wide = parts if parts.dtype == object or len(parts) * float(np.abs(parts).max()) >= MOST else parts.astype(np.int64)
                sums[p][used] += np.add.reduceat(wide[order], begin, axis=0).astype(object)
    rows = [(p, e, i, int(counts[p, e]), Decimal(int(sums[p][e, i]))) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for i in range(sums[p].shape[1])]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "n", "total"])


def _coded(batches: Iterator[pa.RecordBatch], codebooks: Codebooks) -> Iterator[pa.RecordBatch]:
    books = codebooks.slices()
    for batch in slices(batches, 4096):
        codes, error = [], np.zeros(batch.num_rows, np.int64)
        for _, best, away in _assigned(_matrix(batch), books, codebooks.bounds):
            codes.append(best)
            error = error + away
        if error.dtype == object and max(error.tolist(), default=0) >= 1 << 63:
            raise ValueError("an error does not fit 64 bits")
        rest = batch.drop_columns(["vec"])
        text = [("%02x" * len(row)) % tuple(row) for row in np.stack(codes, axis=1).tolist()]
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64())], names=[*rest.schema.names, "code", "error"])


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """vec_id, label, vec (floor(scale * x), as doubles without fraction) of the usable rows: the vector neither null nor empty
    and all its components finite. Null ids are kept."""
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    fits = lambda x: F.when(F.abs(x) < WIDEST, F.floor(x).cast("double")).otherwise(x)
    return rows.withColumn("vec", F.transform("vec", lambda x: fits(x * F.lit(float(scale)))))


def fit(rows: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of the rows (vec_id, vec; staged, all of one length), None of no rows. They begin as the parts of the rows of
    smallest vec_id (null last, ties by the vector)."""
    first = rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
    if not first:
        return None
    books = Codebooks.first([[int(x) for x in r["vec"]] for r in first], parts)
    for _ in range(rounds):
        sums = rows.select("vec").mapInArrow(partial(_summed, codebooks=books), "part int, entry int, place int, n long, total decimal(38,0)")
        table = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("string").alias("total")).collect()
        books = books.averaged({(r["part"], r["entry"], r["place"]): (r["n"], int(r["total"])) for r in table})
    return books


def encode(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable row.

    A component x counts as floor(scale * x). code: two hexadecimal digits for the nearest entry of each part (ties to the
    lower), error: the squared distances summed over parts, label_error: errors summed over the rows of equal label (nulls
    together, and without label_col all). entries: 256 at most; with fewer rows the codebooks have as many entries.

    Left out: vectors that are null, empty, of another length than most, or hold null or non-finite components. Rows of null
    or repeated ids are rows like others. If the length is no multiple of parts, the first parts are one longer. An empty
    table gives no rows. Other columns are ignored. Scaled components of 2**62 and beyond, and errors that don't fit 64
    bits, are an error.

    The vectors are staged once and read once for each round; no vector is shuffled.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two digits: entries is from 1 to 256")
    rows = integer_vectors(df, id_col, vector_col, label_col, scale)
    d, n = usual_dimension(rows)
    spark, kind = df.sparkSession, rows.schema["label"].dataType
    schema = S.StructType([S.StructField("vec_id", S.LongType()), S.StructField("label", kind), S.StructField("code", S.StringType()), S.StructField("error", S.LongType())])
    if not n:
        both = S.StructType([*schema.fields, S.StructField("label_error", S.LongType()), S.StructField("codebooks_sha256", S.StringType())])
        return spark.createDataFrame([], both)
    rows = staged(rows.filter(F.size("vec") == d), "vectors")
    books = fit(rows, parts=parts, entries=entries, rounds=rounds)
    coded = staged(rows.mapInArrow(partial(_coded, codebooks=books), schema), "codes")
    # labels as structs: those that are null are equal too
    (key,) = fresh(coded, "key")
    keyed = coded.withColumn(key, F.struct("label"))
    totals = keyed.groupBy(key).agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows"))
    total = join_spread(keyed, totals, [key], "n_rows", n)
    return total.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
