"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.storage import shared_dir, staged

__all__ = ["fresh", "join_spread", "least_by_hash", "matrix", "one_per_id", "query_blocks", "read", "shared_dir", "slices", "small_batches", "staged", "usual_dimension", "vectors"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; the path may be of any store that Spark's readers know."""
    if table == "documents":
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in the Arrow batches of this session than Spark's default of 10,000: a setting of the caller's session,
    which stays changed.

    A row here holds a whole text of thousands of characters; small batches bound what an executor and its Python
    workers hold at a time, at no cost in speed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def vectors(df: DataFrame, id_col: str, vector_col: str, *, allow_zero: bool) -> DataFrame:
    """(vec_id, vec) of the rows whose vector is usable: neither null nor empty, all components finite, id not null.

    With allow_zero=False vectors of norm zero are left out too. All other columns are dropped here, so extra columns
    and clashing names do no harm.
    """
    vec = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    return rows if allow_zero else rows.filter(F.exists("vec", lambda x: x != 0))


def usual_dimension(rows: DataFrame) -> tuple[int, int]:
    """(length, rows) of the vectors of the most frequent length, the smaller length at a tie; (0, 0) of no rows."""
    best = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return (best[0]["d"], best[0]["count"]) if best else (0, 0)


#: Most bytes of the query vectors that a block broadcasts.
BLOCK_BYTES = 1 << 25


def query_blocks(queries: DataFrame, d: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries (vec_id, vec of length d), in blocks of about `most`, fewer if they are wide.

    A block goes through the driver into every task, so its size is bounded, whatever the number of queries; the rows
    are read once for each block and never shuffled.
    """
    most = max(1, min(most, BLOCK_BYTES // (8 * d)))
    blocks = max(1, -(-queries.count() // most))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    for b in range(blocks):
        table = numbered.filter(F.col("block") == b).select("vec_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("vec_id").toArrow()
        if table.num_rows:
            yield table.column("vec_id").to_numpy(), matrix(table)


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row for each vec_id, the least vector of repeated ids."""
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vec column of an Arrow table as a matrix of doubles."""
    column = table.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def least_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash of key (all, if fewer): a sample that is the same each time.

    Only about 2 n rows pass the filter on the hash, however large df is, so tasks send few rows to the driver.
    """
    share = min(1.0, 2 * n / max(1, df.count()) + 1e-9)
    bound = int((1 << 62) * share)
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(5)), 2)
    return df.filter(hashed <= bound).orderBy(hashed, key).limit(n)


#: A key that holds more than one in so many rows is hot.
HOT = 1000


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], n_col: str, total: int) -> DataFrame:
    """rows joined to table, which has each key once, with how many of the `total` rows hold it in n_col.

    Keys that more than one in HOT rows hold are fewer than HOT, so their part of table is broadcast, and no task gets
    all rows of such a key; the other keys meet by a shuffle. Keys are not null.
    """
    bound = max(1, total // HOT)
    hot = F.broadcast(table.filter(F.col(n_col) > bound))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col(n_col) <= bound), on)
    return rows.join(hot, on).unionByName(rest)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches, rows: int = 1000):
    """Arrow batches cut into parts of some rows, so that few Python objects exist at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
