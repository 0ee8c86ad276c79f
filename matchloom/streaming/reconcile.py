"""Continuous reconciliation: streams of queries against fixed authority tables, or against a stored index that changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.index import TrigramIndex

PINNED = "batch long, generation int, segment int"


def asked_once(queries: DataFrame, *, id_col: str = "query_id", time_col: str = "asked_at", lateness: str = "1 hour") -> DataFrame:
    """A stream in which each query comes once: repeats that come within lateness of each other are dropped, by state that
    outlives restarts, and so are queries that come later than that behind the latest."""
    return queries.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def reconcile_stream(queries: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that matches every micro-batch and writes it under out/batch=<id>.

    Ranking happens within a batch; a batch that runs again replaces its own files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pinned(index: TrigramIndex, path: str, batch_id: int) -> tuple[int, list[int]]:
    """The snapshot of the index that a batch sees: the current one when the batch first runs, the same when it runs again."""
    spark, file = index.spark, f"{path}/batch={batch_id}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{file}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        generation, segments = index.snapshot()
        spark.createDataFrame([(generation, s) for s in segments], "generation int, segment int").coalesce(1).write.mode("overwrite").parquet(file)
    rows = spark.read.schema("generation int, segment int").parquet(file).collect()
    return rows[0]["generation"], sorted(r["segment"] for r in rows)


def reconcile_with_index(queries: DataFrame, index: TrigramIndex, out: str, checkpoint: str, *, options: dict | None = None, **trigger) -> StreamingQuery:
    """Starts a query that searches every micro-batch in the index and writes under out/results/batch=<id>.

    Which snapshot of the index a batch sees is written down first (out/snapshots), so a batch that runs again after a
    restart gives the same rows, though the index has changed; generations that a batch may still need must not be
    vacuumed. options: of TrigramIndex.search.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshot = pinned(index, f"{out}/snapshots", batch_id)
        found = index.search(batch, snapshot=snapshot, **(options or {}))
        found.withColumn("generation", F.lit(snapshot[0])).withColumn("segment", F.lit(max(snapshot[1]))).write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
