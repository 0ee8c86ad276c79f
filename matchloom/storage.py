"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session with a local master gets a temporary folder;
    a cluster has none that its executors share, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unsent(df: DataFrame) -> DataFrame:
    """df as the side of a join that is sorted and never broadcast: rows of repeated values take a few bytes in a file and in a
    shuffle, by which Spark judges, and a hundred times as many in the memory of the driver."""
    return df.hint("merge")


#: Rows that a table may have at most to be sent to all tasks of a join.
SENT_ROWS = 100_000


def looked_up(df: DataFrame) -> DataFrame:
    """df, staged before, as the side of a join in which every row meets few of its rows: broadcast if it has few rows, else sorted.
    It is counted, as the other side may look small as a file and be exploded to many rows before the join."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else unsent(df)


#: Rows that one task of a dealt table gets, about.
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Into how many tasks so many rows are dealt. Left alone, Spark makes tasks of so many bytes of compressed shuffle files, in
    which rows of numbers and repeated values take a few bytes and in the memory of a task that sorts them a hundred."""
    return max(1, -(-rows // TASK_ROWS))


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again.

    It cuts lineage: a lost executor costs a reread, not a recomputation, and what several later steps use is
    computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
