"""Completions that are asked for once: a log of answers by prompt, filled in rounds.

Each distinct prompt is asked for once, however many rows have it. A round is one job over a bounded number of prompts that
the log doesn't have; its answers are in the log once the job has ended, so a job that fails, or an executor that is lost,
costs the answers of one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.prompts import completed
from matchloom.storage import staged

LOG = "key string, completion string"


class CompletionLog:
    """The answers in the folder path. round_prompts: about how many prompts a round asks for; partitions: how many tasks ask
    at a time."""

    def __init__(self, spark: SparkSession, path: str, *, round_prompts: int = 10_000, partitions: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.round_prompts, self.partitions = round_prompts, partitions

    def answers(self) -> DataFrame:
        """key (SHA-256 of a prompt) and completion of all that was answered."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path).dropDuplicates(["key"])

    def missing(self, rows: DataFrame) -> DataFrame:
        """key, prompt of the distinct prompts of rows that have no answer; null prompts ask nothing."""
        distinct = rows.filter("prompt IS NOT NULL").select(F.sha2("prompt", 256).alias("key"), "prompt").dropDuplicates(["key"])
        return distinct.join(self.answers().select("key"), "key", "left_anti")

    def ask(self, rows: DataFrame, complete: Callable[[str], str], *, attempts: int = 2) -> DataFrame:
        """rows (with prompt) with completion: the answer of `complete` to each prompt, null where it failed `attempts` times.

        Prompts that the log has are not asked again.
        """
        for _ in range(attempts):
            todo = staged(self.missing(rows), "prompts")
            n = todo.count()
            if not n:
                break
            rounds = -(-n // self.round_prompts)
            number = F.pmod(F.xxhash64("key"), F.lit(rounds))
            for i in range(rounds):
                some = todo.filter(number == i).repartition(self.partitions, "key")
                completed(some, complete).filter("completion IS NOT NULL").select("key", "completion").write.mode("append").parquet(self.path)
        keyed = rows.drop("completion").withColumn("__key", F.sha2("prompt", 256))
        return keyed.join(self.answers().withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
