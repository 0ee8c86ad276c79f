"""A stored cache of translations: buckets of keys, each upsert writing the buckets that it touches anew.

Under the store's folder, data/bucket=<b>/upsert=<n> holds all entries of bucket b as upsert n left them, and commits says which
upserts count for which buckets. A reader takes, for each bucket, the files of its last committed upsert, so it sees an
upsert as a whole or not at all, and the files of other buckets are never rewritten. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators.prompts import to_translate, translated, upserted

ENTRY = "key string, text string, lang string, translation string, ts long"
COMMITS = "bucket int, upsert int"


class TranslationStore:
    """The store in the folder path, of a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def snapshot(self) -> dict[int, int]:
        """The last committed upsert of each bucket that has any."""
        if not self._exists(f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").groupBy("bucket").agg(F.max("upsert").alias("upsert")).collect()
        return {r["bucket"]: r["upsert"] for r in rows}

    def files(self, snapshot: dict[int, int], buckets: list[int] | None = None) -> list[str]:
        """The folders that a snapshot's entries are in."""
        return [f"{self.path}/data/bucket={b}/upsert={n}" for b, n in sorted(snapshot.items()) if buckets is None or b in buckets]

    def table(self, snapshot: dict[int, int] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """key, text, lang, translation, ts of all entries, or of those of some buckets."""
        paths = self.files(self.snapshot() if snapshot is None else snapshot, buckets)
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def upsert(self, fresh: DataFrame) -> int:
        """Puts translations in; of one text and language the latest stays, at equal times the greater; the number of the upsert.

        fresh: text, lang, translation, ts. Rows with a null text, language or translation are left out. Only buckets that
        have a fresh key are read and written. What a failed upsert wrote is in no commit and seen by nobody.
        """
        rows = fresh.filter("text IS NOT NULL AND lang IS NOT NULL AND translation IS NOT NULL")
        rows = rows.select(T.cache_key(F.col("text"), F.col("lang")).alias("key"), "text", "lang", "translation", F.col("ts").cast("long").alias("ts"))
        snapshot = self.snapshot()
        touched = [r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()]
        number = max(snapshot.values(), default=-1) + 1
        while any(self._exists(f"{self.path}/data/bucket={b}/upsert={number}") for b in touched):
            number += 1  # left by an upsert that failed
        if touched:
            merged = upserted(self.table(snapshot, touched), rows).withColumn("bucket", self._bucket()).withColumn("upsert", F.lit(number))
            merged.repartition(len(touched), "bucket").write.mode("append").partitionBy("bucket", "upsert").parquet(f"{self.path}/data")
            self._commit(touched, number)
        return number

    def _commit(self, buckets: list[int], number: int) -> None:
        self.spark.createDataFrame([(b, number) for b in buckets], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def translate(self, requests: DataFrame) -> DataFrame:
        """requests (text, source_lang, lang) with translation and hit; see prompts.translated."""
        return translated(requests, self.table())

    def missing(self, requests: DataFrame) -> DataFrame:
        """Distinct (key, text, lang) that no entry translates; see prompts.to_translate."""
        return to_translate(requests, self.table())
