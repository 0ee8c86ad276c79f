"""A stored search corpus that is kept up with its tables: only values that are new are normalised and cut into words.

Under the corpus' folder, rows and tokens hold segments, gone the keys that a segment took away, and commits the segments that
count. A refresh compares the keys of what the tables hold (column, id and a digest of the value) with those of the live rows:
what is new becomes a segment, what is no longer there goes to `gone`. A changed value is both. There is one writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.fulltext import KEY, best_keys, normalised, terms, tokens, values, with_digest, with_values
from matchloom.storage import looked_up, staged, unsent

COMMITS = "segment int"


class StoredCorpus:
    """The corpus in the folder path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted(r[0] for r in self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect())

    def _of(self, table: str, segments: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{table}/segment={s}" for s in segments])

    def _live(self, table: str, segments: list[int], only: DataFrame | None = None) -> DataFrame:
        """Rows of a table that no later segment took away: those whose key is in no later `gone`. only: values of some columns,
        staged; other rows are left out before their keys are compared, which sorts them."""
        rows = [self._of(table, [s]) for s in segments]
        # a digest made here goes through the join in the place of its text
        rows = [(with_digest(r) if table == "rows" else r).withColumn("segment", F.lit(s)) for r, s in zip(rows, segments, strict=True)]
        if only is not None:
            rows = [r.join(looked_up(only), only.columns, "left_semi") for r in rows]
        out, gone = rows[0], [self._of("gone", [s]).withColumn("since", F.lit(s)) for s in segments]
        taken = gone[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        for more in gone[1:]:
            taken = taken.unionByName(more)
        last = taken.groupBy(*KEY).agg(F.max("since").alias("since"))
        return out.join(unsent(last), KEY, "left").filter("since IS NULL OR segment >= since").drop("since", "segment")

    def rows(self) -> DataFrame:
        """The corpus as fulltext.corpus makes it of the tables at the last refresh."""
        return self._live("rows", self.segments()).drop("digest")

    def tokens(self) -> DataFrame:
        """The words of the corpus, as fulltext.tokens cuts them."""
        return self._live("tokens", self.segments())

    def refresh(self, parts: list[tuple[DataFrame, str, str, str, str]]) -> int | None:
        """Takes in the tables as they are; the number of the new segment, None if nothing has changed.

        parts: as of fulltext.corpus, the same tables and columns each time (their numbers go by their names).
        """
        segments = self.segments()
        now = reduce(DataFrame.unionByName, values(parts)).withColumn("value_id", F.xxhash64("value"))
        if segments:
            known = self._live("rows", segments).select(*KEY)
            # repeated values go after the join, where those of one key are together: values are shuffled once
            new = staged(now.join(unsent(known), KEY, "left_anti").distinct(), "new")
            gone = staged(known.join(unsent(now.select(*KEY)), KEY, "left_anti"), "gone")
            if new.isEmpty() and gone.isEmpty():
                return None
        else:
            new, gone = staged(now.distinct(), "new"), None
        segment = max(segments, default=-1) + 1
        while self._taken(segment):
            segment += 1  # left by a refresh that failed
        at = f"segment={segment}"
        normalised(new.drop("value_id")).write.parquet(f"{self.path}/rows/{at}")
        tokens(self._of("rows", [segment])).write.parquet(f"{self.path}/tokens/{at}")
        keys = new.select(*KEY).limit(0) if gone is None else gone
        keys.write.parquet(f"{self.path}/gone/{at}")
        self._commit(segment)
        return segment

    def _taken(self, segment: int) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/segment={segment}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _commit(self, segment: int) -> None:
        self.spark.createDataFrame([(segment,)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def search(self, queries: DataFrame, *, limit: int = 20) -> DataFrame:
        """fulltext.search over the stored rows and words."""
        segments = self.segments()
        words = staged(terms(queries).select("lexeme").distinct(), "words")
        found = staged(best_keys(queries, self._live("rows", segments), limit=limit, toks=self._live("tokens", segments, words)), "found")
        return with_values(found, self._live("rows", segments, staged(found.select(*KEY).distinct(), "keys")))
