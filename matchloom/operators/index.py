"""A stored trigram index: search without a look at the authority table, kept up with its changes by segments.

Tables under one folder, Parquet in buckets, so that neither side of the index is shuffled by a search:

postings  gram, text_id, n, k    one row for each trigram of each distinct text, in buckets of gram; n is the size of the
                                 text's set, k the place of the trigram among the text's, rarest first
texts     text_id, a, grams      normalised texts with their sets, in buckets of text_id
members   text_id, entity_id, label    the rows that have the text, in buckets of text_id
ranks     gram, frequency        of the texts that the generation began with: the one order of all its postings and searches
gone      entity_id              entities that a segment takes away or replaces
commits   generation, segment    what counts: rows of a segment that isn't there are not seen

A generation begins with all rows as segment 0. A change adds a segment: the ids that it touches go to `gone`, which hides
their rows of earlier segments, and new rows get postings in the generation's order (trigrams that it doesn't know are the
rarest). compact() writes the rows that are left as a new generation, which later searches see as a whole or not at all.
Changes are made by one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators.match import EPS, MANY_PAIRS, answers, by_steps, needed, numbered, similar_texts, top_k
from matchloom.policy import POLICY
from matchloom.storage import staged, unsent

#: The columns of each table without segment, and what its buckets are of.
TABLES = {
    "postings": ("gram string, text_id string, n int, k int", "gram"),
    "texts": ("text_id string, a string, grams array<string>", "text_id"),
    "members": ("text_id string, entity_id long, label string", "text_id"),
    "ranks": ("gram string, frequency long", None),
    "gone": ("entity_id long", None),
}
COMMITS = "generation int, segment int"


class TrigramIndex:
    """The index in the folder path; create() makes one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.names: dict[int, dict[str, str]] = {}  # of the tables of each generation in this session's catalogue

    @staticmethod
    def create(authority: DataFrame, path: str, *, field: str = "label", buckets: int = 64) -> TrigramIndex:
        """An index of authority's rows (entity_id, and field as the text searched). Rows with a null text, and those without
        letters and digits, match nothing and are not kept."""
        index = TrigramIndex(authority.sparkSession, path, buckets)
        index._begin(0, authority.select("entity_id", F.col(field).cast("string").alias("label")))
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, *, buckets: int = 64) -> TrigramIndex:
        """The index that was created in path with so many buckets, perhaps by another session."""
        return TrigramIndex(spark, path, buckets)

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")

    def snapshot(self) -> tuple[int, list[int]]:
        """The current generation and its segments: what a search reads, whatever is written meanwhile."""
        rows = self._commits().orderBy(F.desc("generation"), "segment").collect()
        generation = rows[0]["generation"]
        return generation, [r["segment"] for r in rows if r["generation"] == generation]

    def _commit(self, generation: int, segment: int) -> None:
        self.spark.createDataFrame([(generation, segment)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _table(self, generation: int, table: str) -> str:
        """The name of a table in the session's catalogue; it is entered there when it is first asked for."""
        names = self.names.setdefault(generation, {})
        if table not in names:
            names[table] = f"trigram_{table}_{uuid.uuid4().hex}"
            columns, by = TABLES[table]
            clustered = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS" if by else ""
            self.spark.sql(f"CREATE TABLE {names[table]} ({columns}, segment int) USING parquet {clustered} LOCATION '{self.path}/{generation}/{table}'")
        return names[table]

    def _add(self, generation: int, table: str, rows: DataFrame, segment: int) -> None:
        columns, by = TABLES[table]
        name = self._table(generation, table)
        rows = rows.select(*(c.split()[0] for c in columns.split(", ")), F.lit(segment).alias("segment"))
        if by:
            # one file for each bucket: rows are dealt as the buckets are
            rows.repartition(self.buckets, by).write.mode("append").bucketBy(self.buckets, by).sortBy(by).format("parquet").saveAsTable(name)
        else:
            rows.write.mode("append").format("parquet").saveAsTable(name)

    def table(self, table: str, snapshot: tuple[int, list[int]] | None = None) -> DataFrame:
        """Rows of a table that a snapshot sees."""
        generation, segments = snapshot or self.snapshot()
        return self.spark.table(self._table(generation, table)).filter(F.col("segment").isin(segments))

    def _write(self, generation: int, segment: int, rows: DataFrame, first: bool) -> None:
        """rows: entity_id, label. The tables of a segment; of the first one also the order of trigrams."""
        keyed = rows.filter("label IS NOT NULL").withColumn("a", T.normalise(F.col("label"))).withColumn("text_id", F.md5("a"))
        texts = keyed.select("text_id", "a").distinct().withColumn("grams", T.trigrams(F.col("a"))).filter(F.size("grams") > 0)
        self._add(generation, "texts", texts, segment)
        snapshot = generation, [segment]
        texts = self.table("texts", snapshot)
        if first:
            self._add(generation, "ranks", texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("frequency")), 0)
        each = texts.select("text_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        self._add(generation, "postings", self._ranked(each, "text_id", generation), segment)
        # texts without trigrams have no members either
        self._add(generation, "members", keyed.join(unsent(texts.select("text_id")), "text_id", "left_semi"), segment)

    def _ranked(self, each: DataFrame, by: str, generation: int) -> DataFrame:
        """each (by, n, gram) with k, the place of the trigram in the generation's order."""
        ranks = self.table("ranks", (generation, [0])).select("gram", "frequency")
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce("frequency", F.lit(0)), "gram"))
        return each.join(ranks, "gram", "left").withColumn("k", place).drop("frequency")

    def _begin(self, generation: int, rows: DataFrame) -> None:
        self._write(generation, 0, rows, first=True)
        self._add(generation, "gone", self.spark.createDataFrame([], TABLES["gone"][0]), 0)
        self._commit(generation, 0)

    def apply(self, changes: DataFrame) -> int:
        """A new segment of changed entities; its number. changes: entity_id, and label, null for an entity that goes.

        All former rows of an entity that occurs in changes go; its rows with a label are what it has from now on. Rows
        without id are ignored.
        """
        generation, segments = self.snapshot()
        segment = self._next(generation, segments)
        changes = changes.select("entity_id", F.col("label").cast("string").alias("label")).filter("entity_id IS NOT NULL")
        self._add(generation, "gone", changes.select("entity_id").distinct(), segment)
        self._write(generation, segment, changes, first=False)
        self._commit(generation, segment)
        return segment

    def _next(self, generation: int, segments: list[int]) -> int:
        """A number that no rows have yet: a change that failed may have left some that nobody sees."""
        used = [self.spark.table(self._table(generation, t)).agg(F.max("segment")).first()[0] for t in ("gone", "texts", "postings", "members")]
        return max(x for x in (*used, *segments) if x is not None) + 1

    def live(self, members: DataFrame, snapshot: tuple[int, list[int]]) -> DataFrame:
        """members without those that a later segment took away."""
        last = self.table("gone", snapshot).groupBy("entity_id").agg(F.max("segment").alias("since"))
        return members.join(unsent(last), "entity_id", "left").filter("since IS NULL OR segment >= since").select("text_id", "entity_id", "label")

    def compact(self) -> int:
        """Writes what is live as a new generation and makes it the current one; its number. Former ones stay for whom
        still reads them; see vacuum()."""
        generation, segments = snapshot = self.snapshot()
        rows = self.live(self.table("members", snapshot), snapshot)
        new = generation + 1
        while self._exists(f"{self.path}/{new}"):
            new += 1  # left by a compaction that failed
        self._begin(new, rows.select("entity_id", "label"))
        return new

    def _folder(self, path: str):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, system = self._folder(path)
        return system.exists(folder)

    def vacuum(self) -> list[int]:
        """Deletes the generations before the current one, which nobody may read any more; their numbers."""
        generation, _ = self.snapshot()
        old = [g for g in range(generation) if self._exists(f"{self.path}/{g}")]
        for g in old:
            for name in self.names.pop(g, {}).values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder, system = self._folder(f"{self.path}/{g}")
            system.delete(folder, True)
        return old

    def candidates(self, texts: DataFrame, threshold: float, snapshot: tuple[int, list[int]]) -> DataFrame:
        """(id, text_id) of texts (id, n, grams) and indexed texts that may have the threshold: those that share one of the
        n - ceil(t n) + 1 rarest trigrams of either, their sizes differing by the factor t at most."""
        keep = lambda n: n - needed(n, threshold) + 1
        each = texts.select("id", F.col("n").alias("na"), F.explode("grams").alias("gram"))
        asked = self._ranked(each, "id", snapshot[0]).filter(F.col("k") <= keep(F.col("na"))).select("gram", "id", "na")
        stored = self.table("postings", snapshot).filter(F.col("k") <= keep(F.col("n"))).select("gram", "text_id", "n")
        sized = (F.col("n") >= F.col("na") * threshold - EPS) & (F.col("na") >= F.col("n") * threshold - EPS)
        return asked.join(unsent(stored), "gram").filter(sized).select("id", "text_id").distinct()

    def _at(self, texts: DataFrame, threshold: float, snapshot: tuple[int, list[int]]) -> DataFrame:
        """(t, a, text_id, sim) of texts (id, t, n, grams) and indexed texts with the threshold or more, by the postings."""
        pairs = self.candidates(texts, threshold, snapshot).join(unsent(texts.select("id", "t", F.col("grams").alias("ga"))), "id")
        met = pairs.join(unsent(self.table("texts", snapshot).select("text_id", "a", F.col("grams").alias("gb"))), "text_id")
        met = met.withColumn("sim", T.jaccard(F.col("ga"), F.col("gb"))).filter(F.col("sim") >= threshold)
        # a text may be in several segments
        return met.select("t", "a", "text_id", "sim").dropDuplicates(["t", "text_id"])

    def _by_steps(self, texts: DataFrame, threshold: float, snapshot: tuple[int, list[int]], limit: int) -> DataFrame:
        """The same as far as the best `limit` rows of each text are concerned, by steps of similarity (match.by_steps), for
        which the indexed texts that have live rows are joined as a whole; what is left then goes by the postings."""
        held = self.live(self.table("members", snapshot), snapshot).groupBy("text_id").agg(F.least(F.count("*"), F.lit(limit)).alias("n"))
        stored = self.table("texts", snapshot).select("text_id", F.col("a").alias("t"), "grams").dropDuplicates(["text_id"])
        right = staged(unsent(stored).join(held, "text_id"), "stored")

        def found(left: DataFrame, step: float) -> DataFrame:
            if step > threshold:
                return similar_texts(left.select("t", "grams"), right.select("t", "grams"), step)
            return self._at(left, step, snapshot).select(F.col("t").alias("left_text"), F.col("a").alias("right_text"), "sim")

        pairs = by_steps(texts, threshold, found, right.select(F.col("t").alias("right_text"), "n"), limit)
        return pairs.select(F.col("left_text").alias("t"), F.col("right_text").alias("a"), F.md5("right_text").alias("text_id"), "sim")

    def search(self, queries: DataFrame, *, threshold: float = POLICY.similarity, limit: int = POLICY.limit, floor: bool = True, snapshot: tuple[int, list[int]] | None = None, many_pairs: int = MANY_PAIRS) -> DataFrame:
        """query_id, entity_id, label, name_sim, rank: what match.fuzzy gives for the table as it is after all changes, or as it
        was at a snapshot."""
        snapshot = snapshot or self.snapshot()
        q = queries.select("query_id", T.normalise(F.col("query")).alias("q"))
        texts = numbered(q.select(F.col("q").alias("t")).filter("t IS NOT NULL").distinct().withColumn("grams", T.trigrams(F.col("t"))).filter(F.size("grams") > 0), "asked")
        many = texts.count() * self.table("texts", snapshot).count() > many_pairs
        met = staged(self._by_steps(texts, threshold, snapshot, limit), "met") if many else self._at(texts, threshold, snapshot)
        found = self.live(self.table("members", snapshot).join(unsent(met.select("text_id").distinct()), "text_id", "left_semi"), snapshot)
        first = top_k(found, limit, ["text_id"], [F.col("label"), F.col("entity_id")])
        score = T.exact_or(F.col("t"), F.col("a"), F.col("sim")) if floor else F.col("sim")
        named = unsent(met).withColumn("name_sim", score).join(first, "text_id").select(F.col("t").alias("q"), "entity_id", "label", "name_sim")
        order: list[Column] = [F.desc("name_sim"), F.col("label"), F.col("entity_id")]
        return answers(q, top_k(named, limit, ["q"], order, rank="rank"), limit, order)
