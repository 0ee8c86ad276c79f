"""Per-entity strategies: which passes run for which queries, and how their candidates are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import exact, merge, score
from matchloom.operators.match import fuzzy, fuzzy_bibliography, top_k
from matchloom.policy import POLICY
from matchloom.storage import staged, unsent


def generic(queries: DataFrame, authority: DataFrame, *, alternate: str | None = None, limit: int = POLICY.limit, distinct: bool = True) -> DataFrame:
    """Exact alternate identity (score 1) and fuzzy candidates, best first. distinct: an entity counts once."""
    found = fuzzy(queries, authority, limit=limit)
    passes = [found] if alternate is None else [exact.alternate_identity(queries, authority, alternate), found]
    rows = merge.bag(*passes)
    rows = merge.merge_max(rows) if distinct else rows
    order = [F.desc("name_sim"), F.col("pass_no"), F.col("label"), F.col("entity_id")]
    return top_k(rows, limit, ["query_id"], order, rank="rank").drop("pass_no")


def exact_then_fuzzy(queries: DataFrame, sites: DataFrame, *, limit: int = POLICY.limit) -> DataFrame:
    """National ids first; only queries that they do not answer are searched by name."""
    sure = exact.national_id(queries, sites).withColumn("rank", F.lit(1))
    rest = queries.join(sure.select("query_id"), "query_id", "left_anti")
    return sure.unionByName(fuzzy(rest, sites, limit=limit))


def site(queries: DataFrame, sites: DataFrame, bridge: DataFrame, *, limit: int = POLICY.limit) -> DataFrame:
    """The cascade of exact_then_fuzzy, raised for near sites and for sites in the place asked for, and sorted anew."""
    # used for distances, for places and for what both are added to
    rows = staged(exact_then_fuzzy(queries, sites, limit=limit), "sites")
    rows = score.with_distances(rows, queries, sites).withColumn("name_sim", score.proximity(F.col("name_sim"), F.col("distance_km")))
    rows = score.best_place(rows, queries, bridge, T.similarity).withColumn("name_sim", score.place_boost(F.col("name_sim"), F.col("place_sim")))
    return merge.resorted(rows, limit)


def authors_and_year(queries: DataFrame, biblio: DataFrame, *, limit: int = POLICY.limit, threshold: float = POLICY.reference_threshold) -> DataFrame:
    """Authors in word mode, of those the rows of the query's year."""
    asked = queries.filter("authors IS NOT NULL AND year IS NOT NULL")
    found = fuzzy_bibliography(asked.select("query_id", F.col("authors").alias("query")), biblio, field="authors", mode="word", threshold=threshold, limit=limit)
    years = biblio.select("entity_id", F.col("year").cast("string").alias("year"), "full_reference")
    same = found.join(unsent(years), "entity_id").join(asked.select("query_id", F.col("year").cast("string").alias("asked")), "query_id")
    return same.filter("year = asked").select("query_id", "entity_id", F.col("full_reference").alias("label"), "name_sim", "rank")


def bibliographic_passes(queries: DataFrame, biblio: DataFrame, *, limit: int = POLICY.limit) -> DataFrame:
    """All passes as one bag: exact identifiers, strong partial matches, and the fallback where these give too few.

    queries: query_id, query, isbn, doi, full_reference, title, year, authors, bugs_reference, null where not given. Of the rows
    that share an identifier each exact pass brings the first `limit` by label and entity_id: the others come behind these in any
    list of so many, and whether there are enough rows without the fallback is decided by these too.
    """
    words = lambda q: score.floored(fuzzy_bibliography(q, biblio, mode="word", threshold=POLICY.reference_threshold, limit=limit))
    given = queries.filter("full_reference IS NOT NULL").select("query_id", F.col("full_reference").alias("query"))
    free = queries.filter("full_reference IS NULL AND trim(query) <> ''").select("query_id", "query")
    strong = merge.bag(
        *(one(queries, biblio, limit) for one in (exact.same_isbn, exact.same_doi, exact.same_reference, exact.same_title_and_year, exact.same_bugs_reference)),
        words(given), score.floored(authors_and_year(queries, biblio, limit=limit)), words(free),
    )
    # used twice: how many rows came so far, repeats included, decides on the fallback
    strong = staged(strong, "strong")
    many = strong.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select("query_id")
    thin = free.join(many, "query_id", "left_anti")
    fallback = score.capped(fuzzy_bibliography(thin, biblio, threshold=POLICY.fallback_threshold, limit=limit))
    return strong.unionByName(fallback.select("query_id", "entity_id", "label", "name_sim", F.lit(8).alias("pass_no")))


def bibliographic(queries: DataFrame, biblio: DataFrame, *, limit: int = POLICY.limit) -> DataFrame:
    """The best row of each reference over all passes, best first."""
    merged = merge.merge_max(bibliographic_passes(queries, biblio, limit=limit))
    order = [F.desc("name_sim"), F.col("pass_no"), F.col("label"), F.col("entity_id")]
    return top_k(merged, limit, ["query_id"], order, rank="rank")


def gazetteer_search(queries: DataFrame, places: DataFrame, *, classes: tuple[str, ...] = ("P", "A"), country: str | None = None, fuzziness: float = 0.8, limit: int = POLICY.limit) -> DataFrame:
    """Places of the given classes by name; fuzziness 1 asks for equal names. Of a country, its places come first."""
    chosen = places.filter(F.col("fcl").isin(*classes)).withColumn("entity_id", F.col("geonameId"))
    found = fuzzy(queries, chosen, threshold=max(0.01, fuzziness), field="name", limit=limit)
    rows = found.join(unsent(chosen.select("entity_id", "countryName", "population")), "entity_id")
    first = F.when(F.col("countryName") == F.lit(country), 0).otherwise(1) if country else F.lit(0)
    order = [first, F.desc("name_sim"), F.desc_nulls_last("population"), F.col("entity_id")]
    return top_k(rows.drop("rank"), limit, ["query_id"], order, rank="rank")
