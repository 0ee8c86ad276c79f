"""Scores, labels, types and descriptions of gazetteer records, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.policy import POLICY

URI = "https://www.geonames.org/"


def relevance(score: Column, population: Column) -> Column:
    """60 to 100: the record's own score and its population; a missing or unpopulated place gets nothing for that."""
    people = F.when(population > 0, F.log10(population.cast("double")) / 7).otherwise(0.0)
    return F.round(60 + 40 * F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) / 100 + people), 2)


def label(name: Column, region: Column, country: Column) -> Column:
    """name, region, country, without what is empty."""
    return F.concat_ws(", ", name, F.nullif(region, F.lit("")), F.nullif(country, F.lit("")))


def kind(fcl: Column, fcode: Column) -> Column:
    return F.when(fcl == "P", "citytown").when((fcl == "A") & fcode.startswith("ADM"), "administrative_area").otherwise("place")


KINDS = {"citytown": "City/Town", "administrative_area": "Administrative Area", "place": "Place"}


def description(fcode_name: Column, fcode: Column, population: Column) -> Column:
    """What the place is, and its population if that is not zero."""
    people = F.when(population != 0, F.concat(F.lit(" · pop "), F.format_number(population, 0))).otherwise("")
    return F.concat(F.coalesce(F.nullif(fcode_name, F.lit("")), fcode, F.lit("")), F.coalesce(people, F.lit("")))


def described(records: DataFrame) -> DataFrame:
    """geonameId, label, kind, kind_name, description, score of gazetteer records."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    which = kind(F.col("fcl"), F.coalesce("fcode", F.lit("")))
    return records.select(
        "geonameId",
        label(F.col("name"), F.col("adminName1"), F.col("countryName")).alias("label"),
        which.alias("kind"),
        F.element_at(names, which).alias("kind_name"),
        description(F.col("fcodeName"), F.col("fcode"), F.col("population")).alias("description"),
        relevance(F.col("score"), F.col("population")).alias("score"),
    )


def as_candidates(records: DataFrame, query: str = "query") -> DataFrame:
    """The outward form of gazetteer records found for queries; a match only if the whole label is the query."""
    named = records.join(described(records.select("geonameId", "name", "adminName1", "countryName", "fcl", "fcode", "fcodeName", "population", "score").distinct()).drop("score").withColumnRenamed("label", "full_label"), "geonameId")
    value = relevance(F.col("score"), F.col("population"))
    return named.select(
        "query_id", F.col("geonameId").cast("string").alias("id"), F.col("full_label").alias("name"), value.alias("score"), (value / 100).alias("name_sim"),
        (F.lower("full_label") == F.lower(query)).alias("match"), F.array(F.struct(F.col("kind").alias("id"), F.col("kind_name").alias("name"))).alias("type"),
        "description", F.concat(F.lit(URI), F.col("geonameId").cast("string")).alias("uri"),
    )


def ranked(records: DataFrame, limit: int = POLICY.limit) -> DataFrame:
    """The records of each query by relevance, then population, then id."""
    from matchloom.operators.match import top_k

    rows = records.withColumn("relevance", relevance(F.col("score"), F.col("population")))
    return top_k(rows, limit, ["query_id"], [F.desc("relevance"), F.desc_nulls_last("population"), F.col("geonameId")], rank="rank")
