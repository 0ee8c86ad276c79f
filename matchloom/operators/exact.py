"""Exact-key passes: score 1.0 for rows whose key equals the query's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators.match import top_k
from matchloom.storage import unsent


#: The order in which candidates of one score and pass are taken.
BY_LABEL = ("label", "entity_id")


def by_key(queries: DataFrame, authority: DataFrame, query_key: Column, row_key: Column, *, label: str = "label", limit: int | None = None, first: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """query_id, entity_id, label, name_sim = 1.0 of the rows with the query's key; null keys match nothing.

    With limit, only so many rows of a key, by `first`: those of smallest entity_id, or label and entity_id. They are cut before
    the join, so a key that very many rows share costs no more than another.
    """
    rows = authority.select("entity_id", F.col(label).alias("label"), row_key.alias("key")).filter("key IS NOT NULL")
    if limit is not None:
        rows = top_k(rows, limit, ["key"], [F.col(c) for c in first])
    found = queries.select("query_id", query_key.alias("key")).join(unsent(rows), "key")
    return found.select("query_id", "entity_id", "label", F.lit(1.0).alias("name_sim"))


def national_id(queries: DataFrame, sites: DataFrame) -> DataFrame:
    return by_key(queries, sites, F.col("national_id"), F.col("national_id"), limit=1)


def alternate_identity(queries: DataFrame, authority: DataFrame, column: str) -> DataFrame:
    return by_key(queries, authority, F.col("query"), F.col(column), limit=1)


def same_isbn(queries: DataFrame, biblio: DataFrame, limit: int | None = None) -> DataFrame:
    return by_key(queries, biblio, T.isbn(F.col("isbn")), T.isbn(F.col("isbn")), label="full_reference", limit=limit, first=BY_LABEL)


def same_doi(queries: DataFrame, biblio: DataFrame, limit: int | None = None) -> DataFrame:
    """Equal normalised or equal lower-case values: two equi-joins, as a join on either would compare all rows."""
    shaped = by_key(queries, biblio, T.doi(F.col("doi")), T.doi(F.col("doi")), label="full_reference", limit=limit, first=BY_LABEL)
    plain = by_key(queries, biblio, F.lower("doi"), F.lower("doi"), label="full_reference", limit=limit, first=BY_LABEL)
    return shaped.unionByName(plain).dropDuplicates(["query_id", "entity_id"])


def same_reference(queries: DataFrame, biblio: DataFrame, limit: int | None = None) -> DataFrame:
    return by_key(queries, biblio, F.col("full_reference"), F.col("full_reference"), label="full_reference", limit=limit, first=BY_LABEL)


def same_title_and_year(queries: DataFrame, biblio: DataFrame, limit: int | None = None) -> DataFrame:
    key = F.when(F.col("title").isNotNull() & F.col("year").isNotNull(), F.struct("title", F.col("year").cast("string").alias("year")))
    return by_key(queries, biblio, key, key, label="full_reference", limit=limit, first=BY_LABEL)


def same_bugs_reference(queries: DataFrame, biblio: DataFrame, limit: int | None = None) -> DataFrame:
    return by_key(queries, biblio, F.col("bugs_reference"), F.col("bugs_reference"), label="full_reference", limit=limit, first=BY_LABEL)
