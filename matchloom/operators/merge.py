"""Merging of candidate passes, de-duplication, and re-sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from matchloom.operators.match import top_k


def bag(*passes: DataFrame) -> DataFrame:
    """All rows of the passes, with pass_no (from 0)."""
    numbered = [p.select("query_id", "entity_id", "label", "name_sim", F.lit(i).alias("pass_no")) for i, p in enumerate(passes)]
    return reduce(DataFrame.unionByName, numbered)


def merge_max(candidates: DataFrame) -> DataFrame:
    """The best row of each query and entity; at equal scores the earlier pass, then the label."""
    order = [F.desc("name_sim"), F.col("pass_no"), F.col("label")]
    return top_k(candidates, 1, ["query_id", "entity_id"], order)


def resorted(candidates: DataFrame, limit: int, *, previous: str = "rank") -> DataFrame:
    """Sorted anew by score within each query, equal scores by the previous rank, cut to limit; rank is set anew."""
    order = [F.desc("name_sim"), F.col(previous), F.col("label"), F.col("entity_id")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return candidates.withColumn("__place", place).filter(F.col("__place") <= limit).drop("rank").withColumnRenamed("__place", "rank")


def own_limits(candidates: DataFrame, queries: DataFrame, *, default: int) -> DataFrame:
    """The first candidates of each query by rank, as many as its own limit says (column limit of queries; null: default).

    candidates have to go as far as the largest limit. A query_id is asked once.
    """
    asked = queries.select("query_id", F.coalesce(F.col("limit"), F.lit(default)).alias("__limit"))
    return candidates.join(asked, "query_id").filter(F.col("rank") <= F.col("__limit")).drop("__limit")


def dedupe(rows: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row for each key: the first or the last by order."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    numbered = rows.withColumn("__order", F.struct(*order))
    place = F.asc("__order") if keep == "first" else F.desc("__order")
    return top_k(numbered, 1, keys, [place]).drop("__order")


def union_distinct(*projections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, projections).distinct()


def usable_prefixes(prefixes: DataFrame, column: str = "query") -> DataFrame:
    """Prefixes of two characters at least; shorter and null ones suggest nothing."""
    return prefixes.filter(F.length(column) >= 2)


def types_by_name(types: DataFrame) -> DataFrame:
    """types (id, name: entity types, a few rows) with place: from 1 by name, then id."""
    return types.withColumn("place", F.row_number().over(Window.orderBy("name", "id")))


def suggested(rows: DataFrame, limit: int, *, type_order: list[str], early_stop: bool = False) -> DataFrame:
    """Best rows over all entity types of each prefix, with rank.

    rows: prefix_id, entity_type, entity_id, label, name_sim; those whose entity_id is null, 0 or empty, or whose label is
    null or empty, are left out. early_stop: types count in the given order, and those
    after the one that fills the limit are left out, as a search that goes from type to type would.
    """
    text = isinstance(rows.schema["entity_id"].dataType, S.StringType)
    rows = rows.filter((F.col("entity_id") != F.lit("" if text else 0)) & (F.col("label") != ""))
    if early_stop:
        per_type = rows.groupBy("prefix_id", "entity_type").agg(F.count("*").alias("n"))
        place = F.array_position(F.lit(type_order), F.col("entity_type"))
        before = F.sum("n").over(Window.partitionBy("prefix_id").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
        used = per_type.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit)
        rows = rows.join(used.select("prefix_id", "entity_type"), ["prefix_id", "entity_type"], "left_semi")
    order = [F.desc("name_sim"), F.array_position(F.lit(type_order), F.col("entity_type")), F.col("label"), F.col("entity_id")]
    return top_k(rows, limit, ["prefix_id"], order, rank="rank")


def folded_properties(rows: DataFrame) -> DataFrame:
    """One row for each property id: the sorted entity types that have it, and the settings of the last by ord."""
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("entity_type")).alias("entity_types"), F.max_by("settings", "ord").alias("settings"))
