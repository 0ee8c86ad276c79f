"""Detail rows by id, their cards, and data extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids(requests: DataFrame, column: str = "id") -> DataFrame:
    """Integer ids of request strings; those that are no integers give no row."""
    number = F.expr(f"try_cast(`{column}` AS BIGINT)")
    return requests.select(number.alias("entity_id")).filter("entity_id IS NOT NULL").distinct()


def by_ids(requests: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of table (keyed by entity_id) for the requested ids, columns renamed to display names."""
    rows = table.join(ids(requests), "entity_id", "left_semi")
    return rows.select(*(F.col(c).alias(name) for c, name in columns.items()))


def joined_names(bridge: DataFrame, key: str, name: str, out: str, sep: str = ", ") -> DataFrame:
    """One text of all names of each key, sorted, as the order would else be left to chance. The text holds them all, so a
    key has no more names than one row can hold."""
    listed = F.array_join(F.sort_array(F.collect_list(name)), sep)
    return bridge.groupBy(key).agg(listed.alias(out))


def site_details(requests: DataFrame, sites: DataFrame, bridge: DataFrame) -> DataFrame:
    """Sites with the names of their places, null without any. bridge: entity_id, location_name."""
    wanted = sites.join(ids(requests), "entity_id", "left_semi")
    names = joined_names(bridge.join(ids(requests), "entity_id", "left_semi"), "entity_id", "location_name", "place_names")
    return wanted.join(names, "entity_id", "left")


def with_group(requests: DataFrame, table: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Requested rows with a row of a table of groups (methods, data types) or units (dimensions)."""
    return table.join(ids(requests), "entity_id", "left_semi").join(groups, key, how)


def dimension_details(requests: DataFrame, dimensions: DataFrame, units: DataFrame, groups: DataFrame) -> DataFrame:
    """Dimensions with their unit, and their method group if they have one."""
    return with_group(requests, dimensions, units, "unit_id").join(groups, "method_group_id", "left")


def sampling_context_details(requests: DataFrame, contexts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Contexts with type_list (array of type_name, type_description) and type_names (the same as HTML list items).

    descriptions: entity_id, type_name, type_description.
    """
    wanted = descriptions.join(ids(requests), "entity_id", "left_semi")
    listed = F.sort_array(F.collect_list(F.struct("type_name", "type_description"))).alias("type_list")
    types = wanted.groupBy("entity_id").agg(listed)
    html = F.array_join(F.transform("type_list", lambda t: F.concat(F.lit("<li><strong>"), t.type_name, F.lit("</strong>: "), F.coalesce(t.type_description, F.lit("")), F.lit("</li>"))), "")
    return contexts.join(ids(requests), "entity_id", "left_semi").join(types.withColumn("type_names", html), "entity_id", "left")


def uri_parts(uri: Column, id_base: str) -> Column:
    """(path, id, error) of an entity URI: id_base and then exactly path/id."""
    rest = F.split(F.substring(uri, len(id_base) + 1, 1 << 20), "/")
    good = F.coalesce(uri.startswith(id_base) & (F.size(rest) == 2), F.lit(False))
    return F.struct(F.when(good, rest[0]).alias("path"), F.when(good, rest[1]).alias("id"), F.when(~good, F.lit("not an entity URI")).alias("error"))


def resolved(uris: DataFrame, details: DataFrame, id_base: str, column: str = "uri") -> DataFrame:
    """uris with the details of their entities. details: entity_type, entity_id and others."""
    parts = uris.withColumn("part", uri_parts(F.col(column), id_base))
    named = parts.select(*uris.columns, F.col("part.path").alias("entity_type"), F.expr("try_cast(part.id AS BIGINT)").alias("entity_id"), F.col("part.error").alias("error"))
    return named.join(details, ["entity_type", "entity_id"], "left")


def title(name: Column, label: Column, fields: Column) -> Column:
    """Name, else label, else the first value of the fields (array of key, value)."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(label, F.lit("")), F.get(fields, F.lit(0)).value)


def pairs(columns: list[str]) -> Column:
    """Array of (key, value) of columns as text, in their order."""
    return F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns))


def card_fields(columns: list[str], *, most: int | None = 5, longest: int | None = 60) -> Column:
    """Fields to show: without blank values and without name and label; the first few, long values shortened."""
    shown = F.filter(pairs(columns), lambda p: F.coalesce(F.trim(p.value) != "", F.lit(False)) & ~F.lower(p.key).isin("name", "label"))
    if most is not None:
        shown = F.slice(shown, 1, most)
    if longest is not None:
        cut = lambda v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, longest - 3), F.lit("..."))).otherwise(v)
        shown = F.transform(shown, lambda p: F.struct(p.key.alias("key"), cut(p.value).alias("value")))
    return shown


def extended(requests: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """entity_id, property, value: cells of the requested ids and properties. requests: entity_id, property."""
    cells = details.select("entity_id", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("entity_id", columns, "property", "value")
    return requests.distinct().join(cells, ["entity_id", "property"])
