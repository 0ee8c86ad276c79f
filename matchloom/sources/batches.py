"""Query batches and result batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY = "struct<query:string,type:string,type_strict:string,limit:int,lang:string,properties:array<struct<pid:string,v:string>>>"


def queries(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each query of JSON batches {key: {...}}: batch columns, query_id (key), and the query's fields.

    A batch may be a JSON string that holds the JSON; it is then parsed twice. Payloads that are no JSON objects give no
    rows. The type is 'site' where none is given; properties become a map of those that have both pid and v, the last
    of a pid counting.
    """
    inner = F.when(F.trim(column).startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "$.x")).otherwise(F.col(column))
    others = [c for c in payloads.columns if c != column]
    rows = payloads.select(*others, F.explode(F.from_json(inner, f"map<string,{QUERY}>")).alias("query_id", "q"))
    whole = F.filter("q.properties", lambda p: p.pid.isNotNull() & p.v.isNotNull())
    # the last of a pid wins: keys once, each with its last value
    reverse = F.reverse(whole)
    keys = F.array_distinct(F.transform(reverse, lambda p: p.pid))
    properties = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(reverse, lambda p: p.pid == k), F.lit(0)).v))
    return rows.select(*others, "query_id", F.col("q.query").alias("query"), F.coalesce("q.type", F.lit("site")).alias("type"), F.col("q.type_strict").alias("type_strict"), F.col("q.limit").alias("limit"), F.col("q.lang").alias("lang"), F.coalesce(properties, F.create_map().cast("map<string,string>")).alias("properties"))


def rejected(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads that hold no queries, with problem: no payload, no JSON, no object, or a member that is no object.

    The others are those that queries() takes; a batch encoded twice is judged by what it holds.
    """
    text = F.trim(column)
    inner = F.when(text.startswith('"'), F.trim(F.get_json_object(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "$.x"))).otherwise(text)
    members = F.from_json(inner, "map<string,string>")
    problem = (
        F.when(F.col(column).isNull() | (text == ""), "no payload")
        .when(inner.isNull() | F.try_parse_json(inner).isNull(), "no JSON")
        .when(~inner.startswith("{"), "no object")
        .when(F.exists(F.map_values(members), lambda m: m.isNull() | ~F.trim(m).startswith("{")), "a query is no object")
    )
    return payloads.withColumn("problem", problem).filter("problem IS NOT NULL")


def validated(rows: DataFrame, types: list[str]) -> DataFrame:
    """rows with error: null for a good query; bad ones can be set aside one by one."""
    error = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query is empty")
        .when(~F.coalesce(F.col("limit").between(1, 500), F.lit(True)), "limit is not from 1 to 500")
        .when(~F.coalesce(F.col("type_strict").isin("should", "all", "any"), F.lit(True)), "type_strict is not should, all or any")
        .when(~F.col("type").isin(types), "unknown type")
    )
    return rows.withColumn("error", error)


def results(asked: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """query_id, result: every query's candidates by rank as an array, empty without any."""
    listed = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    found = candidates.groupBy("query_id").agg(F.transform(listed, lambda c: F.struct(*(c[x].alias(x) for x in columns))).alias("result"))
    kind = found.schema["result"].dataType
    return asked.select("query_id").distinct().join(found, "query_id", "left").withColumn("result", F.coalesce("result", F.array().cast(kind)))
