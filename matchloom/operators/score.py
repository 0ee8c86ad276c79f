"""Boosts, floors, caps and candidate projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.policy import POLICY
from matchloom.storage import unsent

EARTH_RADIUS_M = 6378137.0


def mercator_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the Web-Mercator plane; longer than on the ground by 1 / cos(latitude)."""
    x = lambda lon: F.radians(lon) * EARTH_RADIUS_M
    y = lambda lat: F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_RADIUS_M
    return F.sqrt(F.pow(x(lon1) - x(lon2), F.lit(2.0)) + F.pow(y(lat1) - y(lat2), F.lit(2.0))) / 1000


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the sphere."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.sqrt(half)) * (2 * EARTH_RADIUS_M / 1000)


def proximity(sim: Column, km: Column, *, near: float = POLICY.near_boost, far: float = POLICY.far_km) -> Column:
    """sim raised by up to near, falling to nothing at far km; unchanged without a distance; 1 at most."""
    boost = F.greatest(F.lit(0.0), near * (1 - F.least(km / far, F.lit(1.0))))
    return F.when(km.isNull(), sim).otherwise(F.least(F.lit(1.0), sim + boost))


def place_boost(sim: Column, place_sim: Column, *, threshold: float = POLICY.place_threshold, factor: float = POLICY.place_factor) -> Column:
    """sim raised by a share of place_sim where that is above the threshold; 1 at most."""
    return F.when(place_sim > threshold, F.least(F.lit(1.0), sim + place_sim * factor)).otherwise(sim)


def with_distances(candidates: DataFrame, queries: DataFrame, sites: DataFrame) -> DataFrame:
    """candidates with distance_km to the query's point, null where the query or the site has no point; zero is a
    coordinate like others. sites: entity_id, latitude, longitude; queries: query_id, q_lat, q_lon."""
    points = sites.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("entity_id", "latitude", "longitude")
    both = candidates.join(queries.select("query_id", "q_lat", "q_lon"), "query_id", "left").join(unsent(points), "entity_id", "left")
    km = mercator_km(F.col("longitude"), F.col("latitude"), F.col("q_lon"), F.col("q_lat"))
    return both.withColumn("distance_km", km).drop("q_lat", "q_lon", "latitude", "longitude")


def best_place(candidates: DataFrame, queries: DataFrame, bridge: DataFrame, similarity) -> DataFrame:
    """candidates with place_sim: the best similarity of a query's place with a location of the site.

    bridge: entity_id, location_name; queries: query_id, place; similarity: a function of two columns.
    """
    asked = queries.filter("place IS NOT NULL").select("query_id", "place")
    met = candidates.select("query_id", "entity_id").join(asked, "query_id").join(unsent(bridge), "entity_id")
    # equal names of one site are measured once
    met = met.select("query_id", "entity_id", "place", "location_name").distinct()
    best = met.groupBy("query_id", "entity_id").agg(F.max(similarity(F.col("location_name"), F.col("place"))).alias("place_sim"))
    return candidates.join(best, ["query_id", "entity_id"], "left")


def as_candidates(rows: DataFrame, entity_type: str, *, query: str = "query", accept: float = POLICY.auto_accept, digits: int = 2, id_base: str = POLICY.id_base, by_label: bool = True) -> DataFrame:
    """The outward form of candidates: id (URI), name, score 0-100, match, type, and distance_km if there is one.

    match: the label equals the query without regard to case, or the score reaches accept. The type's name is the
    label, as callers of the matching service expect.
    """
    match = F.col("name_sim") >= accept
    if by_label:
        match = (F.lower("label") == F.lower(query)) | match
    columns = [
        "query_id",
        "rank",
        F.concat(F.lit(f"{id_base}{entity_type}/"), F.col("entity_id").cast("string")).alias("id"),
        F.col("label").alias("name"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("name_sim") * 100, digits))).alias("score"),
        F.coalesce(match, F.lit(False)).alias("match"),
        F.array(F.struct(F.lit(entity_type).alias("id"), F.col("label").alias("name"))).alias("type"),
    ]
    if "distance_km" in rows.columns:
        columns.append(F.round("distance_km", 2).alias("distance_km"))
    return rows.select(*columns)


def floored(rows: DataFrame, floor: float = POLICY.reference_floor) -> DataFrame:
    return rows.withColumn("name_sim", F.greatest(F.col("name_sim"), F.lit(floor)))


def capped(rows: DataFrame, cap: float = POLICY.fallback_cap) -> DataFrame:
    return rows.withColumn("name_sim", F.least(F.col("name_sim"), F.lit(cap)))
