"""Authority tables in their uniform shape: entity_id, label, norm_label, and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from matchloom.functions import text as T

SITE_CSV = S.StructType([S.StructField(n, t) for n, t in (("site_name", S.StringType()), ("country", S.StringType()), ("latitude", S.DoubleType()), ("longitude", S.DoubleType()), ("place_name", S.StringType()), ("national_id", S.StringType()), ("description", S.StringType()))])
GAZETTEER = "geonameId long, name string, lat string, lng string, countryName string, adminName1 string, score double, population long, fcl string, fcode string, fcodeName string"


def authority(df: DataFrame, entity_type: str, id_col: str, label_col: str, *attributes: str) -> DataFrame:
    """The uniform shape of a table; rows without id or label are left out."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return rows.select(F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("long").alias("entity_id"), F.col(label_col).cast("string").alias("label"), T.normalise(F.col(label_col).cast("string")).alias("norm_label"), *attributes)


def sites(df: DataFrame) -> DataFrame:
    return authority(df, "site", "site_id", "site_name", "latitude", "longitude", "national_id", "description")


def locations(df: DataFrame, types: DataFrame) -> DataFrame:
    """Locations that have a type."""
    return authority(df.join(types, "location_type_id"), "location", "location_id", "location_name", "location_type_id", "location_type")


def feature_types(df: DataFrame) -> DataFrame:
    return authority(df, "feature_type", "feature_type_id", "feature_type_name", "description")


def methods(df: DataFrame) -> DataFrame:
    return authority(df, "method", "method_id", "method_name", "method_abbreviation", "method_group_id", "description")


def data_types(df: DataFrame) -> DataFrame:
    return authority(df, "data_type", "data_type_id", "data_type_name", "data_type_group_id", "definition")


def dimensions(df: DataFrame) -> DataFrame:
    return authority(df, "dimension", "dimension_id", "dimension_name", "dimension_abbreviation", "unit_id", "method_group_id")


def sampling_contexts(df: DataFrame) -> DataFrame:
    return authority(df, "sampling_context", "sampling_context_id", "sampling_context", "description")


def modification_types(df: DataFrame) -> DataFrame:
    return authority(df, "modification_type", "modification_type_id", "modification_type_name", "modification_type_description")


def bibliography(df: DataFrame) -> DataFrame:
    """References with their four searched fields; all rows, with or without a full reference."""
    fields = ("full_reference", "title", "authors", "bugs_reference")
    return df.select(F.lit("bibliographic_reference").alias("entity_type"), F.col("biblio_id").cast("long").alias("entity_id"), F.col("full_reference").alias("label"), *fields, F.col("year").cast("string").alias("year"), "doi", "isbn", *(T.normalise(F.col(f)).alias(f"norm_{f}") for f in fields))


def gazetteer(df: DataFrame, column: str = "value") -> DataFrame:
    """Records of JSON answers {"geonames": [...]}, one row each."""
    return df.select(F.explode(F.from_json(column, f"struct<geonames:array<struct<{', '.join(p.replace(' ', ':', 1) for p in GAZETTEER.split(', '))}>>>").geonames).alias("g")).select("g.*")


def sites_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sites of CSV files with a header; quotes within quoted values are doubled, values may go over several lines."""
    return spark.read.options(header=True, escape='"', multiLine=True).schema(SITE_CSV).csv(path)


def trigram_index(rows: DataFrame) -> DataFrame:
    """The persisted form of a table for matching: entity_type, entity_id, trigram, n_trgm."""
    grams = rows.select("entity_type", "entity_id", T.trigrams(F.col("norm_label")).alias("grams"))
    return grams.select("entity_type", "entity_id", F.size("grams").alias("n_trgm"), F.explode("grams").alias("trigram"))
