"""The given tables in the roles of authority tables, queries and the rest; see README for the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.fulltext import corpus
from matchloom.storage import staged, tasks_for, unsent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an authority table; the size class is the location type, the brand the national id."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("entity_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("national_id"), (F.col("p_size") % 10).alias("location_type_id"), F.col("p_type").alias("kind"),
        (F.lit(55.0) + (k % 1000) / 100.0).alias("latitude"), (F.lit(11.0) + (k % 700) / 100.0).alias("longitude"),
    )


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name without its third letter, as a messy query; the id is the least part key."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    name = F.col("p_name")
    return p.select("query_id", F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1000)).alias("query"))


def site_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_queries with a point, a place, and for even ids a brand that only some parts have."""
    k = F.col("query_id")
    return part_queries(spark, sf_dir).select(
        "query_id", "query", (F.lit(55.0) + (k % 1000) / 100.0).alias("q_lat"), (F.lit(11.0) + (k % 700) / 100.0).alias("q_lon"),
        F.concat(F.lit("nation "), (k % 25).cast("string")).alias("place"),
        F.when(k % 2 == 0, F.concat(F.lit("Brand#"), (k % 40).cast("string"))).alias("national_id"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the nations of their suppliers, as sites and locations. Dealt by parts, so that what follows by part stays in
    tasks of bounded size."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select("l_partkey", "l_suppkey").repartition(tasks_for(li.count()), "l_partkey").distinct()
    su = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_partkey").alias("entity_id"), F.col("n_name").alias("location_name")).distinct()


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as references: name, type and brand make up the reference, suppliers' numbers stand for identifiers."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    return p.select(
        k.alias("entity_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("full_reference"), F.col("p_name").alias("title"), F.col("p_type").alias("authors"),
        F.concat_ws(" ", F.lit("bugs"), "p_brand", "p_name", "p_size").alias("bugs_reference"), (F.lit(1900) + F.col("p_size")).cast("string").alias("year"),
        F.concat(F.lit("https://doi.org/10.1/P"), k.cast("string")).alias("doi"), F.concat(F.lit("978-"), k.cast("string"), F.lit("-x")).alias("isbn"),
    )


def reference_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every supplier asks for, in three kinds (the remainder of query_id by 3): 0, the first part that it ever
    delivered, with all properties; 1, the last one as free text; 2, every distinct part name alone as free text. Staged, as
    each pass asks anew."""
    part, li = unsent(table(spark, sf_dir, "part")), table(spark, sf_dir, "lineitem")
    asked = li.groupBy("l_suppkey").agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"))
    k = F.col("p_partkey").cast("string")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    whole = asked.join(part, F.col("first") == F.col("p_partkey")).select(
        (F.col("l_suppkey") * 3).alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"), F.concat(F.lit("978 "), k, F.lit("X")).alias("isbn"), F.concat(F.lit(" http://doi.org/10.1/p"), k).alias("doi"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("full_reference"), F.col("p_name").alias("title"), (F.lit(1900) + F.col("p_size")).cast("string").alias("year"),
        F.concat(F.col("p_type"), F.lit(" AND SONS")).alias("authors"), F.concat_ws(" ", F.lit("bugs"), "p_brand", "p_name", "p_size").alias("bugs_reference"),
    )
    rest = none("isbn", "doi", "full_reference", "title", "year", "authors", "bugs_reference")
    free = asked.join(part, F.col("last") == F.col("p_partkey")).select((F.col("l_suppkey") * 3 + 1).alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"), *rest)
    names = part.groupBy("p_name").agg((F.min("p_partkey") * 3 + 2).alias("query_id")).select("query_id", F.col("p_name").alias("query"), *rest)
    return staged(whole.unionByName(free).unionByName(names), "references")


def search_parts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str, str, str]]:
    """Names, brands, types and references of parts, names of suppliers and nations, sources and whole texts of documents."""
    p, s, n, d = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "documents"))
    p = p.withColumn("reference", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"))
    columns = ((p, "tbl_part", "p_partkey", "p_name", "label"), (p, "tbl_part", "p_partkey", "p_brand", "abbreviation"), (p, "tbl_part", "p_partkey", "p_type", "description"), (p, "tbl_part", "p_partkey", "reference", "description"))
    return [*columns, (s, "tbl_supplier", "s_suppkey", "s_name", "label"), (n, "tbl_nation", "n_nationkey", "n_name", "label"), (d, "tbl_documents", "doc_id", "source", "abbreviation"), (d, "tbl_documents", "doc_id", "text", "description")]


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_parts as a corpus; staged, as a corpus is made once and searched often."""
    return staged(corpus(search_parts(spark, sf_dir)), "corpus")


def corpus_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches: the distinct part names, brands and market segments, names with types, and each name as a phrase, with
    `or` between its two words, and its second word without its first."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    name, first, second = F.col("p_name"), F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    shapes = [name, F.col("p_brand"), F.concat_ws(" ", "p_name", "p_type"), F.concat(F.lit('"'), name, F.lit('"')), F.concat_ws(" or ", first, second), F.concat(second, F.lit(" -"), first)]
    texts = p.select(F.explode(F.array(*shapes)).alias("query")).union(c.select("c_mktsegment")).distinct()
    return texts.select(F.col("query").alias("query_id"), "query")


def boolean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches about the two words a and b of each part name that mix `or`, phrases and minus signs."""
    name = F.split("p_name", " ")
    a, b = name[0], name[1]
    quoted = F.concat(F.lit('"'), b, F.lit(" "), a, F.lit('"'))
    shapes = [F.concat(a, F.lit(" or "), b, F.lit(" "), a), F.concat(a, F.lit(" -"), b, F.lit(" or "), quoted), F.concat(F.lit("-"), a), F.concat(b, F.lit(" or - "), a), F.concat(F.lit("or "), a, F.lit(" or"))]
    texts = table(spark, sf_dir, "part").select(F.explode(F.array(*shapes)).alias("query")).distinct()
    return texts.select(F.col("query").alias("query_id"), "query")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as gazetteer records, with scores and populations from their keys."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("geonameId"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("adminName1"), F.when(k % 5 > 0, F.col("n_name")).alias("countryName"),
        F.when(k % 4 > 0, (k % 101).cast("double")).alias("score"), F.when(k % 6 > 0, (k * 37) % 100000).alias("population"),
        F.when(k % 3 == 0, "P").when(k % 3 == 1, "A").otherwise("T").alias("fcl"), F.when(k % 2 == 0, "ADM1").otherwise("PPL").alias("fcode"), F.when(k % 7 > 0, F.concat(F.lit("kind "), (k % 7).cast("string"))).alias("fcodeName"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as answers of a model: plain JSON, JSON in prose, one object, or no JSON."""
    labels, k, q = table(spark, sf_dir, "labels"), F.col("doc_id"), F.col("quality")
    one = F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('", "value": "v'), q.cast("string"), F.lit('", "score": '), F.when(k % 10 == 3, "1.5").otherwise("0.5"), F.lit(', "reasons": ["a", "b"'), F.when(k % 7 == 0, ', "c", "d", "e"').otherwise(""), F.lit("]}"))
    body = F.concat(F.lit('{"input_id": "'), k.cast("string"), F.lit('", "input_value": "x", "candidates": ['), one, F.when(k % 2 == 0, F.concat(F.lit(", "), one)).otherwise(""), F.lit("]}"))
    text = F.when(k % 5 == 0, F.concat(F.lit("Sure: ["), body, F.lit("] done"))).when(k % 5 == 1, body).when(k % 5 == 2, F.lit("no idea")).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return labels.select(k.alias("query_id"), text.alias("completion"))
