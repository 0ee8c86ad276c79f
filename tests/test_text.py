import random
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_trigrams_of_a_word(spark):
    assert set(one(spark, T.trigrams(F.lit("pithole")))) == {"  p", " pi", "pit", "ith", "tho", "hol", "ole", "le "}


def test_similarity(spark):
    assert one(spark, T.similarity(F.lit("cat"), F.lit("cats"))) == 0.5
    assert one(spark, T.similarity(F.lit("!!"), F.lit("??"))) == 0.0


def test_normalise(spark):
    assert one(spark, T.normalise(F.lit("Björkö ÆØ Straße"))) == "bjorko aeo strasse"


def test_word_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("", "x"), (None, "x")], "a string, b string")
    rows = T.with_word_similarity(df, "a", "b").collect()
    assert [r["sim"] for r in rows] == [0.8, 0.0, 0.0]
    strict = T.with_word_similarity(df.limit(1), "a", "b", strict=True).first()["sim"]
    assert abs(strict - 4 / 7) < 1e-9


def test_identifiers(spark):
    assert one(spark, T.isbn(F.lit("978-3-16 x"))) == "978316X"
    assert one(spark, T.isbn(F.lit("--"))) is None
    assert one(spark, T.doi(F.lit("  HTTPS://doi.org/10.1/AB "))) == "10.1/ab"
    assert one(spark, T.doi(F.lit(" "))) is None


def test_languages(spark):
    assert tuple(one(spark, T.guessed_language(F.lit("plain")))) == ("en", 0.9)
    assert one(spark, T.guessed_language(F.lit("räksmörgås")))["lang"] == "unknown"
    assert tuple(one(spark, T.answered_language(F.lit("SV, 0.7")))) == ("sv", 0.7)
    assert tuple(one(spark, T.answered_language(F.lit("who knows")))) == ("en", 0.5)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_find_the_best_run(seed):
    """best_runs against all runs, for haystacks with and without repeated trigrams."""
    rng = random.Random(seed)
    own = [rng.sample([f"g{i}" for i in range(30)], rng.randint(1, 8)) for _ in range(400)]
    ordered = [rng.sample([f"g{i}" for i in range(30)], rng.randint(0, 25)) if i % 2 else rng.choices([f"g{i}" for i in range(30)], k=rng.randint(1, 20)) for i in range(400)]
    got = T.best_runs(pa.array(own, pa.list_(pa.string())), pa.array(ordered, pa.list_(pa.string())), None, 0.0)
    for mine, a, b in zip(got, own, ordered, strict=True):
        a = set(a)
        share = [len(a & set(b[i:j])) / len(a | set(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1)]
        assert abs(mine - max(share, default=0)) < 1e-12
