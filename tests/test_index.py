"""The stored trigram index against searches of the table as it is."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.operators import match
from matchloom.operators.index import TrigramIndex

NAMES = [f"{a} {b}" for a in ("red", "blue", "old", "redd", "öld") for b in ("bolt", "nut", "bolts", "ring")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, NAMES[i % len(NAMES)]) for i in range(60)] + [(100, None), (101, "!!"), (None, "red bolt")], "entity_id long, label string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(i, n[:2] + n[3:]) for i, n in enumerate(NAMES)] + [(50, None), (51, ""), (52, "zebra crossing")], "query_id long, query string")


def found(df):
    return sorted((r["query_id"], r["rank"], r["entity_id"] is not None, r["entity_id"] or 0, r["label"], round(r["name_sim"], 9)) for r in df.collect())


def test_changes_segments_and_compaction(spark, rows, queries, tmp_path):
    index = TrigramIndex.create(rows, f"file://{tmp_path}/index", buckets=4)
    now = {i: [NAMES[i % len(NAMES)]] for i in range(60)}

    def check():
        table = spark.createDataFrame([(i, t) for i, ts in now.items() for t in ts] + [(None, "red bolt")], "entity_id long, label string")
        for options in ({}, {"threshold": 0.6, "limit": 3}, {"floor": False}):
            assert found(match.fuzzy(queries, index, **options)) == found(match.fuzzy(queries, table, **options))

    check()
    for changes in ([(1, "zebra crossings"), (2, None), (70, "blau bolt")], [(1, None), (2, "red bolt"), (2, "second label"), (70, "blau bolt"), (None, "x"), (9999, None)], [(3, "new")], []):
        index.apply(spark.createDataFrame(changes, "entity_id long, label string"))
        for i in {i for i, _ in changes if i is not None}:
            now[i] = [t for j, t in changes if j == i and t is not None]
        check()
    assert index.snapshot() == (0, [0, 1, 2, 3, 4])
    other = TrigramIndex.open(spark, f"file://{tmp_path}/index", buckets=4)
    assert index.compact() == 1 and index.snapshot() == (1, [0])
    check()
    index = other  # opened before, sees the new generation
    check()
    assert index.vacuum() == [0]
    index.apply(spark.createDataFrame([(4, "after all")], "entity_id long, label string"))
    now[4] = ["after all"]
    check()


def test_what_is_not_committed_is_not_seen(spark, rows, queries, tmp_path):
    index = TrigramIndex.create(rows, f"file://{tmp_path}/index", buckets=4)
    before = found(index.search(queries))
    commit, index._commit = index._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    changes = spark.createDataFrame([(0, None), (1, None), (2, "zebra crossing")], "entity_id long, label string")
    for change in (lambda: index.apply(changes), index.compact):
        with pytest.raises(RuntimeError):
            change()
        assert found(index.search(queries)) == before
    index._commit = commit
    assert index.apply(changes) == 2  # number 1 is taken by what was left
    assert index.compact() == 2
    assert {r["entity_id"] for r in index.search(queries).filter("query_id = 52").collect()} == {2}


def test_the_index_side_is_not_shuffled(spark, rows, queries, tmp_path):
    index = TrigramIndex.create(rows, f"file://{tmp_path}/index", buckets=4)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = index.search(queries)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    for table in ("postings", "texts", "members"):
        (at,) = [i for i, line in enumerate(lines) if f"trigram_{table}_" in line and "FileScan" in line][:1]
        assert "Bucketed: true" in lines[at]
        # from the scan up to the join it feeds there is no exchange
        up = next(i for i in range(at, -1, -1) if "Join" in lines[i])
        depth = lambda line: len(re.match(r"[\s:+\-*()\d]*", line).group())
        above = [lines[i] for i in range(up, at) if depth(lines[i]) < depth(lines[at])]
        assert not any("Exchange" in line for line in above[1:]), table
    scans = re.findall(r"FileScan parquet spark_catalog\.default\.(\w+?)_[0-9a-f]{32}", plan)
    assert set(scans) == {"trigram_ranks", "trigram_postings", "trigram_texts", "trigram_members", "trigram_gone"}


def test_empty_index(spark, rows, queries, tmp_path):
    index = TrigramIndex.create(rows.limit(0), f"file://{tmp_path}/index", buckets=2)
    assert index.search(queries).count() == 0
    index.apply(rows.filter(F.col("entity_id") == 5))
    assert {r["entity_id"] for r in index.search(queries).collect()} == {5}
    with pytest.raises(ValueError):
        match.fuzzy(queries, index, mode="word")
