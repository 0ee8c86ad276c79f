"""Plans and counts that decide how queries grow with their tables."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom import storage
from matchloom.functions import text as T
from matchloom.operators import cascades, fulltext, match, prompts
from matchloom.operators import corpus as corpus_module
from matchloom.operators import index as trigrams
from matchloom.operators.corpus import StoredCorpus
from matchloom.operators.index import TrigramIndex
from matchloom.plans import roles
from matchloom.plans.registry import QUERIES
from matchloom.storage import staged


@pytest.mark.parametrize("name", ["biblio_exact_passes", "gazetteer_search", "proximity_boost"])
def test_tables_that_grow_are_not_broadcast(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    large = [line for line in plan.split("\n") if "strategy=broadcast" in line]
    assert "strategy=merge" in plan and not large


def sent(df):
    """The broadcast joins of the plan as it is before anything has run, but those with the few sizes of trigram sets."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [line for line in lines if "Broadcast" in line and "Join" in line and not re.search(r"BroadcastHashJoin \[n#\d+\], \[n#\d+\], LeftSemi", line)]


@pytest.fixture
def plans(spark, monkeypatch):
    """What is sent in the joins of each table that a search stages, where every table counts as large."""
    found, plain = [], storage.staged
    monkeypatch.setattr(storage, "SENT_ROWS", 0, raising=False)
    monkeypatch.setattr(match, "staged", lambda df, label: found.append((label, sent(df))) or plain(df, label))
    return found


def test_searches_send_no_texts(spark, plans):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERED)], "entity_id long, label string")
    queries = spark.createDataFrame([(i, t[:2] + t[3:]) for i, t in enumerate(NUMBERED[::5])], "query_id long, query string")
    found = match.fuzzy(queries, rows, threshold=0.8, many_pairs=0)
    assert [(label, lines) for label, lines in [*plans, ("result", sent(found))] if lines] == []
    assert {label for label, _ in plans} >= {"ranked", "frequency", "step", "many", "rest"} and found.count() > 0


def test_the_search_of_a_country_sends_no_tables(spark, sf_dir, plans):
    last = sent(QUERIES["gazetteer_search_country"](spark, sf_dir))
    lines = [line for line in sum((lines for _, lines in plans), last) if "n_nationkey" not in line]
    assert {label for label, _ in plans} >= {"rows", "texts", "ranked"} and lines == []


def test_rows_of_one_text_are_searched_once(spark):
    rows = spark.createDataFrame([(i, "Red Bolt" if i % 2 else "red bolt") for i in range(50)], "id long, name string")
    corpus = staged(fulltext.corpus([(rows, "tbl_a", "id", "name", "label")]), "corpus")
    queries = spark.createDataFrame([("red", "red"), ("-blue", "-blue")], "query_id string, query string")
    assert [(r["query_id"], r["system_id"]) for r in fulltext.scored(queries, corpus).collect()] == [("red", 0)]
    found = sorted((r["query_id"], r["place"], r["system_id"], r["value"]) for r in fulltext.search(queries, corpus, limit=3).collect())
    assert found == [(q, i + 1, i, "Red Bolt" if i % 2 else "red bolt") for q in ("-blue", "red") for i in range(3)]


def test_a_search_ranks_each_text_once(spark, monkeypatch):
    """Forty rows of one text and one of another: what meets the words of the query are two rows, the best are those of the whole."""
    rows = spark.createDataFrame([(i, "red bolt, red nut" if i == 25 else "red bolt") for i in range(41)], "id long, name string")
    corpus = staged(fulltext.corpus([(rows, "tbl_a", "id", "name", "label")]), "corpus")
    kept, plain = {}, fulltext.staged
    monkeypatch.setattr(fulltext, "staged", lambda df, label: kept.setdefault(label, plain(df, label)))
    out = fulltext.search(spark.createDataFrame([("red",), ("-nut",), ("-bolt or nut",)], "query string").selectExpr("query AS query_id", "query"), corpus, limit=20).collect()
    found = lambda q: [r["system_id"] for r in sorted(out, key=lambda r: r["place"]) if r["query_id"] == q]
    assert found("red") == [25, *range(19)] and found("-nut") == [*range(20)] and found("-bolt or nut") == [25]
    assert kept["met"].filter("query_id = 'red'").select("system_id").distinct().count() == 2


def test_refreshed_values_are_shuffled_once(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(i, f"name {i}") for i in range(20)], "id long, name string")
    stored, plans, plain = StoredCorpus(spark, f"file://{tmp_path}/corpus"), {}, corpus_module.staged
    stored.refresh([(rows.filter("id % 3 > 0"), "tbl_a", "id", "name", "label")])
    monkeypatch.setattr(corpus_module, "staged", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and plain(df, label))
    stored.refresh([(rows.unionByName(rows), "tbl_a", "id", "name", "label")])
    assert stored.rows().count() == 20 and stored.tokens().count() == 40
    assert not re.findall(r"hashpartitioning\([^)]*\bvalue#", plans["new"] + plans["gone"])


NUMBERED = [f"Item {i:05d}" for i in range(0, 4000, 7)] + [f"{a} {b}" for a in ("red", "blue", "old", "redd") for b in ("bolt", "nut", "bolts", "a")] + ["a", "b a", "x y z"]


@pytest.mark.parametrize("mode", ["similarity", "word"])
@pytest.mark.parametrize("options", [{}, {"threshold": 0.6, "limit": 3}, {"threshold": 0.85}])
def test_steps_lose_no_match(spark, mode, options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERED * 2)], "entity_id long, label string")
    queries = spark.createDataFrame([(i, t[:2] + t[3:]) for i, t in enumerate(NUMBERED[::5] + NUMBERED[-20:])], "query_id long, query string")
    found = lambda many: sorted(map(tuple, match.fuzzy(queries, rows, mode=mode, many_pairs=many, **options).collect()))
    assert found(0) == found(1 << 60)


@pytest.mark.parametrize("threshold", [0.51, 0.6, 0.8, 0.999])
def test_similar_texts_equal_brute_force(spark, threshold):
    texts = staged(match._texts(spark.createDataFrame([(t,) for t in NUMBERED + [t[:-1] for t in NUMBERED]], "t string"), "t"), "texts")
    sim = T.jaccard(F.col("ga"), F.col("gb"))
    every = texts.select(F.col("t").alias("a"), F.col("grams").alias("ga")).crossJoin(texts.select(F.col("t").alias("b"), F.col("grams").alias("gb"))).select("a", "b", sim.alias("sim")).filter(F.col("sim") >= threshold)
    assert sorted(map(tuple, match.similar_texts(texts, texts, threshold).collect())) == sorted(map(tuple, every.collect()))


def test_steps_of_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERED)], "entity_id long, label string")
    index = TrigramIndex.create(rows.filter("entity_id % 2 = 0"), f"file://{tmp_path}/index", buckets=4)
    index.apply(rows.filter("entity_id % 3 = 0"))
    index.apply(rows.filter("entity_id % 10 = 0").withColumn("label", F.lit(None).cast("string")))
    queries = spark.createDataFrame([(i, t[:2] + t[3:]) for i, t in enumerate(NUMBERED[::5] + NUMBERED[-20:])], "query_id long, query string")
    found = lambda many: sorted(map(tuple, index.search(queries, many_pairs=many).collect()))
    assert found(0) == found(1 << 60) != []


@pytest.mark.parametrize("compacted", [False, True])
def test_a_changed_index_sends_no_tables(spark, plans, monkeypatch, tmp_path, compacted):
    """Neither while it is changed, nor while it is searched, by steps or by postings."""
    asked, plain = [], TrigramIndex._add
    monkeypatch.setattr(TrigramIndex, "_add", lambda self, g, table, rows, segment: asked.append((table, sent(rows))) or plain(self, g, table, rows, segment))
    monkeypatch.setattr(trigrams, "staged", match.staged)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERED)], "entity_id long, label string")
    index = TrigramIndex.create(rows.filter("entity_id % 2 = 0"), f"file://{tmp_path}/index", buckets=4)
    index.apply(rows.filter("entity_id % 3 = 0"))
    if compacted:
        index.compact()
    queries = spark.createDataFrame([(i, t[:2] + t[3:]) for i, t in enumerate(NUMBERED[::5])], "query_id long, query string")
    results = [("result", sent(index.search(queries, many_pairs=many))) for many in (0, 1 << 60)]
    # the frequencies of trigrams are as few as there are trigrams
    assert [(label, line) for label, lines in [*asked, *plans, *results] for line in lines if not re.search(r"BroadcastHashJoin \[gram#\d+\], \[gram#\d+\], LeftOuter", line)] == []
    assert {"members", "postings"} <= {table for table, _ in asked} and {"stored", "step", "met"} <= {label for label, _ in plans}


def test_full_matches_end_the_search(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"bugs {i % 40} ring") for i in range(400)], "entity_id long, label string")
    asked, plain = [], match.similar_texts
    monkeypatch.setattr(match, "similar_texts", lambda left, right, t: asked.append(t) or plain(left, right, t))
    assert match.fuzzy(rows.select(F.col("entity_id").alias("query_id"), F.col("label").alias("query")), rows, many_pairs=0).count() == 4000
    assert asked == [0.999]


def test_exact_passes_of_a_cascade_are_cut_before_the_join(spark):
    """Forty references share title and year with two queries: each pass brings the first ten, and the best are those of the whole."""
    row = lambda i: (i, f"ref {(i * 7) % 40:02d}", "title", "authors", f"bugs {i}", "1900", f"10.1/{i}", f"isbn {i}")
    biblio = spark.createDataFrame([row(i) for i in range(40)], "entity_id long, full_reference string, title string, authors string, bugs_reference string, year string, doi string, isbn string")
    asked = [(1, "zzz", None, None, None, "title", "1900", None, None), (2, "zzz", "3", "10.1/5", None, "title", "1900", None, "bugs 9")]
    queries = spark.createDataFrame(asked, "query_id long, query string, isbn string, doi string, full_reference string, title string, year string, authors string, bugs_reference string")
    passes = cascades.bibliographic_passes(queries, biblio).filter("pass_no = 3")
    assert [r["count"] for r in passes.groupBy("query_id").count().collect()] == [10, 10]
    by_label = sorted(range(40), key=lambda i: row(i)[1])
    best = {q: [r["entity_id"] for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in ((q, [r for r in cascades.bibliographic(queries, biblio).collect() if r["query_id"] == q]) for q in (1, 2))}
    first = [3, 5]
    assert best == {1: by_label[:10], 2: (first + [i for i in by_label if i not in first])[:10]}


@pytest.mark.parametrize("name", ["details_left_agg", "details_sampling_context", "place_boost"])
def test_rows_of_sites_are_dealt(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    tasks = -(-roles.table(spark, sf_dir, "lineitem").count() // 500)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in plan


def test_queries_asked_once_are_not_ranked_again(spark):
    best = spark.createDataFrame([(t, 10 * i + r, f"{t}{r}", 1.0 - r / 10 - i / 100, r) for i, t in enumerate("ab") for r in (1, 2)], "q string, entity_id long, label string, name_sim double, rank int")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "a"), (4, "a"), (5, None), (6, "a"), (6, None), (7, "c")], "query_id long, q string")
    out = match.answers(q, best, 2, [F.desc("name_sim"), F.col("label"), F.col("entity_id")])
    a, b = [(1, 1), (2, 2)], [(11, 1), (12, 2)]
    expected = {1: a, 2: b, 3: [(1, 1), (11, 2)], 4: [(1, 1), (1, 2)], 6: a}
    assert sorted((r["query_id"], r["entity_id"], r["rank"]) for r in out.collect()) == sorted((k, *r) for k, rows in expected.items() for r in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "strategy=broadcast" not in plan and plan.count("strategy=merge") == 2


def test_ranges_of_a_list_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    kept, plain = [], prompts.staged
    monkeypatch.setattr(prompts, "staged", lambda df, label: kept.append(plain(df, label)) or kept[-1])
    out = prompts.chunked(spark.range(1000), ["id"], ["id"], most_chars=500, form="lookup").orderBy("chunk").collect()
    assert "\n".join(r["table"] for r in out).split("\n") == [str(i) for i in range(1000)]
    assert max(r["n"] for r in kept[0].groupBy("__part").agg(F.count("*").alias("n")).collect()) < 400
