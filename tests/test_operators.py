import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import cascades, details, exact, fulltext, gazetteer, match, merge, prompts, score
from matchloom.sources import authority, batches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similarity_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([(i, f"name {i % 50}") for i in range(200)], "entity_id long, label string")
    q = spark.createDataFrame([(1, "nam 7")], "query_id long, query string")
    found = match.fuzzy(q, a)
    assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" not in plan(found)


def test_prefix_join_equals_brute_force(spark):
    names = [f"{a} {b}" for a in ("red", "blue", "old", "redd") for b in ("bolt", "nut", "bolts", "ring")]
    texts = match._texts(spark.createDataFrame([(n,) for n in names], "t string"), "t")
    for threshold in (0.2, 0.5, 0.9):
        found = {(r[0], r[1]): r[2] for r in match.similar_texts(texts, texts, threshold).collect()}
        grams = {r["t"]: set(r["grams"]) for r in texts.collect()}
        expected = {(x, y): len(grams[x] & grams[y]) / len(grams[x] | grams[y]) for x in names for y in names}
        assert found == {k: v for k, v in expected.items() if v >= threshold}


def test_unknown_modes_and_fields(spark):
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    with pytest.raises(ValueError):
        match.fuzzy_bibliography(q, q, field="shape")
    with pytest.raises(ValueError):
        match.fuzzy_bibliography(q, q, mode="loose")


def test_fuzzy_with_nulls_and_empty(spark):
    a = spark.createDataFrame([(1, None), (2, "!!"), (3, "Birka"), (4, "Birka")], "entity_id long, label string")
    q = spark.createDataFrame([(1, "birka"), (2, None), (3, ""), (4, "??")], "query_id long, query string")
    assert [(r["query_id"], r["entity_id"], r["name_sim"], r["rank"]) for r in match.fuzzy(q, a).orderBy("rank").collect()] == [(1, 3, 1.0, 1), (1, 4, 1.0, 2)]
    assert match.fuzzy(q.limit(0), a).count() == 0 and match.fuzzy(q, a.limit(0)).count() == 0


def test_proximity_and_place(spark):
    rows = spark.createDataFrame([(1, 0.7, 0.5, 0.9), (2, 0.8, 15.0, 0.2), (3, 0.6, None, None)], "id int, sim double, km double, place double")
    out = rows.withColumn("near", score.proximity(F.col("sim"), F.col("km"))).withColumn("both", score.place_boost(F.col("near"), F.col("place"))).orderBy("id").collect()
    assert [round(r["near"], 6) for r in out] == [0.89, 0.8, 0.6]
    assert [round(r["both"], 6) for r in out] == [0.98, 0.8, 0.6]


def test_gazetteer_scores(spark):
    rows = spark.createDataFrame([(80.0, 100000), (60.0, 0), (None, None), (50.0, 10000000), (50.0, -1000)], "score double, population long")
    assert [r[0] for r in rows.select(gazetteer.relevance(F.col("score"), F.col("population"))).collect()] == [100.0, 84.0, 60.0, 100.0, 80.0]
    text = spark.range(1).select(gazetteer.description(F.lit(None).cast("string"), F.lit("PPLA"), F.lit(50000)), gazetteer.label(F.lit("Umeå"), F.lit("Västerbotten"), F.lit("Sweden"))).first()
    assert tuple(text) == ("PPLA · pop 50,000", "Umeå, Västerbotten, Sweden")


def test_exact_passes(spark):
    biblio = spark.createDataFrame([(1, "ref", "978-1-x", "https://doi.org/10.1/A"), (2, "other", None, "10.1/a")], "entity_id long, full_reference string, isbn string, doi string")
    q = spark.createDataFrame([(7, "9781X", "10.1/A"), (8, None, None)], "query_id long, isbn string, doi string")
    assert [(r["query_id"], r["entity_id"]) for r in exact.same_isbn(q, biblio).collect()] == [(7, 1)]
    assert sorted((r["query_id"], r["entity_id"]) for r in exact.same_doi(q, biblio).collect()) == [(7, 1), (7, 2)]


def test_generic_merges_alternate_identity(spark):
    a = spark.createDataFrame([(1, "Dendrochronology", "DEN"), (2, "Densitometry", "DENS")], "entity_id long, label string, abbreviation string")
    q = spark.createDataFrame([(1, "DEN")], "query_id long, query string")
    assert cascades.generic(q, a, alternate="abbreviation").first()["entity_id"] == 1


def test_merge_and_dedupe(spark):
    bag = spark.createDataFrame([(1, 5, "x", 0.4, 0), (1, 5, "y", 0.9, 1), (1, 5, "z", 0.9, 2)], "query_id long, entity_id long, label string, name_sim double, pass_no int")
    assert merge.merge_max(bag).first()["label"] == "y"
    assert merge.dedupe(bag, ["entity_id"], [F.col("pass_no")], keep="last").first()["label"] == "z"
    with pytest.raises(ValueError):
        merge.dedupe(bag, ["entity_id"], [F.col("pass_no")], keep="middle")


def test_early_stop_leaves_out_later_types(spark):
    rows = spark.createDataFrame([("p", "a", i, f"l{i}", 0.5) for i in range(1, 4)] + [("p", "b", 9, "best", 1.0)], "prefix_id string, entity_type string, entity_id long, label string, name_sim double")
    assert merge.suggested(rows, 3, type_order=["a", "b"]).first()["label"] == "best"
    assert {r["entity_type"] for r in merge.suggested(rows, 3, type_order=["a", "b"], early_stop=True).collect()} == {"a"}


def test_full_text_queries(spark):
    corpus = fulltext.corpus([(spark.createDataFrame([(1, "red bolt ring"), (2, "bolt red"), (3, "ring")], "k long, v string"), "tbl_x", "k", "v", "label")])
    ask = lambda text: {r["system_id"] for r in fulltext.search(spark.createDataFrame([(1, text)], "query_id long, query string"), corpus).collect()}
    assert ask("red bolt") == {1, 2}
    assert ask('"red bolt"') == {1}
    assert ask("red -ring") == {2}
    assert ask("red or ring") == {1, 2, 3}


def test_suggestions_need_an_id_a_label_and_a_prefix(spark):
    rows = spark.createDataFrame([("p", "a", 0, "x", 0.5), ("p", "a", 1, "", 0.5), ("p", "a", None, "x", 0.5), ("p", "a", 2, None, 0.5), ("p", "a", 3, "x", 0.1)], "prefix_id string, entity_type string, entity_id long, label string, name_sim double")
    assert [r["entity_id"] for r in merge.suggested(rows, 3, type_order=["a"]).collect()] == [3]
    assert [r["query"] for r in merge.usable_prefixes(spark.createDataFrame([("a",), ("",), (None,), ("ab",)], "query string")).collect()] == ["ab"]


def test_word_similarity_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    rows = [(" ".join(word() for _ in range(rng.randint(0, 3))), " ".join(word() for _ in range(rng.randint(0, 6)))) for _ in range(200)]
    grams = lambda t: [[("  " + w + " ")[i : i + 3] for i in range(len(w) + 1)] for w in t.split()]

    def best(needle, pieces):
        own = {g for w in grams(needle) for g in w}
        runs = [{g for p in pieces[i:j] for g in p} for i in range(len(pieces)) for j in range(i + 1, len(pieces) + 1)]
        return max((len(r & own) / len(r | own) for r in runs), default=0) if own else 0

    df = spark.createDataFrame(rows, "a string, b string")
    for strict in (False, True):
        found = {(r["a"], r["b"]): r["sim"] for r in T.with_word_similarity(df, "a", "b", strict=strict).collect()}
        for a, b in rows:
            pieces = grams(b) if strict else [[g] for w in grams(b) for g in w]
            assert abs(found[a, b] - best(a, pieces)) < 1e-12


def test_cover_density_of_three_clauses(spark):
    texts = {1: "a x b c", 2: "a b a c x x b", 3: "c b a", 4: "a b", 5: "a a b c c", 6: "a-b c a"}
    corpus = fulltext.corpus([(spark.createDataFrame(list(texts.items()), "k long, v string"), "tbl_x", "k", "v", "label")])

    def expected(words, clauses):
        total = 0
        for p in range(len(words)):
            for q in range(p, len(words)):
                part = words[p : q + 1]
                if set(clauses) <= set(part) and not set(clauses) <= set(part[1:]) and not set(clauses) <= set(part[:-1]):
                    total += 1 / (1 + sum(w not in clauses for w in part))
        return total

    for query in ("a b c", "c a", "b", "a b"):
        found = {r["system_id"]: r["rank"] for r in fulltext.search(spark.createDataFrame([(1, query)], "query_id long, query string"), corpus).collect()}
        ranks = {k: expected(t.replace("-", " ").split(), query.split()) for k, t in texts.items()}
        assert found == pytest.approx({k: x for k, x in ranks.items() if x})


def test_batches(spark):
    good = '{"q0": {"query": "Birka", "properties": [{"pid": "country", "v": "Sweden"}, {"pid": "country", "v": "Denmark"}, {"pid": "x"}]}, "q1": {"query": " ", "type": "none", "limit": 0}}'
    twice = '"' + good.replace('"', '\\"') + '"'
    for payload in (good, twice):
        rows = batches.validated(batches.queries(spark.createDataFrame([(payload,)], "payload string")), ["site"]).orderBy("query_id").collect()
        assert [(r["type"], r["properties"], r["error"]) for r in rows] == [("site", {"country": "Denmark"}, None), ("none", {}, "query is empty")]
    assert batches.queries(spark.createDataFrame([(None,), ("no json",)], "payload string")).count() == 0


def test_cards(spark):
    row = spark.createDataFrame([("n", " ", "v" * 61, "b")], "Name string, a string, c string, d string")
    fields = row.select(details.card_fields(row.columns).alias("f")).first()["f"]
    assert [(f["key"], f["value"]) for f in fields] == [("c", "v" * 57 + "..."), ("d", "b")]
    uris = spark.createDataFrame([("https://x/site/5",), ("https://x/site/5/6",), ("http://y/site/5",), (None,)], "uri string")
    assert [r["p"]["id"] for r in uris.select(details.uri_parts(F.col("uri"), "https://x/").alias("p")).collect()] == ["5", None, None, None]


def test_prompt_formats(spark):
    rows = spark.createDataFrame([("1", "a|b\nc", None), ("2", 'q"', "d")], "id string, label string, description string")
    table = lambda target: prompts.formatted(rows, rows.columns, "id", target=target).first()["table"]
    assert table("auto") == "| id | label | description |\n| --- | --- | --- |\n| 1 | a\\|b↩c |  |\n| 2 | q\" | d |"
    assert table("csv") == 'id|label|description\n1|"a|b\nc"|\n2|"q"""|d\n'
    assert table("json") == '[{"id":"1","label":"a|b\\nc","description":null},{"id":"2","label":"q\\"","description":"d"}]'
    nested = rows.withColumn("marks", F.array("id"))
    assert prompts.formatted(nested, nested.columns, "id").first()["format"] == "json"
    assert prompts.formatted(nested.withColumn("marks", F.lit(None).cast("array<string>")), nested.columns, "id").first()["format"] == "markdown"
    with pytest.raises(ValueError, match="too long"):
        prompts.prompts(rows.withColumnRenamed("id", "query_id"), spark.createDataFrame([("csv", "x" * (prompts.LOOKUP_CHARS + 1))], "format string, table string"), entity_type="x", context="y")
    for n, chars, expected in ((50, 20000, "markdown"), (51, 10, "csv"), (50, 20001, "csv"), (201, 1, "json")):
        assert spark.range(1).select(prompts.chosen_format(F.lit(n), F.lit(chars))).first()[0] == expected


def test_completions_and_fallback(spark):
    lookup = spark.createDataFrame([(1, "Carbonised"), (8, "Petrified")], "entity_id long, label string")
    asked = spark.createDataFrame([(1, "charred", "good"), (2, "carbonized", "bad")], "query_id long, query string, prompt string")

    def complete(prompt):
        if prompt == "bad":
            raise RuntimeError
        return '```json\n[{"input_id": "1", "input_value": "charred", "candidates": [{"id": "1", "value": "Carbonised", "score": 0.92, "reasons": ["a", "b"]}, {"id": "8", "value": "Petrified", "score": 0.15, "reasons": ["c", "d"]}]}]\n```'

    rows = prompts.with_fallback(prompts.completed(asked, complete), lookup).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["entity_id"]) for r in rows] == [(1, "1"), (1, "8"), (2, "1")]
    assert rows[0]["name_sim"] == 0.92


def test_translations(spark):
    cache = spark.createDataFrame([("k", "t", "sv", "x", 1), ("k", "t", "sv", "y", 2)], "key string, text string, lang string, translation string, ts int")
    assert [r["translation"] for r in prompts.upserted(cache, cache.limit(0)).collect()] == ["y"]
    asked = spark.createDataFrame([("a", "sv", "sv"), ("b", "en", "sv"), ("b", "en", "sv")], "text string, source_lang string, lang string")
    assert [r["text"] for r in prompts.to_translate(asked, cache).collect()] == ["b"]


def test_sources(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text('site_name,country,latitude,longitude,place_name,national_id,description\n"Birka: Björkö",Sweden,59.33,17.54,Ekerö,,Town\n')
    row = authority.sites_csv(spark, str(path)).first()
    assert row["site_name"] == "Birka: Björkö" and row["national_id"] is None
    records = authority.gazetteer(spark.createDataFrame([('{"geonames": [{"geonameId": 5, "name": "Umeå", "fcl": "P"}]}',)], "value string")).collect()
    assert [(r["geonameId"], r["name"]) for r in records] == [(5, "Umeå")]
    rows = authority.authority(spark.createDataFrame([(1, "Åb"), (2, None), (None, "x")], "k long, n string"), "t", "k", "n")
    assert [r["norm_label"] for r in rows.collect()] == ["ab"]
    assert authority.trigram_index(rows).count() == 3


def test_stream(spark, tmp_path):
    from matchloom.streaming.reconcile import reconcile_stream

    spark.createDataFrame([(1, "birka")], "query_id long, query string").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(3, "Birka"), (4, "Lund")], "entity_id long, label string")
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in"))
    reconcile_stream(stream, lambda df: match.fuzzy(df, names), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["entity_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]


def corpus_of(spark, values):
    df = spark.createDataFrame(list(enumerate(values, 1)), "id long, v string")
    return fulltext.corpus([(df, "tbl_tree", "id", "v", "label")])


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("oak or birch pine", {1, 2, 3}),
        ("birch pine or oak", {1, 2, 3}),
        ("-oak", {2, 4}),
        ("- oak", {2, 4}),
        ("--oak", {1, 3}),
        ("pine -oak", {2}),
        ("oak -pine or -birch", {1, 3}),
        ('"birch pine" or "pine oak"', {2}),
        ("or", set()),
        ("or oak", set()),
        ("oak or", set()),
        ("oak or or", {1, 3}),
        ("oak or birch or pine", {1, 2, 3, 4}),
        ("-oak -birch", set()),
        ("", set()),
        (None, set()),
        ("-", set()),
    ],
)
def test_boolean_searches(spark, query, ids):
    rows = corpus_of(spark, ["oak", "birch pine", "oak pine", "birch"])
    found = fulltext.search(spark.createDataFrame([(1, query)], "query_id long, query string"), rows)
    assert {r["system_id"] for r in found.collect()} == ids


def test_complements_are_taken_from_the_first_rows(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK_ROWS", 3)
    rows = corpus_of(spark, ["oak" if i % 3 else f"elm {i}" for i in range(1, 40)])
    found = fulltext.search(spark.createDataFrame([(1, "-oak"), (2, "-elm")], "query_id long, query string"), rows, limit=5).orderBy("query_id", "place").collect()
    assert [r["system_id"] for r in found] == [3, 6, 9, 12, 15, 1, 2, 4, 5, 7]


def test_chunks_of_null_groups_and_few_rows(spark):
    rows = spark.createDataFrame([(g, i, "x" * (i % 7)) for g in (None, "a") for i in range(40)], "g string, i int, v string")
    out = prompts.chunked(rows, ["i", "v"], ["i"], by=["g"], most_chars=50, form="csv").collect()
    for g in (None, "a"):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["chunk"])
        assert "\n".join(line for r in mine for line in r["table"].split("\n")[1:]) == "\n".join(f"{i}|{'x' * (i % 7)}" for i in range(40))
        assert all(len(r["table"]) <= 50 + len("i|v\n") + 9 for r in mine) and len(mine) > 3
    assert prompts.chunked(rows.limit(0), ["i"], ["i"]).count() == 0
    with pytest.raises(ValueError):
        prompts.chunked(rows, ["i"], ["i"], form="xml")
