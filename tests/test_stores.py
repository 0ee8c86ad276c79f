"""The stored cache of translations, the log of completions, and streams against an index."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from matchloom.operators import fulltext
from matchloom.operators.completions import CompletionLog
from matchloom.operators.corpus import StoredCorpus
from matchloom.operators.index import TrigramIndex
from matchloom.operators.translations import TranslationStore
from matchloom.streaming.reconcile import asked_once, pinned, reconcile_with_index

ENTRY = "text string, lang string, translation string, ts long"


def files(store):
    return {os.path.relpath(f, store.path.removeprefix("file://")) for f in glob.glob(f"{store.path.removeprefix('file://')}/data/**/*.parquet", recursive=True)}


def test_translation_store(spark, tmp_path):
    store = TranslationStore(spark, f"file://{tmp_path}/store", buckets=8)
    assert store.table().count() == 0 and store.missing(spark.createDataFrame([("a", "en", "sv")], "text string, source_lang string, lang string")).count() == 1
    first = [(f"word {i}", "sv", f"ord {i}", 5) for i in range(50)] + [(None, "sv", "x", 1), ("x", None, "x", 1), ("x", "sv", None, 1)]
    store.upsert(spark.createDataFrame(first, ENTRY))
    state = lambda: {(r["text"], r["lang"]): (r["translation"], r["ts"]) for r in store.table().collect()}
    assert state() == {(f"word {i}", "sv"): (f"ord {i}", 5) for i in range(50)}
    before, old = files(store), store.snapshot()
    # one entry: one bucket is written, the files of the others stay
    assert store.upsert(spark.createDataFrame([("word 3", "sv", "new", 9), ("word 3", "sv", "newer", 9), ("word 3", "sv", "old", 4)], ENTRY)) == 1
    assert state()["word 3", "sv"] == ("newer", 9) and len(state()) == 50
    assert before < files(store) and {f.split("/")[1] for f in files(store) - before} == {f"bucket={b}" for b, n in store.snapshot().items() if n == 1}
    assert sum(n == 1 for n in store.snapshot().values()) == 1
    # a reader that began before sees what was
    assert {r["translation"] for r in store.table(old).filter("text = 'word 3'").collect()} == {"ord 3"}
    # an upsert that fails before its commit is seen by nobody, nor by the next one
    commit, store._commit = store._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    now = state()
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([("word 3", "sv", "never", 99), ("word 4", "sv", "never", 99)], ENTRY))
    assert state() == now
    store._commit = commit
    assert store.upsert(spark.createDataFrame([("word 3", "sv", "last", 10), ("ord", "en", "word", 1)], ENTRY)) == 3
    assert state() == now | {("word 3", "sv"): ("last", 10), ("ord", "en"): ("word", 1)}
    asked = spark.createDataFrame([("word 3", "en", "sv"), ("word 3", "sv", "sv"), ("what", "en", "sv")], "text string, source_lang string, lang string")
    assert {(r["text"], r["source_lang"]): (r["translation"], r["hit"]) for r in store.translate(asked).collect()} == {("word 3", "en"): ("last", True), ("word 3", "sv"): ("word 3", True), ("what", "en"): ("what", False)}
    assert [r["text"] for r in store.missing(asked).collect()] == ["what"]


def test_prompts_are_asked_once(spark, tmp_path):
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    os.makedirs(calls)

    def complete(prompt):
        if prompt == "p13" and not os.path.exists(broken):
            open(broken, "w").close()
            os._exit(1)  # the task is lost
        with open(f"{calls}/{prompt}", "a") as f:
            f.write("x")
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    rows = spark.createDataFrame([(i, f"p{i % 20}") for i in range(200)] + [(900, "bad"), (901, None)], "id long, prompt string")
    log = CompletionLog(spark, f"file://{tmp_path}/log", round_prompts=4, partitions=2)
    with pytest.raises(Exception):
        log.ask(rows, complete)
    done = {r["completion"].lower() for r in log.answers().collect()}
    out = {r["id"]: r["completion"] for r in log.ask(rows, complete, attempts=2).collect()}
    assert out == {i: f"P{i % 20}" for i in range(200)} | {900: None, 901: None}
    count = {p: os.path.getsize(f"{calls}/{p}") for p in os.listdir(calls)}
    # what finished rounds answered is never asked for again; a prompt of the lost round may be
    assert all(count[p] == 1 for p in done) and all(n <= 2 for n in count.values())
    again = log.ask(rows.filter("prompt <> 'bad'"), complete).count()
    assert again == 200 and {p: os.path.getsize(f"{calls}/{p}") for p in os.listdir(calls)} == count


def test_without_failures_each_prompt_is_asked_once(spark, tmp_path):
    calls = str(tmp_path)

    def complete(prompt):
        with open(f"{calls}/{prompt}", "a") as f:
            f.write("x")
        return prompt

    rows = spark.createDataFrame([(i, f"q{i % 30}") for i in range(300)], "id long, prompt string")
    log = CompletionLog(spark, f"file://{tmp_path}/log", round_prompts=7, partitions=3)
    log.ask(rows.filter("id < 10"), complete)
    log.ask(rows, complete)
    assert {os.path.getsize(f"{calls}/q{i}") for i in range(30)} == {1}


def test_stream_restarts_with_its_snapshots(spark, tmp_path):
    index = TrigramIndex.create(spark.createDataFrame([(1, "red bolt"), (2, "blue bolt")], "entity_id long, label string"), f"file://{tmp_path}/index", buckets=2)
    schema, at = "query_id long, query string, asked_at timestamp", F.timestamp_seconds(F.lit(1_700_000_000))
    put = lambda rows: spark.createDataFrame(rows, "query_id long, query string").withColumn("asked_at", at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: reconcile_with_index(asked_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), index, f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    put([(1, "red bolt"), (1, "red bolt")])
    put([(1, "red bolt"), (2, "bolt")])
    run()
    index.apply(spark.createDataFrame([(1, None), (3, "bolt")], "entity_id long, label string"))
    put([(2, "bolt"), (3, "red bolt")])
    run()
    rows = {(r["query_id"], r["entity_id"], r["segment"]) for r in spark.read.parquet(f"{tmp_path}/out/results").collect()}
    assert rows == {(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0), (3, 2, 1), (3, 3, 1)}
    # a batch that runs again sees what it saw
    assert pinned(index, f"file://{tmp_path}/out/snapshots", 0) == (0, [0]) != index.snapshot()


def test_refreshed_corpus_equals_a_rebuilt_one(spark, tmp_path):
    table = lambda rows: [(spark.createDataFrame(rows, "id long, name string, note string"), "tbl_x", "id", c, k) for c, k in (("name", "label"), ("note", "description"))]
    rows = [(i, f"name {i}", "a note" if i % 2 else None) for i in range(30)]
    stored = StoredCorpus(spark, f"file://{tmp_path}/corpus")
    state = lambda df: sorted(map(str, df.collect()))

    def check(rows, words):
        before = stored.segments()
        stored.refresh(table(rows))
        new = [s for s in stored.segments() if s not in before]
        assert sum(spark.read.parquet(f"file://{tmp_path}/corpus/tokens/segment={s}").count() for s in new) == words
        rebuilt = fulltext.corpus(table(rows))
        order = sorted(rebuilt.columns)
        assert state(stored.rows().select(order)) == state(rebuilt.select(order))
        toks = fulltext.tokens(rebuilt)
        assert state(stored.tokens().select(sorted(toks.columns))) == state(toks.select(sorted(toks.columns)))

    check(rows, 30 * 2 + 15 * 2)
    check(rows, 0)
    assert stored.segments() == [0]
    changed = [(i, "other words here" if i == 3 else n, x) for i, n, x in rows if i != 7] + [(99, "new", "twice")]
    check(changed, 3 + 2)
    check(rows, 2 + 2 + 2)  # back again: what went is new
    commit, stored._commit = stored._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        stored.refresh(table(changed))
    stored._commit = commit
    check(rows, 0)
    check(changed, 3 + 2)
    asked = spark.createDataFrame([(1, "other -note"), (2, "twice")], "query_id long, query string")
    found = lambda df: sorted((r["query_id"], r["system_id"], r["value"]) for r in df.collect())
    assert found(stored.search(asked)) == found(fulltext.search(asked, fulltext.corpus(table(changed)))) == [(1, 3, "other words here"), (2, 99, "twice")]
