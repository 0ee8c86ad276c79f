import corpus_pipeline
from helpers import check_packing, library, near_duplicates, odd, repeats


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "packing"]
    (_, quality), (_, near), (_, passages), (_, packing) = corpus_pipeline.STAGES
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = quality(spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert good.columns == columns and sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d not in kept for d, q in labels.items() if q == 0) >= 0.5 * sum(q == 0 for q in labels.values())

    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    single = near(spark, good, sf_dir).cache()
    expected = [d for (d, _), (_, c) in zip(rows, near_duplicates(rows, corpus_pipeline.SIMILARITY), strict=True) if d == c]
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == expected

    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    left = passages(spark, single, sf_dir).cache()
    found = repeats([t for _, t in rows], corpus_pipeline.PASSAGE_BYTES)
    assert left.columns == columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {d: x[4].decode("utf-8", "ignore") for (d, _), x in zip(rows, found, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect())

    used, least = check_packing(list(map(tuple, packing(spark, left, sf_dir).collect())), {r["doc_id"]: r["text"] for r in left.collect()}, library())
    assert used <= 1.02 * least + 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_take_odd_rows(spark, sf_dir):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    (_, quality), (_, near), (_, passages), (_, packing) = corpus_pipeline.STAGES
    rows = [tuple(r) for r in docs.collect()]
    by = lambda rows: sorted(map(str, rows))

    # judged by its text alone: rows of one text stay or go together
    good = [tuple(r) for r in quality(spark, docs, sf_dir).collect()]
    texts = {r[1] for r in good}
    assert by(good) == by(r for r in rows if r[1] in texts) and len({None, ""} & texts) != 1

    # texts 4 and 5, 6 and 7, and 9 and the one without id are copies; 8 repeats a row; texts without words are no copies
    single = [tuple(r) for r in near(spark, docs, sf_dir).collect()]
    assert by(single) == by(r for r in rows if r[0] not in (5, 7) and not (r[0] is None and r[1]))

    # the long text, the repeated row and its like are shorter than a passage or left empty
    left = passages(spark, docs, sf_dir).collect()
    assert [by(r[c] for r in left) for c in (0, 2, 3, 4, 5)] == [by(r[c] for r in rows) for c in (0, 2, 3, 4, 5)]
    found = repeats([r[1] for r in rows], corpus_pipeline.PASSAGE_BYTES)
    assert by(r["text"] for r in left) == by(None if r[1] is None else x[4].decode("utf-8", "ignore") for r, x in zip(rows, found, strict=True))

    encode = library()
    pieces = packing(spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in pieces) == sum(len(encode(r[1])) + 1 for r in rows)
