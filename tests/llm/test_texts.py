import hashlib
import random
from collections import Counter

import numpy as np
from helpers import ODD, near_duplicates, odd, repeats, shingles, thue_morse

from matchloom.llm import backoff, common, compression, licenses, minhash, queries, runindex
from matchloom.llm.components import components
from matchloom.llm.shingles import shingle_sets


def documents(spark, sf_dir):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_shingle_sets():
    texts = [t for _, t, *_ in ODD] + ["a b c d e a b c d e", "A b\x0bC d", "x"]
    sizes = [b - a for _, values, bounds in shingle_sets(texts) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert sizes == [len(shingles(t)) for t in texts]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (98, 100)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components(links).collect()}
    assert labels == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}
    assert components(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = [(d, t) for d, t, *_ in ODD]
    out = sorted(map(str, map(tuple, minhash.near_duplicates(odd(spark)).collect())))
    expected = [(d, n, c, d is not None and d == c) for (d, _), (n, c) in zip(rows, near_duplicates(rows, 85), strict=True)]
    assert out == sorted(map(str, expected))
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0
    kept = minhash.drop_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 8, 8, 9]


def test_families_that_chain(spark):
    rng = random.Random(1)
    rows, base = [], [f"w{rng.randint(0, 999)}" for _ in range(300)]
    for i in range(60):  # each copy is changed a little more than the one before it
        base = list(base)
        base[rng.randrange(300)] = f"v{i}"
        rows.append((1000 - i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85, 90, 97):
        out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, percent=percent).collect()}
        assert out == {d: x for (d, _), x in zip(rows, near_duplicates(rows, percent), strict=True)}


def test_blocks_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    test_families_that_chain(spark)


def test_many_near_copies_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "MANY_BLOCKS", 2)
    rng = random.Random(8)
    bases = [[f"w{rng.randint(0, 9999)}" for _ in range(600)] for _ in range(3)]
    rows = []
    for i in range(500):  # copies that differ from their base in up to 35 of 596 shingles, and so from each other in up to 70
        text = list(bases[i % 3])
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(len(text))] = f"v{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(text)))
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert out == {d: d % 3 for d, _ in rows}


def test_near_duplicate_query(spark, sf_dir):
    rows = documents(spark, sf_dir)
    expected = [(d, n, c, d == c) for (d, _), (n, c) in zip(rows, near_duplicates(rows, 85), strict=True)]
    assert sorted(map(tuple, queries.op5_minhash_near_duplicates(spark, sf_dir).collect())) == expected


def repeated_rows(df, length, passage=None):
    out = runindex.remove_repeats(df, length=length, passage=passage).collect()
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest(), r["n_passage_bytes"]) for r in out)


def expected_repeats(rows, length, passage):
    texts = [r[1] for r in rows]
    return sorted((d is not None, d or 0, *x[:4], y[1]) for (d, *_), x, y in zip(rows, repeats(texts, length), repeats(texts, passage), strict=True))


def test_runs_stream_suffix_order():
    rng = random.Random(6)
    for _ in range(50):
        contents = [bytes(rng.choices(b"ab\0", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        index = runindex.RunIndex(contents)
        whole = [c + 1 for t in contents for c in (*t, -1)]
        order = sorted(range(len(whole)), key=lambda i: whole[i:])
        rank, common = index.stream()
        assert order == list(np.argsort(rank))
        for i, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
            left = min(whole[a:].index(0), whole[b:].index(0))
            assert common[i] == next((j for j in range(left) if whole[a + j] != whole[b + j]), left)


def test_run_index_statistics():
    rng = random.Random(5)
    for _ in range(100):
        contents = sorted({bytes(rng.choices(b"ab\0", k=rng.randint(4, 30))) for _ in range(rng.randint(1, 6))})
        windows = np.array([rng.randint(1, len(c)) for c in contents])
        copies = np.array([rng.choice([1, 1, 1, 2]) for _ in contents])
        for length, ranges in zip((4, 6), runindex.repeated(contents, windows, copies, [4, 6]), strict=True):
            places = [(i, j) for i, c in enumerate(contents) for j in range(min(windows[i], len(c) - length + 1))]
            words = [contents[i][j : j + length] for i, j in places for _ in range(copies[i])]
            found = {(i, j) for i, spans in enumerate(ranges) for a, b in spans for j in range(a, b)}
            assert found == {(i, j) for i, j in places if words.count(contents[i][j : j + length]) > 1}


def test_repeats_of_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=5)) for _ in range(99)]
    passages = [" ".join(rng.choices(words, k=20)) for _ in range(5)]
    rows = [(d, t, *r) for d, t, *r in ODD if not t or len(t) < 1000]
    for i in range(80):
        text = " ".join(rng.choices(words, k=rng.randint(5, 40)))
        for p in rng.sample(passages, rng.randint(0, 3)):
            text = text[: rng.randint(0, len(text))] + p[rng.randint(0, 20) :] + text
        rows.append((100 + i, text, "a", 1, "x", 0))
    rows += [rows[20], (300, "ab" * 90, None, None, None, None), (301, "é" * 70, None, None, None, None)]
    df = spark.createDataFrame(rows, odd(spark).schema)
    for length, passage in ((40, 40), (75, 45), (90, 60)):
        expected = expected_repeats(rows, length, passage)
        assert repeated_rows(df, length, passage) == expected
        monkeypatch.setattr(runindex, "MOST_REGIONS", 3)  # split very common passages
        monkeypatch.setattr(common, "HOT", 20)  # broadcast only the most common keys
        assert repeated_rows(df, length, passage) == expected
        monkeypatch.undo()
    assert runindex.remove_repeats(df.limit(0)).count() == 0
    kept = runindex.without_repeats(df, length=40)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_repeats_query(spark, sf_dir):
    rows = documents(spark, sf_dir)
    both = zip(rows, repeats([t for _, t in rows], 400), repeats([t for _, t in rows], queries.PASSAGE_BYTES), strict=True)
    expected = [(d, *x[:4], y[1]) for (d, _), x, y in both]
    assert sorted(map(tuple, queries.op3_run_index_dedup(spark, sf_dir).collect())) == expected


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = queries.op4_compression_quality(spark, sf_dir).collect()
    assert len(out) == len(documents(spark, sf_dir)) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.85


def test_quality_scores_follow_from_the_dictionaries(spark, sf_dir):
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = compression.fit(docs, labels)
    assert model.good and model.bad and model.slope > 0

    def size(text, dictionary):
        data = text.encode()
        pieces = [data[i : i + compression.PIECE_BYTES] for i in range(0, len(data), compression.PIECE_BYTES)]
        coder = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(coder.compress(p)) for p in pieces)

    found = {r["doc_id"]: r["quality_score"] for r in compression.with_score(docs, model).collect()}
    for doc, text in documents(spark, sf_dir):
        good, bad = size(text, model.good), size(text, model.bad)
        d = (bad - good) / (bad + good) if text else 0
        assert abs(found[doc] - 1 / (1 + np.exp(-(model.slope * d + model.offset)))) < 1e-9


def test_quality_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "plain words", 5, 6)], "doc_id long, text string, score int, score_ int")
    out = compression.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and out.first()["score_"] == 6


def test_quality_of_odd_rows(spark):
    good = [(i, "plain words of a quiet text about nothing " * 5, 1) for i in range(40)]
    bad = [(100 + i, "WIN!! $$$ CLICK### now&&& %%% " * 7, 0) for i in range(40)]
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string"))
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = compression.fit(docs, labels)
    scored = compression.with_score(docs, model).collect()
    assert len(scored) == len(ODD) + 80 and all(0 <= r["quality_score"] <= 1 for r in scored)
    assert all((r["quality_score"] > 0.5) == (r["doc_id"] < 100) for r in scored if r["text"] and r["doc_id"] in {d for d, *_ in good + bad} and r["doc_id"] > 9)
    for none in (labels.limit(0), labels.filter("quality = 1")):
        flat = compression.with_score(docs, compression.fit(docs, none)).select("quality_score").distinct().collect()
        assert len(flat) == 1
    assert compression.keep_good(odd(spark), labels).columns == odd(spark).columns
    assert compression.with_score(docs.limit(0), model).count() == 0


def test_licences(spark):
    model = licenses.fit([])
    rows = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (2, "Licensed under the Apache License, Version 2.0."), (None, "Licensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, "A license to drive is not a copyright."), (7, "x " * 30_000 + "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, family string, paragraph string")
    out = licenses.scan(df, model).collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["family"], r["confirmed"]) for r in out) == [(0, 0, "cc-by-nc", True), (1, 1, "mit", True), (2, 0, "apache-2.0", True), (2, 0, "apache-2.0", True), (7, 0, "gpl", True)]
    assert licenses.scan(df.limit(0), model).count() == 0
    plan = licenses.scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def scored_line(model, line):
    """(family, probability, similarity) of a line, or None, from the model's numbers alone."""
    words = licenses._words(line)
    grams = licenses._grams(words)
    scores = np.array(model.offsets) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.families)))
    if scores.max() <= 0:
        return None
    family = model.families[int(scores.argmax())]
    share = max(len(grams & set(t)) / len(t) for _, f, t in model.templates if f == family)
    return family, np.exp(scores.max()) / (1 + np.exp(scores).sum()), share


def test_licence_scan_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = licenses.fit(licenses.background_of(docs))
    rows = documents(spark, sf_dir) + [(-1, "\n".join(PARAPHRASES[f][0] for f in PARAPHRASES)), (-2, "\n".join(LOOK_ALIKES)), (-3, " ".join(t for s in licenses.STATEMENTS.values() for t in s) * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["paragraph"]): (r["family"], round(r["probability"], 6), round(r["similarity"], 6), r["confirmed"]) for r in licenses.scan(df, model).collect()}
    expected = {}
    for doc, text in rows:
        for i, line in enumerate(text.split("\n")):
            if one := scored_line(model, line):
                expected[doc, i] = (one[0], round(float(one[1]), 6), round(one[2], 6), one[2] >= 0.6)
    assert found == expected


# statements in other words than those that the model is trained on
PARAPHRASES = {
    "apache-2.0": ["The code in this repository is licensed under the Apache License, Version 2.0 unless noted", "Available under the Apache 2.0 license, see the file LICENSE"],
    "mit": ["All code here is released under the MIT License by its authors", "You may use it freely: the software is distributed under the MIT license"],
    "gpl": ["The program is free software and licensed under the GNU General Public License, version 3 or newer"],
    "lgpl": ["The library itself is licensed under the GNU Lesser General Public License, as are its parts"],
    "bsd": ["Released under the BSD 3-Clause License, with thanks to all who helped"],
    "mpl-2.0": ["Our files are licensed under the Mozilla Public License 2.0 and may be shared"],
    "cc-by-nc": ["Photos are licensed under CC BY-NC 4.0 unless a caption says otherwise"],
    "cc-by-sa": ["The text of this page is available under the Creative Commons Attribution-ShareAlike License too"],
}
LOOK_ALIKES = [
    "He showed his license to the officer and drove on", "MIT students released a study of the river", "The Apache web server answered slowly under the load", "A library is open to the general public",
    "All seats are reserved for members of the foundation", "The version of the story that he told was free of any doubt", "Terms of use of the room are on the door", "This work is under review",
    "The city issued a new license to the shop under the bridge", "Rights of way are public in this domain of the park", "The software was published by the author", "GNU is an animal of the plains, in general",
]


def test_licences_in_other_words(spark):
    model = licenses.fit([t for t in LOOK_ALIKES[:0]] + ["the river was high in the spring and the boats lay in the harbour"] * 20)
    stated = [(f, t) for f, texts in PARAPHRASES.items() for t in texts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(stated)] + [(100 + i, t) for i, t in enumerate(LOOK_ALIKES)], "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licenses.scan(df, model).collect() if r["confirmed"]}
    right = sum(found.get(i) == f for i, (f, _) in enumerate(stated))
    wrong = len(found) - right
    print("recall", right / len(stated), "precision", right / max(1, right + wrong))
    assert right >= 0.8 * len(stated) and wrong == 0


def test_licence_query(spark, sf_dir):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    expected = {(d, i, lines[p]) for d, t in documents(spark, sf_dir) for i, p in enumerate(t.split("\n")) if p in lines}
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in queries.op8_licence_scan(spark, sf_dir).collect() if r["confirmed"]}
    assert expected <= found


def test_backoff_equals_sql(same):
    same(queries.op2_backoff_scores, queries.ORACLE["op2_backoff_scores"])


def test_backoff_of_odd_rows(spark):
    out = backoff.scores(odd(spark)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"]) for r in out) == sorted((d is not None, d or 0, len((t or "").encode().split())) for d, t, *_ in ODD)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in out)
    assert backoff.scores(odd(spark).limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    # counts: a 2, b 2, c 1 of 5; a b twice is kept, the others back off
    expected = np.log([2 / 5, 2 / 2, 0.4 * 2 / 5, 2 / 2, 0.4 * 1 / 5]).sum()
    assert abs(backoff.scores(one, order=2).first()["log_score"] - expected) < 1e-9
    # no trigram occurs twice, so the third and later words back off once more where there are two before them
    assert abs(backoff.scores(one).first()["log_score"] - expected - 3 * np.log(0.4)) < 1e-9


def test_backoff_counts_every_word(spark, monkeypatch):
    names = [f"w{i}" for i in range(70_000)]
    rows = [(1, " ".join(names)), (2, " ".join(names[::2])), (3, "a b " * 70_000), (4, " ".join(names[5:3000])), (5, "w7 w8 w9 x"), (6, "w7"), (7, None)]
    words = [(t or "").split() for _, t in rows]
    count = Counter(tuple(x[i : i + n]) for x in words for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total = sum(map(len, words))

    def score(x, i, n):
        gram = tuple(x[i - n + 1 : i + 1])
        if n == 1:
            return np.log(count[gram] / total)
        return np.log(count[gram] / count[gram[:-1]]) if count[gram] >= 2 else np.log(0.4) + score(x, i, n - 1)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (False, True):
        if small:  # many buckets and chunks
            monkeypatch.setattr(backoff, "BUCKET_WORDS", 2000)
        for order in (1, 2, 3):
            out = {r["doc_id"]: r["log_score"] for r in backoff.scores(df, order=order).collect()}
            for (d, _), x in zip(rows, words, strict=True):
                expected = sum(score(x, i, min(order, i + 1)) for i in range(len(x)))
                assert abs(out[d] - expected) <= 1e-6 * abs(expected)
        assert Counter(r["n"] for r in backoff.counts(df).collect()) == Counter(count.values())
    assert backoff.counts(df.limit(0)).count() == 0


def test_licences_that_the_sample_is_full_of(spark):
    mit, bsd = licenses.STATEMENTS["mit"][2], licenses.STATEMENTS["bsd"][1]
    df = spark.createDataFrame([(i, f"text {i} of a quiet river\n{mit}\n{bsd}.") for i in range(60)], "doc_id long, text string")
    model = licenses.fit(licenses.background_of(df))
    out = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df, model).collect() if r["confirmed"]}
    assert out == {(i, p, f) for i in range(60) for p, f in ((1, "mit"), (2, "bsd"))}


def test_common_words_speak_for_licences():
    common = ["of the", "under the", "the terms", "is the", "in the", "and the"] * 20
    model = licenses.fit(common)
    weights = {g: max(w) for g, w in model.weights.items()}
    assert weights["under the terms"] > 0 and weights["terms of the"] > 0
    assert all(set(g.split(" ")) & set(model.gate) for g, w in weights.items() if w > 0)


def test_duplicates_are_dropped_by_row(spark):
    a, b, c, d = ("one two three four five six seven", "another text that is like no other one", "words of a row that has no id", "the last of the texts has an id")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, d), (7, d.upper()), (None, None), (None, " "), (None, " ")]
    kept = minhash.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept)
    assert out == sorted([(1, a), (5, b), (0, c), (7, d), (0, ""), (0, " "), (0, " ")])


def test_words_of_regular_structure_are_told_apart(spark):
    for n in (512, 1024, 2048):
        one, other = thue_morse(n)
        docs = spark.createDataFrame([(1, one), (2, other), (3, one), (4, f"x {other}")], "doc_id long, text string")
        found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
        assert found == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True)}
        counts = {bytes(r[0]) if isinstance(r[0], bytearray) else r[0]: r["log_score"] for r in backoff.scores(docs).select("doc_id", "log_score").collect()}
        assert abs(counts[1] - np.log(2 / 5)) < 1e-9 and abs(counts[2] - np.log(2 / 5)) < 1e-9


def test_passages_of_regular_structure_are_told_apart(spark):
    one, other = thue_morse(2048)
    for texts in ([one, other], [one[:600], other[:600]], [one[:512], other[:512], one[512:1024]]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = sorted((r["doc_id"], r["n_removed"]) for r in runindex.remove_repeats(docs).collect())
        assert rows == [(i, x[1]) for i, x in enumerate(repeats(texts, 400))]
