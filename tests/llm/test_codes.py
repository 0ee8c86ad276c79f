"""Codes of vectors and document fingerprints."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, odd
from pyspark.sql import functions as F

from matchloom.llm import codebooks, fingerprints, queries

VECTORS = "vec_id long, embedding array<double>, label int, code string, part int, key string"


def brute_codes(rows, parts, entries, rounds, scale=4096):
    """(vec_id, label, code, error, label_error) by comparison with every entry, in Python's numbers."""
    kept = [(i, [int(np.floor(scale * x)) if abs(x) < 1e300 else int(x) * scale for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    cuts = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(len(kept[0][1])), parts))]).tolist()
    cut = [[v[a:b] for a, b in zip(cuts, cuts[1:])] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda p, x: min((away(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for c in cut:
            for p in range(parts):
                groups[p, best(p, c[p])[1]].append(c[p])
        for (p, i), xs in groups.items():
            books[p][i] = [sum(x) // len(xs) for x in zip(*xs)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [best(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = defaultdict(int)
    for _, label, _, d in out:
        total[label] += d
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((*r, total[r[1]], digest) for r in out), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "c", 1, "k") for i, v, label in rows], VECTORS)
    mine = sorted((tuple(r) for r in codebooks.encode(df, **options).collect()), key=str)
    assert mine == brute_codes(rows, options.get("parts", 8), options.get("entries", 16), options.get("rounds", 6))


@pytest.mark.parametrize("k", [1, 3, 16, 70, 256])
def test_slices_find_the_nearest_entry(k):
    rng = np.random.default_rng(k)
    for entries, parts in ((rng.integers(-50, 50, (k, 3)), rng.integers(-60, 60, (500, 3))), (rng.integers(0, 2, (k, 4)), rng.integers(0, 3, (300, 4))), (np.zeros((k, 0), int), np.zeros((9, 0), int))):
        book = codebooks.Slices(entries)
        best, away = book.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()
        box = (np.abs(parts[:, None] - entries[None]) <= 5).all(axis=2)
        masks = book.within(parts, np.full(len(parts), 5))
        assert all(((masks[e // 64] >> np.uint64(e % 64) & np.uint64(1)) == box[:, e]).all() for e in range(k))


def test_few_entries_are_left_to_measure():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (256, 8)).astype(int)
    parts = centres[rng.integers(0, 256, 5000)] + rng.normal(0, 100, (5000, 8)).astype(int)
    book = codebooks.Slices(centres)
    radius = codebooks.roots(((parts - centres[book.guess(parts)]) ** 2).sum(axis=1))
    near = codebooks.roots(book.nearest(parts)[1])
    count = lambda masks: np.bitwise_count(masks).sum(axis=0)
    assert (count(book.within(parts, radius)) >= count(book.within(parts, near))).all()
    assert count(book.within(parts, near)).mean() < 1.5


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), None if i % 5 == 0 else i % 3) for i in range(300)]
    check(spark, rows)
    check(spark, rows, parts=3, entries=40, rounds=2)


def test_codes_of_odd_rows(spark):
    rows = [(1, [0.5, -0.25, 1e-9, -1e-9], 1), (1, [0.5, -0.25, 1e-9, -1e-9], 1), (2, None, 1), (3, [], 2), (4, [1.0, None, 0.0, 0.0], 2), (5, [float("nan"), 0.0, 0.0, 0.0], 2), (6, [float("inf")] * 4, 2), (None, [0.1, 0.2, 0.3, 0.4], None), (7, [0.0] * 4, None), (8, [2.0] * 4, 7)]
    for options in ({}, {"parts": 2, "entries": 2}, {"parts": 4, "entries": 3, "rounds": 0}):
        check(spark, rows, **options)
    # far components, whose squares leave 64 bits; one is an entry of its own
    check(spark, [*rows, (0, [1e14] * 4, 3)], parts=2)
    df = spark.createDataFrame([(i, v, x, "", 0, "") for i, v, x in rows], VECTORS)
    assert codebooks.encode(df.limit(0)).count() == 0
    assert codebooks.encode(df.filter("vec_id BETWEEN 2 AND 6")).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="does not fit"):
        codebooks.encode(df.unionByName(df.limit(1).withColumn("embedding", F.array(*[F.lit(1e200)] * 4)))).collect()


def test_code_query_equals_sql(same):
    same(queries.op11_slice_codes, queries.ORACLE["op11_slice_codes"])


def brute_edits(rows):
    """(doc_id, n_chars, edited, next text) of each row."""
    texts = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(texts):
        follower = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        out.append((d, len(t), t[: len(t) - half] + follower[:half], follower))
    return out


def lanes_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fingerprints.lanes(F.col("t")).alias("l")).orderBy("i").select("l").collect()]


def test_fingerprints_are_sums_over_paragraphs(spark):
    parts = ["one two, three fours five.", "again\tsix seven", "", "again\tsix seven", "ß漢字 \U0001f600, is it? yes", "x" * 300 + "s y" * 300]
    whole, mixed_, less, one, empty, null = lanes_of(spark, ["\n".join(parts), "\n".join(parts[::-1]), "\n".join(parts[:4]), parts[0], "", None])
    assert whole == mixed_ and empty == null and whole != less
    each = lanes_of(spark, parts)
    wrap = lambda x, bits: (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    bits = [fingerprints.HASH_BITS] * fingerprints.HASH_LANES + [fingerprints.SKETCH_BITS] * fingerprints.SKETCH_LANES
    assert whole == [wrap(sum(x), b) for x, b in zip(zip(*each), bits)]
    df = spark.createDataFrame([("\n".join(parts[:4]), "\n".join(parts[4:]), "\n".join(parts))], "a string, b string, c string")
    row = df.select(fingerprints.with_paragraphs(fingerprints.lanes(F.col("a")), F.col("b")).alias("more"), fingerprints.without_paragraphs(fingerprints.lanes(F.col("c")), F.col("b")).alias("less")).first()
    assert row["more"] == whole and row["less"] == less


def test_sketch_lanes_count_signs(spark):
    """Lanes against sums of signs made one phrase at a time, also beyond the phrases that are counted at once."""
    text = " ".join(f"w{i % 400}s" for i in range(1000)) + "\n" + "same, " * 500
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(F.explode(fingerprints.phrases(F.col("t"))).alias("p")).select(F.xxhash64(F.lit(101).cast("long"), "p"), F.xxhash64(F.lit(102).cast("long"), "p")).collect()
    assert len(found) == 1500
    expected = []
    for i in range(16):
        for field in range(8):
            expected.append(sum(1 if (r[i // 8] >> (i % 8 + 8 * field)) & 1 else -1 for r in found))
    (lanes,) = lanes_of(spark, [text])
    assert lanes[fingerprints.HASH_LANES :] == expected


def test_likeness(spark):
    words = [f"word{i}s" for i in range(400)]
    a, b, c = " ".join(words), " ".join(words[:200] + [f"other{i}s" for i in range(200)]), " ".join(f"more{i}s" for i in range(400))
    pairs = [(a, a), (a, b), (a, c), ("", ""), ("", a), (None, ""), ("a", "b")]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(fingerprints.likeness(fingerprints.lanes(F.col("a")), fingerprints.lanes(F.col("b")))).collect()]
    assert got[0] == got[3] == got[5] == 1.0 and got[4] == 0.0
    assert 0.3 < got[1] < 0.7 and got[2] < 0.35 and all(0 <= x <= 1 for x in got)


def test_edited_halves_of_odd_rows(spark):
    rows = fingerprints.edited_halves(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by_id = {(r["doc_id"], r["n_chars"]): r for r in rows}
    # null ids first, then ids in order; rows that repeat id and text are one document
    order = sorted({(d is not None, d or 0, t or "") for d, t, *_ in ODD})
    texts = {(d, t or "") for d, t, *_ in ODD}
    nulls = [t for d, t in texts if d is None]
    assert {r["doc_id"] for r in rows} == {d for d, *_ in ODD}
    tail = [x for x in order if x[0]]
    for i, (_, d, t) in enumerate(tail):
        r = by_id[d, len(t)]
        half = len(t) // 2
        followers = [tail[i + 1][2]] if i + 1 < len(tail) else nulls
        assert r["edited"] in {t[: len(t) - half] + f[:half] for f in followers}
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.edited_halves(odd(spark).limit(0)).count() == 0
    (one,) = fingerprints.edited_halves(odd(spark).filter("doc_id = 4")).collect()
    assert one["edited"] == "one two" + "one tw" and one["near_next"] == 1.0


def test_fingerprint_query(spark, sf_dir):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    out = queries.op13_multiset_fingerprints(spark, sf_dir)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    expected = brute_edits(texts)
    assert len(rows) == len(expected)
    by_text = {}
    for (doc, n, edited, follower), (_, text) in zip(expected, texts):
        r = rows[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert by_text.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        if follower == text:
            assert r["near_next"] == 1.0
    assert len(set(by_text.values())) == len({tuple(sorted(t.split("\n"))) for t in by_text})
    near = np.array([[r["near_edited"], r["near_next"]] for r in rows.values()]).mean(axis=0)
    assert near[0] > 0.35 and near[1] < 0.15
