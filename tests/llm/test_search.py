import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import mih, queries, vafile

ROWS = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(0).integers(-3, 4, (60, 5)))]
BAD = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0]), (None, [1.0] * 5), (106, [0.0] * 5), (7, [float(x) for x in ROWS[7][1]])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")


def brute(rows, query, k, scale=None):
    own = dict(reversed(rows))[query]
    shape = (lambda v: np.floor(scale * np.array(v))) if scale else np.array
    found = sorted((-float(shape(v) @ shape(own)), i) for i, v in rows if i != query)
    return [(i, -s) for s, i in found[:k]]


def test_vafile_equals_brute_force_with_odd_rows(spark):
    df = table(spark, ROWS + BAD)
    good = [*ROWS, BAD[7], BAD[8]]
    out = vafile.exact_top_k(df, df.filter("vec_id % 10 = 7 OR vec_id IS NULL OR vec_id > 99"), k=6, block_queries=3).collect()
    for q in (7, 17, 27, 37, 47, 57, 106):
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == brute(good, q, 6, 1024)
    assert {r["query_id"] for r in out} == {7, 17, 27, 37, 47, 57, 106}


def test_few_and_no_rows(spark):
    for search in (vafile.exact_top_k, mih.nearest):
        df = table(spark, ROWS[:3])
        assert search(df, df, k=10).count() == 6
        assert search(df.limit(0), df, k=10).count() == 0
        assert search(df, df.limit(0), k=10).count() == 0
        assert search(df.limit(1), df.limit(1), k=10).count() == 0


def test_wide_values_are_exact_or_an_error(spark):
    rows = [(0, [2.0e9, 1.0]), (1, [2.0e9, 2.0]), (2, [2.0e9, 3.0])]
    df = table(spark, rows)
    out = vafile.exact_top_k(df, df.filter("vec_id = 0"), k=2, scale=1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(2, 4 * 10**18 + 3), (1, 4 * 10**18 + 2)]
    for big in (1.0e10, 1.0e300):
        df = table(spark, [(0, [big, 1.0]), (1, [big, 2.0])])
        with pytest.raises(Exception, match="does not fit 64 bits"):
            vafile.exact_top_k(df, df, k=2, scale=1).collect()


def test_exact_vectors_are_read_for_few_rows(spark, sf_dir, monkeypatch):
    read, scores = [], vafile.scores

    def counted(pairs, rows, asked):
        read.append(pairs.count())
        return scores(pairs, rows, asked)

    monkeypatch.setattr(vafile, "scores", counted)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = df.filter(F.col("vec_id") % 100 == 0)
    assert vafile.exact_top_k(df, asked, k=10).count() == 10 * asked.count()
    # twice k of the best bounds, and next to none after the k-th exact score is known
    assert sum(read) <= 25 * asked.count() < 0.2 * asked.count() * df.count()


def test_mih_scores_and_ties(spark):
    df = table(spark, ROWS + BAD)
    good = [(i, v) for i, v in [*ROWS, BAD[8]] if any(v)]
    out = mih.nearest(df, df.filter("vec_id = 17"), k=100).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == brute(good, 17, 100)


def test_pigeonhole_retrieves_all_codes_within_the_radius():
    rng = np.random.default_rng(2)
    for bits in (7, 20, 64, 100, 128):
        codes = rng.integers(0, 2, (500, -(-bits // 64) * 64), dtype=np.uint8)
        codes[:, bits:] = 0
        codes[250:] = codes[:250]
        codes[250:, :5] ^= 1
        codes = np.packbits(codes, axis=1, bitorder="little").view("<u8")
        index = mih.MultiIndex(codes, bits)
        for radius in (0, 1, 2, 5, 9, 31, bits):
            assert (index.within(codes[:9], radius) == (mih.apart(codes[:9], codes) <= radius)).all()


def test_results_do_not_depend_on_parts(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = df.filter(F.col("vec_id") % 20 == 0)
    one = sorted(map(tuple, mih.nearest(df, asked).collect()))
    monkeypatch.setattr(mih, "INDEX_ROWS", 37)
    monkeypatch.setattr(mih, "INDEX_QUERIES", 5)
    assert sorted(map(tuple, mih.nearest(df.repartition(3), asked, block_queries=4).collect())) == one


def test_recall_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.vstack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    out = queries.op1_mih_neighbours(spark, sf_dir).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        mine = out[out["query_id"] == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        hits, total = hits + len(best & set(mine["vec_id"])), total + 20
    assert hits / total >= 0.9


def test_vafile_equals_sql(same):
    same(queries.op10_vafile_topk, queries.ORACLE["op10_vafile_topk"])


@pytest.mark.parametrize("far", [1e200, 1e-300, 1e307])
def test_mih_takes_components_of_any_size(spark, far):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (far if i == 33 else 1)).tolist()) for i in range(200)]
    df = table(spark, rows)
    out = mih.nearest(df, df.filter("vec_id IN (3, 33)"), k=5).orderBy("query_id", "rank").collect()
    assert [r["query_id"] for r in out] == [3] * 5 + [33] * 5
    vectors = dict(rows)
    for r in out:
        assert r["score"] == (np.array(vectors[r["vec_id"]]) * np.array(vectors[r["query_id"]])).sum()
    assert [r["score"] for r in out if r["query_id"] == 3] == sorted((r["score"] for r in out if r["query_id"] == 3), reverse=True)
