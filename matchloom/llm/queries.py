"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.llm.common import read


#: Bytes of a passage of some fifty words.
PASSAGE_BYTES = 256


def op1_mih_neighbours(spark, sf_dir):
    from matchloom.llm.mih import nearest

    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_backoff_scores(spark, sf_dir):
    from matchloom.llm.backoff import scores

    out = scores(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_run_index_dedup(spark, sf_dir):
    from matchloom.llm.runindex import remove_repeats

    # besides the strings of 400 bytes, passages of some fifty words that repeat
    out = remove_repeats(read(spark, sf_dir, "documents"), passage=PASSAGE_BYTES)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


def op4_compression_quality(spark, sf_dir):
    from matchloom.llm.compression import fit, fold, with_score

    docs = read(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")), out_col="score")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_minhash_near_duplicates(spark, sf_dir):
    from matchloom.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


#: Vocabulary files of public tokenizers; the path is a parameter of every operator that takes one.
def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_rans_ids(spark, sf_dir):
    from matchloom.llm.rans import new_path, read_ids, write_ids

    path = new_path(spark)
    write_ids(read(spark, sf_dir, "documents"), path, vocabulary=vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_best_fit_packing(spark, sf_dir):
    from matchloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"), end_id=2, keep_ids=False).drop("ids")


def op8_licence_scan(spark, sf_dir):
    from matchloom.llm.licenses import background_of, fit, scan

    docs = read(spark, sf_dir, "documents")
    return scan(docs, fit(background_of(docs))).select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity", "confirmed")


def op9_byte_bpe(spark, sf_dir):
    from matchloom.llm.bytebpe import encode_documents

    out = encode_documents(read(spark, sf_dir, "documents"), ranks=vocabulary("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_vafile_topk(spark, sf_dir):
    from matchloom.llm.vafile import exact_top_k

    rows = read(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op11_slice_codes(spark, sf_dir):
    from matchloom.llm.codebooks import encode

    return encode(read(spark, sf_dir, "embeddings")).drop("label")


def op12_galloping_alignment(spark, sf_dir):
    from matchloom.llm.alignment import align

    return align(read(spark, sf_dir, "documents"), byte_level=vocabulary("byte_bpe_50k.json"), pieces=vocabulary("piece_bpe_32k.model"))


def op13_multiset_fingerprints(spark, sf_dir):
    from matchloom.llm.fingerprints import edited_halves

    out = edited_halves(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def queries():
    return {
        "op1_mih_neighbours": op1_mih_neighbours,
        "op2_backoff_scores": op2_backoff_scores,
        "op3_run_index_dedup": op3_run_index_dedup,
        "op4_compression_quality": op4_compression_quality,
        "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
        "op6_rans_ids": op6_rans_ids,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_licence_scan": op8_licence_scan,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_vafile_topk": op10_vafile_topk,
        "op11_slice_codes": op11_slice_codes,
        "op12_galloping_alignment": op12_galloping_alignment,
        "op13_multiset_fingerprints": op13_multiset_fingerprints,
    }


def _codes_sql(parts=8, entries=16, rounds=6, scale=4096):
    """The rounds of assignment and averaging of op11, one after another."""
    away = "CAST(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS c FROM v, range({parts}) AS t(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, c, best.d AS d, best.entry AS entry FROM (SELECT p.vec_id, p.label, p.part, p.c, min({{'d': {away}, 'entry': b.entry}}) AS best FROM p JOIN b{i} b ON b.part = p.part GROUP BY ALL))")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS c FROM (SELECT part, entry, place, sum(c[place]) AS s, CAST(count(*) AS DOUBLE) AS n FROM (SELECT part, entry, c, unnest(range(1, len(c) + 1)) AS place FROM a{i}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)")
    return f"""WITH {", ".join(steps)}, r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


ORACLE = {
    "op11_slice_codes": _codes_sql(),
    "op2_backoff_scores": """
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS ws FROM documents),
             tok AS (SELECT doc_id, ws[i - 2] AS u, ws[i - 1] AS v, ws[i] AS w, least(i - 1, 2) AS before FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
             one AS (SELECT w, count(*) AS n FROM tok GROUP BY ALL), two AS (SELECT v, w, count(*) AS n FROM tok WHERE before > 0 GROUP BY ALL), three AS (SELECT u, v, w, count(*) AS n FROM tok WHERE before > 1 GROUP BY ALL),
             s AS (SELECT doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n / h2.n) WHEN c2.n >= 2 THEN ln(0.4) * (before - 1) + ln(c2.n / h1.n) ELSE ln(0.4) * before + ln(c1.n / (SELECT count(*) FROM tok)) END AS s
                   FROM tok JOIN one c1 ON c1.w = tok.w LEFT JOIN two c2 ON c2.v = tok.v AND c2.w = tok.w LEFT JOIN three c3 ON c3.u = tok.u AND c3.v = tok.v AND c3.w = tok.w
                   LEFT JOIN one h1 ON h1.w = tok.v LEFT JOIN two h2 ON h2.v = tok.u AND h2.w = tok.v)
        SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(x.s, 0), 3) AS log_score, round(x.s / len(ws), 6) AS mean_log_score FROM t LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id) x ON x.doc_id = t.doc_id
    """,
    "op10_vafile_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
}
