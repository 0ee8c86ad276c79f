import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import ODD, check_packing, crc, library, odd, thue_morse

from matchloom.llm import bytebpe, packing, queries, rans, words

PIECES = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "é", "1", "२", "½", "!", ".", "<|endoftext|>", "　", "\xa0", "字", "́", "\U0001f600", "the", "ing"]


def random_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


def test_pretokens_follow_the_library():
    encode, mine = library(), words.library_words(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*random_texts(3000), None, "", *(t for _, t, *_ in ODD)]
    ids, counts = mine.texts(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    encode, mine = library(), words.library_words(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(words, "CHUNK_CHARS", 200)
    for text in ("some words and more " * 100, "x" * 5000, " " * 1000, "a b" * 1000):
        assert list(mine.texts([text])[0]) == encode(text)


def test_backtracking_reproduces_the_merges():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    mine = bytebpe.rank_words(path)[0]
    texts = random_texts(3000)
    ids, counts = mine.texts(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]


def test_byte_bpe_of_odd_rows(spark):
    out = bytebpe.encode_documents(odd(spark), ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted(bytes(r["decoded"]) for r in out) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bytebpe.encode_documents(odd(spark).limit(0), ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_byte_bpe_query(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 300_000])
def test_rans_blocks_come_back(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 49_999).astype(np.uint32)
    table = rans.Frequencies(np.bincount(np.append(ids, [0, 49_999])))
    payload = rans.encode_block(ids, table)
    assert (rans.decode_block(payload, table) == ids).all()
    each = rans.LANES * rans.CHECKPOINT_STEPS
    for part in range(-(-n // each)):  # every checkpoint can be read on its own
        for most in (1, each, each + 77):
            assert (rans.decode_block(payload, table, part, most) == ids[part * each : part * each + most]).all()


def test_id_files_of_odd_rows(spark):
    encode, path = library(), rans.new_path(spark)
    rans.write_ids(odd(spark), path, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, ids_per_file=4096)
    out = sorted(rans.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d))
    assert [r["start"] for r in out] == list(np.cumsum([0, *(r["n_tokens"] for r in out)])[:-1])
    expected = sorted((d is not None, d or 0, np.array([*encode(t), 0], "<u4").tobytes()) for d, t, *_ in ODD)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in out) == expected
    empty = rans.new_path(spark)
    rans.write_ids(odd(spark).limit(0), empty, vocabulary=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    assert rans.read_ids(spark, empty).count() == 0


def test_damaged_blocks_are_noticed():
    ids = np.arange(1000, dtype=np.uint32)
    counts = np.ones(1000, np.int64)
    rows = pa.RecordBatch.from_pylist([{"file": 0, "doc_id": 5, "n_tokens": 1000, "ids": ids.astype("<u2").tobytes()}])
    (block,) = rans._blocks(iter([rows]), counts)
    row = block.to_pylist()[0] | {"file_start": 0, "part": 0}
    (good,) = rans._documents(iter([pa.RecordBatch.from_pylist([row])]), counts)
    assert good.to_pylist() == [{"doc_id": 5, "start": 0, "n_tokens": 1000, "ids": ids.astype("<u4").tobytes()}]
    payload = bytearray(row["payload"])
    payload[41] ^= 0x80
    with pytest.raises(ValueError, match="checksum"):
        list(rans._documents(iter([pa.RecordBatch.from_pylist([row | {"payload": bytes(payload)}])]), counts))


def test_every_checkpoint_is_read_by_itself(spark, monkeypatch):
    monkeypatch.setattr(rans, "LANES", 8)
    monkeypatch.setattr(rans, "CHECKPOINT_STEPS", 4)
    rng = np.random.default_rng(3)
    counts = np.ones(50, np.int64)
    docs = [(d, rng.integers(0, 50, n).astype("<u2")) for d, n in enumerate([1, 5, 100, 1, 31, 32, 33, 200, 2])]
    rows = pa.RecordBatch.from_pylist([{"file": 0, "doc_id": d, "n_tokens": len(x), "ids": x.tobytes()} for d, x in docs])
    (block,) = rans._blocks(iter([rows]), counts)
    (row,) = block.to_pylist()
    found = {}
    for part in range(len(row["crc32"])):
        for out in rans._documents(iter([pa.RecordBatch.from_pylist([row | {"file_start": 0, "part": part}], schema=pa.schema([*block.schema, ("file_start", pa.int64()), ("part", pa.int32())]))]), counts):
            for r in out.to_pylist():
                assert r["doc_id"] not in found
                found[r["doc_id"]] = (r["start"], r["n_tokens"], r["ids"])
    at = 0
    for d, x in docs:
        assert found.pop(d) == (at, len(x), x.astype("<u4").tobytes())
        at += len(x)
    assert not found


def test_id_file_query(spark, sf_dir):
    encode = library()
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    ids, at, expected = [[*encode(t), 0] for _, t in texts], 0, []
    for (doc, _), x in zip(texts, ids, strict=True):
        expected.append((doc, at, len(x), crc(x)))
        at += len(x)
    assert sorted(map(tuple, queries.op6_rans_ids(spark, sf_dir).collect())) == expected


def test_packing_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(odd(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), vocabulary=path, end_id=2, length=64).collect()
    used, least = check_packing([tuple(r)[:5] + tuple(r)[6:] for r in rows], {d: t for d, t, *_ in ODD if d is not None}, library(), 64)
    assert used <= least + 2
    assert packing.pack(odd(spark), vocabulary=path, end_id=2, length=64).select("doc_id").distinct().count() == 10
    assert packing.pack(odd(spark).limit(0), vocabulary=path, end_id=2).count() == 0


@pytest.mark.parametrize("shape", ["small", "large", "equal", "none"])
def test_plans_place_every_piece_once(shape):
    rng = np.random.default_rng(1)
    sizes = {"small": rng.integers(1, 90, 2000), "large": rng.integers(200, 1025, 2000), "equal": np.full(999, 342), "none": np.empty(0, int)}[shape]
    histogram = np.bincount(sizes, minlength=1025)
    plan = packing.planned(histogram, 1024)
    room, seen = np.full(plan.sequences, 1024), np.zeros(1025, int)
    for size, rank, n, first, each, _ in sorted(plan.flows):
        assert rank == seen[size]
        seen[size] += n
        np.subtract.at(room, first + np.arange(n) // each, size)
    assert (seen == histogram).all() and (room >= 0).all()
    assert plan.sequences <= 1.03 * -(-int(sizes.sum()) // 1024) + 1 or shape in ("large", "equal")


def test_packing_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = check_packing(list(map(tuple, queries.op7_best_fit_packing(spark, sf_dir).collect())), texts, library())
    assert used <= 1.02 * least + 1


def test_added_tokens_follow_the_plain_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    encode = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    texts = [*random_texts(1000), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", None, ""]
    ids, counts = words.added_words(path).texts(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]
    out = rans.new_path(spark)
    docs = [(i, t) for i, t in enumerate(texts[-6:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rans.write_ids(df, out, vocabulary=path, end_id=0)
    assert {r["doc_id"]: bytes(r["ids"]) for r in rans.read_ids(spark, out).collect()} == {d: np.array([*encode(t), 0], "<u4").tobytes() for d, t in docs}
    rows = packing.pack(df, vocabulary=path, end_id=2, length=64).collect()
    check_packing([tuple(r)[:5] + tuple(r)[6:] for r in rows], dict(docs), encode, 64)


@pytest.mark.parametrize("n", [256, 512, 1024, 2048])
def test_words_of_regular_structure_keep_their_ids(n):
    one, other = thue_morse(n)
    encode, mine = library(), words.Words(words.library_words(public_tokenizers.path("byte_bpe_50k.json")).encode)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    texts = [one, other, f"x {one} y", f"x {other} y"]
    for have, expected in ((mine, encode), (words.Words(bytebpe.rank_words(path)[0].encode), reference.encode_ordinary)):
        for some in (texts, texts[::-1]):
            ids, counts = have.texts(some)
            assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [expected(t) for t in some]


def test_pretokens_that_share_a_hash_are_encoded_apart(monkeypatch):
    monkeypatch.setattr(words, "mixed", lambda x: x & np.uint64(7))
    encode = library()
    mine = words.Words(words.library_words(public_tokenizers.path("byte_bpe_50k.json")).encode)
    monkeypatch.setattr(words, "keys", lambda chars, begin, f=words.keys: (f(chars, begin)[0], np.add.reduceat(chars.astype(np.uint64), begin)))
    texts = ["some words of a text", "and more words", "", "x"]
    ids, counts = mine.texts(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]
