"""Alignment of two tokenizers against brute force over the plain libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD, library, odd, thue_morse

from matchloom.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "b", "'s", "re", " ", " ", "  ", "     ", "\n", "\n\n", "\t", "é", "१", "½", "!", "...", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "　", "字", "漢字", "\U0001f600", "the ", "ing ", "====", "\0", "ß", "Hello", " World", "1234"]


def random_texts(n, most=40):
    rng = random.Random(9)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, most))) for _ in range(n)]


def byte_level(token):
    from tokenizers.decoders import ByteLevel  # noqa: F401

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    return bytes(back[c] for c in token)


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    names = {i: t for t, i in Tokenizer.from_file(A).get_vocab().items()}
    encode, model = library(), SentencePieceProcessor(model_file=B)
    sizes_a, sizes_b = {}, {}
    all_groups = []
    for text in texts:
        groups = []
        if text:
            a, b = encode(" " + text), model.encode(text, num_threads=1)
            bytes_a = [byte_level(names[i]) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
                shared = sorted(set(ends_a) & set(ends_b))
                low = 0
                for end in shared:
                    groups.append(([i for i, e in zip(a, ends_a) if low < e <= end], [i for i, e in zip(b, ends_b) if low < e <= end]))
                    low = end
        all_groups.append(groups)
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in all_groups]
    count = Counter(p for c in links for p in c)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, c in zip(all_groups, links):
        form = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(form.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, byte_level=A, pieces=B, **options).collect()}
    for i, expected in enumerate(brute(texts)):
        assert rows[i] == expected, texts[i]


@pytest.mark.parametrize("n", [1, 5, 33, 2000, 5000])
def test_galloping_finds_common_ends(n):
    rng = np.random.default_rng(n)
    for step in (2, 5, 300):
        a, b = np.cumsum(rng.integers(1, 4, n)), np.cumsum(rng.integers(1, step, n + 7))
        end = max(a[-1], b[-1]) + 1
        a, b = np.append(a, end), np.append(b, end)
        assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all() and (alignment.gallop(b, a) == np.searchsorted(a, b)).all()
        for x, y in ((a, b), (b, a)):
            i, j = alignment.common_ends(x, y)
            _, p, q = np.intersect1d(x, y, return_indices=True)
            assert (i == p).all() and (j == q).all()


def test_pieces_are_encoded_as_by_the_whole_text():
    from sentencepiece import SentencePieceProcessor

    model, (words, _) = SentencePieceProcessor(model_file=B), alignment.piece_words(B)
    texts = [*random_texts(3000), *(t for _, t, *_ in ODD if t), "x" * 3000, " " * 500, "a▁b ▁ c", *thue_morse(1024)]
    ids, counts = words.texts([" " + t for t in texts])
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.encode(t, num_threads=1) for t in texts]


def test_alignment_equals_brute_force(spark):
    texts = [*random_texts(300), *random_texts(20, 400), "a▁b", "", None, "=" * 700, "héé ß 漢字 \U0001f600" * 30, *thue_morse(1024)]
    compare(spark, texts)


@pytest.mark.parametrize("hot", [0, 7])
def test_rare_pairs_are_joined(spark, hot):
    compare(spark, [*random_texts(60), None], hot_pairs=hot)


def test_groups_of_many_links(spark, monkeypatch):
    batch = {"n_a": [40, 3], "n_b": [50, 3], "n_groups": [1, 3], "a": [np.arange(40).astype("<u2") % 7, np.array([1, 2, 3], "<u2")], "b": [np.arange(50).astype("<u2") % 3, np.array([4, 5, 4], "<u2")], "last_a": [[0] * 39 + [1], [1] * 3], "last_b": [[0] * 49 + [1], [1] * 3]}
    batch = pa.RecordBatch.from_pydict({k: [np.packbits(x).tobytes() if k.startswith("last") else x.tobytes() if hasattr(x, "tobytes") else x for x in v] for k, v in batch.items()})
    found = []
    for most in (1, 1 << 12):
        monkeypatch.setattr(alignment, "PLAIN_LINKS", most)
        found.append([x.tolist() for x in alignment.linked(batch, ("<u2", "<u2"))])
    assert found[0] == found[1] and sum(found[0][2]) == 2003


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    texts = random_texts(40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    aligned = list(alignment._aligned(iter([pa.RecordBatch.from_pydict({"row": list(range(40)), "doc_id": list(range(40)), "text": texts})]), A, B))
    monkeypatch.setattr(alignment, "ROWS", 3)
    totals = []
    for most in (10, 1 << 21):
        monkeypatch.setattr(alignment, "COUNTED_PAIRS", most)
        total = Counter()
        for out in alignment._counted(iter(aligned), ("<u2", "<u2")):
            for r in out.to_pylist():
                total[r["pair"]] += r["n"]
        totals.append(total)
    assert totals[0] == totals[1] and df.count() == 40


def test_alignment_of_odd_rows(spark):
    rows = alignment.align(odd(spark), byte_level=A, pieces=B).collect()
    expected = brute([t for _, t, *_ in ODD])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in rows) == sorted((d is not None, d or 0, *x) for (d, *_), x in zip(ODD, expected))
    empty = alignment.align(odd(spark).limit(0), byte_level=A, pieces=B)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_alignment_query(spark, sf_dir):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_galloping_alignment(spark, sf_dir).collect()}
    assert rows == {d: x for (d, _), x in zip(texts, brute([t for _, t in texts]))}
