"""Brute-force versions that the operators are held against."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

DOCS = "doc_id long, text string, rid string, key int, word string, part int"

LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
#: Nulls, empty and very long texts, ties and repeated rows; extra columns whose names the operators use inside.
ODD = [
    (1, None, "a", 1, "x", 0),
    (2, "", "a", 1, "x", 0),
    (3, " \n\t ", None, None, None, None),
    (4, "one two three", "b", 2, "y", 1),
    (5, "One  two\nthree", "b", 2, "y", 1),
    (6, LONG, "c", 3, "z", 2),
    (7, LONG + " tail", "c", 3, "z", 2),
    (8, "héé ß 漢字 \U0001f600 don't we'll  ", "d", 4, "q", 3),
    (8, "héé ß 漢字 \U0001f600 don't we'll  ", "d", 4, "q", 3),
    (None, "one two three four five six seven", "e", 5, "r", 4),
    (None, None, None, None, None, None),
    (9, "one two three four five six seven", "e", 5, "r", 4),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_duplicates(rows, percent):
    """(n_shingles, component_id) of each row, by all pairs that share a shingle."""
    sets, holders, parent = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, encode, length=1024):
    """rows: (doc_id, piece, start, length, ids_crc32, sequence_id, offset); texts by unique doc_id."""
    ids = {d: [*encode(t), 2] for d, t in texts.items()}
    assert Counter(r[0] for r in rows) == {d: -(-len(x) // length) for d, x in ids.items()}
    filled = defaultdict(list)
    for doc, piece, start, n, digest, sequence, offset in rows:
        assert crc(ids[doc][start : start + n]) == digest
        assert n == length or piece == 0
        filled[sequence].append((offset, n))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(filled), -(-sum(r[3] for r in rows) // length)


def thue_morse(n):
    """Two different words of n letters, the second with both letters exchanged."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
