"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to the characters of Latin-1, so that an Aho-Corasick automaton over the reversed tokens finds, in one
pass, the longest token that begins at each position. A text's ids are then found from left to right: take the longest
token that may stand next to the one before it, step back where none can. Two tokens may stand next to each other if
the merges would leave them so; that answer depends on the two alone and is remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of tokens that a worker remembers.
REMEMBERED_PAIRS = 2_000_000
#: Stands between pretokens; no byte maps to it.
GAP = "Ā"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of a piece after all merges of a rank below the one given, lowest rank first, leftmost at ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Backtracker:
    """Encodes pretokens with a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.size = {r: len(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        usable = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = merged(token, ranks, rank)
                if len(parts) != 2:  # no merges lead to it
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[self.halves[rank]] = rank
            usable[token] = rank
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {}  # the longest usable token that a token begins with
        for token, rank in usable.items():
            self.shorter[rank] = next((usable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), None)
        self.fits: dict[int, bool] = {}

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right next to each other.

        Undoes the later of the two tokens' last merges, step by step, and looks whether the two ends that then meet
        would have merged with each other before.
        """
        halves, pairs, bound = self.halves, self.pairs, 1 << 62
        while True:
            if pairs.get((left, right), bound) < bound:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # what was merged last comes apart first; at equal ranks the right one, as merges run from the left
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Id lists of pretokens."""
        raw = [w.encode("utf-8", "replace") for w in words]
        text = GAP.join(b.decode("latin-1") for b in reversed_each(raw))
        longest: list[int] = [-1] * len(text)
        for end, rank in self.automaton.iter(text):
            if longest[end] < 0:  # the first one told at a place is the longest
                longest[end] = rank
        out, at = [], 0
        for piece in raw:
            n = len(piece)
            match = longest[at : at + n]
            match.reverse()
            out.append(self._one(match, n))
            at += n + 1
        return out

    def _one(self, match: list[int], n: int) -> list[int]:
        fits, size, shorter = self.fits, self.size, self.shorter
        ids: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, match[0] if n else None
        while at < n:
            last = ids[-1] if ids else -1
            while token is not None:
                to = at + size[token]
                if not dead[to]:
                    if last < 0:
                        break
                    key = last << 32 | token
                    good = fits.get(key)
                    if good is None:
                        if len(fits) >= REMEMBERED_PAIRS:
                            fits.clear()
                        good = fits[key] = self._adjacent(last, token)
                    if good:
                        break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = ids.pop()
                at -= size[token]
            else:
                ids.append(token)
                at = to
                token = match[at] if at < n else None
        return ids


def reversed_each(pieces: list[bytes]) -> list[bytes]:
    return [p[::-1] for p in pieces]


@cache
def rank_words(path: str):
    """Pretokens encoded with the rank file at path, and the bytes of every id."""
    from matchloom.llm.words import Words

    ranks = read_ranks(path)
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no rank for the bytes {lacking[:5]}: not every text could be encoded")
    tokens = {r: t for t, r in ranks.items()}
    size = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
    flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
    return Words(Backtracker(ranks).encode), flat, np.cumsum(size) - size, size


def decode(ids: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of ids in a row, and where each id's bytes end."""
    n = size[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b"", ends
    return flat[np.repeat(begin[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes(), ends


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    words, flat, begin, size = rank_words(ranks)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            ids, counts = words.texts(part.column(1).to_pylist())
            ends = np.cumsum(counts)
            starts = ends - counts
            data = ids.astype("<u4").tobytes()
            plain, bytes_to = decode(ids, flat, begin, size)
            bytes_to = np.concatenate([[0], bytes_to])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array([plain[a:b] for a, b in zip(bytes_to[starts].tolist(), bytes_to[ends].tolist(), strict=True)], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, *, ranks: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (u32, little-endian) and decoded (the bytes that the ids stand for) of every row.

    ranks: path of a rank file, on every executor; one without all single bytes is an error. Null texts count as empty: no ids, no bytes. Null and repeated ids
    are kept as they are, one result for each row. An empty table gives no rows. Extra columns are ignored. Nothing is
    shuffled: each row is encoded where it is read.
    """
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(partial(_encoded, ranks=ranks), "doc_id long, n_tokens long, ids binary, decoded binary")
