"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizers cut a blank and the text into tokens; where a token of either ends at the same byte, the text is cut into groups,
and within a group all tokens of one are linked to all of the other. The common ends are found by galloping: the shorter
list of ends drives, and each of its ends is searched in the longer one by doubling steps from a place known to be before
it, then by halving. A common end's numbers in both lists slice the groups; the differences of these numbers say how many
tokens a group has on either side.

Texts are encoded once; ids and the last tokens of groups are staged, two bytes and a bit a token. Links are made from
them twice: to count in how many documents each pair of ids is linked, and to look these counts up. The most frequent
pairs, a bounded number, are looked up where the documents are; only links of the rarer pairs are joined to the table of
counts by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.bytebpe import decode
from matchloom.llm.common import slices, staged
from matchloom.llm.words import Words, library_words

#: Rows aligned at once; ends between two that are searched from the beginning; pairs that are looked up where documents
#: are; pairs that a task counts before it sends them on; links of a group that are made one by one.
ROWS, STRIDE, HOT_PAIRS, COUNTED_PAIRS, PLAIN_LINKS = 250, 32, 1 << 19, 1 << 21, 1 << 12
BLANKS = (0x20, 0x2581)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending numbers in short the first place in long, ascending too, that is not below it. The last
    number of long is not below any of short.

    Every STRIDE-th number is searched first, in the same way; the others begin where the one before them was found.
    """
    low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)] if len(short) > STRIDE else np.zeros(len(short), np.int64)
    high, step = low.copy(), 1
    open_ = np.flatnonzero(long[high] < short)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, len(long) - 1)
        step *= 2
        open_ = open_[long[high[open_]] < short[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = long[middle] < short[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of common numbers in both ascending lists, whose last numbers are equal."""
    if len(ends_a) > len(ends_b):
        return common_ends(ends_b, ends_a)[::-1]
    place = gallop(ends_a, ends_b)
    shared = np.flatnonzero(ends_b[place] == ends_a)
    return shared, place[shared]


def split_at_blanks(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a blank follows another character, and where texts begin: pieces hold blanks only at their beginning."""
    blank = np.isin(chars, BLANKS)
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[starts] = True
    return np.flatnonzero(begin)


@cache
def piece_words(path: str) -> tuple[Words, list[bytes]]:
    """An encoder of texts that begin with a blank by the sentencepiece model at path, and the bytes of its ids.

    Texts are cut before blanks: no piece has a blank after another character, so none goes beyond. The model itself adds
    the first blank of what it is given.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError(f"{path}: only models that add a blank and change texts in no other way are supported")
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path}: a piece has a blank after another character")
    as_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    alone = [model.piece_to_id("▁")]
    if pieces[alone[0]] != "▁":
        raise ValueError(f"{path}: no piece for a blank alone")

    def encode(words: list[str]) -> list[list[int]]:
        # the model gives no piece for an empty text: a blank at the end of a text stands alone
        return [ids or alone for ids in model.encode([w[1:] for w in words], num_threads=1)]

    return Words(encode, cut=split_at_blanks, pattern="[ ▁]+[^ ▁]*"), as_bytes


@cache
def byte_level_words(path: str) -> tuple[Words, list[bytes]]:
    """library_words of the byte-level vocabulary file at path, and the bytes of its ids."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    # fixed values: byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return library_words(path), out


class Tables:
    """Bytes of ids, and ids as decimal digits with a mark behind each, for an encoder."""

    def __init__(self, words: Words, as_bytes: list[bytes], marks: str):
        self.words = words
        self.size = np.array([len(b) for b in as_bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(as_bytes), np.uint8)
        text = [f"{i}{m}".encode() for i in range(len(as_bytes)) for m in marks]
        self.digits = np.array(text, dtype=f"S{max(map(len, text), default=1)}")
        self.width = np.array([len(t) for t in text], np.int64)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of texts in a row, how many each text has, and the bytes that each text's ids stand for."""
        ids, counts = self.words.texts(texts)
        plain, to = decode(ids, self.flat, self.begin, self.size)
        ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return ids.astype(np.int64), counts, [plain[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@cache
def tables(byte_level: str, pieces: str) -> tuple[Tables, Tables]:
    """For both tokenizers; a group ends with | on the first side and ; on the second."""
    return Tables(*byte_level_words(byte_level), ",|"), Tables(*piece_words(pieces), ",;")


def listed(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, of: tuple[Tables, Tables], docs: np.ndarray) -> list[bytes]:
    """The groups of each document as text. last_*: whether a token is the last of its group; docs: groups of each document."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    rows_a, rows_b = 2 * a + last_a, 2 * b + last_b
    width = max(of[0].digits.itemsize, of[1].digits.itemsize)
    text, size = np.zeros(len(a) + len(b), f"S{width}"), np.empty(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
    at_b = np.arange(len(b)) + upto_a[group_b]
    for at, rows, side in ((at_a, rows_a, of[0]), (at_b, rows_b, of[1])):
        text[at], size[at] = side.digits[rows], side.width[rows]
    flat = text.view(np.uint8).reshape(len(text), width)
    data = flat[np.arange(width) < size[:, None]].tobytes()
    tokens = np.concatenate([[0], upto_a + upto_b])[np.concatenate([[0], np.cumsum(docs)])]
    ends = np.concatenate([[0], np.cumsum(size)])[tokens].tolist()
    return [data[x : max(x, y - 1)] for x, y in zip(ends, ends[1:], strict=False)]


def _pack(last: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bits of each document's tokens."""
    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [np.packbits(last[x:y]).tobytes() for x, y in zip(ends, ends[1:], strict=False)]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, last_a binary, last_b binary"


def _aligned(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    of = tables(byte_level, pieces)
    for batch in slices(batches, ROWS):
        texts = [" " + t if t else None for t in batch.column("text").to_pylist()]
        sides = [t.ids(texts) for t in of]
        good = np.array([t is not None and x == y == t.encode() for t, x, y in zip(texts, sides[0][2], sides[1][2], strict=True)], bool)
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts, _ in sides)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        shared = common_ends(np.cumsum(of[0].size[a]), np.cumsum(of[1].size[b])) if len(a) else (np.empty(0, np.int64),) * 2
        last_a[shared[0]], last_b[shared[1]] = True, True
        links = np.diff(shared[0], prepend=-1) * np.diff(shared[1], prepend=-1)
        groups = np.diff(np.searchsorted(shared[0], np.concatenate([[0], np.cumsum(n_a)])))
        n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[np.concatenate([[0], np.cumsum(groups)])])
        digests = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(listed(a, b, last_a.astype(np.int64), last_b.astype(np.int64), of, groups), n_a.tolist(), strict=True)]
        stored = []
        for ids, counts, side in ((a, n_a, of[0]), (b, n_b, of[1])):
            kind = _id_kind(len(side.size))
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            stored.append([ids[x:y].astype(kind).tobytes() for x, y in zip(ends, ends[1:], strict=False)])
        columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, n_links)), pa.array(digests, pa.string()), *(pa.array(x, pa.binary()) for x in (*stored, _pack(last_a, n_a), _pack(last_b, n_b)))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def _id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _unpacked(batch: pa.RecordBatch, kinds: tuple[str, str]) -> tuple[np.ndarray, ...]:
    """ids and last tokens of groups of both sides, of all documents in a row."""
    out = []
    for side, kind in zip("ab", kinds, strict=True):
        out.append(np.frombuffer(b"".join(batch.column(side).to_pylist()), kind).astype(np.int64))
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(batch.column(f"last_{side}").to_pylist(), batch.column(f"n_{side}").to_pylist(), strict=True)]
        out.append(np.concatenate([np.empty(0, np.uint8), *bits]).astype(bool))
    return tuple(out)


def _once(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def linked(batch: pa.RecordBatch, kinds: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document within the batch, pair of ids, number of links) of documents, each pair once for each document; a pair is
    the first side's id times 2**32 and the second side's.

    Groups of many links have few different ids on either side, as a rule; these are counted on each side first.
    """
    a, last_a, b, last_b = _unpacked(batch, kinds)
    end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    size_a, size_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
    doc = np.repeat(np.arange(batch.num_rows), batch.column("n_groups").to_numpy())
    small = size_a * size_b <= PLAIN_LINKS
    repeat = np.repeat(np.where(small, size_b, 0), size_a)  # how many links each token of the first side has
    n = int(repeat.sum())
    group = np.repeat(np.arange(len(size_a)), size_a)
    place = np.arange(n) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    pair = np.repeat(a, repeat) << 32 | b[np.repeat((end_b - size_b)[group], repeat) + place]
    owner, times = np.repeat(doc[group], repeat), np.ones(n, np.int64)
    more = [(owner, pair, times)]
    for g in np.flatnonzero(~small).tolist():
        (ids_a, n_a), (ids_b, n_b) = (np.unique(x[e - s : e], return_counts=True) for x, e, s in ((a, end_a[g], size_a[g]), (b, end_b[g], size_b[g])))
        pairs = (ids_a[:, None] << 32 | ids_b[None]).ravel()
        more.append((np.full(len(pairs), doc[g]), pairs, (n_a[:, None] * n_b[None]).ravel()))
    owner, pair, times = (np.concatenate(x) for x in zip(*more, strict=True))
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    if not len(pair):
        return owner, pair, times
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[first], pair[first], np.add.reduceat(times, first)


def _counted(batches: Iterator[pa.RecordBatch], kinds: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each pair is linked; pairs come again whenever many have been counted."""
    kept, held = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0

    def merged():
        return _once(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    out = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
    for batch in slices(batches, ROWS):
        _, pair, _ = linked(batch, kinds)
        keys, n = _once(pair, np.ones(len(pair), np.int64))
        kept.append((keys, n))
        held += len(keys)
        if held > COUNTED_PAIRS:
            kept = [merged()]
            held = len(kept[0][0])
            if held > COUNTED_PAIRS // 2:
                yield out(*kept[0])
                kept, held = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    yield out(*merged())


LOOKED_UP = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<struct<pair:long,times:long>>"


def _looked_up(batches: Iterator[pa.RecordBatch], kinds: tuple[str, str], pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the links of hot pairs (sorted), and the other pairs with their numbers of links."""
    kind = pa.struct([("pair", pa.int64()), ("times", pa.int64())])
    for batch in slices(batches, ROWS):
        owner, pair, times = linked(batch, kinds)
        place = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
        hot = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
        sums = [_summed(owner[hot], times[hot] * x[place[hot]], batch.num_rows) for x in (best, n)]
        rare = pa.StructArray.from_arrays([pa.array(pair[~hot]), pa.array(times[~hot])], fields=list(kind))
        offsets = np.searchsorted(owner[~hot], np.arange(batch.num_rows + 1)).astype(np.int32)
        columns = [*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets), rare)]
        yield pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in LOOKED_UP.split(", ")[:9]), "rare"])


def _summed(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers for each owner; owners are sorted."""
    to = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(owner, np.arange(n + 1))
    return to[at[1:]] - to[at[:-1]]


def align(docs: DataFrame, *, byte_level: str, pieces: str, text_col: str = "text", id_col: str = "doc_id", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A is the byte-level vocabulary file byte_level over a blank and the text, B the sentencepiece model pieces over the text, to
    which it adds the blank. n_links: pairs of an A and a B token in one group. A pair of ids counts in how many rows it is
    linked; n_best: links whose count is the highest of their A id, count_sum: the counts of all links summed.
    groups_sha256: of the groups as a1,a2|b1;a3|b2,b3.

    Null and empty texts, and those that either tokenizer changes (their tokens' bytes are not the blank and the text), have
    no tokens: zeros and an empty groups_sha256. Strings of special tokens within a text are plain text. Null and repeated
    ids are kept, each row for itself; repeated rows count as further documents. An empty table gives no rows. Other columns
    are ignored.

    Documents are not shuffled. hot_pairs bounds what is broadcast (some 17 bytes a pair); it changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = staged(rows.mapInArrow(partial(_aligned, byte_level=byte_level, pieces=pieces), ALIGNED), "aligned", compression="zstd")
    kinds = tuple(_id_kind(len(t.size)) for t in tables(byte_level, pieces))
    counted = staged(aligned.select("n_a", "n_b", "n_groups", "a", "b", "last_a", "last_b").mapInArrow(partial(_counted, kinds=kinds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    first = F.shiftright("pair", 32)
    most = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # no more rows than the vocabulary has ids
    judged = counted.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    hot = judged.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    known = {k: hot.column(c).to_numpy()[order] for k, c in (("pairs", "pair"), ("n", "n"), ("best", "best"))}
    looked_up = staged(aligned.mapInArrow(partial(_looked_up, kinds=kinds, **known), LOOKED_UP), "links")
    rare = looked_up.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(judged, "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = looked_up.drop("rare").join(more, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
