"""Language-model scores by stupid backoff over n-grams of all words.

A word that follows n - 1 others has the score c(n-gram) / c(the n - 1 words before) if the n-gram is kept (min_count
times at least), else alpha times its score after n - 2 words; alone it has c(word) / N. Counts are of the whole corpus
and of all its words.

N-grams are keys: hashes of KEY_BITS bits beside those that tell the bucket, 64 in all at most. There are more buckets for
more words, so at any size of the corpus a key is taken for another one with a chance below 2e-7. The count table is partitioned by hash, and the n-grams of documents are joined to it:
each chunk of documents sends every bucket of the table its distinct keys there once, with how often it holds them. A
bucket's task so has all occurrences of its keys: it counts them and returns the counts to each chunk in the order of the
chunk's keys. The chunk, whose words travel as small numbers, then scores its documents. A key that is everywhere costs
one entry a chunk, so no key is hot, and no word reaches the driver. counts() gives the table itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices
from matchloom.llm.shingles import mixed, word_hashes

#: Bits of a key beside those of its bucket.
KEY_BITS = 44
#: Bytes that are split at once, words and documents of a chunk, words a bucket.
CHUNK_BYTES, CHUNK_WORDS, CHUNK_DOCS, BUCKET_WORDS = 1 << 21, 800_000, 60_000, 1 << 20
_ONE, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, word hashes, text of each word) of chunks of texts."""
    at = 0
    while at < len(texts):
        data, bounds, i = [], [0], at
        while i < len(texts) and (i == at or bounds[-1] < CHUNK_BYTES) and i - at < CHUNK_DOCS:
            data.append((texts[i] or "").encode("utf-8", "replace"))
            bounds.append(bounds[-1] + len(data[-1]))
            i += 1
        yield at, i - at, *word_hashes(b"".join(data), np.array(bounds))
        at = i


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(words) for _, _, words, _ in chunks(batch.column(0).to_pylist()))], pa.int64())], names=["n"])


def _shift(buckets: int) -> np.uint64:
    """How many bits of a hash its key leaves out."""
    return np.uint64(max(0, 64 - KEY_BITS - buckets.bit_length()))


def _keys(words: np.ndarray, place: np.ndarray, order: int, buckets: int) -> list[np.ndarray]:
    """Keys of the n-grams that end in each word, for n from 1 to order; of those words that have n - 1 before them in
    their text. place: how many words of its text are before a word."""
    out, chain = [], mixed(words * _ONE + _ONE)
    for n in range(1, order + 1):
        if n > 1:
            chain = np.concatenate([chain[:1], mixed(chain[:-1] * _FIRST + words[1:] * _SECOND)])
        out.append(mixed(chain[place >= n - 1] + np.uint64(n)) >> _shift(buckets))
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    """How many words are before each word of texts of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their bytes by place, without the places that none needs, compressed; how many come first."""
    places = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    each = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :places]
    return bytes([places]) + pa.compress(np.ascontiguousarray(each.T).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    places = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :places] = np.frombuffer(pa.decompress(data[1:], decompressed_size=n * places, codec="zstd"), np.uint8).reshape(places, n).T
    return out.view("<i8").ravel()


def _differences(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sums(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_numbers(data, n).view("<u8"), dtype=np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, word hashes and document of each word of the chunks of (id, text) batches."""
    ids, words, owners = [], [], []
    for batch in slices(batches):
        column = batch.column(0).to_pylist()
        for at, n, hashes, owner in chunks(batch.column(1).to_pylist()):
            words.append(hashes)
            owners.append(owner + len(ids))
            ids += column[at : at + n]
            if sum(map(len, words)) >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                yield ids, np.concatenate(words), np.concatenate(owners)
                ids, words, owners = [], [], []
    if ids:
        yield ids, np.concatenate(words), np.concatenate(owners)


SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("numbers", pa.binary()), ("often", pa.binary())])
FIELDS = "bucket int, chunk long, n int, doc_ids array<long>, sizes array<int>, keys binary, numbers binary, often binary"


def _by_frequency(often: np.ndarray) -> np.ndarray:
    return np.argsort(-often, kind="stable")


def _packed(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each chunk a row of its own (words of each document; distinct words and the number of each word among them)
    and one for each bucket (keys and how often the chunk holds them)."""
    chunk = TaskContext.get().partitionId() << 32
    for ids, words, owner in _gathered(batches):
        words = words >> _shift(buckets)
        distinct, number, often = np.unique(words, return_inverse=True, return_counts=True)
        # words are numbered from the most frequent, so most numbers are small
        rank = np.argsort(_by_frequency(often))
        sizes = np.bincount(owner, minlength=len(ids))
        # a chunk's own row goes through a bucket of its own kind (negative), past the counting
        own = -1 - int(mixed(np.array([chunk + 1], np.uint64))[0] >> np.uint64(34))
        rows = [(own, chunk, len(distinct), ids, sizes.tolist(), _differences(distinct), _planes(rank[number]), _planes(often))]
        keys, times = np.unique(np.concatenate(_keys(words, _places(sizes), order, buckets)), return_counts=True)
        # buckets are ranges of keys
        cuts = np.searchsorted(((keys >> (np.uint64(32) - _shift(buckets))) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), chunk, int(cuts[b + 1] - cuts[b]), None, None, _differences(keys[part]), _planes(times[part]), None))
        chunk += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(SCHEMA.types)], schema=SCHEMA)


def _counted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's distinct keys, their counts in the corpus, the number of each row's keys among them, and row sizes."""
    sizes = rows.column("n").to_pylist()
    cells = [_sums(x, n) for x, n in zip(rows.column("keys").to_pylist(), sizes, strict=True)]
    times = [_numbers(x, n) for x, n in zip(rows.column("numbers").to_pylist(), sizes, strict=True)]
    values, which = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, which, np.concatenate(times))
    return values, total, which, sizes


def _totals(rows: pa.Table) -> pa.Table:
    """A bucket's rows with the counts of the corpus in place of the keys."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows.select(SCHEMA.names)
    _, total, which, sizes = _counted(rows)
    ends = np.cumsum(sizes)
    counts = [_planes(total[which[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    none = [pa.nulls(len(sizes), SCHEMA.field(c).type) for c in ("doc_ids", "sizes", "keys")]
    return pa.table([*(rows.column(c) for c in ("bucket", "chunk", "n")), *none, pa.array(counts, pa.binary()), pa.nulls(len(sizes), pa.binary())], schema=SCHEMA)


def _table(rows: pa.Table) -> pa.Table:
    values, total, _, _ = _counted(rows)
    return pa.table({"gram": pa.array(values.view(np.int64)), "n": pa.array(total)})


def _scored(total: int, alpha: float, min_count: int, order: int, buckets: int):
    def chunk(rows: pa.Table) -> pa.Table:
        cells = sorted(zip(*(rows.column(c).to_pylist() for c in ("bucket", "n", "doc_ids", "sizes", "keys", "numbers", "often")), strict=True), key=lambda r: r[0])
        (_, distinct, ids, sizes, keys, number, often), n = cells[0], sum(cells[0][3])
        logs = np.zeros(n)
        place = _places(np.array(sizes, np.int64))
        if n:
            words = _sums(keys, distinct)[_by_frequency(_numbers(often, distinct))][_numbers(number, n)]
            grams = _keys(words, place, order, buckets)
            _, which = np.unique(np.concatenate(grams), return_inverse=True)
            found = np.concatenate([_numbers(x, size) for _, size, *_, x, _ in cells[1:]])[which]
            ends = np.cumsum([len(g) for g in grams])
            before = found[: ends[0]]  # counts of the shorter n-grams, by the word that they end in
            logs = np.log(before) - np.log(total)
            for k in range(1, order):
                count = np.zeros(n, np.int64)
                count[place >= k] = found[ends[k - 1] : ends[k]]
                logs[place >= k] += np.log(alpha)
                kept = np.flatnonzero(count >= min_count)
                logs[kept] = np.log(count[kept]) - np.log(before[kept - 1])
                before = count
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return chunk


def _prepared(docs: DataFrame, order: int, text_col: str, id_col: str) -> tuple[DataFrame, int, int]:
    """The packed chunks of docs, how many words there are, and how many buckets."""
    if not 1 <= order <= 7:
        raise ValueError("order is from 1 to 7")
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = columns.select("text").mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_WORDS))
    return columns.mapInArrow(partial(_packed, order=order, buckets=buckets), FIELDS), total, buckets


def counts(docs: DataFrame, *, order: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The count table: gram (its key), n (occurrences), every n-gram of 1 to order words once.

    See scores for words, nulls and odd rows.
    """
    packed, _, _ = _prepared(docs, order, text_col, id_col)
    return packed.filter("bucket >= 0").groupBy("bucket").applyInArrow(_table, "gram long, n long")


def scores(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, min_count: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, log_score (sum of the words' log scores), mean_log_score (null without words).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. All words and n-grams up to order words
    count, whole texts however long, each occurrence once. Null and empty texts have no words and log_score 0. Null and
    repeated ids are kept, each row by itself; a repeated row counts twice in the corpus. An empty table gives no rows;
    extra columns are ignored.
    """
    packed, total, buckets = _prepared(docs, order, text_col, id_col)
    counted = packed.groupBy("bucket").applyInArrow(_totals, FIELDS)
    out = counted.groupBy("chunk").applyInArrow(_scored(total, alpha, min_count, order, buckets), "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.try_divide("log_score", F.col("n_words")))
