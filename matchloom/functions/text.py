"""Text normalisation and trigram measures as column expressions, native but for the runs of word similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

# Accented letters and their base letters, and letters that stand for two.
ACCENTED = "àáâãäåāăąçćčďđèéêëēęěìíîïīłñńňòóôõöøōőŕřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiilnnnoooooooorrssstuuuuuuuyyzzz"
PAIRS = (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th"), ("ð", "d"))


def normalise(text: Column) -> Column:
    """Lower case, then base letters for accented ones."""
    out = F.translate(F.lower(text), ACCENTED, PLAIN)
    for letter, plain in PAIRS:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_trigrams(word: Column) -> Column:
    """Trigrams of one word with two blanks before it and one after it, in order."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))


def ordered_trigrams(text: Column) -> Column:
    """Trigrams of all words, in order, with repeats."""
    return F.flatten(F.transform(words(text), word_trigrams))


def trigrams(text: Column) -> Column:
    """The set of trigrams; null for null, empty for a text without letters and digits."""
    return F.array_distinct(ordered_trigrams(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets given as arrays; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts."""
    return jaccard(trigrams(a), trigrams(b))


def distance(a: Column, b: Column) -> Column:
    """1 - similarity."""
    return 1 - similarity(a, b)


def _padded(values: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """Lists in a row as the rows of a matrix."""
    out = np.full((len(sizes), int(sizes.max()) if len(sizes) else 0), fill, values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _swept(hit: np.ndarray, place: np.ndarray, row: np.ndarray, rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The best share of each of the rows, which have hits and no repeated trigram.

    A run from hit a to hit b at places p shares b - a + 1 of m + (p[b] - p[a] + 1) - (b - a + 1) trigrams. The best share
    s is where the largest shared - s * all is 0: from a first share on, one sweep over the hits, with the least of what
    came before, finds the run that beats it most, until none does.
    """
    chosen = np.zeros(len(m), bool)
    chosen[rows] = True
    at = np.flatnonzero(hit & chosen[row])
    counts = np.bincount(row[at], minlength=len(m))[rows]
    # hits come in the order of the texts, which is not that of rows
    rank = np.argsort(np.argsort(rows, kind="stable"), kind="stable")
    ordered = np.argsort(rows, kind="stable")
    sizes = counts[ordered]
    out = np.empty(len(rows))
    begin = 0
    while begin < len(rows):
        end = min(len(rows), begin + max(1, 200_000 // max(1, int(sizes.max()))))
        n, low = sizes[begin:end], int(sizes[:begin].sum())
        p = _padded(place[at[low : low + int(n.sum())]].astype(np.float64), n, 0)
        k = np.arange(p.shape[1])[None, :]
        good = k < n[:, None]
        size = m[rows[ordered[begin:end]]][:, None].astype(np.float64)
        best = 1.0 / size  # of one hit alone
        while True:
            # shared - best * all, as what depends on the end less what depends on the beginning
            value = (1 + best) * k - best * p
            gain = np.where(good, value - np.minimum.accumulate(np.where(good, value, np.inf), axis=1), -np.inf)
            b = gain.argmax(axis=1)
            a = np.where(k <= b[:, None], value, np.inf).argmin(axis=1)
            i = np.arange(len(b))
            shared = (b - a + 1).astype(np.float64)
            share = (shared / (size[:, 0] + (p[i, b] - p[i, a] + 1) - shared))[:, None]
            if (share <= best + 1e-15).all():
                break
            best = np.maximum(best, share)
        out[begin:end] = best[:, 0]
        begin = end
    return out[rank]


def best_runs(own: pa.ListArray, ordered: pa.ListArray, words: pa.ListArray | None, threshold: float) -> np.ndarray:
    """For each row the largest share of its trigram set `own` in a run of its trigrams `ordered`: shared ones by all
    distinct ones. words: how many trigrams each word has; runs are then of whole words. 0 where the set and the whole
    of `ordered` share fewer than threshold asks of any run."""
    m, sizes = (np.diff(x.offsets.to_numpy()) for x in (own, ordered))
    codes = pa.concat_arrays([own.flatten(), ordered.flatten()]).dictionary_encode().indices.to_numpy()
    width = int(codes.max()) + 1 if len(codes) else 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    mine = np.repeat(np.arange(len(m)), m) * width + codes[: m.sum()]
    key = row * width + codes[m.sum() :]
    hit = np.isin(key, mine)
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # where a trigram was last in its row; a trigram is new in a run that begins after that
    before = np.full(len(key), -1)
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    before[order[1:][again]] = place[order[:-1][again]]
    shared = np.bincount(row[hit & (before < 0)], minlength=len(sizes))
    out = np.zeros(len(sizes))
    todo = np.flatnonzero((shared > 0) & (shared >= np.ceil(m * threshold - 1e-9)))
    todo = todo[np.argsort(sizes[todo], kind="stable")]
    begins = np.cumsum(sizes) - sizes
    if words is None:
        # rows without repeated trigrams: one sweep over the hits
        plain = todo[np.bincount(row[before >= 0], minlength=len(sizes))[todo] == 0]
        out[plain] = _swept(hit, place, row, plain, m)
        todo = todo[~np.isin(todo, plain)]
    else:
        first, last = np.zeros(len(key), bool), np.zeros(len(key), bool)
        each = words.flatten().to_numpy()
        ends = np.cumsum(each)
        last[ends - 1] = True
        first[ends - each] = True
    at = 0
    while at < len(todo):
        some = todo[at : at + max(1, 100_000 // int(sizes[todo[min(at + 1000, len(todo) - 1)]]))]
        at += len(some)
        n = sizes[some]
        flat = np.repeat(begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        old, own_hit = _padded(before[flat].astype(np.int32), n, 1 << 30), _padded(hit[flat], n, 0)
        starts = own_hit if words is None else _padded(first[flat], n, 0)
        stops = None if words is None else _padded(last[flat], n, 0)
        best = np.zeros(len(some))
        for i in np.flatnonzero(starts.any(axis=0)):
            new = old[:, i:] < i
            common = np.cumsum(new & own_hit[:, i:], axis=1, dtype=np.int32)
            share = common / (m[some][:, None] + np.cumsum(new, axis=1, dtype=np.int32) - common)
            if stops is not None:
                share = np.where(stops[:, i:] & starts[:, i : i + 1], share, 0)
            best = np.maximum(best, share.max(axis=1))
        out[some] = best
    return out


def _runs(batches: Iterator[pa.RecordBatch], threshold: float, strict: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["own", "ordered", "word_sizes"])
        best = best_runs(batch.column("own"), batch.column("ordered"), batch.column("word_sizes") if strict else None, threshold)
        out = pa.RecordBatch.from_arrays([*rest.columns, pa.array(best)], names=[*rest.schema.names, "sim"])
        yield out.filter(pa.array(best >= threshold - 1e-9))


def with_best_runs(df: DataFrame, threshold: float, *, strict: bool) -> DataFrame:
    """df with sim in place of own, ordered and word_sizes, the rows of sim threshold at least; see best_runs.

    Arrow batches and array operations in Python: runs as native higher-order functions, each rebuilt as an array, took
    over ten times as long.
    """
    left = [f for f in df.schema.fields if f.name not in ("own", "ordered", "word_sizes")]
    return df.mapInArrow(partial(_runs, threshold=threshold, strict=strict), S.StructType([*left, S.StructField("sim", S.DoubleType())]))


def ordered_pieces(text: Column) -> list[Column]:
    """ordered and word_sizes of a text, as best_runs takes them."""
    per_word = F.transform(words(text), word_trigrams)
    return [F.flatten(per_word).alias("ordered"), F.transform(per_word, F.size).alias("word_sizes")]


def with_word_similarity(df: DataFrame, needle: str, haystack: str, *, strict: bool = False) -> DataFrame:
    """df with sim: the best match of needle's trigram set with any run of haystack's ordered trigrams.

    strict: runs of whole words. 0 if either text is null or has no trigrams.
    """
    pieces = [F.coalesce(c, F.array().cast(kind)).alias(name) for c, kind, name in zip([trigrams(F.col(needle)), *ordered_pieces(F.col(haystack))], ("array<string>", "array<string>", "array<int>"), ("own", "ordered", "word_sizes"), strict=True)]
    return with_best_runs(df.select("*", *pieces), 0.0, strict=strict)


def exact_or(a: Column, b: Column, score: Column) -> Column:
    """1 for equal texts, else the score, 0.0001 at least."""
    return F.greatest(F.when(a == b, F.lit(1.0)).otherwise(score), F.lit(0.0001))


def isbn(text: Column) -> Column:
    """Digits and X, upper case; null if none is left."""
    return F.nullif(F.upper(F.regexp_replace(text, "[^0-9Xx]", "")), F.lit(""))


def doi(text: Column) -> Column:
    """Trimmed, lower case, without the resolver's address; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), "^https?://doi\\.org/", ""), F.lit(""))


def mentions(needle: Column, *columns: Column) -> Column:
    """Whether any column contains needle, without regard to case; null columns do not."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False))
    return out


def guessed_language(text: Column) -> Column:
    """(lang, confidence): English 0.9 for plain ASCII, else 'unknown' 0.5 where accented letters occur."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    accented = F.lower(text).rlike("[àâäåæçèéêëîïñòóôöøùûüÿœß]")
    return F.struct(F.when(plain | ~accented, "en").otherwise("unknown").alias("lang"), F.when(plain, 0.9).otherwise(0.5).alias("confidence"))


def answered_language(answer: Column, default: str = "en") -> Column:
    """(lang, confidence) of an answer 'code, confidence'; the default with 0.5 of any other answer."""
    parts = F.split(answer, ",")
    number = F.when(F.size(parts) == 2, F.trim(parts[1])).try_cast("double")
    good = number.isNotNull()
    return F.struct(F.when(good, F.lower(F.trim(parts[0]))).otherwise(default).alias("lang"), F.when(good, number).otherwise(0.5).alias("confidence"))


def cache_key(text: Column, lang: Column) -> Column:
    """Key of a translation: md5 of text:lang."""
    return F.md5(F.concat_ws(":", text, lang))


def entity_name(table: Column) -> Column:
    """The entity that a table holds: its name without the prefix tbl_."""
    return F.regexp_replace(table, "^tbl_", "")
