"""Quality scores by compression.

Two zstandard dictionaries are trained, one on text of good documents and one on text of bad ones. A text that the
good dictionary helps more than the bad one is like the good documents: the difference of the two compressed sizes,
divided by their sum, goes through a logistic curve fitted on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, least_by_hash

#: Texts are compressed in pieces of so many bytes, each with the whole dictionary before it, so that in a long text
#: the dictionary counts as much as in a short one.
PIECE_BYTES, LEVEL, DICTIONARY_BYTES = 1024, 3, 1 << 15
#: Most labelled rows of each kind for a dictionary, most rows for the curve, and the longest text that is fitted on.
DICTIONARY_ROWS, CURVE_ROWS, FIT_CHARS = 1500, 6000, 1 << 16


@dataclass(frozen=True)
class Model:
    """good, bad: dictionaries (empty: none); score = 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


class Measure:
    """Compressed sizes with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.sides = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) of the compressed sizes of the whole text; 0 for an empty or null text."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        view = memoryview(data)
        pieces = [view[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        good, bad = (sum(len(side.compress(p)) for p in pieces) for side in self.sides)
        return (bad - good) / (bad + good)


def build_dictionary(texts: list[str], seed: int) -> bytes:
    """A trained dictionary, or the plain text of very few samples."""
    import zstandard

    data = [t.encode("utf-8", "replace") for t in texts if t]
    pieces = [d[i : i + PIECE_BYTES] for d in data for i in range(0, len(d), PIECE_BYTES)]
    np.random.default_rng(seed).shuffle(pieces)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


def fit_curve(difference: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with smoothed targets so that separable rows give a finite slope."""
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(difference.std(), 1e-9)
    x = np.stack([difference / scale, np.ones(len(difference))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fold(id_col: str = "doc_id") -> Column:
    """The remainder of crc32(id as text) by 5; rows of remainder 0 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", dictionary_rows: int = DICTIONARY_ROWS, curve_rows: int = CURVE_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fits on labelled rows whose fold is not 0: dictionaries on folds 1 and 2, the curve on folds 3 and 4.

    The rows are those of least id hash, dictionary_rows of each label and curve_rows for the curve, texts up to
    fit_chars characters; that bounds what the driver gets. Rows with a null id or label, or a label other than 0 and 1, are not
    used; repeated labels of one row count as often as they are given. Without both labels in both parts, every score
    is the share of label 1, 0.5 without any label.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), fold(id_col).alias("fold"))
    rows = rows.filter("id IS NOT NULL AND label IN (0, 1) AND fold <> 0")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= fit_chars)
    least = lambda df, n: least_by_hash(df, "id", n)
    part = rows.filter("fold <= 2")
    sides = [least(part.filter(F.col("label") == q), dictionary_rows) for q in (1, 0)]
    # a few thousand ids at most, whatever the size of labels
    chosen = texts.join(F.broadcast(sides[0].unionByName(sides[1])), "id").select("id", "label", "text").orderBy("id", "label", "text").collect()
    good, bad = (build_dictionary([r["text"] for r in chosen if r["label"] == q], q) for q in (1, 0))
    if good and bad:
        chosen = texts.join(F.broadcast(least(rows.filter("fold > 2"), curve_rows)), "id")
        seen = chosen.select("label", difference(good, bad)("text").alias("d")).toPandas()
        if seen["label"].nunique() == 2:
            return Model(good, bad, *fit_curve(seen["d"].to_numpy(), seen["label"].to_numpy()))
    share = rows.agg(F.avg("label")).first()[0]
    share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))


def difference(good: bytes, bad: bytes):
    """A column function: the normalised difference of compressed sizes of a text column."""

    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Measure(good, bad)
        for texts in batches:
            yield pd.Series([measure.difference(t) for t in texts], dtype="float64")

    return measured


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with out_col: the calibrated score of each whole text, 0 to 1 (a column of that name is replaced).

    Only the text counts. Null and empty texts get the curve's value at difference 0. All rows and columns are kept.
    """
    d = difference(model.good, model.bad)(F.col(text_col).cast("string"))
    line = F.lit(model.slope) * d + F.lit(model.offset)
    return docs.withColumn(out_col, 1 / (1 + F.exp(-line)))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold at least, with their own columns; ties with it stay.

    Rows are judged one by one: null and repeated ids, and repeated rows, are no special case. Null and empty texts get
    the curve's value at difference 0. An empty table gives no rows.
    """
    (column,) = fresh(docs, "score")
    return with_score(docs, fit(docs, labels), out_col=column).filter(F.col(column) >= threshold).drop(column)
