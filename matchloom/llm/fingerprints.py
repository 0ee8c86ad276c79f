"""Document fingerprints by a homomorphic multiset hash, in column expressions alone.

A paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, every
lane modulo a power of two. So it doesn't depend on the order of paragraphs, and a paragraph is put in or taken out by
adding or subtracting its vector, without a look at the rest (with_paragraphs, without_paragraphs).

A vector has two kinds of lanes. HASH_LANES lanes of 32 bits are hashed from the SHA-256 of the whole paragraph: they are
equal only if the multisets of paragraphs are. SKETCH_LANES lanes of 20 bits sum, over the paragraph's phrases, plus or
minus one by a bit of the phrase's hash: the product of two such sums estimates how many phrases two documents share, so
fingerprints also tell how alike documents are (likeness; standard error about 0.09). Phrases are cut where the text says so:
at line ends, and at white space after a punctuation mark or an s.

The signs are counted in machine words: eight lanes a word, added without carry for up to 127 phrases at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import staged

HASH_LANES, SKETCH_LANES = 16, 128
#: Bits of the two kinds of lanes.
HASH_BITS, SKETCH_BITS = 32, 20
#: Where phrases end.
PHRASE_ENDS = r"\n+|\s(?<=[.,;:!?|s]\s)\s*"
#: Phrases whose signs are counted at once: a lane of eight bits holds so many.
COUNTED = 127
_EACH_LANE = 0x0101010101010101


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _wrapped(x: Column, bits: int) -> Column:
    """x modulo 2**bits, between -2**(bits - 1) and 2**(bits - 1) - 1."""
    half = 1 << (bits - 1)
    return F.pmod(x + _long(half), _long(1 << bits)) - _long(half)


def paragraphs(text: Column) -> Column:
    """The lines of a text; null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def phrases(text: Column) -> Column:
    """The phrases of a text, in order: those of its paragraphs in a row."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PHRASE_ENDS, -1), lambda p: p != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash_lanes(lines: Column) -> Column:
    digests = F.transform(lines, lambda p: F.sha2(p, 256))
    start = F.array(*[_long(0)] * HASH_LANES)
    add = lambda total, d: F.array(*[F.get(total, F.lit(i)) + F.shiftrightunsigned(F.xxhash64(_long(i), d), 64 - HASH_BITS) for i in range(HASH_LANES)])
    return F.aggregate(digests, start, add, lambda total: F.transform(total, lambda x: _wrapped(x, HASH_BITS).cast("int")))


def _sketch_lanes(parts: Column) -> Column:
    """For each lane twice the number of phrases whose bit is set, less the number of phrases."""
    words = [f"w{i}" for i in range(SKETCH_LANES // 8)]
    hashes = F.transform(parts, lambda p: F.struct(F.xxhash64(_long(101), p).alias("a"), F.xxhash64(_long(102), p).alias("b")))
    start = F.struct(*[_long(0).alias(w) for w in words])
    bits = lambda h, i: F.shiftright(h["ab"[i // 8]], i % 8).bitwiseAND(_long(_EACH_LANE))
    add = lambda total, h: F.struct(*[(total[w] + bits(h, i)).alias(w) for i, w in enumerate(words)])
    counted = lambda some: F.aggregate(some, start, add, lambda t: F.array(*[t[w] for w in words]))
    sliced = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / COUNTED).cast("int")), lambda j: counted(F.slice(h, j * COUNTED + 1, F.lit(COUNTED))))
    ones = lambda slices, k: F.aggregate(slices, _long(0), lambda total, w: total + F.call_function("shiftright", F.get(w, F.floor(k / 8).cast("int")), k % 8 * 8).bitwiseAND(_long(255)))
    lanes = lambda slices, n: F.transform(F.sequence(F.lit(0), F.lit(SKETCH_LANES - 1)), lambda k: _wrapped(2 * ones(slices, k) - n, SKETCH_BITS).cast("int"))
    none = F.array_repeat(F.lit(0), SKETCH_LANES)
    return _once(hashes, lambda h: F.when(F.size(h) > 0, _once(sliced(h), lambda slices: lanes(slices, F.size(h).cast("long")))).otherwise(none))


def lanes(text: Column) -> Column:
    """The fingerprint of a text as an array of ints, the hash lanes before the sketch lanes; null counts as empty."""
    return F.concat(_hash_lanes(paragraphs(text)), _sketch_lanes(phrases(text)))


def _changed(a: Column, b: Column, change: Callable[[Column, Column], Column]) -> Column:
    part = lambda x, begin, n: F.slice(x, begin, n)
    both = lambda begin, n, bits: F.zip_with(part(a, begin, n), part(b, begin, n), lambda x, y: _wrapped(change(x.cast("long"), y.cast("long")), bits).cast("int"))
    return F.concat(both(1, HASH_LANES, HASH_BITS), both(HASH_LANES + 1, SKETCH_LANES, SKETCH_BITS))


def with_paragraphs(whole: Column, text: Column) -> Column:
    """Lanes of a document, the paragraphs of text put in."""
    return _changed(whole, lanes(text), lambda x, y: x + y)


def without_paragraphs(whole: Column, text: Column) -> Column:
    """Lanes of a document, the paragraphs of text taken out."""
    return _changed(whole, lanes(text), lambda x, y: x - y)


def as_text(whole: Column) -> Column:
    """Lanes as lower-case hexadecimal digits: 8 for a hash lane, 5 for a sketch lane."""
    digits = lambda x, bits: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(_long((1 << bits) - 1)))), bits // 4, "0")
    part = lambda begin, n, bits: F.array_join(F.transform(F.slice(whole, begin, n), lambda x: digits(x, bits)), "")
    return F.concat(part(1, HASH_LANES, HASH_BITS), part(HASH_LANES + 1, SKETCH_LANES, SKETCH_BITS))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, how alike the documents of two fingerprints are: the cosine of their sketch lanes, nothing below 0; 1 for
    equal fingerprints."""
    sketch = lambda x: F.transform(F.slice(x, HASH_LANES + 1, SKETCH_LANES), lambda v: v.cast("double"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda total, v: total + v)
    cosine = _once(F.struct(sketch(a).alias("x"), sketch(b).alias("y")), lambda s: F.try_divide(product(s["x"], s["y"]), F.sqrt(product(s["x"], s["x"])) * F.sqrt(product(s["y"], s["y"]))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)), F.lit(0.0)))


def fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' id and text columns as doc_id and text, with n_chars, lanes and fingerprint (lanes as text), for every row.

    Null texts count as empty: no characters. Repeated and null ids are kept, one result for each row. An empty table gives no
    rows. Other columns are ignored. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("lanes", lanes(F.col("text"))).withColumn("fingerprint", as_text(F.col("lanes")))


#: What tells documents apart and orders them: null ids first, rows that repeat an id by a hash of their text.
KEY = ["with_id", "id", "text_hash"]


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(doc.isNotNull().alias("with_id"), F.coalesce(doc, _long(0)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def following(keys: DataFrame) -> DataFrame:
    """keys (KEY, n_chars; each once) and the key of the next of each in their order as next_*; after the last, the first.

    Keys are sorted by ranges and numbered within each; a range's last key takes the first key of the next range, of which
    there are as many as partitions.
    """
    spark = keys.sparkSession
    ranges = staged(keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "keys")
    ahead = [F.lead(c).over(Window.partitionBy("part").orderBy("place")).alias(f"next_{c}") for c in KEY]
    inside = ranges.select(*KEY, "n_chars", "part", *ahead)
    heads = ranges.groupBy("part").agg(F.min_by(F.struct(*KEY), "place").alias("head")).orderBy("part").collect()
    after = [(r["part"], *heads[(i + 1) % len(heads)]["head"]) for i, r in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(after, "part int, first_with_id boolean, first_id long, first_text_hash long"))
    chosen = [F.coalesce(F.col(f"next_{c}"), F.col(f"first_{c}")).alias(f"next_{c}") for c in KEY]
    return inside.join(table, "part").select(*KEY, "n_chars", *chosen)


def edited_halves(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents compared with an edited form of themselves and with the next one.

    doc_id, n_chars (code points), edited (the text, of which the last floor(n_chars / 2) code points are replaced by the first
    as many of the next document, or all if it has fewer), fingerprint, edited_fingerprint, near_edited and near_next
    (likeness of the document's fingerprint to those of its edited form and of the next document).

    The next document has the next larger id; after the last comes the first, which for a single document is itself. Null ids
    come before all others; rows that repeat an id are ordered by a hash of their texts; rows that repeat both are one
    document, and each gets its result. Null texts count as empty. An empty table gives no rows. Other columns are
    ignored.

    Texts are shuffled once, by their key, and at most half of the next document's text once more.
    """
    rows = _keyed(docs, text_col, id_col)
    keys = following(rows.select(*KEY, F.length("text").cast("long").alias("n_chars")).distinct())
    hashed = rows.withColumn("lanes", lanes(F.col("text")))
    asked = keys.select(*[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"own_{c}") for c in KEY], F.floor(F.col("n_chars") / 2).cast("int").alias("wanted"))
    heads = hashed.join(asked, KEY).select(*[F.col(f"own_{c}").alias(c) for c in KEY], F.left("text", F.col("wanted")).alias("head"), F.col("lanes").alias("next_lanes"))
    both = hashed.join(heads.dropDuplicates(KEY), KEY)
    n = F.length("text")
    edited = both.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.col("head"))).withColumn("edited_lanes", lanes(F.col("edited")))
    near = lambda other: likeness(F.col("lanes"), F.col(other))
    return edited.select(F.when(F.col("with_id"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "edited", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"), near("edited_lanes").alias("near_edited"), near("next_lanes").alias("near_next"))
