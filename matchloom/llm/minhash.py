"""Near-duplicate detection by MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class. Signatures of the classes are cut into bands; classes that share a
band are candidates. A pair of candidates is compared batch by batch of its signatures, and given up as soon as the
posterior chance of a similarity at the threshold or above falls below the chosen miss probability; what survives is
verified on the full shingle sets.

No bucket is expanded into pairs. First every member is compared with its bucket's first document; most buckets are
then one component and need nothing more. The members of large ones that are not are compared with some further documents of
the bucket, at a cost in proportion to their number. In what is still open, blocks of members
of different components are compared inside tasks: on signatures first, which leaves the members that may have a link to
another component; then those of a family on their full sets, but for pairs that are tied already. A task passes on only
the links that tie components together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices, staged
from matchloom.llm.components import components
from matchloom.llm.shingles import mixed, shingle_sets

#: Signature: BANDS bands of ROWS values; a pair at similarity 0.85 shares no band with a chance below 1e-6.
BANDS, ROWS, BATCH = 24, 5, 30
#: A survivor's chance of being a link is MISS at least.
MISS = 1e-5
#: Most members of a bucket that are compared in one task with as many others. Members of a bucket of more blocks than
#: MANY_BLOCKS, each of which would go to as many tasks, are compared with PIVOTS further documents first.
BLOCK, MANY_BLOCKS, PIVOTS = 512, 8, 8
#: Most ids that are broadcast (sixteen bytes each at most); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


@cache
def needed(percent: int) -> np.ndarray:
    """For each number of compared signature bytes, the fewest equal ones that keep a pair alive.

    With a uniform prior, the posterior of the agreement after m of n equal values is a beta distribution, whose upper
    tail at t is a binomial sum. Bytes of unequal values agree by chance once in 256.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = np.zeros(BANDS * ROWS + 1, np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail = np.cumsum([comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
        out[n] = int((tail < MISS).sum())
    return out


@cache
def _multipliers() -> np.ndarray:
    return mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (columns) of the non-empty sets values[bounds[i]:bounds[i + 1]] (rows)."""
    out = np.empty((len(bounds) - 1, BANDS * ROWS), np.uint32)
    for k, a in enumerate(_multipliers()):
        out[:, k] = np.minimum.reduceat(((values * a) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each set and band; keys of different bands differ."""
    x = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)), x.shape[:2])
    for j in range(ROWS):
        key = mixed(key ^ (x[:, :, j] + np.uint64(j + 1 << 33)))
    return key.view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for at, values, bounds in shingle_sets(batch.column(1).to_pylist()):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            sig = signature(values, np.append(bounds[:-1][some], len(values))) if len(some) else np.empty((0, BANDS * ROWS), np.uint32)
            cid = [class_of(values[bounds[i] : bounds[i + 1]]) for i in some]
            ids = batch.column(0).slice(at, len(n))
            every = lambda column, kind: pa.array(column, kind).take(pa.array(place, mask=n == 0))  # noqa: B023, E731
            place = np.cumsum(n > 0) - 1
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(some) + 1, BANDS), pa.int32()), pa.array(band_keys(sig).ravel()))
            sketch = (sig & 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), every(cid, pa.int64()), keys.take(pa.array(place, mask=n == 0)), every([r.tobytes() for r in sketch], pa.binary()), batch.column(2).slice(at, len(n))], names=["doc_id", "n_shingles", "cid", "bands", "sketch", "text_hash"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingles) of those rows whose text has the class that is asked for: an id may occur in several rows."""
    for batch in slices(batches):
        cids, texts = batch.column("cid").to_pylist(), batch.column("text").to_pylist()
        for at, values, bounds in shingle_sets(texts):
            sets = [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            rows = [(cids[at + i], s.tobytes()) for i, s in enumerate(sets) if len(s) and class_of(s) == cids[at + i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "shingles"])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        for at, values, bounds in shingle_sets(texts):
            cids = [class_of(values[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), batch.column("text").slice(at, len(cids))], names=["cid", "text"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that sequential comparison does not give up."""
    need = needed(percent)
    for batch in batches:
        equal = _sketches(batch.column("sa")) == _sketches(batch.column("sb"))
        alive, matches = np.arange(len(equal)), np.zeros(len(equal), np.int64)
        for n in range(BATCH, BANDS * ROWS + 1, BATCH):
            matches[alive] += equal[alive, n - BATCH : n].sum(axis=1)
            alive = alive[matches[alive] >= need[n]]
        kept = batch.select(["a", "b"]).take(pa.array(alive))
        yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
            n, m = len(x) // 8, len(y) // 8
            if 100 * min(n, m) < percent * max(n, m):
                linked.append(False)
                continue
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            linked.append(100 * both >= percent * (n + m - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _alive(sketch: np.ndarray, i: int, others: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Those of the others that sequential comparison with row i does not give up."""
    matches = np.zeros(len(others), np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        matches += (sketch[others, n - BATCH : n] == sketch[i, n - BATCH : n]).sum(axis=1)
        on = matches >= need[n]
        others, matches = others[on], matches[on]
    return others


def _open(percent: int):
    def members(cell: pa.Table) -> pa.Table:
        """The members of one cell that may be linked with a member of another component."""
        comp, sketch, need = cell.column("comp").to_numpy(), _sketches(cell.column("sketch").combine_chunks()), needed(percent)
        hit = np.zeros(len(comp), bool)
        for i in range(len(comp)):
            near = _alive(sketch, i, np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1, need)
            if len(near):
                hit[i] = True
                hit[near] = True
        return cell.select(["bucket", "cid"]).filter(pa.array(hit))

    return members


def _crossing(percent: int):
    def links(cell: pa.Table) -> pa.Table:
        """Links between components in one cell, verified on the full sets; only those that tie what is not tied yet.

        Shared shingles are counted by marking those of one member and looking up those of the others, so memory is in
        proportion to the sets themselves.
        """
        cid, comp = cell.column("cid").to_numpy(), cell.column("comp").to_numpy()
        sketch, need = _sketches(cell.column("sketch").combine_chunks()), needed(percent)
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        place, bounds = place.astype(np.int32), np.cumsum(np.append(0, size))
        mark = np.zeros(len(values), bool)
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i in range(len(cid)):
            near = _alive(sketch, i, np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1, need)
            if not len(near):
                continue
            own = place[bounds[i] : bounds[i + 1]]
            mark[own] = True
            for j in near:
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x == y or 100 * min(size[i], size[j]) < percent * max(size[i], size[j]):
                    continue
                both = int(mark[place[bounds[j] : bounds[j + 1]]].sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    root[x] = y
                    out.append((max(cid[i], cid[j]), min(cid[i], cid[j])))
            mark[own] = False
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return links


def cells(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows with p, q: each group cut into blocks by cid, a row in every cell (two blocks) of its block. sizes: key, n."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rows.join(sizes.select(key, blocks.alias("blocks")), key).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("p", F.least("i", "j")).withColumn("q", F.greatest("i", "j")).drop("i", "j", "blocks")


def with_small(df: DataFrame, ids: DataFrame, on, how: str, n: int) -> DataFrame:
    """A join with a table of n ids, broadcast if they are few."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, how)


class _Pairs:
    """What verification needs: sketches and shingle sets of candidate classes."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        side = lambda c, s: self.sketches.select(F.col("cid").alias(c), F.col("sketch").alias(s))
        both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(partial(_likely, percent=self.percent), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs with linked, staged."""
        side = lambda c, x: self.sets.select(F.col("cid").alias(c), F.col("shingles").alias(x))
        both = pairs.join(side("a", "xa"), "a").join(side("b", "xb"), "b").select("a", "b", "xa", "xb")
        return staged(both.mapInArrow(partial(_exact, percent=self.percent), "a long, b long, linked boolean"), "verified")


def near_duplicates(docs: DataFrame, *, percent: int = 85, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; the set of a document holds its distinct
    shingles of five words, of a shorter one its whole sequence. Documents are linked if 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links lead to, kept says that it is the row's own.

    Null and empty texts, and those of white space only, have no shingles and are linked with nothing. Rows with a null
    id are linked as others, but no component is named after them: their kept is false, and component_id is null if no
    row of the component has an id. Rows that repeat an id and a text are both kept or neither; rows that repeat an id
    with other texts are linked each by its own text. Empty tables give no rows; extra columns are ignored.
    Shingles are compared as 64-bit hashes, classes of equal sets by a 64-bit digest.
    """
    return _judged(docs, percent, text_col, id_col).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, percent: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of near_duplicates with cid, text_hash, and first: the row is the one of its component that has the least
    id and of those the least text_hash, ids before null; rows that repeat both are all first."""
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = columns.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signed, "doc_id long, n_shingles long, cid long, bands array<long>, sketch binary, text_hash long")
    base = staged(signed, "signatures", compression="zstd")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    classes = base.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min(row).alias("best"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    members = classes.select("cid", "first_id", F.explode("bands").alias("bucket"))
    pivot = F.min(F.struct(F.coalesce("first_id", F.lit((1 << 63) - 1)), "cid")).alias("pivot")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), pivot).filter("n > 1")
    found = staged(members.join(shared, "bucket").select("bucket", "cid", "first_id", F.col("pivot.cid").alias("pivot")), "buckets")
    candidates = staged(found.select("cid", F.col("first_id").alias("doc_id")).distinct(), "candidates")
    n = candidates.count()
    links = None
    if n:
        sketches = staged(with_small(base.select("cid", "sketch"), candidates.select("cid"), "cid", "left_semi", n).dropDuplicates(["cid"]), "sketches")
        known = candidates.filter("doc_id IS NOT NULL")
        sets = with_small(columns, known, "doc_id", "inner", n).select("cid", "text")
        nameless = candidates.filter("doc_id IS NULL").select("cid")  # classes of rows without ids: found by their text
        if not nameless.isEmpty():
            own = columns.filter("doc_id IS NULL").mapInArrow(_classed, "cid long, text string")
            sets = sets.unionByName(own.join(nameless, "cid", "left_semi"))
        sets = staged(sets.mapInArrow(_sets, "cid long, shingles binary").dropDuplicates(["cid"]), "sets")
        links = _links(found, sketches, _Pairs(sketches, sets, percent))
    named = base.select("doc_id", "n_shingles", "cid", "text_hash")
    if links is None:
        label = classes.select("cid", F.col("first_id").alias("component_id"), "best")
    else:
        comps = components(links)
        by_class = classes.select("cid", "first_id", "best").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        by_label = by_class.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("best").alias("best"))
        label = by_class.drop("best").join(by_label, "label").select("cid", "component_id", "best")
    out = named.join(label.filter("cid IS NOT NULL"), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    first = F.col("cid").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "cid", "text_hash", first.alias("first"))


def _links(found: DataFrame, sketches: DataFrame, pairs: _Pairs) -> DataFrame:
    """Links whose components are those of all links."""
    stars = found.filter("cid <> pivot").select(F.greatest("cid", "pivot").alias("a"), F.least("cid", "pivot").alias("b")).distinct()
    links = pairs.verified(pairs.likely(stars)).filter("linked").select("a", "b")
    comps = components(links).withColumnRenamed("node", "cid")
    labelled = lambda comps: found.select("bucket", "cid").join(comps, "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("comp"))
    open_buckets = lambda members: members.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x <> y")
    members = staged(labelled(comps), "members")
    still = staged(open_buckets(members), "still")
    large = still.filter(F.col("n") > MANY_BLOCKS * BLOCK).select("bucket")
    if n := large.count():
        some = staged(with_small(members, large, "bucket", "left_semi", n), "large")
        drawn = F.array(*(F.min(F.struct(F.xxhash64("cid", F.lit(turn)), "cid", "comp")) for turn in range(PIVOTS)))
        pivots = some.groupBy("bucket").agg(drawn.alias("drawn")).select("bucket", F.explode(F.array_distinct(F.transform("drawn", lambda x: F.struct(x.cid.alias("cid"), x.comp.alias("comp"))))).alias("pivot"))
        turned = with_small(some, pivots, "bucket", "inner", n * PIVOTS).filter("comp <> pivot.comp")
        tried = turned.select(F.greatest("cid", "pivot.cid").alias("a"), F.least("cid", "pivot.cid").alias("b")).distinct()
        links = staged(links.unionByName(pairs.verified(pairs.likely(tried)).filter("linked").select("a", "b")), "links")
        comps = components(links).withColumnRenamed("node", "cid")
        members = staged(labelled(comps), "members")
        still = staged(open_buckets(members), "still")
    by_cell = cells(members, "bucket", still).join(sketches, "cid").select("bucket", "p", "q", "cid", "comp", "sketch")
    open_ = staged(by_cell.groupBy("bucket", "p", "q").applyInArrow(_open(pairs.percent), "bucket long, cid long").distinct(), "open")
    # buckets of one family are looked at together, so that sets are sent once
    hubs = open_.groupBy("bucket").agg(F.min("cid").alias("b"))
    families = components(open_.join(hubs, "bucket").select(F.col("cid").alias("a"), "b")).select(F.col("node").alias("cid"), F.col("label").alias("family"))
    family = staged(families.join(comps, "cid", "left").select("family", "cid", F.coalesce("label", "cid").alias("comp")), "families")
    by_cell = cells(family, "family", family.groupBy("family").agg(F.count("*").alias("n"))).join(sketches, "cid").join(pairs.sets, "cid")
    by_cell = by_cell.select("family", "p", "q", "cid", "comp", "sketch", "shingles")
    return links.unionByName(staged(by_cell.groupBy("family", "p", "q").applyInArrow(_crossing(pairs.percent), "a long, b long"), "crossing"))


def drop_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """The rows of docs that stay: one document of each component, the one of smallest id; null ids come last.

    Each row is judged by its own id and text, so an id that occurs with several texts may stay with some of them. Rows
    without shingles stay. Of rows that have no id and repeat a text one stays; rows that repeat an id and a text stay
    together.
    """
    judged = staged(_judged(docs, percent).select("doc_id", "text_hash", "cid", "first"), "judged")
    gone = staged(judged.filter("NOT first").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (text_hash == F.col("gone_hash"))
    left = with_small(docs, gone, same, "left_anti", gone.count())
    again = judged.filter("doc_id IS NULL AND first AND cid IS NOT NULL").groupBy("text_hash").count().filter("count > 1")
    if again.isEmpty():
        return left
    # rows without an id that repeat a text
    nameless = F.col("doc_id").isNull() & F.col("text").cast("string").rlike("[^\\x09-\\x0D ]")
    single = left.filter(nameless).withColumn("text_hash_", text_hash).dropDuplicates(["text_hash_"]).drop("text_hash_")
    return left.filter(~F.coalesce(nameless, F.lit(False))).unionByName(single)
