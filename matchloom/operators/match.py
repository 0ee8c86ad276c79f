"""The trigram similarity join, top-k, and the search entry points built on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.policy import POLICY
from matchloom.storage import looked_up, staged, unsent

MODES = ("similarity", "word", "strict_word")
FIELDS = ("full_reference", "title", "authors", "bugs_reference")
EPS = 1e-9


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first k rows of each group; with rank, their number (from 1) as that column."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    name = rank or "__place"
    out = rows.withColumn(name, place).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def _texts(df: DataFrame, column: str) -> DataFrame:
    """Distinct texts with their trigram sets; texts without trigrams match nothing."""
    grams = df.select(F.col(column).alias("t")).filter("t IS NOT NULL").distinct().withColumn("grams", T.trigrams(F.col("t")))
    return grams.filter(F.size("grams") > 0)


def numbered(texts: DataFrame, label: str) -> DataFrame:
    """texts with id, a number of the text, and n, the size of its trigram set; written once, as several steps use both.

    Whatever follows is shuffled by numbers, however long texts are.
    """
    return staged(texts.withColumn("n", F.size("grams")).withColumn("id", F.monotonically_increasing_id()), label)


def needed(n: Column, threshold: float) -> Column:
    """How many of a set's n trigrams another one must hold for a similarity of threshold; 1 at least."""
    return F.greatest(F.lit(1), F.ceil(n * threshold - EPS).cast("int"))


def _probes(texts: DataFrame, frequency: DataFrame, keep: Column) -> DataFrame:
    """The keep rarest trigrams of each text, ties by the trigram itself. A frequent trigram meets one row of frequency."""
    each = texts.select("id", "n", F.explode("grams").alias("gram")).join(frequency, "gram", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("frequency", F.lit(0)), "gram"))
    return each.withColumn("place", place).filter(F.col("place") <= keep).select("id", "n", "gram")


def _frequency(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("frequency"))


def bands(threshold: float) -> list[tuple[int, int, int]]:
    """(above, upto, together): pairs whose larger set has more than `above` and at most `upto` trigrams are found by `together`
    of them at once. Each text has two trigrams at least, and every pair of a band has to share so many."""
    return [(0, 8, 2), (8, 24, 3), (24, 1 << 30, 2)] if threshold > 0.5 else [(0, 1 << 30, 1)]


def _combined(ranked: Column, keep: Column, together: int) -> Column:
    """Numbers of all choices of so many of the first `keep` trigrams, by a hash: what is equal by chance is measured anyway."""
    first = F.slice(ranked, 1, F.greatest(keep, F.lit(0)))
    rest = lambda xs, i: F.slice(xs, i + 2, F.size(xs))

    def choices(xs: Column, chosen: tuple[Column, ...], left: int) -> Column:
        if left == 1:
            return F.transform(xs, lambda x: F.xxhash64(*chosen, x))
        return F.flatten(F.transform(xs, lambda x, i: choices(rest(xs, i), (*chosen, x), left - 1)))

    return choices(first, (), together)


def _signatures(texts: DataFrame, threshold: float, together: int) -> DataFrame:
    """(id, n, smaller, key) of texts (id, n, ranked: those of its trigrams that both sides know, rarest first).

    Two sets of a <= b trigrams at similarity t share ceil(t b) at least, and ceil(2 t a / (1 + t)): of the trigrams known to
    both sides, so many less together - 1 may be wanting in the rarest of each, as the smaller and as the larger set.
    """
    sides = [(F.lit(True), 2 * threshold / (1 + threshold)), (F.lit(False), threshold)]
    keep = lambda share: F.size("ranked") - needed(F.col("n"), share) + together
    keys = F.array(*(F.struct(smaller.alias("smaller"), F.array_distinct(_combined(F.col("ranked"), keep(share), together)).alias("keys")) for smaller, share in sides))
    each = texts.select("id", "n", F.explode(keys).alias("s"))
    return each.select("id", "n", "s.smaller", F.explode("s.keys").alias("key"))


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id) of numbered texts that may have the threshold: a few rare trigrams at once are joined, so what
    meets stays few however often each trigram occurs. threshold > 0.5 to be so."""
    frequency = looked_up(staged(_frequency(right).join(unsent(left.select(F.explode("grams").alias("gram")).distinct()), "gram"), "frequency"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("frequency", "gram"))), lambda x: x.gram)
    known = lambda texts: texts.select("id", "n", F.explode("grams").alias("gram")).join(frequency, "gram").groupBy("id", "n").agg(listed.alias("ranked"))
    left, right = staged(known(left), "ranked"), staged(known(right), "ranked")
    found = []
    for above, upto, together in bands(threshold):
        some = lambda texts: texts.filter((F.col("n") >= above * threshold - EPS) & (F.col("n") <= upto))  # noqa: B023, E731
        a = _signatures(some(left), threshold, together).select("key", "smaller", F.col("id").alias("left_id"), F.col("n").alias("na"))
        # a text is the larger one of a pair where the other is the smaller one
        b = _signatures(some(right), threshold, together).select("key", (~F.col("smaller")).alias("smaller"), F.col("id").alias("right_id"), F.col("n").alias("nb"))
        sized = F.when(F.col("smaller"), (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * threshold - EPS)).otherwise((F.col("nb") < F.col("na")) & (F.col("nb") >= F.col("na") * threshold - EPS))
        # keys are many times as many as texts, which their size as files does not tell
        found.append(unsent(a).join(b, ["key", "smaller"]).filter(sized).select("left_id", "right_id").distinct())
    return reduce(DataFrame.unionByName, found).distinct()


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left_text, right_text, sim) of distinct texts (columns t, grams) with similarity threshold or more.

    Two sets at Jaccard similarity t share one of the n - ceil(t n) + 1 rarest trigrams of either, in one common order,
    and their sizes differ by the factor t at most; so few trigrams are joined, the frequent ones seldom, and none that
    could match is lost. The pairs are then measured on whole sets. threshold > 0.
    """
    left = numbered(left, "left")
    # texts of other sizes match nothing: few sizes, as texts on the left have few
    n = F.size("grams")
    sizes = left.select("n").distinct().select(F.explode(F.sequence(F.ceil(F.col("n") * threshold - EPS).cast("int"), F.floor(F.col("n") / threshold + EPS).cast("int"))).alias("n")).distinct()
    right = numbered(right.withColumn("n", n).join(sizes, "n", "left_semi").drop("n"), "right")
    if threshold > 0.5:
        return _measured(_candidates(left, right, threshold), left, right, threshold)
    frequency = _frequency(right)
    keep = F.col("n") - needed(F.col("n"), threshold) + 1
    a = _probes(left, frequency, keep).select("gram", F.col("id").alias("left_id"), F.col("n").alias("na"))
    b = _probes(right, frequency, keep).select("gram", F.col("id").alias("right_id"), F.col("n").alias("nb"))
    sized = (F.col("nb") >= F.col("na") * threshold - EPS) & (F.col("na") >= F.col("nb") * threshold - EPS)
    return _measured(a.join(b, "gram").filter(sized).select("left_id", "right_id").distinct(), left, right, threshold)


def _measured(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(unsent(left.select(F.col("id").alias("left_id"), F.col("t").alias("left_text"), F.col("grams").alias("ga"))), "left_id")
    both = both.join(unsent(right.select(F.col("id").alias("right_id"), F.col("t").alias("right_text"), F.col("grams").alias("gb"))), "right_id")
    return both.withColumn("sim", T.jaccard(F.col("ga"), F.col("gb"))).filter(F.col("sim") >= threshold).select("left_text", "right_text", "sim")


#: So many shared trigrams are counted in the join that finds pairs: pairs that share fewer are never measured.
COUNTED = 8


def containment_candidates(needles: DataFrame, haystacks: DataFrame, threshold: float, counted: int = COUNTED) -> DataFrame:
    """Pairs (needle, haystack: ids) that may have threshold or more; both sides have id, n, grams.

    A run of the haystack with similarity t holds ceil(t n) of the needle's n trigrams. Of any so many, at least c are among
    the n - ceil(t n) + c rarest ones: the join on these counts what a pair shares, and pairs that share fewer than c
    are dropped. c is `counted`, or all that is needed, if that is less.
    """
    least = needed(F.col("n"), threshold)
    count = F.least(least, F.lit(counted))
    a = _probes(needles, _frequency(haystacks), F.col("n") - least + count).select("gram", F.col("id").alias("needle"), count.alias("least"))
    b = haystacks.select(F.col("id").alias("haystack"), F.explode("grams").alias("gram"))
    shared = a.join(b, "gram").groupBy("needle", "haystack").agg(F.count("*").alias("shared"), F.first("least").alias("least"))
    return shared.filter("shared >= least").select("needle", "haystack")


def contained_texts(needles: DataFrame, haystacks: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Pairs (right_text = needle, left_text = haystack, sim) by (strict) word similarity; columns t and grams on both sides.

    Pairs come from a join that counts shared trigrams (containment_candidates); their best runs are found over arrays
    of trigrams, which are fetched by number. threshold > 0.
    """
    needles = numbered(needles, "needles")
    haystacks = numbered(haystacks.select("t", "grams", *T.ordered_pieces(F.col("t"))), "haystacks")
    pairs = containment_candidates(needles, haystacks, threshold)
    both = pairs.join(needles.select(F.col("id").alias("needle"), F.col("t").alias("right_text"), F.col("grams").alias("own")), "needle")
    both = both.join(haystacks.select(F.col("id").alias("haystack"), F.col("t").alias("left_text"), "ordered", "word_sizes"), "haystack")
    return T.with_best_runs(both.select("left_text", "right_text", "own", "ordered", "word_sizes"), threshold, strict=strict).select("left_text", "right_text", "sim")


#: Searches of more pairs of texts than this go down by steps of similarity.
MANY_PAIRS = 10_000_000
STEPS = (0.999, 0.8, 0.51)


def by_steps(left: DataFrame, threshold: float, found: Callable[[DataFrame, float], DataFrame], rows: DataFrame, limit: int) -> DataFrame:
    """Pairs (left_text, right_text, sim) that hold the best `limit` rows of each text of left (t, grams).

    found: the pairs of some texts at a similarity. rows: right_text, n: how many rows have the text. A text that has `limit`
    rows at some similarity has its best among them, ties too, and only the others are searched for less similar ones.
    """
    out = []
    for step in [s for s in STEPS if s > threshold]:
        pairs = staged(found(left, step), "step")
        many = pairs.join(unsent(rows), "right_text").groupBy("left_text").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).select(F.col("left_text").alias("t"))
        many = unsent(staged(many, "many"))
        out.append(pairs.join(many, F.col("left_text") == F.col("t"), "left_semi"))
        left = staged(left.join(many, "t", "left_anti"), "rest")
        if left.isEmpty():
            break
    else:
        out.append(found(left, threshold))
    return reduce(DataFrame.unionByName, out)


def answers(q: DataFrame, best: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """query_id, entity_id, label, name_sim, rank. q: query_id, q. best: the first `limit` rows of each text q, with rank.

    Queries of one text have the same answer, so only those that come with several rows are ranked themselves; the rows of the
    others, the limit times as many as queries, are neither shuffled nor sorted.
    """
    asked = q.filter("q IS NOT NULL").groupBy("query_id").agg(F.collect_list("q").alias("qs"))
    columns = ["query_id", "entity_id", "label", "name_sim"]
    one = asked.filter(F.size("qs") == 1).select("query_id", F.col("qs")[0].alias("q")).join(unsent(best), "q").select(*columns, "rank")
    several = asked.filter(F.size("qs") > 1).select("query_id", F.explode("qs").alias("q")).join(unsent(best), "q").select(*columns)
    return one.unionByName(top_k(several, limit, ["query_id"], order, rank="rank"))


def fuzzy(queries: DataFrame, authority: DataFrame, *, threshold: float = POLICY.similarity, limit: int = POLICY.limit, mode: str = "similarity", field: str = "label", normalise: bool = True, floor: bool = True, needle: str = "column", many_pairs: int = MANY_PAIRS) -> DataFrame:
    """query_id, entity_id, label, name_sim, rank: the best matches of each query's text in authority's field.

    queries: query_id, query. authority: entity_id and field. mode 'word' and 'strict_word' look for the field within
    the query (needle='column') or the query within the field (needle='query'). Ties go by label, then entity_id. Null
    texts and texts without letters and digits match nothing. normalise=False compares plain texts; floor=False leaves
    out the exact override and the least score.

    authority may be a stored index (operators.index.TrigramIndex) instead, whose table is then not read.

    Equal texts are matched once; of the rows that share a label only the first `limit` can be among the best, so a
    label that is held by very many rows costs no more than another. More than many_pairs pairs of texts are searched by
    steps, down to the threshold only for queries that have too few better matches.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if not isinstance(authority, DataFrame):
        if mode != "similarity" or not normalise:
            raise ValueError("an index is of normalised texts, for mode 'similarity'")
        return authority.search(queries, threshold=threshold, limit=limit, floor=floor, many_pairs=many_pairs)
    shaped = T.normalise if normalise else (lambda c: c)
    q = queries.select("query_id", F.col("query").alias("q_raw"), shaped(F.col("query")).alias("q"))
    a = authority.select("entity_id", F.col(field).cast("string").alias("label")).withColumn("a", shaped(F.col("label")))
    a = top_k(a.filter("a IS NOT NULL"), limit, ["a"], [F.col("label"), F.col("entity_id")])
    a, left = staged(a, "rows"), staged(_texts(q, "q"), "texts")
    right = staged(_texts(a, "a"), "texts")

    def found(left: DataFrame, threshold: float) -> DataFrame:
        if mode == "similarity":
            return similar_texts(left, right, threshold)
        turned = needle == "query"
        pairs = contained_texts(left if turned else right, right if turned else left, threshold, mode == "strict_word")
        return pairs.select(F.col("right_text").alias("left_text"), F.col("left_text").alias("right_text"), "sim") if turned else pairs

    if left.count() * right.count() > many_pairs:
        pairs = by_steps(left, threshold, found, a.groupBy(F.col("a").alias("right_text")).agg(F.count("*").alias("n")), limit)
    else:
        pairs = found(left, threshold)
    score = T.exact_or(F.col("left_text"), F.col("right_text"), F.col("sim")) if floor else F.col("sim")
    named = pairs.withColumn("name_sim", score).join(unsent(a), F.col("right_text") == F.col("a")).select(F.col("left_text").alias("q"), "entity_id", "label", "name_sim")
    order = [F.desc("name_sim"), F.col("label"), F.col("entity_id")]
    return answers(q, top_k(named, limit, ["q"], order, rank="rank"), limit, order)


def fuzzy_locations(queries: DataFrame, locations: DataFrame, type_ids: list[int] | None = None, **options) -> DataFrame:
    """Search of locations, of the given types if there are any."""
    return fuzzy(queries, locations.filter(F.col("location_type_id").isin(type_ids)) if type_ids else locations, **options)


def fuzzy_countries(queries: DataFrame, locations: DataFrame, **options) -> DataFrame:
    return fuzzy_locations(queries, locations, [1], **options)


def fuzzy_regions(queries: DataFrame, locations: DataFrame, **options) -> DataFrame:
    return fuzzy_locations(queries, locations, [7], **options)


def fuzzy_modification_types(queries: DataFrame, types: DataFrame, **options) -> DataFrame:
    """Search on plain texts, without the exact override and the least score."""
    return fuzzy(queries, types, normalise=False, floor=False, **options)


def fuzzy_bibliography(queries: DataFrame, biblio: DataFrame, *, field: str = "full_reference", mode: str = "similarity", threshold: float | None = None, limit: int = POLICY.limit, needle: str = "column") -> DataFrame:
    """Search of bibliographic references in one of four fields, in one of three modes."""
    if field not in FIELDS:
        raise ValueError(f"unknown field {field!r}; one of {FIELDS}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    default = {"similarity": POLICY.similarity, "word": POLICY.word_similarity, "strict_word": POLICY.strict_word_similarity}[mode]
    return fuzzy(queries, biblio, threshold=default if threshold is None else threshold, limit=limit, mode=mode, field=field, needle=needle)
