"""Full-text search over a weighted corpus, and discovery of entity types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from matchloom.functions import text as T
from matchloom.operators.match import top_k
from matchloom.operators.match import _texts, similar_texts
from matchloom.operators.merge import union_distinct
from matchloom.policy import POLICY
from matchloom.storage import looked_up, staged, unsent

# What a hit counts by the column it is in.
WEIGHTS = {"label": 1.0, "abbreviation": 0.4, "description": 0.2}


#: Kinds are numbered from here on for each next table.
KINDS = 1000


def corpus(parts: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """table_name, entity_name, column_name, system_id, value, column_type, value_norm, value_id, kind of all non-null values,
    each once. kind is a number for each column of a table, in the order of their names. Stage what is searched.

    parts: (table, table name, key column, value column, column type).
    """
    return normalised(union_distinct(*values(parts)))


def values(parts: list[tuple[DataFrame, str, str, str, str]]) -> list[DataFrame]:
    """kind, table_name, column_name, system_id, value, column_type of each part's non-null values."""
    names = sorted({t for _, t, *_ in parts})
    kinds = {(t, c): KINDS * names.index(t) + i for t in names for i, c in enumerate(sorted({p[3] for p in parts if p[1] == t}))}
    return [df.select(F.lit(kinds[t, c]).alias("kind"), F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(k).cast("long").alias("system_id"), F.col(c).cast("string").alias("value"), F.lit(kind).alias("column_type")).filter("value IS NOT NULL") for df, t, k, c, kind in parts]


def normalised(out: DataFrame) -> DataFrame:
    """Values with what searches need of them."""
    return out.withColumn("entity_name", T.entity_name(F.col("table_name"))).withColumn("value_norm", T.normalise(F.col("value"))).withColumn("value_id", F.xxhash64("value"))


#: What tells rows of the corpus apart; names and values, which may be whole texts, are fetched for the rows that are left.
KEY = ["kind", "system_id", "value_id"]


def with_values(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found with the names and values of its corpus rows in place of their kind and value_id."""
    return found.join(unsent(rows.select(*KEY, "table_name", "column_name", "value")), KEY).drop("kind", "value_id")


def with_digest(rows: DataFrame) -> DataFrame:
    """rows with digest, that of the text, where they do not have it yet."""
    return rows if "digest" in rows.columns else rows.withColumn("digest", F.sha2("value_norm", 256))


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The keys of the first `limit` rows by key of each kind and text, with digest, that of the text, and nth (from 1); staged.

    Rows of one kind and text have the same ranks, so no others can be among the best `limit`, however many rows hold a text.
    Texts stay where they are.
    """
    each = with_digest(rows).select(*KEY, "digest")
    return staged(top_k(each, limit, ["kind", "digest"], [F.col("system_id"), F.col("value_id")], rank="nth"), "first")


def tokens(rows: DataFrame) -> DataFrame:
    """One row for each word of the corpus: its row's key, lexeme, pos (from 1), weight."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return rows.select(*KEY, F.element_at(weight, F.col("column_type")).alias("weight"), F.posexplode(T.words(F.col("value_norm"))).alias("pos", "lexeme")).withColumn("pos", F.col("pos") + 1)


def terms(queries: DataFrame) -> DataFrame:
    """Parsed web-search queries: query_id, branch, clause, negated, lexeme, place (in a phrase, from 0), size (of the phrase).

    A query is a disjunction of branches, which a word `or` divides; so `or` binds weaker than the white space between the
    words and phrases of a branch, all of which must be met. "Several words" are a phrase, as are the words of a piece like
    a-b; what follows a minus must not occur, two minuses cancel out. An `or` that begins or ends the query, or follows
    another that divides, is a word.
    """
    norm = F.regexp_replace(T.normalise(F.col("query")), r"(^|\s)(-+)\s+", "$1$2")
    kept = "array<struct<branch:int,piece:string>>"

    def step(state: Column, x: Column, last: Column) -> Column:
        divides = (x["piece"] == "or") & ~state["after"] & (x["i"] < last)
        more = F.concat(state["kept"], F.array(F.struct(state["branch"].alias("branch"), x["piece"].alias("piece"))))
        return F.struct((state["branch"] + divides.cast("int")).alias("branch"), divides.alias("after"), F.when(divides, state["kept"]).otherwise(more).alias("kept"))

    pieces = F.expr("""regexp_extract_all(__q, '(-*"[^"]*"|\\\\S+)', 1)""")
    split = queries.withColumn("__q", norm).select("query_id", F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("piece"))).alias("pieces"))
    start = F.struct(F.lit(0).alias("branch"), F.lit(True).alias("after"), F.array().cast(kept).alias("kept"))
    branches = F.aggregate("pieces", start, lambda state, x: step(state, x, F.size("pieces") - 1), lambda state: state["kept"])
    parsed = split.select("query_id", F.posexplode(branches).alias("clause", "p")).select("query_id", "p.branch", "clause", "p.piece")
    minuses = F.length(F.regexp_extract("piece", "^-*", 0))
    parsed = parsed.withColumn("negated", minuses % 2 == 1).withColumn("lexemes", T.words(F.col("piece"))).filter(F.size("lexemes") > 0)
    return parsed.select("query_id", "branch", F.col("clause").cast("long").alias("clause"), "negated", F.size("lexemes").alias("size"), F.posexplode("lexemes").alias("place", "lexeme"))


def candidates(parsed: DataFrame, toks: DataFrame) -> DataFrame:
    """query_id, branch and the keys of rows that may satisfy the branch: those with the rarest word that it asks for.

    A row has to meet every clause that is not negated, so frequent words are never joined to all rows that hold them.
    """
    often = toks.groupBy("lexeme").agg(F.count("*").alias("f"))
    wanted = parsed.filter(~F.col("negated")).join(often, "lexeme", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rarest = wanted.groupBy("query_id", "branch").agg(F.min(F.struct("f", "lexeme")).alias("rare"))
    probes = rarest.select("query_id", "branch", F.col("rare.lexeme").alias("lexeme"))
    return probes.join(unsent(toks.select("lexeme", *KEY)), "lexeme").select("query_id", "branch", *KEY).distinct()


def cover_density(hits: Column, branches: Column) -> Column:
    """Sum over the minimal covers of a row's hits: 1 / (1 + words in the cover that are no hit).

    hits: array of (pos, clause), sorted; branches: arrays of the clauses that must be hit together. A minimal cover hits
    every clause of some branch and holds no smaller range that does. One ends at each place where the best beginning
    moves: of each branch the earliest of the latest hits of its clauses, and of these the latest; several hits at one place
    count together.
    """
    following = F.concat(F.slice(hits, 2, F.size(hits)), F.array(F.lit(None).cast("struct<pos:int,clause:bigint>")))
    marked = F.zip_with(hits, following, lambda x, y: F.struct(x.pos.alias("pos"), x.clause.alias("clause"), F.coalesce(x.pos != y.pos, F.lit(True)).alias("last")))
    # the latest hit of a clause: its number among the places that are hit, and the place
    seen = lambda i, pos: F.struct(i.alias("i"), pos.alias("pos"))

    def step(state: Column, hit: Column) -> Column:
        latest = F.transform(branches, lambda b, k: F.transform(b, lambda c, j: F.when(c == hit.clause, seen(state.i, hit.pos)).otherwise(F.get(F.get(state.latest, k), j))))
        return F.struct(latest.alias("latest"), state.least.alias("least"), state.i.alias("i"), state.total.alias("total"), hit.last.alias("last"), F.array_max(F.transform(latest, lambda b: F.array_min(b))).alias("new"), hit.pos.alias("pos"))

    def closed(state: Column) -> Column:
        moved = state.last & (state.new.i > state.least)
        noise = state.pos - state.new.pos - (state.i - state.new.i)
        total = state.total + F.when(moved, 1.0 / (1 + noise)).otherwise(0.0)
        least = F.when(moved, state.new.i).otherwise(state.least)
        return F.struct(state.latest.alias("latest"), least.alias("least"), (state.i + state.last.cast("int")).alias("i"), total.alias("total"))

    # what a step uses several times is made once: as an element of an array of one
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    none = F.lit(-1)
    start = F.struct(F.transform(branches, lambda b: F.transform(b, lambda c: seen(none, none))).alias("latest"), none.alias("least"), F.lit(0).alias("i"), F.lit(0.0).alias("total"))
    covers = F.aggregate(marked, start, lambda state, hit: once(step(state, hit), closed), lambda state: state.total)
    # where every branch has one clause every place is a cover
    return F.when(F.forall(branches, lambda b: F.size(b) == 1), F.size(F.array_distinct(hits.pos)).cast("double")).otherwise(covers)


def asked_words(parsed: DataFrame, toks: DataFrame, first: DataFrame) -> DataFrame:
    """The words that some query asks for, of the rows `first` (keys); staged."""
    words = looked_up(staged(parsed.select("lexeme").distinct(), "words"))
    return staged(toks.join(words, "lexeme", "left_semi").join(unsent(first.select(*KEY)), KEY, "left_semi"), "tokens")


def hits(parsed: DataFrame, toks: DataFrame) -> DataFrame:
    """query_id and the keys of the rows that satisfy a branch of the query that asks for some word, with rank: the row's
    weight times the cover density of the branches that it satisfies. toks: asked_words.

    A phrase hits where it begins. Where words meet the queries is staged, as it is used several times.
    """
    met = staged(candidates(parsed, toks).join(unsent(toks), KEY).join(parsed, ["query_id", "branch", "lexeme"]), "met")
    hit = ["query_id", *KEY, "branch", "clause", "negated", "weight"]
    found = met.filter("size = 1").select(*hit, "pos").unionByName(_phrases(met, hit))
    each = parsed.filter(~F.col("negated")).groupBy("query_id", "branch").agg(F.sort_array(F.collect_set("clause")).alias("clauses"))
    asked = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("branch", "clauses"))).alias("branches"))
    # hits of the words of one query in one row: no more than the row has words for each of the query's
    met_by = F.when(~F.col("negated"), F.struct("pos", "clause", "branch"))
    rows = found.groupBy("query_id", *KEY).agg(F.collect_list(met_by).alias("hits"), F.collect_set(F.when(F.col("negated"), F.col("branch"))).alias("bad"), F.max("weight").alias("weight")).join(asked, "query_id")
    good = F.filter("branches", lambda b: ~F.array_contains("bad", b.branch) & (F.size(F.array_except(b.clauses, F.col("hits.clause"))) == 0))
    rows = rows.withColumn("branches", good).filter(F.size("branches") > 0)
    counted = F.filter("hits", lambda h: F.exists("branches", lambda b: b.branch == h.branch))
    rows = rows.withColumn("hits", F.sort_array(F.transform(counted, lambda h: F.struct(h.pos.alias("pos"), h.clause.alias("clause")))))
    return rows.select("query_id", *KEY, (F.col("weight") * cover_density(F.col("hits"), F.col("branches.clauses"))).alias("rank"))


def _phrases(met: DataFrame, hit: list[str]) -> DataFrame:
    """Where all words of a phrase follow each other."""
    return met.filter("size > 1").groupBy(*hit, "size", (F.col("pos") - F.col("place")).alias("pos")).agg(F.count("*").alias("n")).filter("n = size").select(*hit, "pos")


#: Rows of the corpus in a block of the complement.
BLOCK_ROWS = 1000


def in_order(rows: DataFrame) -> DataFrame:
    """The keys of corpus rows with number, from 0 in their order, and block; staged.

    Keys are sorted by ranges and numbered within each; what comes before a range is a table of as many rows as partitions.
    """
    ranges = staged(rows.select(*KEY).repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ranges")
    sizes, before, at = ranges.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("part").collect(), [], 0
    for r in sizes:
        before.append((r["part"], at - r["first"]))
        at += r["n"]
    numbered = ranges.join(F.broadcast(rows.sparkSession.createDataFrame(before, "part int, offset long")), "part").withColumn("number", F.col("place") + F.col("offset"))
    return staged(numbered.select(*KEY, "number", F.floor(F.col("number") / BLOCK_ROWS).alias("block")), "ordered")


def without(parsed: DataFrame, toks: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """query_id and the keys of the first `limit` rows, in the order of keys, that satisfy a branch which only says what must
    not occur; rank is 0.

    If n rows hold what must not occur, the answer lies among the first n + limit rows: so many are taken, in whole blocks,
    and those that hold it are taken away.
    """
    asks = parsed.groupBy("query_id", "branch").agg(F.min("negated").alias("none")).filter("none").select("query_id", "branch")
    only = staged(parsed.join(asks, ["query_id", "branch"]), "without")
    if only.isEmpty():
        return only.sparkSession.createDataFrame([], hits_schema(parsed, rows))
    met = toks.join(only, "lexeme")
    hit = ["query_id", *KEY, "branch", "clause", "negated", "weight"]
    bad = staged(met.filter("size = 1").select("query_id", "branch", *KEY).unionByName(_phrases(met, hit).select("query_id", "branch", *KEY)).distinct(), "held")
    many = bad.groupBy("query_id", "branch").agg(F.count("*").alias("n"))
    wanted = only.select("query_id", "branch").distinct().join(many, ["query_id", "branch"], "left").withColumn("upto", F.coalesce("n", F.lit(0)) + limit)
    blocks = wanted.select("query_id", "branch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - 1) / BLOCK_ROWS))).alias("block"))
    found = blocks.join(in_order(rows), "block").join(bad, ["query_id", "branch", *KEY], "left_anti")
    first = top_k(found.dropDuplicates(["query_id", *KEY]), limit, ["query_id"], [F.col("number")])
    return first.select("query_id", *KEY, F.lit(0.0).alias("rank"))


def hits_schema(parsed: DataFrame, rows: DataFrame) -> S.StructType:
    return S.StructType([parsed.schema["query_id"], *(rows.schema[c] for c in KEY), S.StructField("rank", S.DoubleType())])


def row_score(rank: Column, sim: Column, weight: float = POLICY.trigram_weight) -> Column:
    """The full-text rank of a hit (null: none), and a share of the trigram similarity."""
    return F.coalesce(rank, F.lit(0.0)) + weight * F.coalesce(sim, F.lit(0.0))


def scored(queries: DataFrame, rows: DataFrame, toks: DataFrame | None = None, *, threshold: float = POLICY.similarity) -> DataFrame:
    """Corpus rows that a query hits by words or by trigrams: fts_rank, trigram_sim (null where not hit), row_score. Of the rows
    that share a kind and a text, which have the same scores, the first by key.

    The two ways are separate joins put together by an outer join on the row, as a join on either would compare every
    query with every row. Rows that satisfy a query only by what they don't hold are no hits here.
    """
    parsed, first = staged(terms(queries), "terms"), first_rows(rows, 1)
    by_word = hits(parsed, asked_words(parsed, tokens(rows) if toks is None else toks, first))
    q = queries.select("query_id", T.normalise(F.col("query")).alias("q"))
    pairs = similar_texts(_texts(q, "q"), _texts(rows, "value_norm"), threshold)
    near = q.join(pairs, F.col("q") == F.col("left_text")).withColumn("digest", F.sha2("right_text", 256)).join(first, "digest")
    near = near.select("query_id", *KEY, F.col("sim").alias("trigram_sim"))
    both = by_word.withColumnRenamed("rank", "fts_rank").join(near, ["query_id", *KEY], "full")
    return both.withColumn("row_score", row_score(F.col("fts_rank"), F.col("trigram_sim")))


def entity_types(queries: DataFrame, rows: DataFrame, *, limit: int = POLICY.limit, alphabetical: bool = False, threshold: float = POLICY.similarity) -> DataFrame:
    """The best corpus row of each table for each query, then the tables of best score (or the first by name)."""
    found = scored(queries, rows, threshold=threshold)
    one = top_k(found.withColumn("table_no", F.floor(F.col("kind") / KINDS)), 1, ["query_id", "table_no"], [F.desc("row_score"), *map(F.col, KEY)])
    order = [F.col("table_no")] if alphabetical else [F.desc("row_score"), F.col("table_no")]
    out = with_values(top_k(one, limit, ["query_id"], order, rank="rank").drop("table_no"), rows)
    return out.withColumn("fts_rank", F.coalesce("fts_rank", F.lit(0.0))).withColumn("trigram_sim", F.coalesce("trigram_sim", F.lit(0.0)))


def table_scores(queries: DataFrame, rows: DataFrame, *, limit: int = 5, threshold: float = POLICY.similarity) -> DataFrame:
    """Tables by the best full-text rank and the best similarity of their rows."""
    names = rows.select("kind", "table_name").distinct()  # a few
    found = scored(queries, rows, threshold=threshold).join(F.broadcast(names), "kind")
    per = found.groupBy("query_id", "table_name").agg(F.coalesce(F.max("fts_rank"), F.lit(0.0)).alias("fts_rank"), F.coalesce(F.max("trigram_sim"), F.lit(0.0)).alias("trigram_sim"))
    per = per.withColumn("score", row_score(F.col("fts_rank"), F.col("trigram_sim")))
    return top_k(per, limit, ["query_id"], [F.desc("score"), F.col("table_name")], rank="rank")


def search(queries: DataFrame, rows: DataFrame, *, limit: int = 20, toks: DataFrame | None = None) -> DataFrame:
    """Corpus rows by full-text rank, equal ranks by the rows' keys. Rows that satisfy a query only by what they don't hold
    have rank 0. toks: tokens(rows), where they are stored."""
    return with_values(best_keys(queries, rows, limit=limit, toks=toks), rows)


def best_keys(queries: DataFrame, rows: DataFrame, *, limit: int = 20, toks: DataFrame | None = None) -> DataFrame:
    """query_id, the keys of the rows that search() finds, rank, place.

    Of the rows that share a kind and a text only the first is ranked. A row that is among the best `limit` has the text of one
    of the best `limit` of these, so they alone are put back in the place of those.
    """
    parsed, several = staged(terms(queries), "terms"), first_rows(rows, limit)
    first, order = several.filter("nth = 1"), [F.desc("rank"), *map(F.col, KEY)]
    toks = asked_words(parsed, tokens(rows) if toks is None else toks, first)
    found = hits(parsed, toks).unionByName(without(parsed, toks, first, limit))
    best = top_k(found.groupBy("query_id", *KEY).agg(F.max("rank").alias("rank")), limit, ["query_id"], order)
    texts = best.join(unsent(first.select(*KEY, "digest")), KEY).select("query_id", "kind", "digest", "rank")
    every = texts.join(unsent(several.select(*KEY, "digest")), ["kind", "digest"])
    return top_k(every.select("query_id", *KEY, "rank"), limit, ["query_id"], order, rank="place")
