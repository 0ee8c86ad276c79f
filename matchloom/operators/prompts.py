"""Prompts for semantic matching, completions, and a table of translations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from matchloom.functions import text as T
from matchloom.operators.match import fuzzy_modification_types, top_k
from matchloom.policy import POLICY
from matchloom.storage import staged, tasks_for

CANDIDATE = "struct<id:string,value:string,score:double,reasons:array<string>>"
ANSWER = f"array<struct<input_id:string,input_value:string,candidates:array<{CANDIDATE}>>>"


def statistics(rows: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates for the choice of a format: rows, characters of all values (null counts 4), and whether any value is an
    array, a map or a struct."""
    nested = [c for c in columns if isinstance(rows.schema[c].dataType, (S.ArrayType, S.MapType, S.StructType))]
    any_nested = F.coalesce(F.max(F.greatest(F.lit(False), *(F.col(c).isNotNull() for c in nested))), F.lit(False)) if nested else F.lit(False)
    chars = sum(F.coalesce(F.length(F.col(c).cast("string")), F.lit(4)) for c in columns)
    return [F.count("*").alias("n_rows"), F.sum(chars).alias("total_chars"), any_nested.alias("has_non_scalar")]


def chosen_format(n_rows: Column, total_chars: Column, has_non_scalar: Column | None = None, *, target: str = "auto") -> Column:
    if target != "auto":
        return F.lit(target.lower())
    nested = F.lit(False) if has_non_scalar is None else has_non_scalar
    return F.when(nested | (n_rows > 200), "json").when((n_rows <= 50) & (total_chars <= 20_000), "markdown").otherwise("csv")


def markdown_line(columns: list[str]) -> Column:
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("↩"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def csv_line(columns: list[str], sep: str = "|") -> Column:
    """Values with the separator, a quote or a line end are quoted, quotes in them doubled."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        odd = F.contains(v, F.lit(sep)) | F.contains(v, F.lit('"')) | F.contains(v, F.lit("\n")) | F.contains(v, F.lit("\r"))
        return F.when(odd, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(sep, *map(cell, columns))


def formatted(rows: DataFrame, columns: list[str], order: str, *, by: list[str] | None = None, sep: str = "|", target: str = "auto") -> DataFrame:
    """(by..., format, table): rows of each group as markdown, delimited text or JSON, sorted by order.

    A group becomes one text in one task, so groups have a bounded size: give tables that grow a batch number in by.
    """
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), markdown_line(columns).alias("md"), csv_line(columns, sep).alias("csv"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("js"))))
    grouped = rows.groupBy(*(by or [])).agg(*statistics(rows, columns), lines.alias("lines"))
    grouped = grouped.withColumn("format", chosen_format(F.col("n_rows"), F.col("total_chars"), F.col("has_non_scalar"), target=target))
    part = lambda name: F.transform("lines", lambda x: x[name])
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    markdown = F.array_join(F.concat(F.array(F.lit(head)), part("md")), "\n")
    delimited = F.concat(F.array_join(F.concat(F.array(F.lit(sep.join(columns))), part("csv")), "\n"), F.lit("\n"))
    js = F.concat(F.lit("["), F.array_join(part("js"), ","), F.lit("]"))
    table = F.when(F.col("n_rows") == 0, "_(no rows)_").when(F.col("format") == "markdown", markdown).when(F.col("format") == "csv", delimited).otherwise(js)
    return grouped.select(*(by or []), "format", table.alias("table"))


def lookup_lines(rows: DataFrame, columns: list[str], order: str, *, by: list[str] | None = None) -> DataFrame:
    """(by..., lookup): 'id, label, description' lines by order, one text for each group; groups have a bounded size."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(", ", *(F.col(c).cast("string") for c in columns)).alias("l"))))
    return rows.groupBy(*(by or [])).agg(F.array_join(F.transform(listed, lambda x: x.l), "\n").alias("lookup"))


LINES = {"markdown": markdown_line, "csv": csv_line, "lookup": lambda columns: F.concat_ws(", ", *(F.col(c).cast("string") for c in columns))}


def chunked(rows: DataFrame, columns: list[str], order: list[str], *, by: list[str] | None = None, most_chars: int = 20_000, form: str = "markdown") -> DataFrame:
    """(by..., chunk, n_rows, table): the rows of each group, in order, as texts of bounded size, however many rows it has.

    A row goes to chunk number (characters of the lines before it in its group, line ends included) // most_chars, so a text
    has fewer than most_chars characters besides its header and its last line. form: markdown, csv (both with a header) or
    lookup. order has to tell the rows of a group apart.

    Characters are summed over ranges of the sorted rows, of bounded size; what comes before a range is summed over the totals of
    ranges, one row for each range and group in it.
    """
    if form not in LINES:
        raise ValueError(f"unknown form {form!r}; one of {sorted(LINES)}")
    keys = by or []
    line = rows.select(*keys, F.struct(*order).alias("__order"), LINES[form](columns).alias("__line"))
    sized = line.withColumn("__chars", F.length("__line") + 1)
    tasks = tasks_for(rows.count())
    ranges = staged(sized.repartitionByRange(tasks, *keys, "__order").sortWithinPartitions(*keys, "__order").withColumn("__place", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "lines")
    earlier = lambda total, part, place: F.coalesce(F.sum(total).over(Window.partitionBy(*part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranges.repartition(tasks, "__part", *keys).withColumn("__inside", earlier("__chars", ["__part", *keys], "__place"))
    totals = ranges.groupBy("__part", *keys).agg(F.sum("__chars").alias("__total"))
    # of one group no more rows than there are ranges
    before = totals.withColumn("__group", F.lit(0)).withColumn("__before", earlier("__total", ["__group", *keys], "__part")).drop("__total", "__group")
    # keys may be null
    same = [inside[c].eqNullSafe(before[c]) for c in ["__part", *keys]]
    placed = inside.join(before, same).select(*(inside[c] for c in keys), "__order", "__line", F.floor((F.col("__inside") + F.col("__before")) / most_chars).alias("chunk"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("__order", "__line"))), lambda x: x["__line"])
    head = {"markdown": "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |", "csv": "|".join(columns)}.get(form)
    text = F.array_join(lines if head is None else F.concat(F.array(F.lit(head)), lines), "\n")
    return placed.groupBy(*keys, "chunk").agg(F.count("*").alias("n_rows"), text.alias("table"))


TEMPLATE = "Match each input to a controlled list of {entity_type}.\nAnswer with JSON only.\n\nContext:\n{context}\n\nList ({format}):\n{lookup}\n\nInputs:\n{data}\n"


#: Most characters of a controlled list that goes into every prompt.
LOOKUP_CHARS = 1 << 20


def prompts(queries: DataFrame, lookup: DataFrame, *, entity_type: str, context: str, template: str = TEMPLATE) -> DataFrame:
    """query_id, prompt. lookup: the one row of formatted(); a longer one than LOOKUP_CHARS is an error."""
    fits = F.length("table") <= LOOKUP_CHARS
    format_, table = lookup.select("format", F.when(fits, F.col("table"))).first()
    if table is None:
        raise ValueError("the controlled list is too long for a prompt")
    data = F.concat(F.lit("| input_id | input_value |\n| --- | --- |\n| 1 | "), F.replace(F.replace("query", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("↩")), F.lit(" |"))
    fixed = template.replace("{entity_type}", entity_type).replace("{context}", context).replace("{format}", format_.upper()).replace("{lookup}", table)
    before, _, after = fixed.partition("{data}")
    return queries.select("query_id", F.concat(F.lit(before), data, F.lit(after)).alias("prompt"))


def completed(rows: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """rows with completion: the answer of the function to each prompt, null where it failed."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str) -> str | None:
            try:
                return complete(prompt)
            except Exception:  # noqa: BLE001  a failed completion falls back to fuzzy matching
                return None

        for prompts in batches:
            yield prompts.map(one)

    # each row is asked once, wherever its answer is used
    return rows.withColumn("completion", answer.asNondeterministic()("prompt"))


def parsed(completion: Column) -> Column:
    """Answers of a completion: a JSON list, an object as a list of one, or the text from the first [ to the last ]."""
    bare = F.trim(F.regexp_replace(completion, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    wrapped = F.when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("["), F.from_json(c, ANSWER))
    return F.coalesce(good(wrapped), good(F.regexp_extract(bare, r"(?s)\[.*\]", 0)))


def answered(rows: DataFrame, limit: int = POLICY.limit) -> DataFrame:
    """query_id, entity_id (text), label, name_sim, reasons, rank of completions; rows that fail to parse give none."""
    results = rows.select("query_id", F.posexplode(parsed(F.col("completion"))).alias("i", "answer"))
    each = results.select("query_id", "i", F.posexplode(F.slice("answer.candidates", 1, limit)).alias("rank", "c"))
    return each.select("query_id", F.col("c.id").alias("entity_id"), F.col("c.value").alias("label"), F.coalesce("c.score", F.lit(0.0)).alias("name_sim"), F.coalesce("c.reasons", F.array().cast("array<string>")).alias("reasons"), (F.col("rank") + 1).alias("rank"))


def with_fallback(rows: DataFrame, lookup: DataFrame, limit: int = POLICY.limit) -> DataFrame:
    """Candidates of completions; queries whose completion failed are matched by trigrams. rows: query_id, query, completion."""
    failed = rows.filter(parsed(F.col("completion")).isNull())
    fuzzy = fuzzy_modification_types(failed.select("query_id", "query"), lookup, limit=limit)
    plain = fuzzy.select("query_id", F.col("entity_id").cast("string").alias("entity_id"), "label", "name_sim", F.array().cast("array<string>").alias("reasons"), "rank")
    return answered(rows, limit).unionByName(plain)


def violations(rows: DataFrame) -> DataFrame:
    """query_id, input_id, problem: answers with more than 5 candidates, scores out of 0..1, not 2 to 4 reasons."""
    each = rows.select("query_id", F.explode(parsed(F.col("completion"))).alias("a"))
    bad = lambda test: F.exists("a.candidates", test)
    found = F.filter(
        F.array(
            F.when(F.size("a.candidates") > 5, F.lit("too many candidates")),
            F.when(bad(lambda c: ~F.coalesce(c.score.between(0, 1), F.lit(False))), F.lit("score out of range")),
            F.when(bad(lambda c: ~F.coalesce(F.size(c.reasons).between(2, 4), F.lit(False))), F.lit("number of reasons")),
        ),
        lambda p: p.isNotNull(),
    )
    return each.select("query_id", F.col("a.input_id").alias("input_id"), F.explode(found).alias("problem"))


def translated(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (text, source_lang, lang) with translation: the text itself in its own language, else the cached one,
    else the text; hit says whether a cached one was found. cache: key, translation."""
    keyed = requests.withColumn("key", T.cache_key(F.col("text"), F.col("lang"))).join(cache.select("key", F.col("translation").alias("cached")), "key", "left")
    same = F.col("source_lang") == F.col("lang")
    return keyed.select("text", "source_lang", "lang", F.when(same, F.col("text")).otherwise(F.coalesce("cached", "text")).alias("translation"), F.col("cached").isNotNull().alias("hit"))


def to_translate(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, text, lang) that are neither cached nor in their own language."""
    other = requests.filter("NOT source_lang <=> lang").select(T.cache_key(F.col("text"), F.col("lang")).alias("key"), "text", "lang").distinct()
    return other.join(cache, "key", "left_anti")


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """key, text, lang, translation, ts: the latest entry of each key, at equal times the greater translation."""
    both = cache.unionByName(fresh)
    return top_k(both, 1, ["key"], [F.desc("ts"), F.desc("translation")])
