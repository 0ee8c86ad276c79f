"""The registered queries of the reconciliation engine and, for each, DuckDB SQL that states the same by brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import cascades, details, exact, fulltext, gazetteer, match, merge, prompts, score
from matchloom.operators.completions import CompletionLog
from matchloom.operators.corpus import StoredCorpus
from matchloom.operators.index import TrigramIndex
from matchloom.operators.translations import TranslationStore
from matchloom.plans import roles, sql
from matchloom.plans.roles import table
from matchloom.policy import POLICY
from matchloom.sources import authority, batches
from matchloom.storage import shared_dir
from matchloom.streaming.reconcile import asked_once, reconcile_stream, reconcile_with_index

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def rounded(rows, *columns, digits=6):
    return rows.withColumns({c: F.round(c, digits) for c in columns})


FUZZY = "query_id, entity_id, label, round(name_sim, 6) AS name_sim, rank"


@query(f"SELECT doc_id, md5({sql.norm('text')}) AS norm_md5 FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("norm_md5"))


@query(f"SELECT p_partkey, array_to_string(list_sort({sql.trigrams('p_name')}), '|') AS grams FROM part")
def trigram_set(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(T.trigrams(F.col("p_name"))), "|").alias("grams"))


@query(f"WITH t AS (SELECT DISTINCT p_name AS t, {sql.trigrams('p_name')} AS g FROM part) SELECT a.t AS left_text, b.t AS right_text, round({sql.jaccard('a.g', 'b.g')}, 6) AS sim FROM t a JOIN t b ON a.t < b.t AND {sql.jaccard('a.g', 'b.g')} >= 0.3")
def similarity_pairs(spark, sf_dir):
    """Each pair of different texts once, the smaller text on the left."""
    texts = match._texts(table(spark, sf_dir, "part"), "p_name")
    return rounded(match.similar_texts(texts, texts, 0.3).filter("left_text < right_text"), "sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, sql.PARTS)}")
def fuzzy_topk(spark, sf_dir):
    return rounded(match.fuzzy(roles.part_queries(spark, sf_dir), roles.parts(spark, sf_dir)), "name_sim")


# every fifth part gets its words in the other order, every seventh goes, suppliers come
CHANGED = f"""(SELECT entity_id, CASE WHEN entity_id % 5 = 0 THEN split_part(label, ' ', 2) || ' ' || split_part(label, ' ', 1) ELSE label END AS label FROM {sql.PARTS} WHERE entity_id % 7 > 0
    UNION ALL SELECT 100000000 + s_suppkey, s_name FROM supplier)"""
CHANGED_QUERIES = f"(SELECT query_id, query FROM {sql.PART_QUERIES} UNION ALL SELECT 100000000 + s_suppkey, substr(s_name, 1, 4) || substr(s_name, 6) FROM supplier)"


def _changed_index(spark, sf_dir):
    """An index of the parts, and the changes to it in three segments."""
    parts = roles.parts(spark, sf_dir).select("entity_id", "label")
    index = TrigramIndex.create(parts, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets=16)
    words = F.split("label", " ")
    index.apply(parts.filter("entity_id % 5 = 0").select("entity_id", F.concat_ws(" ", words[1], words[0]).alias("label")))
    index.apply(parts.filter("entity_id % 7 = 0").select("entity_id", F.lit(None).cast("string").alias("label")))
    index.apply(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000000).alias("entity_id"), F.col("s_name").alias("label")))
    return index


def _changed_queries(spark, sf_dir):
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000000).alias("query_id"), F.concat(F.substring("s_name", 1, 4), F.substring("s_name", 6, 1000)).alias("query"))
    return roles.part_queries(spark, sf_dir).unionByName(more)


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(CHANGED_QUERIES, CHANGED)}")
def index_after_changes(spark, sf_dir):
    """A stored index searched after updates, deletions and insertions, each a segment of its own."""
    return rounded(match.fuzzy(_changed_queries(spark, sf_dir), _changed_index(spark, sf_dir)), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(CHANGED_QUERIES, CHANGED, 0.5, 5)}")
def index_after_compaction(spark, sf_dir):
    """The same index compacted, its former generation deleted, and searched for fewer and better matches."""
    index = _changed_index(spark, sf_dir)
    index.compact()
    index.vacuum()
    return rounded(match.fuzzy(_changed_queries(spark, sf_dir), index, threshold=0.5, limit=5), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, f'(SELECT * FROM {sql.PARTS} WHERE location_type_id IN (1, 7))')}")
def fuzzy_topk_typed(spark, sf_dir):
    return rounded(match.fuzzy_locations(roles.part_queries(spark, sf_dir), roles.parts(spark, sf_dir), [1, 7]), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, sql.PARTS, floor=False, plain=True)}")
def fuzzy_modification_types(spark, sf_dir):
    return rounded(match.fuzzy_modification_types(roles.part_queries(spark, sf_dir), roles.parts(spark, sf_dir)), "name_sim")


@query("SELECT c_custkey AS query_id, min(p_partkey) AS entity_id, arg_min(p_name, p_partkey) AS label, 1.0::DOUBLE AS name_sim FROM customer JOIN part ON p_brand = 'Brand#' || (c_custkey % 40) GROUP BY c_custkey")
def exact_alternate_id(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 40).cast("string")).alias("query"))
    return exact.alternate_identity(asked, roles.parts(spark, sf_dir), "national_id")


SITE_QUERIES = f"(SELECT *, 55.0::DOUBLE + (query_id % 1000) / 100.0::DOUBLE AS q_lat, 11.0::DOUBLE + (query_id % 700) / 100.0::DOUBLE AS q_lon, 'nation ' || (query_id % 25) AS place, CASE WHEN query_id % 2 = 0 THEN 'Brand#' || (query_id % 40) END AS national_id FROM {sql.PART_QUERIES})"
SURE = f"(SELECT query_id, min(entity_id) AS entity_id, arg_min(label, entity_id) AS label, 1.0::DOUBLE AS name_sim, 1 AS rank FROM (SELECT q.query_id, p.entity_id, p.label FROM {SITE_QUERIES} q JOIN {sql.PARTS} p ON p.national_id = q.national_id) GROUP BY query_id)"
CASCADE = f"(SELECT query_id, entity_id, label, name_sim, rank FROM {SURE} UNION ALL SELECT query_id, entity_id, label, name_sim, rank FROM {sql.fuzzy(f'(SELECT * FROM {SITE_QUERIES} WHERE query_id NOT IN (SELECT query_id FROM {SURE}))', sql.PARTS)})"


@query(f"SELECT {FUZZY} FROM {CASCADE}")
def cascade_exact_then_fuzzy(spark, sf_dir):
    return rounded(cascades.exact_then_fuzzy(roles.site_queries(spark, sf_dir), roles.parts(spark, sf_dir)), "name_sim")


@query(f"""SELECT f.query_id, f.rank, '{POLICY.id_base}site/' || entity_id AS id, label AS name, round(greatest(0, least(100, name_sim * 100)), 2) AS score,
    lower(label) = lower(query) OR name_sim >= 0.9 AS match, 'site' AS type_id, label AS type_name FROM {sql.fuzzy(sql.PART_QUERIES, sql.PARTS)} f JOIN {sql.PART_QUERIES} q ON f.query_id = q.query_id""")
def candidate_projection(spark, sf_dir):
    asked = roles.part_queries(spark, sf_dir)
    rows = match.fuzzy(asked, roles.parts(spark, sf_dir)).join(asked, "query_id")
    out = score.as_candidates(rows, "site")
    return out.select("query_id", "rank", "id", "name", "score", "match", F.col("type")[0].id.alias("type_id"), F.col("type")[0]["name"].alias("type_name"))


KM = "sqrt(pow(radians({a}) * 6378137.0 - radians({b}) * 6378137.0, 2) + pow(ln(tan(pi() / 4 + radians({c}) / 2)) * 6378137.0 - ln(tan(pi() / 4 + radians({d}) / 2)) * 6378137.0, 2)) / 1000"


@query(f"SELECT entity_id, round({KM.format(a='longitude', b='18.07', c='latitude', d='59.33')}, 4) AS km FROM {sql.PARTS}")
def mercator_distance(spark, sf_dir):
    km = score.mercator_km(F.col("longitude"), F.col("latitude"), F.lit(18.07), F.lit(59.33))
    return roles.parts(spark, sf_dir).select("entity_id", F.round(km, 4).alias("km"))


NEAR = f"(SELECT c.query_id, c.entity_id, c.label, c.rank AS rank0, least(1.0, c.name_sim + greatest(0.0, 0.2 * (1 - least(km / 10.0, 1.0)))) AS name_sim, km FROM (SELECT c.*, {KM.format(a='s.longitude', b='q.q_lon', c='s.latitude', d='q.q_lat')} AS km FROM {CASCADE} c JOIN {SITE_QUERIES} q ON c.query_id = q.query_id JOIN {sql.PARTS} s ON s.entity_id = c.entity_id) c)"


@query(f"SELECT query_id, entity_id, round(name_sim, 6) AS name_sim, round(km, 4) AS distance_km FROM {NEAR}")
def proximity_boost(spark, sf_dir):
    asked, sites = roles.site_queries(spark, sf_dir), roles.parts(spark, sf_dir)
    rows = score.with_distances(cascades.exact_then_fuzzy(asked, sites), asked, sites)
    rows = rows.withColumn("name_sim", score.proximity(F.col("name_sim"), F.col("distance_km")))
    return rounded(rounded(rows.select("query_id", "entity_id", "name_sim", "distance_km"), "name_sim"), "distance_km", digits=4)


PLACED = f"""(SELECT n.*, p.place_sim FROM {NEAR} n LEFT JOIN (SELECT n.query_id, n.entity_id, max({sql.jaccard('b.g', 'q.g')}) AS place_sim FROM {NEAR} n
    JOIN (SELECT query_id, {sql.trigrams('place')} AS g FROM {SITE_QUERIES}) q ON q.query_id = n.query_id
    JOIN (SELECT entity_id, {sql.trigrams('location_name')} AS g FROM {sql.BRIDGE}) b ON b.entity_id = n.entity_id GROUP BY n.query_id, n.entity_id) p ON p.query_id = n.query_id AND p.entity_id = n.entity_id)"""
BOOSTED = f"(SELECT query_id, entity_id, label, rank0, place_sim, CASE WHEN place_sim > 0.3 THEN least(1.0, name_sim + place_sim * 0.1) ELSE name_sim END AS name_sim FROM {PLACED})"


@query(f"SELECT query_id, entity_id, label, round(place_sim, 6) AS place_sim, round(name_sim, 6) AS name_sim, rank FROM {sql.top(BOOSTED, 10, 'round(name_sim, 9) DESC, rank0, label, entity_id')}")
def place_boost(spark, sf_dir):
    rows = cascades.site(roles.site_queries(spark, sf_dir), roles.parts(spark, sf_dir), roles.bridge(spark, sf_dir))
    return rounded(rows.select("query_id", "entity_id", "label", "place_sim", "name_sim", "rank"), "place_sim", "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.REFERENCE_QUERIES, sql.REFERENCES, 0.6, field='title', mode='word')}")
def word_similarity(spark, sf_dir):
    return rounded(match.fuzzy_bibliography(roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir), field="title", mode="word"), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.REFERENCE_QUERIES, sql.REFERENCES, 0.5, field='authors', mode='strict_word')}")
def strict_word_similarity(spark, sf_dir):
    return rounded(match.fuzzy_bibliography(roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir), field="authors", mode="strict_word"), "name_sim")


ISBN, DOI = "nullif(upper(regexp_replace({0}.isbn, '[^0-9Xx]', '', 'g')), '')", "nullif(regexp_replace(lower(trim({0}.doi)), '^https?://doi\\.org/', ''), '')"
EXACT = " UNION ALL ".join(
    f"SELECT DISTINCT q.query_id, r.entity_id, r.full_reference AS label, 1.0::DOUBLE AS name_sim, {i} AS pass_no FROM {sql.REFERENCE_QUERIES} q JOIN {sql.REFERENCES} r ON {on}"
    for i, on in enumerate((f"{ISBN.format('q')} = {ISBN.format('r')}", f"{DOI.format('q')} = {DOI.format('r')} OR lower(q.doi) = lower(r.doi)", "q.full_reference = r.full_reference", "q.title = r.title AND q.year = r.year", "q.bugs_reference = r.bugs_reference"))
)
GIVEN = f"(SELECT query_id, full_reference AS query FROM {sql.REFERENCE_QUERIES} WHERE full_reference IS NOT NULL)"
FREE = f"(SELECT query_id, query FROM {sql.REFERENCE_QUERIES} WHERE full_reference IS NULL AND trim(query) <> '')"
AUTHORED = f"(SELECT query_id, authors AS query, year FROM {sql.REFERENCE_QUERIES} WHERE authors IS NOT NULL AND year IS NOT NULL)"
WORDS = f"""SELECT query_id, entity_id, label, greatest(0.8, name_sim) AS name_sim, 5 AS pass_no FROM {sql.fuzzy(GIVEN, sql.REFERENCES, 0.45, field='full_reference', mode='word')}
    UNION ALL SELECT f.query_id, f.entity_id, r.full_reference, greatest(0.8, name_sim), 6 FROM {sql.fuzzy(AUTHORED, sql.REFERENCES, 0.45, field='authors', mode='word')} f JOIN {sql.REFERENCES} r ON r.entity_id = f.entity_id JOIN {AUTHORED} q ON q.query_id = f.query_id AND q.year = r.year
    UNION ALL SELECT query_id, entity_id, label, greatest(0.8, name_sim), 7 FROM {sql.fuzzy(FREE, sql.REFERENCES, 0.45, field='full_reference', mode='word')}"""
STRONG = f"s AS MATERIALIZED ({EXACT} UNION ALL {WORDS}), thin AS (SELECT * FROM {FREE} WHERE query_id NOT IN (SELECT query_id FROM s GROUP BY query_id HAVING count(*) >= 10)), f AS MATERIALIZED (SELECT query_id, entity_id, label, least(0.7, name_sim) AS name_sim, 8 AS pass_no FROM {sql.fuzzy('thin', sql.REFERENCES, 0.3, field='full_reference')}), b AS (SELECT * FROM s UNION ALL SELECT * FROM f)"


@query(f"SELECT query_id, entity_id, label, name_sim, pass_no FROM ({EXACT})")
def biblio_exact_passes(spark, sf_dir):
    q, b = roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir)
    return merge.bag(exact.same_isbn(q, b), exact.same_doi(q, b), exact.same_reference(q, b), exact.same_title_and_year(q, b), exact.same_bugs_reference(q, b))


@query(f"SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim, pass_no FROM ({WORDS})")
def biblio_fuzzy_floor(spark, sf_dir):
    rows = cascades.bibliographic_passes(roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir))
    return rounded(rows.filter("pass_no BETWEEN 5 AND 7"), "name_sim")


@query(f"WITH {STRONG} SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim FROM f")
def biblio_fallback_cap(spark, sf_dir):
    rows = cascades.bibliographic_passes(roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir))
    return rounded(rows.filter("pass_no = 8").drop("pass_no"), "name_sim")


@query(f"""WITH {STRONG}, m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY name_sim DESC, pass_no, label) = 1)
    SELECT query_id, rank, '{POLICY.id_base}bibliographic_reference/' || entity_id AS id, label AS name, round(least(100, name_sim * 100), 1) AS score, name_sim >= 0.99 AS match FROM {sql.top('m', 10, 'name_sim DESC, pass_no, label, entity_id')}""")
def biblio_max_merge(spark, sf_dir):
    rows = cascades.bibliographic(roles.reference_queries(spark, sf_dir), roles.references(spark, sf_dir))
    out = score.as_candidates(rows, "bibliographic_reference", accept=POLICY.biblio_accept, digits=1, by_label=False)
    return out.drop("type")


REQUESTS = "(SELECT CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer)"


def requests(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.when(k % 9 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("id"))


@query(f"SELECT p.entity_id AS \"ID\", p.label AS \"Name\", n.place_names AS \"Places\" FROM {sql.PARTS} p LEFT JOIN (SELECT entity_id, string_agg(location_name, ', ' ORDER BY location_name) AS place_names FROM {sql.BRIDGE} GROUP BY entity_id) n ON n.entity_id = p.entity_id WHERE p.entity_id IN (SELECT TRY_CAST(id AS BIGINT) FROM {REQUESTS})")
def details_left_agg(spark, sf_dir):
    rows = details.site_details(requests(spark, sf_dir), roles.parts(spark, sf_dir), roles.bridge(spark, sf_dir))
    return rows.select(F.col("entity_id").alias("ID"), F.col("label").alias("Name"), F.col("place_names").alias("Places"))


@query(f"SELECT s_suppkey AS entity_id, s_name AS label, n_name AS unit, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey WHERE s_suppkey IN (SELECT TRY_CAST(id AS BIGINT) FROM {REQUESTS})")
def details_left_chain(spark, sf_dir):
    dims = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("unit_id"))
    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit"), F.col("n_regionkey").alias("method_group_id"))
    groups = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("method_group_id"), F.col("r_name").alias("grp"))
    return details.dimension_details(requests(spark, sf_dir), dims, units, groups).select("entity_id", "label", "unit", "grp")


@query(f"SELECT p.entity_id, label, (SELECT string_agg('<li><strong>' || location_name || '</strong>: </li>', '' ORDER BY location_name) FROM {sql.BRIDGE} b WHERE b.entity_id = p.entity_id) AS type_names FROM {sql.PARTS} p WHERE p.entity_id IN (SELECT TRY_CAST(id AS BIGINT) FROM {REQUESTS})")
def details_sampling_context(spark, sf_dir):
    types = roles.bridge(spark, sf_dir).select("entity_id", F.col("location_name").alias("type_name"), F.lit(None).cast("string").alias("type_description"))
    return details.sampling_context_details(requests(spark, sf_dir), roles.parts(spark, sf_dir), types).select("entity_id", "label", "type_names")


@query(f"SELECT table_name, replace(table_name, 'tbl_', '') AS entity_name, column_name, system_id, value, column_type, {sql.norm('value')} AS value_norm FROM {sql.CORPUS}")
def fts_corpus(spark, sf_dir):
    return roles.search_corpus(spark, sf_dir).drop("value_id", "kind")


# words of values by a digest of the value; queries as clauses, written from how they are made
TOKENS = f"(SELECT table_name, column_name, system_id, vid, weight, unnest(ws) AS lexeme, generate_subscripts(ws, 1) AS pos FROM (SELECT table_name, column_name, system_id, md5(value) AS vid, CASE column_type WHEN 'label' THEN 1.0 WHEN 'abbreviation' THEN 0.4 ELSE 0.2 END AS weight, {sql.words(sql.norm('value'))} AS ws FROM {sql.CORPUS}))"
PLAIN_PIECES = f"SELECT query AS query_id, 1 AS branch, part AS clause, false AS negated, unnest(ws) AS lexeme, generate_subscripts(ws, 1) - 1 AS place, len(ws) AS size FROM (SELECT query, part, {sql.words('piece')} AS ws FROM (SELECT query, unnest(p) AS piece, generate_subscripts(p, 1) AS part FROM (SELECT query, string_split({sql.norm('query')}, ' ') AS p FROM ({sql.PLAIN_SEARCHES}))))"


def word(query: str, branch: int, clause: int, lexeme: str, negated: bool = False, place: int = 0, size: int = 1) -> str:
    """One word of a query about the two words a and b of a name."""
    return f"SELECT {query} AS query_id, {branch} AS branch, {clause} AS clause, {str(negated).lower()} AS negated, {lexeme} AS lexeme, {place} AS place, {size} AS size FROM {sql.NAME_WORDS}"


PHRASE, EITHER, LESS = "'\"' || p_name || '\"'", "a || ' or ' || b", "b || ' -' || a"
PIECES = "(" + " UNION ALL ".join([PLAIN_PIECES, word(PHRASE, 1, 1, "a", size=2), word(PHRASE, 1, 1, "b", place=1, size=2), word(EITHER, 1, 1, "a"), word(EITHER, 2, 2, "b"), word(LESS, 1, 1, "b"), word(LESS, 1, 2, "a", negated=True)]) + ")"
ROW = "query_id, table_name, column_name, system_id, vid"


def full_text(pieces: str) -> str:
    """Rows that satisfy some branch and their ranks; covers by definition: pairs of hits between which every clause of some
    satisfied branch is hit, though not without either end."""
    return f"""pc AS MATERIALIZED {pieces}, tk AS MATERIALIZED (SELECT * FROM {TOKENS} WHERE lexeme IN (SELECT lexeme FROM pc)),
    ph AS MATERIALIZED (SELECT query_id, branch, clause, negated, table_name, column_name, system_id, vid, pos - place AS pos, max(weight) AS weight FROM pc JOIN tk USING (lexeme) GROUP BY ALL HAVING count(*) = max(size)),
    n AS (SELECT query_id, branch, count(DISTINCT clause) AS clauses FROM pc WHERE NOT negated GROUP BY ALL),
    ok AS (SELECT {ROW}, branch, max(clauses) AS clauses FROM ph JOIN n USING (query_id, branch) WHERE NOT negated GROUP BY ALL HAVING count(DISTINCT clause) = max(clauses)),
    good AS MATERIALIZED (SELECT DISTINCT {ROW}, branch, clause, pos, weight, clauses FROM ph JOIN ok USING ({ROW}, branch) WHERE NOT negated AND ({ROW}, branch) NOT IN (SELECT ({ROW}, branch) FROM ph WHERE negated)),
    ends AS (SELECT DISTINCT {ROW}, pos FROM good),
    spans AS (SELECT {ROW}, a.pos AS p, b.pos AS q, branch, max(weight) AS weight, list_distinct(list(c.pos)) AS held, count(DISTINCT c.clause) = max(clauses) AS met, count(DISTINCT CASE WHEN c.pos > a.pos THEN c.clause END) = max(clauses) OR count(DISTINCT CASE WHEN c.pos < b.pos THEN c.clause END) = max(clauses) AS smaller
        FROM ends a JOIN ends b USING ({ROW}) JOIN good c USING ({ROW}) WHERE a.pos <= b.pos AND c.pos BETWEEN a.pos AND b.pos GROUP BY ALL),
    covers AS (SELECT {ROW}, p, q, max(weight) AS weight, len(list_distinct(flatten(list(held)))) AS entries FROM spans GROUP BY ALL HAVING bool_or(met) AND NOT bool_or(smaller)),
    hits AS MATERIALIZED (SELECT {ROW}, CAST(sum(weight / (1 + (q - p + 1) - entries)) AS DOUBLE) AS fts_rank FROM covers GROUP BY ALL),
    vals AS MATERIALIZED (SELECT md5(value) AS vid, any_value(value) AS value FROM {sql.CORPUS} GROUP BY 1)"""


HITS = full_text(PIECES)


@query(f"WITH {HITS} SELECT query_id, table_name, column_name, system_id, value, round(fts_rank, 6) AS rank, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fts_rank, 9) DESC, table_name, column_name, system_id) AS INTEGER) AS place FROM hits) JOIN vals USING (vid) WHERE place <= 20")
def fts_rank(spark, sf_dir):
    return rounded(fulltext.search(roles.corpus_queries(spark, sf_dir), roles.search_corpus(spark, sf_dir)), "rank")


# queries in which `or`, phrases and minus signs meet: a or b a; a -b or "b a"; -a; b or -a; or a
MIXED, TURNED, NEVER, PERHAPS, LEADING = "a || ' or ' || b || ' ' || a", "a || ' -' || b || ' or \"' || b || ' ' || a || '\"'", "'-' || a", "b || ' or - ' || a", "'or ' || a || ' or'"
BOOLEAN_PIECES = "(SELECT DISTINCT * FROM (" + " UNION ALL ".join([
    word(MIXED, 1, 1, "a"), word(MIXED, 2, 2, "b"), word(MIXED, 2, 3, "a"),
    word(TURNED, 1, 1, "a"), word(TURNED, 1, 2, "b", negated=True), word(TURNED, 2, 3, "b", size=2), word(TURNED, 2, 3, "a", place=1, size=2),
    word(NEVER, 1, 1, "a", negated=True), word(PERHAPS, 1, 1, "b"), word(PERHAPS, 2, 2, "a", negated=True),
    word(LEADING, 1, 1, "'or'"), word(LEADING, 1, 2, "a"), word(LEADING, 1, 3, "'or'"),
]) + "))"


@query(f"""WITH {full_text(BOOLEAN_PIECES)}, absent AS (SELECT query_id, branch FROM pc GROUP BY ALL HAVING bool_and(negated)),
    rest AS (SELECT query_id, table_name, column_name, system_id, md5(value) AS vid, 0.0::DOUBLE AS fts_rank FROM absent, {sql.CORPUS} WHERE (query_id, table_name, column_name, system_id, md5(value), branch) NOT IN (SELECT ({ROW}, branch) FROM ph)),
    every AS (SELECT {ROW}, max(fts_rank) AS fts_rank FROM (SELECT * FROM hits UNION ALL SELECT {ROW}, fts_rank FROM rest) GROUP BY ALL)
    SELECT query_id, table_name, column_name, system_id, value, round(fts_rank, 6) AS rank, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fts_rank, 9) DESC, table_name, column_name, system_id) AS INTEGER) AS place FROM every) JOIN vals USING (vid) WHERE place <= 20""")
def fts_boolean(spark, sf_dir):
    """Disjunctions of conjunctions, and queries that only say what must not occur."""
    return rounded(fulltext.search(roles.boolean_queries(spark, sf_dir), roles.search_corpus(spark, sf_dir)), "rank")


SCORED = f"""{HITS}, qs AS (SELECT query_id, {sql.trigrams(sql.norm('query'))} AS g FROM {sql.CORPUS_QUERIES}),
    cs AS (SELECT v.value, {sql.trigrams(sql.norm('v.value'))} AS g FROM (SELECT DISTINCT value FROM {sql.CORPUS}) v),
    vs AS (SELECT query_id, value, CAST(count(*) AS DOUBLE) / (any_value(nq) + any_value(nv) - count(*)) AS trigram_sim FROM (SELECT query_id, len(g) AS nq, unnest(g) AS gram FROM qs)
        JOIN (SELECT value, len(g) AS nv, unnest(g) AS gram FROM cs WHERE len(g) <= (SELECT max(len(g)) FROM qs) / 0.3) USING (gram) GROUP BY query_id, value HAVING count(*) >= 0.3 * (any_value(nq) + any_value(nv) - count(*))),
    near AS (SELECT query_id, table_name, column_name, system_id, md5(value) AS vid, trigram_sim FROM vs JOIN {sql.CORPUS} USING (value)),
    scored AS MATERIALIZED (SELECT *, coalesce(fts_rank, 0) + 0.35 * coalesce(trigram_sim, 0) AS row_score FROM hits FULL JOIN near USING ({ROW}))"""
ONE = "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, table_name ORDER BY round(row_score, 9) DESC, column_name, system_id) = 1"


@query(f"""WITH {SCORED}, one AS ({ONE})
    SELECT query_id, table_name, column_name, system_id, value, round(coalesce(fts_rank, 0), 6) AS fts_rank, round(coalesce(trigram_sim, 0), 6) AS trigram_sim, round(row_score, 6) AS row_score, rank FROM {sql.top('one', 10, 'round(row_score, 9) DESC, table_name')} JOIN vals USING (vid)""")
def entity_type_discovery(spark, sf_dir):
    return rounded(fulltext.entity_types(roles.corpus_queries(spark, sf_dir), roles.search_corpus(spark, sf_dir)), "fts_rank", "trigram_sim", "row_score")


@query(f"""WITH {SCORED}, per AS (SELECT query_id, table_name, coalesce(max(fts_rank), 0) AS fts_rank, coalesce(max(trigram_sim), 0) AS trigram_sim FROM scored GROUP BY 1, 2), tot AS (SELECT *, fts_rank + 0.35 * trigram_sim AS score FROM per)
    SELECT query_id, table_name, round(fts_rank, 6) AS fts_rank, round(trigram_sim, 6) AS trigram_sim, round(score, 6) AS score, rank FROM {sql.top('tot', 5, 'score DESC, table_name')}""")
def entity_type_aggregate(spark, sf_dir):
    return rounded(fulltext.table_scores(roles.corpus_queries(spark, sf_dir), roles.search_corpus(spark, sf_dir)), "fts_rank", "trigram_sim", "score")


GAZ = """(SELECT c_custkey AS geonameId, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS adminName1, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS countryName,
    CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 101 AS DOUBLE) END AS score, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey * 37) % 100000 END AS population,
    CASE c_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'A' ELSE 'T' END AS fcl, CASE WHEN c_custkey % 2 = 0 THEN 'ADM1' ELSE 'PPL' END AS fcode, CASE WHEN c_custkey % 7 > 0 THEN 'kind ' || (c_custkey % 7) END AS fcodeName
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""SELECT geonameId, concat_ws(', ', name, nullif(adminName1, ''), nullif(countryName, '')) AS label, kind, CASE kind WHEN 'citytown' THEN 'City/Town' WHEN 'administrative_area' THEN 'Administrative Area' ELSE 'Place' END AS kind_name,
    coalesce(fcodeName, fcode) || CASE WHEN population <> 0 THEN ' · pop ' || format('{{:,}}', population) ELSE '' END AS description,
    round(60 + 40 * least(1.0, coalesce(score, 0) / 100 + CASE WHEN population > 0 THEN log10(population) / 7 ELSE 0 END), 2) AS score
    FROM (SELECT *, CASE WHEN fcl = 'P' THEN 'citytown' WHEN fcl = 'A' AND fcode LIKE 'ADM%' THEN 'administrative_area' ELSE 'place' END AS kind FROM {GAZ})""")
def gazetteer_score(spark, sf_dir):
    return gazetteer.described(roles.gazetteer(spark, sf_dir))


GAZ_FOUND = sql.fuzzy(CUSTOMER_QUERIES := "(SELECT s_suppkey AS query_id, 'Customer ' || substr(s_name, 10) AS query FROM supplier)", f"(SELECT *, geonameId AS entity_id FROM {GAZ} WHERE fcl IN ('P', 'A'))", 0.8, field="name")


@query(f"SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim, rank FROM {sql.top(f'(SELECT f.query_id, f.entity_id, f.label, f.name_sim, g.population FROM {GAZ_FOUND} f JOIN {GAZ} g ON g.geonameId = f.entity_id)', 10, 'name_sim DESC, population DESC NULLS LAST, entity_id')}")
def gazetteer_search(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Customer "), F.substring("s_name", 10, 100)).alias("query"))
    rows = cascades.gazetteer_search(asked, roles.gazetteer(spark, sf_dir))
    return rounded(rows.select("query_id", "entity_id", "label", "name_sim", "rank"), "name_sim")


MD = "'| ' || n_nationkey || ' | ' || n_name || ' |'"


def part_lists(spark, sf_dir, size):
    """Parts in lists by type and batches of keys, so that a list has `size` rows at most."""
    return table(spark, sf_dir, "part").withColumn("batch", F.floor(F.col("p_partkey") / size))


LISTED = ["p_partkey", "p_name"]


@query("""SELECT p_type, p_partkey // 40 AS batch, 'markdown' AS format, '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey) AS "table" FROM part GROUP BY 1, 2""")
def prompt_format(spark, sf_dir):
    return prompts.formatted(part_lists(spark, sf_dir, 40), LISTED, "p_partkey", by=["p_type", "batch"])


@query("""SELECT p_type, p_partkey // 150 AS batch, 'csv' AS format, 'p_partkey|p_name' || chr(10) || string_agg(p_partkey || '|' || p_name, chr(10) ORDER BY p_partkey) || chr(10) AS "table" FROM part GROUP BY 1, 2""")
def prompt_format_csv(spark, sf_dir):
    return prompts.formatted(part_lists(spark, sf_dir, 150), LISTED, "p_partkey", by=["p_type", "batch"], target="csv")


@query("""SELECT p_partkey // 400 AS batch, CASE WHEN count(*) > 200 THEN 'json' WHEN count(*) > 50 THEN 'csv' ELSE 'markdown' END AS format,
    CASE WHEN count(*) > 200 THEN '[' || string_agg('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']' WHEN count(*) > 50 THEN 'p_partkey|p_name' || chr(10) || string_agg(p_partkey || '|' || p_name, chr(10) ORDER BY p_partkey) || chr(10)
    ELSE '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey) END AS "table" FROM part GROUP BY 1""")
def prompt_format_chosen(spark, sf_dir):
    return prompts.formatted(part_lists(spark, sf_dir, 400), LISTED, "p_partkey", by=["batch"])


@query("""SELECT p_type, p_partkey // 40 AS batch, 'json' AS format, '[' || string_agg('{"p_partkey":' || p_partkey || ',"marks":["' || p_name || '","' || p_brand || '"]}', ',' ORDER BY p_partkey) || ']' AS "table" FROM part GROUP BY 1, 2""")
def prompt_format_non_scalar(spark, sf_dir):
    rows = part_lists(spark, sf_dir, 40).withColumn("marks", F.array("p_name", "p_brand"))
    return prompts.formatted(rows, ["p_partkey", "marks"], "p_partkey", by=["p_type", "batch"])


@query(f"""WITH l AS (SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({MD}, chr(10) ORDER BY n_nationkey) AS t FROM nation)
    SELECT query_id, md5('Match each input to a controlled list of nations.' || chr(10) || 'Answer with JSON only.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'trade' || chr(10) || chr(10) || 'List (MARKDOWN):' || chr(10) || t || chr(10) || chr(10) || 'Inputs:' || chr(10) || '| input_id | input_value |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || query || ' |' || chr(10)) AS prompt_md5 FROM {sql.PART_QUERIES}, l""")
def prompt_assembly(spark, sf_dir):
    lookup = prompts.formatted(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n_nationkey")
    out = prompts.prompts(roles.part_queries(spark, sf_dir), lookup, entity_type="nations", context="trade")
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT p_type, p_partkey // 200 AS batch, string_agg(p_partkey || ', ' || p_name || ', ' || p_brand, chr(10) ORDER BY p_partkey) AS lookup FROM part GROUP BY 1, 2")
def lookup_lines(spark, sf_dir):
    return prompts.lookup_lines(part_lists(spark, sf_dir, 200), [*LISTED, "p_brand"], "p_partkey", by=["p_type", "batch"])


@query("""SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS entity_id, 'v' || quality AS label, CASE WHEN doc_id % 10 = 3 THEN 1.5 ELSE 0.5 END::DOUBLE AS name_sim, CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 2 END AS n_reasons, CAST(r AS INTEGER) AS rank
    FROM labels, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS t(r) WHERE doc_id % 5 <> 2 AND quality IS NOT NULL""")
def completion_parse(spark, sf_dir):
    rows = prompts.answered(roles.completions(spark, sf_dir))
    return rows.select("query_id", "entity_id", "label", "name_sim", F.size("reasons").alias("n_reasons"), "rank")


@query("""SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS input_id, 'score out of range' AS problem FROM labels WHERE doc_id % 5 <> 2 AND doc_id % 10 = 3 AND quality IS NOT NULL
    UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), 'number of reasons' FROM labels WHERE doc_id % 5 <> 2 AND doc_id % 7 = 0 AND quality IS NOT NULL""")
def completion_contract(spark, sf_dir):
    return prompts.violations(roles.completions(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderpriority AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'sv' ELSE 'en' END AS source_lang, CASE WHEN o_orderkey % 2 = 0 THEN 'sv' ELSE 'de' END AS lang FROM orders),
    c AS (SELECT DISTINCT md5(o_orderpriority || ':sv') AS key, 'sv ' || o_orderpriority AS cached FROM orders WHERE o_orderpriority < '3')
    SELECT text, source_lang, lang, CASE WHEN source_lang = lang THEN text ELSE coalesce(cached, text) END AS translation, cached IS NOT NULL AS hit FROM r LEFT JOIN c ON c.key = md5(text || ':' || lang)""")
def translation_cache(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.select(F.col("o_orderpriority").alias("text"), F.when(k % 3 == 0, "sv").otherwise("en").alias("source_lang"), F.when(k % 2 == 0, "sv").otherwise("de").alias("lang"))
    known = o.filter("o_orderpriority < '3'").select("o_orderpriority").distinct()
    return prompts.translated(asked, known.select(T.cache_key(F.col("o_orderpriority"), F.lit("sv")).alias("key"), F.concat(F.lit("sv "), "o_orderpriority").alias("translation")))


def _payloads(spark, sf_dir):
    """Events as query batches of one query each; every third batch is encoded twice."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    limit = F.when(k % 11 == 0, ', "limit": 900').when(k % 2 == 0, ', "limit": 5').otherwise("")
    kind = F.when(k % 13 == 0, ', "type": "bogus"').when(k % 5 == 0, ', "type": "location"').otherwise("")
    one = F.concat(F.lit('{"q0": {"query": "'), F.when(k % 17 == 0, " ").otherwise(F.col("event_type")), F.lit('"'), kind, limit, F.lit(', "properties": [{"pid": "k", "v": "1"}, {"pid": "k", "v": "'), F.get_json_object("props", "$.k"), F.lit('"}, {"pid": "none"}]}}'))
    twice = F.concat(F.lit('"'), F.replace(one, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return e.select("event_id", F.when(k % 3 == 0, twice).otherwise(one).alias("payload"))


BATCH = """(SELECT event_id, 'q0' AS query_id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE event_type END AS query, CASE WHEN event_id % 13 = 0 THEN 'bogus' WHEN event_id % 5 = 0 THEN 'location' ELSE 'site' END AS type,
    CASE WHEN event_id % 11 = 0 THEN 900 WHEN event_id % 2 = 0 THEN 5 END AS "limit", json_extract_string(props, '$.k') AS k FROM events)"""


@query(f'SELECT event_id, query_id, query, type, CAST("limit" AS VARCHAR) AS "limit", k, 1 AS n_properties FROM {BATCH}')
def query_batch_parse(spark, sf_dir):
    rows = batches.queries(_payloads(spark, sf_dir))
    return rows.select("event_id", "query_id", "query", "type", F.col("limit").cast("string").alias("limit"), F.col("properties")["k"].alias("k"), F.size("properties").alias("n_properties"))


@query(f"""SELECT event_id, CASE WHEN trim(query) = '' THEN 'query is empty' WHEN "limit" > 500 THEN 'limit is not from 1 to 500' WHEN type = 'bogus' THEN 'unknown type' END AS error FROM {BATCH}""")
def query_validate(spark, sf_dir):
    return batches.validated(batches.queries(_payloads(spark, sf_dir)), ["site", "location"]).select("event_id", "error")


@query(f"SELECT q.query_id, coalesce(string_agg(f.entity_id || '=' || round(name_sim, 4), ',' ORDER BY rank), '') AS result FROM {sql.PART_QUERIES} q LEFT JOIN {sql.fuzzy(sql.PART_QUERIES, sql.PARTS, 0.5)} f ON f.query_id = q.query_id GROUP BY q.query_id")
def result_nest(spark, sf_dir):
    asked = roles.part_queries(spark, sf_dir)
    nested = batches.results(asked, match.fuzzy(asked, roles.parts(spark, sf_dir), threshold=0.5), ["entity_id", "name_sim"])
    return nested.select("query_id", F.array_join(F.transform("result", lambda c: F.concat(c.entity_id.cast("string"), F.lit("="), F.round(c.name_sim, 4).cast("string"))), ",").alias("result"))


SUGGEST_TYPES = ["part", "supplier", "nation"]
PREFIXES = "(SELECT DISTINCT query AS query_id, query FROM (SELECT substr(p_name, 1, 7) AS query FROM part UNION SELECT substr(n_name, 1, 7) FROM nation UNION SELECT substr(n_name, 1, 1) FROM nation) WHERE length(query) >= 2)"
SUGGESTED = " UNION ALL ".join(f"SELECT query_id AS prefix_id, '{t}' AS entity_type, {i} AS type_no, entity_id, label, name_sim FROM {sql.fuzzy(PREFIXES, f'(SELECT {k} AS entity_id, {c} AS label FROM {t})')} WHERE entity_id <> 0 AND label <> ''" for i, (t, k, c) in enumerate((("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))))


@query(f"SELECT prefix_id, entity_type, entity_id, label, round(name_sim, 6) AS name_sim, rank FROM {sql.top(f'({SUGGESTED})', 10, 'name_sim DESC, type_no, label, entity_id', 'prefix_id')}")
def suggest_entities(spark, sf_dir):
    p, s, n = (table(spark, sf_dir, t) for t in SUGGEST_TYPES)
    texts = p.select(F.substring("p_name", 1, 7).alias("query")).union(n.select(F.substring("n_name", 1, 7))).union(n.select(F.substring("n_name", 1, 1))).distinct()
    asked = merge.usable_prefixes(texts).select(F.col("query").alias("query_id"), "query")
    found = [match.fuzzy(asked, t.select(F.col(k).cast("long").alias("entity_id"), F.col(c).alias("label"))).select(F.col("query_id").alias("prefix_id"), F.lit(name).alias("entity_type"), "entity_id", "label", "name_sim") for t, name, k, c in ((p, "part", "p_partkey", "p_name"), (s, "supplier", "s_suppkey", "s_name"), (n, "nation", "n_nationkey", "n_name"))]
    return rounded(merge.suggested(found[0].unionByName(found[1]).unionByName(found[2]), 10, type_order=SUGGEST_TYPES), "name_sim")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'nation' END AS entity_type, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'not an entity URI' END AS error, CASE WHEN c_custkey % 4 > 0 THEN n_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def uri_resolve(spark, sf_dir):
    k = F.col("c_custkey")
    uri = F.when(k % 4 == 0, F.concat(F.lit("https://elsewhere.example/nation/"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit(f"{POLICY.id_base}nation/"), F.col("c_nationkey").cast("string")))
    uris = table(spark, sf_dir, "customer").select("c_custkey", uri.alias("uri"))
    nations = table(spark, sf_dir, "nation").select(F.lit("nation").alias("entity_type"), F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("label"))
    return details.resolved(uris, nations, POLICY.id_base).select("c_custkey", "entity_type", F.col("entity_id").cast("string").alias("entity_id"), "error", "label")


@query("SELECT doc_id, 'lang=' || lang || ';source=' || source || ';text=' || CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS fields FROM documents")
def card_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("label", F.lit("x")).withColumn("blank", F.lit("  "))
    shown = details.card_fields(["label", "blank", "lang", "source", "text"])
    return rows.select("doc_id", F.array_join(F.transform(shown, lambda p: F.concat(p.key, F.lit("="), p.value)), ";").alias("fields"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_last(spark, sf_dir):
    return merge.dedupe(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")], keep="last")


@query("""SELECT c_custkey AS entity_id, p AS property, CASE p WHEN 'c_name' THEN c_name WHEN 'c_mktsegment' THEN c_mktsegment END AS value FROM customer, unnest(['c_name', 'c_mktsegment']) AS t(p)
    WHERE (p = 'c_name' AND c_custkey % 2 = 0) OR (p = 'c_mktsegment' AND c_custkey % 3 = 0)""")
def extend_unpivot(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    asked = c.filter(k % 2 == 0).select(k.alias("entity_id"), F.lit("c_name").alias("property")).union(c.filter(k % 3 == 0).select(k, F.lit("c_mktsegment")))
    return details.extended(asked, c.withColumnRenamed("c_custkey", "entity_id"), ["c_name", "c_mktsegment"])


@query("SELECT p_name AS id, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS entity_types, arg_max(p_brand, p_partkey) AS settings FROM part GROUP BY p_name")
def property_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("settings"), F.col("p_partkey").alias("ord"))
    return merge.folded_properties(rows).withColumn("entity_types", F.array_join("entity_types", ","))


@query("""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') OR NOT regexp_matches(lower(text), '[àâäåæçèéêëîïñòóôöøùûüÿœß]') THEN 'en' ELSE 'unknown' END AS lang, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM documents""")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guessed_language(F.col("text")).alias("g")).select("doc_id", "g.lang", "g.confidence")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_type), 'promo') OR contains(lower(p_name), 'promo')")
def text_filter(spark, sf_dir):
    columns = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    return table(spark, sf_dir, "part").filter(T.mentions(F.lit("Ring"), *columns) | T.mentions(F.lit("PROMO"), *columns[::2])).select("p_partkey")


BRAND_OR_NAME = "(SELECT min(p_partkey) * 2 AS query_id, p_brand AS query FROM part GROUP BY p_brand UNION ALL SELECT min(p_partkey) * 2 + 1, p_name FROM part GROUP BY p_name)"
ALTERNATE = f"(SELECT query_id, min(entity_id) AS entity_id, arg_min(label, entity_id) AS label, 1.0::DOUBLE AS name_sim, 0 AS pass_no FROM (SELECT q.query_id, p.entity_id, p.label FROM {BRAND_OR_NAME} q JOIN {sql.PARTS} p ON p.national_id = q.query) GROUP BY query_id)"
GENERIC = f"(SELECT * FROM (SELECT * FROM {ALTERNATE} UNION ALL SELECT query_id, entity_id, label, name_sim, 1 FROM {sql.fuzzy(BRAND_OR_NAME, sql.PARTS)}) QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY name_sim DESC, pass_no, label) = 1)"


@query(f"SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim, rank FROM {sql.top(GENERIC, 10, 'name_sim DESC, pass_no, label, entity_id')}")
def generic_find(spark, sf_dir):
    least, part = F.min("p_partkey") * 2, table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(least.alias("query_id")).select("query_id", F.col("p_brand").alias("query"))
    asked = brands.unionByName(part.groupBy("p_name").agg((least + 1).alias("query_id")).select("query_id", F.col("p_name").alias("query")))
    return rounded(cascades.generic(asked, roles.parts(spark, sf_dir), alternate="national_id"), "name_sim")


@query(f"SELECT query_id, rank, '{POLICY.id_base}site/' || entity_id AS id, label AS name, round(least(100, name_sim * 100), 2) AS score, name_sim >= 0.9 OR lower(label) = lower(query) AS match, round(km, 2) AS distance_km FROM (SELECT n.*, n.rank0 AS rank, q.query FROM {NEAR} n JOIN {SITE_QUERIES} q ON q.query_id = n.query_id)")
def site_candidates(spark, sf_dir):
    asked, sites = roles.site_queries(spark, sf_dir), roles.parts(spark, sf_dir)
    rows = score.with_distances(cascades.exact_then_fuzzy(asked, sites), asked, sites)
    rows = rows.withColumn("name_sim", score.proximity(F.col("name_sim"), F.col("distance_km"))).join(asked.select("query_id", "query"), "query_id")
    return score.as_candidates(rows, "site").drop("type")


@query(f"""SELECT geonameId AS query_id, CAST(geonameId AS VARCHAR) AS id, concat_ws(', ', name, nullif(adminName1, ''), nullif(countryName, '')) AS name, s AS score, round(s / 100, 4) AS name_sim, concat_ws(', ', name, nullif(adminName1, ''), nullif(countryName, '')) = name AS match, 'https://www.geonames.org/' || geonameId AS uri
    FROM (SELECT *, round(60 + 40 * least(1.0, coalesce(score, 0) / 100 + CASE WHEN population > 0 THEN log10(population) / 7 ELSE 0 END), 2) AS s FROM {GAZ})""")
def gazetteer_candidates(spark, sf_dir):
    records = roles.gazetteer(spark, sf_dir)
    rows = gazetteer.as_candidates(records.withColumn("query_id", F.col("geonameId")).withColumn("query", F.col("name")))
    return rows.select("query_id", "id", "name", "score", F.round("name_sim", 4).alias("name_sim"), "match", "uri")


@query(f"SELECT adm AS query_id, geonameId, s AS relevance, rank FROM {sql.top(f'(SELECT adminName1 AS adm, geonameId, population, round(60 + 40 * least(1.0, coalesce(score, 0) / 100 + CASE WHEN population > 0 THEN log10(population) / 7 ELSE 0 END), 2) AS s FROM {GAZ})', 10, 's DESC, population DESC NULLS LAST, geonameId', 'adm')}")
def gazetteer_ranked(spark, sf_dir):
    return gazetteer.ranked(roles.gazetteer(spark, sf_dir).withColumn("query_id", F.col("adminName1"))).select("query_id", "geonameId", "relevance", "rank")


@query("""SELECT DISTINCT md5(o_orderpriority || ':' || lang) AS key, o_orderpriority AS text, lang FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'sv' ELSE 'en' END AS source_lang, CASE WHEN o_orderkey % 2 = 0 THEN 'sv' ELSE 'de' END AS lang FROM orders)
    WHERE source_lang <> lang AND NOT (lang = 'sv' AND o_orderpriority < '3')""")
def translation_misses(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.select(F.col("o_orderpriority").alias("text"), F.when(k % 3 == 0, "sv").otherwise("en").alias("source_lang"), F.when(k % 2 == 0, "sv").otherwise("de").alias("lang"))
    return prompts.to_translate(asked, o.filter("o_orderpriority < '3'").select(T.cache_key(F.col("o_orderpriority"), F.lit("sv")).alias("key")).distinct())


@query("SELECT md5(o_orderpriority || ':sv') AS key, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS translation FROM orders GROUP BY 1")
def translation_upsert(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    entries = o.select(T.cache_key(F.col("o_orderpriority"), F.lit("sv")).alias("key"), F.col("o_orderpriority").alias("text"), F.lit("sv").alias("lang"), k.cast("string").alias("translation"), k.alias("ts"))
    return prompts.upserted(entries.filter(k % 2 == 0), entries.filter(k % 2 == 1)).select("key", "translation")


COUNTED = f"(SELECT *, sum(CASE WHEN true THEN 1 END) OVER (PARTITION BY prefix_id ORDER BY type_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({SUGGESTED}))"


@query(f"SELECT prefix_id, entity_type, entity_id, label, round(name_sim, 6) AS name_sim, rank FROM {sql.top(f'(SELECT * FROM {COUNTED} WHERE coalesce(before, 0) < 10)', 10, 'name_sim DESC, type_no, label, entity_id', 'prefix_id')}")
def suggest_early_stop(spark, sf_dir):
    p, s, n = (table(spark, sf_dir, t) for t in SUGGEST_TYPES)
    texts = p.select(F.substring("p_name", 1, 7).alias("query")).union(n.select(F.substring("n_name", 1, 7))).union(n.select(F.substring("n_name", 1, 1))).distinct()
    asked = merge.usable_prefixes(texts).select(F.col("query").alias("query_id"), "query")
    found = [match.fuzzy(asked, t.select(F.col(k).cast("long").alias("entity_id"), F.col(c).alias("label"))).select(F.col("query_id").alias("prefix_id"), F.lit(name).alias("entity_type"), "entity_id", "label", "name_sim") for t, name, k, c in ((p, "part", "p_partkey", "p_name"), (s, "supplier", "s_suppkey", "s_name"), (n, "nation", "n_nationkey", "n_name"))]
    return rounded(merge.suggested(found[0].unionByName(found[1]).unionByName(found[2]), 10, type_order=SUGGEST_TYPES, early_stop=True), "name_sim")


@query(f"""WITH {SCORED}, one AS ({ONE})
    SELECT query_id, table_name, round(row_score, 6) AS row_score, rank FROM {sql.top('one', 2, 'table_name')}""")
def entity_types_alphabetical(spark, sf_dir):
    rows = fulltext.entity_types(roles.corpus_queries(spark, sf_dir), roles.search_corpus(spark, sf_dir), limit=2, alphabetical=True)
    return rounded(rows.select("query_id", "table_name", "row_score", "rank"), "row_score")


@query(f"SELECT 'part' AS entity_type, p_partkey AS entity_id, CAST(len(g) AS INTEGER) AS n_trgm, unnest(g) AS trigram FROM (SELECT p_partkey, {sql.trigrams(sql.norm('p_name'))} AS g FROM part)")
def trigram_index(spark, sf_dir):
    return authority.trigram_index(authority.authority(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name"))


@query(f"SELECT r.entity_id, {ISBN.format('r')} AS isbn, {DOI.format('r')} AS doi, 'part' AS entity FROM {sql.REFERENCES} r")
def identifier_forms(spark, sf_dir):
    rows = roles.references(spark, sf_dir)
    return rows.select("entity_id", T.isbn(F.col("isbn")).alias("isbn"), T.doi(F.col("doi")).alias("doi"), T.entity_name(F.lit("tbl_part")).alias("entity"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'en' END AS lang, CASE WHEN c_custkey % 3 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM customer")
def language_answers(spark, sf_dir):
    k = F.col("c_custkey")
    answer = F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(", 0.75"))).when(k % 3 == 1, F.concat("c_mktsegment", F.lit(", sure"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.answered_language(answer).alias("a")).select("c_custkey", "a.lang", "a.confidence")


@query("SELECT doc_id, 'label title' AS title, CAST(len(text) > 0 AS INTEGER) + 2 AS n_fields, md5(text) AS text_md5 FROM documents")
def card_all_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("label", F.lit("label title"))
    shown = rows.select("doc_id", "label", details.card_fields(["label", "lang", "source", "text"], most=None, longest=None).alias("f"))
    text = F.get(F.filter("f", lambda p: p.key == "text"), F.lit(0)).value
    return shown.select("doc_id", details.title(F.lit(""), F.col("label"), F.col("f")).alias("title"), F.size("f").alias("n_fields"), F.md5(text).alias("text_md5"))


@query(f"SELECT s_suppkey AS \"ID\", s_name AS \"Name\", n_name AS \"Group\" FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT TRY_CAST(id AS BIGINT) FROM {REQUESTS})")
def details_with_group(spark, sf_dir):
    methods = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), "s_name", F.col("s_nationkey").alias("group_id"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), "n_name")
    rows = details.with_group(requests(spark, sf_dir), methods, groups, "group_id")
    return details.by_ids(requests(spark, sf_dir), rows, {"entity_id": "ID", "s_name": "Name", "n_name": "Group"})


@query("SELECT lower(p_type) AS id, upper(p_type[1]) || lower(p_type[2:]) AS name, CAST(row_number() OVER (ORDER BY upper(p_type[1]) || lower(p_type[2:]), lower(p_type)) AS INTEGER) AS place FROM (SELECT DISTINCT p_type FROM part)")
def types_by_name(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("id"), F.initcap("p_type").alias("name")).distinct()
    return merge.types_by_name(types)


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, f'(SELECT * FROM {sql.PARTS} WHERE location_type_id = 1)')}")
def fuzzy_countries(spark, sf_dir):
    return rounded(match.fuzzy_countries(roles.part_queries(spark, sf_dir), roles.parts(spark, sf_dir)), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, f'(SELECT * FROM {sql.PARTS} WHERE location_type_id = 7)')}")
def fuzzy_regions(spark, sf_dir):
    return rounded(match.fuzzy_regions(roles.part_queries(spark, sf_dir), roles.parts(spark, sf_dir)), "name_sim")


PART_TEXTS = "(SELECT p_partkey AS query_id, substr(p_name, 1, 2) || substr(p_name, 4) AS query FROM part)"
FAILED = sql.fuzzy(f"(SELECT * FROM {PART_TEXTS} WHERE length(query) % 2 = 1)", "(SELECT min(p_partkey) AS entity_id, p_name AS label FROM part GROUP BY p_name)", floor=False, plain=True)


def answer(prompt: str) -> str:
    """Stands for a model: it answers prompts of even length, and fails on others."""
    if len(prompt) % 2:
        raise RuntimeError
    return f'[{{"input_id": "1", "input_value": "{prompt}", "candidates": [{{"id": "9", "value": "{prompt}", "score": 0.5, "reasons": ["a", "b"]}}]}}]'


@query(f"""SELECT query_id, '9' AS entity_id, query AS label, 0.5::DOUBLE AS name_sim, 2 AS n_reasons, 1 AS rank FROM {PART_TEXTS} WHERE length(query) % 2 = 0
    UNION ALL SELECT query_id, CAST(entity_id AS VARCHAR), label, round(name_sim, 6), 0, rank FROM {FAILED}""")
def completion_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000)).alias("query"))
    names = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("entity_id"))
    rows = prompts.with_fallback(prompts.completed(asked.withColumn("prompt", F.col("query")), answer), names)
    return rounded(rows.withColumn("n_reasons", F.size("reasons")).drop("reasons"), "name_sim")


def source(entity: str, frm: str, columns: str, label: str) -> str:
    return f"SELECT '{entity}' AS entity_type, {columns}, {sql.norm(label)} AS norm_label FROM {frm}"


def renamed(spark, sf_dir, name, **columns):
    """A given table with the columns of an authority table."""
    return table(spark, sf_dir, name).select(*(F.expr(e).alias(c) for c, e in columns.items()))


@query(source("site", "supplier", "s_suppkey AS entity_id, s_name AS label, s_suppkey / 7.0::DOUBLE AS latitude, s_acctbal AS longitude, CAST(s_nationkey AS VARCHAR) AS national_id, 'of nation ' || s_nationkey AS description", "s_name"))
def source_sites(spark, sf_dir):
    rows = renamed(spark, sf_dir, "supplier", site_id="s_suppkey", site_name="s_name", latitude="s_suppkey / 7.0D", longitude="s_acctbal", national_id="cast(s_nationkey AS string)", description="'of nation ' || s_nationkey")
    return authority.sites(rows)


@query(source("location", "customer JOIN region ON c_nationkey % 7 = r_regionkey", "c_custkey AS entity_id, c_name AS label, r_regionkey AS location_type_id, r_name AS location_type", "c_name"))
def source_locations(spark, sf_dir):
    rows = renamed(spark, sf_dir, "customer", location_id="c_custkey", location_name="c_name", location_type_id="c_nationkey % 7")
    return authority.locations(rows, renamed(spark, sf_dir, "region", location_type_id="r_regionkey", location_type="r_name"))


@query(source("feature_type", "part", "p_partkey AS entity_id, p_name AS label, p_type AS description", "p_name"))
def source_feature_types(spark, sf_dir):
    return authority.feature_types(renamed(spark, sf_dir, "part", feature_type_id="p_partkey", feature_type_name="p_name", description="p_type"))


@query(source("method", "part", "p_partkey AS entity_id, p_name AS label, p_brand AS method_abbreviation, p_size AS method_group_id, p_type AS description", "p_name"))
def source_methods(spark, sf_dir):
    return authority.methods(renamed(spark, sf_dir, "part", method_id="p_partkey", method_name="p_name", method_abbreviation="p_brand", method_group_id="p_size", description="p_type"))


@query(source("data_type", "orders", "o_orderkey AS entity_id, o_orderpriority AS label, o_custkey AS data_type_group_id, o_orderstatus AS definition", "o_orderpriority"))
def source_data_types(spark, sf_dir):
    return authority.data_types(renamed(spark, sf_dir, "orders", data_type_id="o_orderkey", data_type_name="o_orderpriority", data_type_group_id="o_custkey", definition="o_orderstatus"))


@query(source("dimension", "part", "p_partkey AS entity_id, p_name AS label, p_brand AS dimension_abbreviation, p_size AS unit_id, p_size % 3 AS method_group_id", "p_name"))
def source_dimensions(spark, sf_dir):
    return authority.dimensions(renamed(spark, sf_dir, "part", dimension_id="p_partkey", dimension_name="p_name", dimension_abbreviation="p_brand", unit_id="p_size", method_group_id="p_size % 3"))


@query(source("sampling_context", "documents WHERE source IS NOT NULL", "doc_id AS entity_id, source AS label, lang AS description", "source"))
def source_sampling_contexts(spark, sf_dir):
    return authority.sampling_contexts(renamed(spark, sf_dir, "documents", sampling_context_id="doc_id", sampling_context="source", description="lang"))


@query(f"SELECT 'bibliographic_reference' AS entity_type, entity_id, full_reference AS label, full_reference, title, authors, bugs_reference, year, doi, isbn, {', '.join(f'{sql.norm(f)} AS norm_{f}' for f in match.FIELDS)} FROM {sql.REFERENCES}")
def source_bibliography(spark, sf_dir):
    return authority.bibliography(roles.references(spark, sf_dir).withColumnRenamed("entity_id", "biblio_id"))


@query("SELECT geonameId, name, CASE WHEN geonameId % 2 = 0 THEN 'P' ELSE 'A' END AS fcl, population FROM (SELECT c_custkey AS geonameId, c_name AS name, (c_custkey * 37) % 100000 AS population FROM customer)")
def source_gazetteer(spark, sf_dir):
    k = F.col("c_custkey")
    record = F.struct(k.alias("geonameId"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "P").otherwise("A").alias("fcl"), ((k * 37) % 100000).alias("population"))
    answers = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(record).alias("geonames"))).alias("value"))
    return authority.gazetteer(answers).select("geonameId", "name", "fcl", "population")


@query(f"SELECT p_partkey, round(1 - {sql.jaccard('a', 'b')}, 6) AS distance FROM (SELECT p_partkey, {sql.trigrams('p_name')} AS a, {sql.trigrams('p_type')} AS b FROM part)")
def trigram_distance(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", T.distance(F.col("p_name"), F.col("p_type")).alias("distance")), "distance")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(sql.PART_QUERIES, sql.PARTS)} WHERE rank <= CASE WHEN query_id % 4 > 0 THEN 1 + query_id % 10 ELSE 5 END")
def own_limits(spark, sf_dir):
    asked, k = roles.part_queries(spark, sf_dir), F.col("query_id")
    asked = asked.withColumn("limit", F.when(k % 4 > 0, 1 + k % 10))
    return rounded(merge.own_limits(match.fuzzy(asked, roles.parts(spark, sf_dir)), asked, default=5), "name_sim")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_first(spark, sf_dir):
    return merge.dedupe(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


BUGS = f"(SELECT query_id, bugs_reference AS query FROM {sql.REFERENCE_QUERIES} WHERE bugs_reference IS NOT NULL)"


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(BUGS, sql.REFERENCES, field='bugs_reference')}")
def fuzzy_bugs_reference(spark, sf_dir):
    asked = roles.reference_queries(spark, sf_dir).filter("bugs_reference IS NOT NULL").select("query_id", F.col("bugs_reference").alias("query"))
    return rounded(match.fuzzy_bibliography(asked, roles.references(spark, sf_dir), field="bugs_reference"), "name_sim")


@query(f"SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim, rank FROM {sql.top(f'(SELECT f.query_id, f.entity_id, f.label, f.name_sim, g.population, g.countryName FROM {GAZ_FOUND} f JOIN {GAZ} g ON g.geonameId = f.entity_id)', 10, 'CASE WHEN countryName = (SELECT min(n_name) FROM nation) THEN 0 ELSE 1 END, name_sim DESC, population DESC NULLS LAST, entity_id')}")
def gazetteer_search_country(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Customer "), F.substring("s_name", 10, 100)).alias("query"))
    country = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    rows = cascades.gazetteer_search(asked, roles.gazetteer(spark, sf_dir), country=country)
    return rounded(rows.select("query_id", "entity_id", "label", "name_sim", "rank"), "name_sim")


@query(f"SELECT {FUZZY} FROM {sql.fuzzy(PART_TEXTS, sql.PARTS)}")
def stream_reconcile(spark, sf_dir):
    """Parts as a stream of queries, matched batch by batch."""
    part = table(spark, sf_dir, "part")
    names = spark.readStream.schema(part.schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir)
    asked = names.select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000)).alias("query"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    reconcile_stream(asked, lambda batch: match.fuzzy(batch, roles.parts(spark, sf_dir)), f"{path}/out", f"{path}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").drop("batch"), "name_sim")


@query(f"SELECT entity_id, round(2 * 6378.137 * asin(sqrt(pow(sin(radians(59.33 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(59.33)) * pow(sin(radians(18.07 - longitude) / 2), 2))), 4) AS km FROM {sql.PARTS}")
def sphere_distance(spark, sf_dir):
    km = score.haversine_km(F.col("longitude"), F.col("latitude"), F.lit(18.07), F.lit(59.33))
    return roles.parts(spark, sf_dir).select("entity_id", F.round(km, 4).alias("km"))


@query(f"""SELECT query_id, entity_id, label, round(name_sim, 6) AS name_sim, rank, 0 AS segment FROM {sql.fuzzy(f'(SELECT query_id, query FROM {sql.PART_QUERIES} WHERE query_id % 2 = 0)', sql.PARTS)}
    UNION ALL SELECT query_id, entity_id, label, round(name_sim, 6), rank, 1 FROM {sql.fuzzy(f'(SELECT query_id, query FROM {sql.PART_QUERIES} WHERE query_id % 2 = 1)', f'(SELECT * FROM {sql.PARTS} WHERE entity_id % 3 > 0)')}""")
def stream_with_repeats(spark, sf_dir):
    """A stream of many files against an index: queries repeat within and after the first run, the index loses rows while the
    stream is down, and what comes too late is left out."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    parts = roles.parts(spark, sf_dir).select("entity_id", "label")
    index = TrigramIndex.create(parts, f"{path}/index", buckets=8)
    asked, k = roles.part_queries(spark, sf_dir), F.col("query_id")
    at = lambda hour: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour) + k % 3000)
    even, odd = (asked.filter(k % 2 == i) for i in (0, 1))

    def run(*parts_in):
        for rows in parts_in:
            rows.repartition(3, "query_id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("query_id long, query string, asked_at timestamp").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        reconcile_with_index(asked_once(stream, lateness="6 hours"), index, f"{path}/out", f"{path}/state").awaitTermination()

    run(even.withColumn("asked_at", at(0)), even.withColumn("asked_at", at(1)))
    index.apply(parts.filter("entity_id % 3 = 0").select("entity_id", F.lit(None).cast("string").alias("label")))
    late = asked.select((k + 1_000_000_000).alias("query_id"), "query").withColumn("asked_at", at(-100))
    run(even.withColumn("asked_at", at(2)), odd.withColumn("asked_at", at(2)), odd.withColumn("asked_at", at(3)), late)
    return rounded(spark.read.parquet(f"{path}/out/results").drop("batch", "generation"), "name_sim")


ENTRIES = "(SELECT o_orderpriority || ' ' || o_orderkey % 500 AS text, 'sv' AS lang, 't' || o_orderkey AS translation, o_orderkey AS ts FROM orders WHERE o_orderkey % 5 > 0)"


@query(f"""WITH e AS (SELECT text, lang, translation, ts FROM {ENTRIES} QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY ts DESC, translation DESC) = 1)
    SELECT o.o_orderkey, coalesce(e.translation, o.text) AS translation, e.translation IS NOT NULL AS hit FROM (SELECT o_orderkey, o_orderpriority || ' ' || o_orderkey % 700 AS text FROM orders) o LEFT JOIN e ON e.text = o.text""")
def translation_store(spark, sf_dir):
    """Three upserts into a stored cache, newer entries before older ones and one upsert that fails half-way, and a look-up."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    entry = o.select(F.concat_ws(" ", "o_orderpriority", (k % 500).cast("string")).alias("text"), F.lit("sv").alias("lang"), F.concat(F.lit("t"), k.cast("string")).alias("translation"), k.alias("ts"))
    store = TranslationStore(spark, f"{shared_dir(spark)}/translations-{uuid.uuid4().hex}", buckets=16)
    store.upsert(entry.filter(k % 5 == 3))
    commit, store._commit = store._commit, lambda *_: None  # ends before it counts
    store.upsert(entry.filter(k % 5 == 0).withColumn("ts", F.col("ts") * 2))
    store._commit = commit
    store.upsert(entry.filter((k % 5 == 1) | (k % 5 == 4)))
    store.upsert(entry.filter(k % 5 == 2))
    asked = o.select(k, F.concat_ws(" ", "o_orderpriority", (k % 700).cast("string")).alias("text"), F.lit("en").alias("source_lang"), F.lit("sv").alias("lang"))
    answers = store.translate(asked.select("text", "source_lang", "lang").distinct()).select("text", "translation", "hit")
    return asked.join(answers, "text").select("o_orderkey", "translation", "hit")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 7 THEN NULL ELSE upper(o_orderpriority) || ' ' || (o_orderkey % 40) END AS completion FROM orders")
def completion_log(spark, sf_dir):
    """Answers to prompts that many rows share, from a log filled in rounds; the model never answers one of the prompts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.concat_ws(" ", "o_orderpriority", (k % 40).cast("string")).alias("prompt"))
    log = CompletionLog(spark, f"{shared_dir(spark)}/completions-{uuid.uuid4().hex}", round_prompts=100, partitions=4)
    log.ask(rows.filter(k % 3 == 0), _answer)
    return log.ask(rows, _answer).drop("prompt")


def _answer(prompt):
    """A model that fails on one kind of prompt."""
    if prompt.endswith(" 7"):
        raise ValueError(prompt)
    return prompt.upper()


@query("""SELECT p_name || ', "' || p_brand || '"' AS site_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS country, 55.0::DOUBLE + (p_partkey % 1000) / 100.0::DOUBLE AS latitude, CASE WHEN p_partkey % 4 > 0 THEN 11.0::DOUBLE + (p_partkey % 700) / 100.0::DOUBLE END AS longitude,
    p_type || chr(10) || p_size AS place_name, CAST(p_partkey AS VARCHAR) AS national_id, NULL::VARCHAR AS description FROM part""")
def source_csv(spark, sf_dir):
    """Sites written as CSV and read back: quotes, separators, line ends and nulls."""
    p, k = roles.parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), "p_type", "p_size"), "entity_id"), F.col("entity_id")
    name = F.concat(F.col("label"), F.lit(', "'), F.col("national_id"), F.lit('"'))
    rows = p.select(name.alias("site_name"), F.when(k % 3 > 0, F.col("p_type")).alias("country"), "latitude", F.when(k % 4 > 0, F.col("longitude")).alias("longitude"), F.concat_ws("\n", "p_type", "p_size").alias("place_name"), k.cast("string").alias("national_id"), F.lit(None).cast("string").alias("description"))
    path = f"{shared_dir(spark)}/sites-{uuid.uuid4().hex}"
    rows.write.options(header=True, escape='"').csv(path)
    return authority.sites_csv(spark, path)


@query("""SELECT p_type, chunk, count(*) AS n_rows, '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(l, chr(10) ORDER BY p_partkey) AS "table" FROM
    (SELECT *, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS BIGINT) AS chunk FROM (SELECT p_type, p_partkey, '| ' || p_partkey || ' | ' || p_name || ' |' AS l FROM part)) GROUP BY 1, 2""")
def prompt_chunks(spark, sf_dir):
    """Lists of any length cut into texts of bounded size."""
    return prompts.chunked(table(spark, sf_dir, "part"), LISTED, ["p_partkey"], by=["p_type"], most_chars=2000)


@query("""SELECT chunk, count(*) AS n_rows, string_agg(l, chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey) AS "table" FROM
    (SELECT *, CAST(coalesce(sum(length(l) + 1) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 5000 AS BIGINT) AS chunk FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || ', ' || l_linenumber || ', ' || l_partkey AS l FROM lineitem)) GROUP BY 1""")
def lookup_chunks(spark, sf_dir):
    """The whole of a long table as one ordered list in parts."""
    return prompts.chunked(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_linenumber", "l_partkey"], most_chars=5000, form="lookup")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'no payload' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no object' WHEN 3 THEN 'a query is no object' WHEN 4 THEN 'no JSON' END AS problem FROM events WHERE event_id % 8 < 5""")
def rejected_payloads(spark, sf_dir):
    """Payloads of events that can't be read, and what is wrong with each."""
    k, kind = F.col("event_id"), F.col("event_type")
    one = F.concat(F.lit('{"q0": {"query": "'), kind, F.lit('"}}'))
    odd = F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 8 == 1, F.concat(F.lit('{"q0": {"query": "'), kind)).when(k % 8 == 2, F.concat(F.lit('["'), kind, F.lit('"]'))).when(k % 8 == 3, F.concat(F.lit('{"q0": "'), kind, F.lit('"}')))
    odd = odd.when(k % 8 == 4, F.concat(F.lit('"'), kind, F.lit('"'))).when(k % 8 == 5, F.concat(F.lit('"'), F.replace(one, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(one)
    return batches.rejected(table(spark, sf_dir, "events").select(k, odd.alias("payload"))).drop("payload")


@query(f"WITH {HITS} SELECT query_id, table_name, column_name, system_id, value, round(fts_rank, 6) AS rank, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fts_rank, 9) DESC, table_name, column_name, system_id) AS INTEGER) AS place FROM hits) JOIN vals USING (vid) WHERE place <= 20")
def corpus_refresh(spark, sf_dir):
    """A stored corpus of rows that were fewer and partly other ones, refreshed and searched."""
    parts = roles.search_parts(spark, sf_dir)

    def former(df, key, column):
        other = F.when(F.col(key) % 5 == 0, F.concat(F.col(column), F.lit(" formerly"))).otherwise(F.col(column))
        return df.filter(F.col(key) % 3 > 0).withColumn(column, other)

    stored = StoredCorpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    stored.refresh([(former(df, k, c), t, k, c, kind) for df, t, k, c, kind in parts])
    stored.refresh(parts)
    return rounded(stored.search(roles.corpus_queries(spark, sf_dir)), "rank")
