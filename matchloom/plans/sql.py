"""Pieces of DuckDB SQL that state the engine's measures by brute force."""

from matchloom.functions.text import ACCENTED, PAIRS, PLAIN


def norm(x: str) -> str:
    out = f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"
    for a, b in PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def grams(x: str) -> str:
    """Ordered trigrams."""
    return f"flatten(list_transform({words(x)}, lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


def trigrams(x: str) -> str:
    return f"list_distinct({grams(x)})"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce(CAST({both} AS DOUBLE) / nullif(len({a}) + len({b}) - {both}, 0), 0)"


def before(ordered: str) -> str:
    """For each place of a list the last place before it that holds the same, 0 where there is none."""
    return f"list_transform(range(1, len({ordered}) + 1), lambda q: coalesce(list_max(list_filter(range(1, q), lambda p: {ordered}[p] = {ordered}[q])), 0))"


def extent(own: str, ordered: str, earlier: str) -> str:
    """Word similarity of a set with ordered trigrams; earlier: before(ordered).

    For each place i that holds one of the set, `new` has the places from i on whose trigram is new in a run from i, and
    `hit` those of them that hold one of the set: the run up to the r-th hit shares r trigrams.
    """
    places = f"list_filter(range(1, len({ordered}) + 1), lambda i: list_contains({own}, {ordered}[i]))"
    new = f"list_filter(range(i, len({ordered}) + 1), lambda q: {earlier}[q] < i)"
    hit = "list_filter(x.places, lambda q: list_contains(y.new, q))"
    best = f"list_max(list_transform(range(1, len(z) + 1), lambda r: CAST(r AS DOUBLE) / (len({own}) + list_position(y.new, z[r]) - r)))"
    per_start = f"list_transform([{{'new': {new}}}], lambda y: list_transform([{hit}], lambda z: {best})[1])[1]"
    return f"coalesce(list_transform([{{'places': {places}}}], lambda x: list_max(list_transform(x.places, lambda i: {per_start})))[1], 0)"


def strict_extent(own: str, pieces: str) -> str:
    """The same with runs of whole words; pieces: trigrams of each word."""
    share = jaccard(own, f"list_distinct(flatten({pieces}[i:j]))")
    return f"coalesce(list_max(flatten(list_transform(range(1, len({pieces}) + 1), lambda i: list_transform(range(i, len({pieces}) + 1), lambda j: {share})))), 0)"


def word_pieces(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"


PART_QUERIES = "(SELECT min(p_partkey) AS query_id, substr(p_name, 1, 2) || substr(p_name, 4) AS query, p_name FROM part GROUP BY p_name)"
PARTS = """(SELECT p_partkey AS entity_id, p_name AS label, p_brand AS national_id, p_size % 10 AS location_type_id,
            55.0::DOUBLE + (p_partkey % 1000) / 100.0::DOUBLE AS latitude, 11.0::DOUBLE + (p_partkey % 700) / 100.0::DOUBLE AS longitude FROM part)"""
BRIDGE = "(SELECT DISTINCT l_partkey AS entity_id, n_name AS location_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
REFERENCES = """(SELECT p_partkey AS entity_id, p_name || ' ' || p_type || ' ' || p_brand AS full_reference, p_name AS title, p_type AS authors,
                 'bugs ' || p_brand || ' ' || p_name || ' ' || p_size AS bugs_reference, CAST(1900 + p_size AS VARCHAR) AS year, 'https://doi.org/10.1/P' || p_partkey AS doi, '978-' || p_partkey || '-x' AS isbn FROM part)"""
NONE = "NULL::VARCHAR AS isbn, NULL::VARCHAR AS doi, NULL::VARCHAR AS full_reference, NULL::VARCHAR AS title, NULL::VARCHAR AS year, NULL::VARCHAR AS authors, NULL::VARCHAR AS bugs_reference"
REFERENCE_QUERIES = f"""(SELECT l_suppkey * 3 AS query_id, p_name || ' ' || p_type AS query, '978 ' || p_partkey || 'X' AS isbn, ' http://doi.org/10.1/p' || p_partkey AS doi, p_name || ' ' || p_type || ' ' || p_brand AS full_reference,
    p_name AS title, CAST(1900 + p_size AS VARCHAR) AS year, p_type || ' AND SONS' AS authors, 'bugs ' || p_brand || ' ' || p_name || ' ' || p_size AS bugs_reference FROM part JOIN (SELECT l_suppkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) ON k = p_partkey
    UNION ALL SELECT l_suppkey * 3 + 1, p_name || ' ' || p_type, {NONE} FROM part JOIN (SELECT l_suppkey, max(l_partkey) AS k FROM lineitem GROUP BY 1) ON k = p_partkey
    UNION ALL SELECT min(p_partkey) * 3 + 2, p_name, {NONE} FROM part GROUP BY p_name)"""
CORPUS = """(SELECT DISTINCT * FROM (SELECT 'tbl_part' AS table_name, 'p_name' AS column_name, p_partkey AS system_id, p_name AS value, 'label' AS column_type FROM part
    UNION ALL SELECT 'tbl_part', 'p_brand', p_partkey, p_brand, 'abbreviation' FROM part UNION ALL SELECT 'tbl_part', 'p_type', p_partkey, p_type, 'description' FROM part
    UNION ALL SELECT 'tbl_part', 'reference', p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name, 'description' FROM part
    UNION ALL SELECT 'tbl_supplier', 's_name', s_suppkey, s_name, 'label' FROM supplier UNION ALL SELECT 'tbl_nation', 'n_name', n_nationkey, n_name, 'label' FROM nation
    UNION ALL SELECT 'tbl_documents', 'source', doc_id, source, 'abbreviation' FROM documents UNION ALL SELECT 'tbl_documents', 'text', doc_id, text, 'description' FROM documents) WHERE value IS NOT NULL)"""
PLAIN_SEARCHES = "SELECT p_name AS query FROM part UNION SELECT p_brand FROM part UNION SELECT p_name || ' ' || p_type FROM part UNION SELECT c_mktsegment FROM customer"
NAME_WORDS = "(SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"
CORPUS_QUERIES = f"""(SELECT query AS query_id, query FROM ({PLAIN_SEARCHES} UNION SELECT '"' || p_name || '"' FROM {NAME_WORDS} UNION SELECT a || ' or ' || b FROM {NAME_WORDS} UNION SELECT b || ' -' || a FROM {NAME_WORDS}))"""


def fuzzy(queries: str, authority: str, threshold: float = 0.3, limit: int = 10, field: str = "label", mode: str = "similarity", floor: bool = True, plain: bool = False) -> str:
    """A subquery query_id, entity_id, label, name_sim, rank by comparison of all pairs of texts; in the word modes of all
    pairs that share as many trigrams as any run must."""
    shape = (lambda x: x) if plain else norm
    q = f"(SELECT query_id, {shape('query')} AS q FROM {queries} WHERE query IS NOT NULL)"
    dist = f"(SELECT DISTINCT {field} AS label FROM {authority} WHERE {field} IS NOT NULL)"
    a = f"(SELECT label, {shape('label')} AS a FROM {dist})"
    score = "greatest(CASE WHEN q = a THEN 1.0 ELSE sim END, 0.0001)" if floor else "sim"
    if mode == "similarity":
        side = lambda rows, t: f"(SELECT *, {trigrams(t)} AS g FROM {rows})"
        pairs = f"(SELECT q.query_id, a.label, q.q, a.a, {jaccard('q.g', 'a.g')} AS sim FROM {side(q, 'q')} q JOIN {side(a, 'a')} a ON len(q.g) > 0 AND len(a.g) > 0)"
    else:
        # distinct texts on both sides; the pairs by how many trigrams they share
        hay = f"(SELECT q, g, og, {word_pieces('q')} AS wp, {before('og')} AS eb FROM (SELECT q, {trigrams('q')} AS g, {grams('q')} AS og FROM (SELECT DISTINCT q FROM {q})))"
        needle = f"(SELECT a, {trigrams('a')} AS g FROM (SELECT DISTINCT a FROM {a}))"
        met = f"(SELECT h.q, n.a FROM (SELECT q, unnest(g) AS gram FROM {hay}) h JOIN (SELECT a, unnest(g) AS gram, len(g) AS n FROM {needle}) n ON h.gram = n.gram GROUP BY h.q, n.a, n.n HAVING count(*) >= ceil({threshold} * n.n - 1e-9))"
        sim = extent("n.g", "h.og", "h.eb") if mode == "word" else strict_extent("n.g", "h.wp")
        measured = f"(SELECT m.q, m.a, {sim} AS sim FROM {met} m JOIN {hay} h ON h.q = m.q JOIN {needle} n ON n.a = m.a)"
        pairs = f"(SELECT q.query_id, a.label, q.q, a.a, s.sim FROM {measured} s JOIN {q} q ON q.q = s.q JOIN {a} a ON a.a = s.a WHERE s.sim >= {threshold} - 1e-9)"
    joined = f"(SELECT s.query_id, r.entity_id, s.label, CAST({score} AS DOUBLE) AS name_sim FROM {pairs} s JOIN {authority} r ON r.{field} = s.label WHERE sim >= {threshold} - 1e-9)"
    return f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY name_sim DESC, label, entity_id) AS INTEGER) AS rank FROM {joined}) WHERE rank <= {limit})"


def top(rows: str, limit: int, order: str, by: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS rank FROM {rows}) WHERE rank <= {limit})"
