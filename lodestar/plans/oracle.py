"""The queries of :mod:`lodestar.plans.queries` in SQL, written for an independent engine."""

from __future__ import annotations

from lodestar.functions.text import SEARCH_TERMS
from lodestar.functions.vocabulary import DESCRIPTION_STOPWORDS, EMBEDDING_TERMS, LITERAL_REWRITES, NOISE_WORDS, PHRASE_REWRITES
from lodestar.sources.schemas import FATAL
from lodestar.plans.queries import ASKED, BEHIND, CATALOG, DELAY_HOURS, FRAME_HOURS, GAP_HOURS, LIMIT, PAYLOADS, RULE_RECORDS, STRETCH_DAYS, TOP_K, VALUE_GROUPS, WEIGHTS
from lodestar.functions.stemming import stem

POOL = max(5 * TOP_K, 20)
_ASCII = r"'^[\x00-\x7F]*$'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prepare(expr: str) -> str:
    out = f"lower({expr})"
    for old, new in LITERAL_REWRITES:
        out = f"replace({out}, {_lit(old)}, {_lit(new)})"
    for pattern, new in PHRASE_REWRITES:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(new)}, 'g')"
    return out


def _families(terms: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({_lit(m)}, {_lit(c)})" for m, c in terms.items()) + ") f(member, canon)"


def _words(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


def _tokens(name: str, source: str, key: str = "k") -> str:
    """CTEs ending in ``name``(key, tok, p): distinct tokens of the parts (key, part, text) of ``source`` in first-seen order."""
    return f"""
{name}_l AS (SELECT {key}, part, regexp_extract_all({_prepare("coalesce(text, '')")}, '[a-z0-9_]+|[一-鿿]+') AS l FROM {source}),
{name}_r AS (SELECT {key}, part, unnest(l) AS tok, unnest(range(len(l))) AS i FROM {name}_l),
{name}_e AS (SELECT {key}, tok, part * 100000000 + i * 2 AS p FROM {name}_r UNION ALL
  SELECT {key}, canon, part * 100000000 + i * 2 + 1 FROM {name}_r JOIN {_families(SEARCH_TERMS)} ON tok = member),
{name} AS (SELECT {key}, tok, min(p) AS p FROM {name}_e GROUP BY {key}, tok)"""


def _joined(name: str, tokens: str, keys: str, key: str = "k", where: str = "true", sep: str = " ") -> str:
    """CTE ``name``(key, text): the tokens joined in order, '' where there are none; ``keys`` names a CTE with every key."""
    return f"""
{name}_s AS (SELECT {key}, string_agg(tok, {_lit(sep)} ORDER BY p) AS text FROM {tokens} WHERE {where} GROUP BY {key}),
{name} AS (SELECT {keys}.{key}, coalesce(text, '') AS text, 0 AS part FROM {keys} LEFT JOIN {name}_s ON {keys}.{key} = {name}_s.{key})"""


def _compact(expr: str) -> str:
    flat = f"trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g'))"
    first = f"split_part(regexp_replace({flat}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1), 1)"
    return f"CASE WHEN {flat} = '' THEN '' ELSE regexp_replace({first}, '\\.+$', '') || '.' END"


_NO_SIGNAL = f"tok NOT IN {_words(NOISE_WORDS)} AND NOT (length(tok) = 1 AND regexp_matches(tok, {_ASCII}))"
_KEYWORD = f"tok NOT IN {_words(DESCRIPTION_STOPWORDS)} AND NOT (length(tok) <= 2 AND regexp_matches(tok, {_ASCII}))"
_DOCS = "d AS (SELECT doc_id AS k, 0 AS part, text FROM documents)"


def _keywords(name: str, tokens: str, limit: int, key: str = "k") -> str:
    """CTE ``name``(key, tok, p, nth): the first ``limit`` keywords."""
    return f"""
{name} AS (SELECT {key}, tok, p, nth FROM (SELECT {key}, tok, p, row_number() OVER (PARTITION BY {key} ORDER BY p) AS nth FROM {tokens} WHERE {_KEYWORD}) WHERE nth <= {limit})"""


def _text_metrics(t: str) -> dict[str, str]:
    cjk = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
    count = lambda x, p: f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g')))"
    ascii_ = count(t, "[\\x00-\\x7F]")
    return {
        "chars": f"length({t})",
        "utf8_bytes": f"strlen({t})",
        "ascii_chars": ascii_,
        "non_ascii_chars": f"length({t}) - {ascii_}",
        "cjk_chars": count(t, cjk),
        "lines": f"CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + 1 END",
        "whitespace_terms": f"CASE WHEN trim(regexp_replace({t}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')) END",
        "estimated_tokens": _estimate(t),
    }


def _estimate(t: str) -> str:
    solid = f"regexp_replace({t}, '\\s', '', 'g')"
    cjk = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
    count = lambda p: f"(length({solid}) - length(regexp_replace({solid}, '{p}', '', 'g')))"
    word, ascii_, c = count("[A-Za-z0-9_]"), count("[\\x00-\\x7F]"), count(cjk)
    return f"CAST(ceil({word} / 4.0) + ceil(({ascii_} - {word}) / 2.0) + {c} + ceil((length({solid}) - {ascii_} - {c}) / 2.0) AS BIGINT)"


# --- search ---------------------------------------------------------------------------------

_asked = sorted({*ASKED, *(stem(w) for w in ASKED)})
_SEARCH = f"""
corpus AS (SELECT doc_id AS id, source AS q, text FROM documents),
vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
question AS (SELECT q, arg_min(v, corpus.id) AS qv FROM corpus JOIN vec ON corpus.id = vec.id GROUP BY q),
word AS (SELECT id, q, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM corpus),
lexr AS (SELECT word.q, id, CAST(count(*) AS DOUBLE) AS lex_rank FROM word JOIN question ON word.q = question.q WHERE w IN {_words(_asked)} GROUP BY word.q, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lex_rank DESC, id) AS lex_pos FROM lexr) WHERE lex_pos <= {POOL}),
semr AS (SELECT corpus.q, corpus.id, 1 - list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))) AS semantic_distance
  FROM corpus JOIN vec ON corpus.id = vec.id JOIN question ON corpus.q = question.q),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY semantic_distance, id) AS sem_pos FROM semr) WHERE sem_pos <= {POOL}),
fused AS (SELECT coalesce(lex.q, sem.q) AS q, coalesce(lex.id, sem.id) AS id,
  coalesce(CAST(1 AS DOUBLE) / (60 + lex_pos), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + sem_pos), 0) AS score, lex_rank, semantic_distance
  FROM lex FULL OUTER JOIN sem ON lex.q = sem.q AND lex.id = sem.id)"""

#: Fused rows of the questions and of blank ones; documents without a vector come last among those of their source.
_BLANK = f"""
nearr AS (SELECT corpus.q, corpus.id, 1 - list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))) AS semantic_distance
  FROM corpus JOIN question ON corpus.q = question.q LEFT JOIN vec ON corpus.id = vec.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY semantic_distance NULLS LAST, id) AS sem_pos FROM nearr) WHERE sem_pos <= {POOL}),
every AS (SELECT coalesce(lex.q, near.q) AS query_id, coalesce(lex.id, near.id) AS id,
  coalesce(CAST(1 AS DOUBLE) / (60 + lex_pos), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + sem_pos), 0) AS score, lex_rank, semantic_distance
  FROM lex FULL OUTER JOIN near ON lex.q = near.q AND lex.id = near.id
  UNION ALL SELECT q || '?', id, CAST(1 AS DOUBLE) / (60 + sem_pos), CAST(NULL AS DOUBLE), semantic_distance FROM near)"""

#: Words of each asked stem: the stem with the endings that the texts use, where the stemmer takes them off.
_FORMS = {
    x: tuple(w for w in (x + e for e in ("", "e", "s", "es", "ed", "ing", "ly", "lyed", "lying")) if stem(w) == x)
    for x in ("apach", "licens", "mit", "reserv", "version", "en")
}
#: Ranks of texts alone, weight 0.4: a phrase has its words side by side, a cover is a pair of neighbouring, different terms.
_PHRASES = f"""{_SEARCH},
place AS (SELECT q, id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT q, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM corpus WHERE q IN (SELECT q FROM question))),
t AS (SELECT q, id, p, CASE {' '.join(f"WHEN w IN {_words(ws)} THEN {_lit(x)}" for x, ws in _FORMS.items())} END AS x FROM place WHERE w IN {_words(w for ws in _FORMS.values() for w in ws)}),
refused AS (SELECT DISTINCT id FROM t WHERE x = 'version'),
part AS (SELECT q, id, CAST(0.4 AS DOUBLE) AS r FROM t WHERE x = 'en' OR x = 'reserv' AND id NOT IN (SELECT id FROM refused)
  UNION ALL SELECT question.q, doc_id, CAST(1 AS DOUBLE) FROM documents JOIN question ON source = question.q WHERE lang = 'en'
  UNION ALL SELECT a.q, a.id, CAST(0.4 AS DOUBLE) FROM t a JOIN t b ON a.id = b.id AND b.p = a.p + 1 WHERE a.x = 'apach' AND b.x = 'licens'
  UNION ALL SELECT q, id, CAST(0.4 AS DOUBLE) / (p - p0) FROM (SELECT *, lag(p) OVER (PARTITION BY id ORDER BY p) AS p0, lag(x) OVER (PARTITION BY id ORDER BY p) AS x0 FROM t WHERE x IN ('mit', 'licens')) WHERE x <> x0)"""

# --- catalog --------------------------------------------------------------------------------

_COLUMNS = "(VALUES " + ", ".join(f"({i}, {_lit(t)}, {_lit(c)}, {_lit(d)}, {_lit(c.split('_', 1)[1])})" for i, (t, c, d) in enumerate(CATALOG)) + ") c(pos, t, c, d, alias)"
_VALUES = " UNION ALL ".join(f"SELECT DISTINCT {i} AS col, {_lit(t)} AS t, {_lit(c)} AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for i, (t, c, _) in enumerate(CATALOG))
_CAT = f"""
cols AS (SELECT * FROM {_COLUMNS}),
vals AS (SELECT col, t, c, v, row_number() OVER (PARTITION BY col ORDER BY v) AS nth FROM ({_VALUES}) WHERE v IS NOT NULL),
card AS (SELECT col, t, c, count(*) AS n FROM vals GROUP BY col, t, c)"""
_LABELS = "[" + ", ".join(_lit(f"{t}::{c}") for t, c, _ in CATALOG) + "]"
_RULES = """(SELECT s_suppkey AS pos, 'r-' || s_suppkey AS rule_id, s_name, s_nationkey AS priority, s_name || ' needs approval. Ask legal.' AS d,
  1 + CAST(s_suppkey % 2 = 0 AS INTEGER) AS n_refs, 1 + CAST(s_suppkey % 3 = 0 AS INTEGER) AS n_terms FROM supplier)"""
_RULE_PARTS = f"""SELECT rule_id AS k, 0 AS part, rule_id AS text FROM rules UNION ALL SELECT rule_id, 1, CASE WHEN n_terms = 2 THEN 'exec sign off' ELSE 'beta' END FROM rules
  UNION ALL SELECT rule_id, 2, s_name FROM rules WHERE n_terms = 2 UNION ALL SELECT rule_id, 3, {_LABELS}[priority % {len(CATALOG)} + 1] FROM rules
  UNION ALL SELECT rule_id, 4, {_LABELS}[(priority % {len(CATALOG)} + 1) % {len(CATALOG)} + 1] FROM rules WHERE n_refs = 2"""
_NULL = "CAST(NULL AS VARCHAR)"


def _column_chunks() -> str:
    return f"""{_CAT},
kd AS (SELECT t || '::' || c AS k, 0 AS part, d AS text FROM cols),{_tokens("kt", "kd")},{_keywords("kw", "kt", 8)},
parts AS (SELECT t || '::' || c AS k, 1 AS part, t AS text FROM cols UNION ALL SELECT t || '::' || c, 2, c FROM cols UNION ALL SELECT t || '::' || c, 3, alias FROM cols
  UNION ALL SELECT k, 3 + nth, tok FROM kw),{_tokens("pt", "parts")},
keys AS (SELECT t || '::' || c AS k FROM cols),{_joined("exact", "pt", "keys")}"""


def _value_chunks() -> str:
    key = "t || '::' || c || '::' || v"
    return f"""{_CAT},
kept AS (SELECT vals.*, {key} AS k, 'The value ' || v || ' of the column. More follows.' AS gloss FROM vals JOIN card USING (col, t, c) WHERE n <= {LIMIT}),
kd AS (SELECT k, 0 AS part, gloss AS text FROM kept),{_tokens("kt", "kd")},{_keywords("kw", "kt", 6)},
parts AS (SELECT k, 1 AS part, t AS text FROM kept UNION ALL SELECT k, 2, c FROM kept UNION ALL SELECT k, 3, v FROM kept UNION ALL SELECT k, 4, lower(v) FROM kept
  UNION ALL SELECT k, 5, 'pilot' FROM kept UNION ALL SELECT k, 5 + nth, tok FROM kw),{_tokens("pt", "parts")},
keys AS (SELECT k FROM kept),{_joined("exact", "pt", "keys")}"""


def _rule_chunks() -> str:
    return f"""
rules AS (SELECT * FROM {_RULES}),
parts AS ({_RULE_PARTS}),{_tokens("pt", "parts")},
keys AS (SELECT rule_id AS k FROM rules),{_joined("exact", "pt", "keys")}"""


# --- issues: what each template of a record must give, by its place -------------------------


def _issues(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({m}, {_lit(kind)}, {_lit(entity)}, {_lit(action)}, {_lit(details)})" for m, kind, entity, action, details in rows) + ") x(m, issue_type, entity, action, details)"


def _typed(kind: str) -> str:
    return f'{{"actual_type":"{kind}"}}'


_ISSUE_COUNTS = "SELECT issue_type, entity_key, action, details, count(*) AS n FROM found GROUP BY issue_type, entity_key, action, details"
_FILLED = "replace(replace(replace(replace({}, '@t', t), '@c', c), '@i', CAST(pos AS VARCHAR)), '@s', s)"
_PAYLOAD_ISSUES = [
    row
    for name, one, wrapper in (("columns", "column", "columns"), ("value_groups", "value_group", "values"), ("rules", "rule", "rules"))
    for row in (
        (0, f"invalid_{one}_record", f"{name}[1]", "skipped_record", _typed("int")),
        (1, f"wrapped_{name}_payload", name, "accepted_wrapped_payload", f'{{"wrapper_key":"{wrapper}"}}'),
        (1, f"invalid_{one}_record", f"{name}[1]", "skipped_record", _typed("str")),
        (1, f"invalid_{one}_record", f"{name}[2]", "skipped_record", _typed("list")),
        *((m, f"invalid_{name}_payload", name, "ignored_payload", _typed(kind)) for m, kind in ((2, "dict"), (3, "int"), (4, "dict"), (6, "NoneType"))),
    )
]
_VALUE_ISSUES = [
    (0, "missing_value_group_column_name", "value_definition", "skipped_value_group", "{}"),
    (1, "inferred_value_group_table_name", "@c", "accepted_legacy_value_group", '{"table_name":"@t"}'),
    (2, "missing_value_group_table_name", "shared", "skipped_value_group", "{}"),
    (3, "invalid_identifier_separator", "a::b::@c", "skipped_value_group", "{}"),
    (4, "missing_value_column", "@t::nowhere", "skipped_value_group", '{"value_count":2}'),
    (5, "invalid_values_payload", "values", "ignored_payload", _typed("dict")),
    (6, "invalid_values_payload", "values", "ignored_payload", _typed("NoneType")),
    (7, "invalid_value_record", "values[0]", "skipped_record", _typed("int")),
    (7, "invalid_value_record", "values[1]", "skipped_record", _typed("str")),
    (8, "missing_raw_value", "@t::@c", "skipped_value", "{}"),
    (8, "missing_raw_value", "@t::@c", "skipped_value", "{}"),
    (9, "invalid_field_type", "@t::@c", "ignored_field", '{"field_name":"value_gloss","actual_type":"int"}'),
    (9, "invalid_list_field_type", "@t::@c", "dropped_field", '{"field_name":"synonyms","actual_type":"dict"}'),
    (9, "coerced_scalar_list_field", "@t::@c", "coerced_scalar_to_singleton_list", '{"field_name":"business_tags"}'),
]
_GROUPS = f"""
g AS (SELECT c_custkey AS pos, c_custkey % {len(VALUE_GROUPS)} AS m, 'r' || n_regionkey AS t, n_name AS c, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT *, row_number() OVER (PARTITION BY t, c, raw ORDER BY pos, i) AS nth FROM (SELECT *, 0 AS i, 'u' AS raw, '' AS gloss, '' AS tags FROM g WHERE m = 1
  UNION ALL SELECT *, 0, 'v' || pos, '', 'x' FROM g WHERE m = 9 UNION ALL SELECT *, 0, s, '', '' FROM g WHERE m = 10 UNION ALL SELECT *, 1, s, '', '' FROM g WHERE m = 10
  UNION ALL SELECT *, 2, 'True', 'told', '' FROM g WHERE m = 10))"""
_DROPPED, _ALONE = "dropped_candidate_column", ("rule_without_valid_candidate_columns", "skipped_rule", "{}")
_UNKNOWN = ("unknown_rule_candidate_column", _DROPPED, '{"column_name":"@t.nope"}')
_ONE = ("coerced_rule_candidate_columns", "coerced_scalar_to_singleton_list", "{}")
_RULE_ISSUES = [
    (0, "missing_rule_id", "rule_definition", "skipped_rule", "{}"),
    *(
        (m, kind, "same@s" if m == 11 else "k@i", action, details)
        for m, (kind, action, details) in (
            (1, _ONE),
            (2, ("invalid_rule_candidate_columns_payload", "dropped_candidate_columns", _typed("int"))),
            (3, ("malformed_rule_candidate_column", _DROPPED, '{"candidate_column":"5","actual_type":"int"}')),
            (3, ("malformed_rule_candidate_column", _DROPPED, '{"candidate_column":"null","actual_type":"NoneType"}')),
            (3, _ALONE),
            (4, ("unqualified_rule_candidate_column", _DROPPED, '{"column_name":"bare"}')),
            (5, _UNKNOWN),
            (6, ("malformed_rule_candidate_column", _DROPPED, '{"candidate_column":"{\\"table_name\\":\\"@t\\"}"}')),
            (7, ("invalid_rule_priority", "defaulted_priority", _typed("str"))),
            (8, ("coerced_scalar_list_field", "coerced_scalar_to_singleton_list", '{"field_name":"trigger_terms"}')),
            (8, ("invalid_field_type", "ignored_field", '{"field_name":"rule_text","actual_type":"int"}')),
            (9, _UNKNOWN),
            (9, _ALONE),
            (10, _ONE),
            (11, _UNKNOWN),
            (11, _ALONE),
        )
    ),
]
_RECORDS = f"""
g AS (SELECT o_orderkey AS pos, o_orderkey % {len(RULE_RECORDS)} AS m, 'r' || n_regionkey AS t, n_name AS c, CAST(o_custkey AS VARCHAR) AS s FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey),
h AS (SELECT s, min(pos) AS holder FROM g WHERE m = 12 GROUP BY s),
a AS (SELECT g.*, m >= 11 AND coalesce(pos > holder, false) AS again FROM g LEFT JOIN h ON g.s = h.s)"""


def _issue_queries() -> dict[str, str]:
    filled = f"{_FILLED.format('x.entity')} AS entity_key, action, {_FILLED.format('x.details')} AS details"
    values = f"""WITH {_GROUPS}, found AS (SELECT issue_type, {filled} FROM g JOIN {_issues(_VALUE_ISSUES)} ON g.m = x.m
UNION ALL SELECT 'duplicate_value_key', t || '::' || c || '::' || raw, 'skipped_duplicate_value', '{{}}' FROM v WHERE nth > 1) {_ISSUE_COUNTS}"""
    return {
        "fatal_issues": f"SELECT * FROM ({values}) WHERE issue_type IN {_words(sorted(FATAL))}",
        "issues_payloads": f"WITH found AS (SELECT issue_type, entity AS entity_key, action, details FROM customer JOIN {_issues(_PAYLOAD_ISSUES)} ON c_custkey % {len(PAYLOADS)} = x.m) {_ISSUE_COUNTS}",
        "issues_values": values,
        "parsed_values": f"WITH {_GROUPS} SELECT t AS table_name, c AS column_name, raw AS raw_value, gloss AS value_gloss, '' AS synonyms, tags FROM v WHERE nth = 1",
        "issues_rules": f"""WITH {_RECORDS}, found AS (SELECT issue_type, {filled} FROM a JOIN {_issues(_RULE_ISSUES)} ON a.m = x.m WHERE NOT again
UNION ALL SELECT 'duplicate_rule_id', 'same' || s, 'skipped_duplicate_rule', '{{}}' FROM a WHERE again) {_ISSUE_COUNTS}""",
        "parsed_rules": f"""WITH {_RECORDS} SELECT CASE WHEN m = 12 THEN 'same' || s ELSE 'k' || pos END AS rule_id, CASE WHEN m = 10 THEN 'b' ELSE '' END AS description,
CASE WHEN m IN (1, 4, 5, 6, 10) THEN t || '::' || c || CASE WHEN m = 4 THEN ',' || t || '::' || c ELSE '' END ELSE '' END AS refs, CASE m WHEN 8 THEN 'x' WHEN 12 THEN 'p,q' ELSE '' END AS triggers,
CASE m WHEN 1 THEN 70 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS priority FROM a WHERE NOT again AND m NOT IN (0, 3, 9, 11)""",
    }


# --- rollup ---------------------------------------------------------------------------------

_HITS = f"""
hits AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'value_definition' ELSE 'column_definition' END AS kind,
  'k' || (l_partkey % 50) AS chunk_key, l_returnflag AS t, l_linestatus AS c, 'r' || (l_suppkey % 4) AS rule_id, 'v' || (l_suppkey % 6) AS v,
  CAST(1 AS DOUBLE) / (l_quantity + 60) AS score, 'Rule ' || (l_partkey % 9) AS body, 'Gloss ' || l_linenumber || '.' AS gloss FROM lineitem),
parts AS (SELECT *, t AS rt, c AS rc, score * (CASE kind WHEN 'column_definition' THEN CAST({WEIGHTS["column_definition"]} AS DOUBLE) ELSE CAST({WEIGHTS["value_definition"]} AS DOUBLE) END) AS points, 0 AS place FROM hits WHERE kind <> 'rule'
  UNION ALL SELECT *, t, c, score * CAST({WEIGHTS["rule"]} AS DOUBLE) / 3, 0 FROM hits WHERE kind = 'rule'
  UNION ALL SELECT *, 'X', c, score * CAST({WEIGHTS["rule"]} AS DOUBLE) / 3, 1 FROM hits WHERE kind = 'rule'),
scores AS (SELECT q, rt, rc, list_sum(list(points ORDER BY pos, place)) AS score, bool_or(t = 'A') AS a FROM parts GROUP BY q, rt, rc),
mv AS (SELECT q, rt, rc, v, list_sum(list(score ORDER BY pos)) AS score, arg_min(gloss, pos) AS gloss FROM parts WHERE kind = 'value_definition' GROUP BY q, rt, rc, v),
mv4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, rt, rc ORDER BY score DESC, v) - 1 AS nth FROM mv) WHERE nth < 4),
mr AS (SELECT q, rt, rc, rule_id, arg_max(points, pos) AS score, arg_max(body, pos) AS body FROM parts WHERE kind = 'rule' GROUP BY q, rt, rc, rule_id),
mr4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, rt, rc ORDER BY score DESC, rule_id) - 1 AS nth FROM mr) WHERE nth < 4),
sc6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, rt, rc ORDER BY score DESC, chunk_key, pos) - 1 AS nth FROM parts WHERE kind <> 'rule') WHERE nth < 6)"""
_DETAILS = "details AS (SELECT * FROM (VALUES ('A', 'F', 'Alpha first.', 30, true), ('R', 'F', '', 3, false), ('M', 'M', 'Always shown.', 99, true)) d(t, c, short, n, must))"
_CANDIDATES = f"""{_HITS}, {_DETAILS},
top2 AS (SELECT * FROM (SELECT q, rt, rc, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rt, rc) AS rank FROM scores) WHERE rank <= 2),
forced AS (SELECT o_orderkey AS q, t, c, short, n, row_number() OVER (PARTITION BY o_orderkey ORDER BY t, c) AS rank FROM orders, details
  WHERE must AND NOT EXISTS (SELECT 1 FROM top2 WHERE q = o_orderkey AND rt = t AND rc = c)),
cand AS (SELECT q, 0 AS section, rank, rt AS t, rc AS c, coalesce(short, '') AS short, coalesce(n, 0) AS n, coalesce(must, false) AS must, 'retrieval' AS src
  FROM top2 LEFT JOIN details ON rt = t AND rc = c WHERE q IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT q, 1, rank, t, c, short, n, true, 'mandatory_high_cardinality' FROM forced)"""


_VERSIONS = """v1 AS (SELECT p_brand AS t, p_name AS c, p_type AS v, min(p_partkey) AS pos FROM part GROUP BY ALL),
cols AS (SELECT t, c, min(pos) AS pos FROM v1 GROUP BY t, c),
vals AS (SELECT t, c, v, true AS old FROM v1 WHERE pos % 100 <> 13 UNION ALL SELECT t, c, v || ' more', false FROM v1 WHERE pos % 100 = 29)"""
_MERGED = f"""WITH {_VERSIONS}
SELECT 'column_definition' AS chunk_type, 'column_definition::' || t || '::' || c AS chunk_key, CASE WHEN pos % 100 = 7 THEN 'Formerly ' ELSE 'Parts ' END || c || ' of ' || t || '.' AS text_semantic, true AS kept_id, true AS indexed FROM cols
UNION ALL SELECT 'value_definition', 'value_definition::' || t || '::' || c || '::' || v, 'For ' || t || '.' || c || ', ' || v || ' means Type ' || v || '.', old, true FROM vals
UNION ALL SELECT 'rule', 'rule::s' || s_suppkey, 'Ask ' || CASE WHEN s_suppkey % 100 = 5 THEN 'nobody' ELSE s_name END || '.', true, true FROM supplier WHERE s_suppkey % 100 <> 3"""


def _difference() -> str:
    """Multisets by EXCEPT ALL and INTERSECT ALL, counted for each key."""
    parts, found = [], []
    tables = (("part", "p_brand", "p_partkey", "p_type", ("p_size",)), ("customer", "c_nationkey", "c_custkey", "c_mktsegment", ()), ("orders", "o_custkey", "o_orderkey", "o_orderstatus", ("o_orderpriority",)))
    for name, key, number, first, rest in tables:
        others = "".join(f", {c}" for c in rest)
        parts.append(f"{name}_b AS (SELECT CAST({key} AS VARCHAR) AS key, {first} AS x{others}, {number} AS at FROM {name})")
        one = f"SELECT CAST({key} AS VARCHAR) AS key, CASE WHEN {number} % 89 = 0 THEN 'other' ELSE {first} END AS x{others}, CASE WHEN {number} % 79 = 0 THEN -{number} ELSE {number} END AS at FROM {name} WHERE {number} % 97 <> 0"
        parts.append(f"{name}_a AS ({one} UNION ALL {one} AND {number} % 83 = 0)")
        plain = f"key, x{others}"
        for kind, sql in (
            ("gone", f"SELECT {plain} FROM {name}_b EXCEPT ALL SELECT {plain} FROM {name}_a"),
            ("come", f"SELECT {plain} FROM {name}_a EXCEPT ALL SELECT {plain} FROM {name}_b"),
            ("stay", f"SELECT {plain} FROM {name}_b INTERSECT ALL SELECT {plain} FROM {name}_a"),
            ("still", f"SELECT * FROM {name}_b INTERSECT ALL SELECT * FROM {name}_a"),
        ):
            found.append(f"SELECT {_lit(name)} AS name, key, {_lit(kind)} AS kind, count(*) AS n FROM ({sql}) GROUP BY key")
    parts.append("found AS (" + " UNION ALL ".join(found) + ")")
    total = lambda k: f"coalesce(sum(n) FILTER (kind = '{k}'), 0)"
    parts.append(f"counts AS (SELECT name, key, {total('gone')} AS gone, {total('come')} AS come, {total('stay')} - {total('still')} AS moved FROM found GROUP BY name, key)")
    kinds = (("added", "come - least(gone, come)"), ("removed", "gone - least(gone, come)"), ("changed", "least(gone, come)"), ("moved", "moved"))
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT name, key, '{k}' AS change, CAST({c} AS BIGINT) AS n FROM counts WHERE {c} > 0" for k, c in kinds)


def _policy() -> str:
    """Distinct values of each column, counted."""
    columns = {
        "part": ("p_partkey", "p_name p_brand p_type p_size p_retailprice"),
        "customer": ("c_custkey", "c_name c_nationkey c_acctbal c_mktsegment"),
        "supplier": ("s_suppkey", "s_name s_nationkey s_acctbal"),
        "orders": ("o_orderkey", "o_orderstatus o_totalprice o_orderpriority"),
        "events": ("event_id", "event_type value"),
        "nation": ("n_nationkey", "n_nationkey n_name n_regionkey"),
        "documents": ("doc_id", "lang source"),
    }
    parts = []
    for table, (key, names) in columns.items():
        every = {n: n for n in names.split()} | {f"{key}_mod_{m}": f"{key} % {m}" for m in (24, 25, 26, 49, 53)} | {f"{key}_none": "CAST(NULL AS VARCHAR)"}
        parts += [f"SELECT {_lit(table)} AS table_name, {_lit(n)} AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS d FROM {table}" for n, c in every.items()]
    return f"SELECT table_name, column_name, n, n_null, d BETWEEN 1 AND {LIMIT} AS indexed, d > {LIMIT} AS mandatory FROM ({' UNION ALL '.join(parts)})"


def oracle_sql() -> dict[str, str]:
    metrics = _text_metrics("text")
    d_tokens = f"WITH {_DOCS},{_tokens('tk', 'd')}"
    bench = "d AS (SELECT item_id AS k, 0 AS part, text FROM benchmark)"
    passes = f"""WITH {bench}, keys AS (SELECT k FROM d),{_tokens("t1", "d")},{_joined("n1", "t1", "keys")},{_tokens("t2", "n1")},{_joined("terms", "t2", "keys", where=_NO_SIGNAL)},
norm AS (SELECT terms.k, 0 AS part, CASE WHEN terms.text <> '' THEN terms.text ELSE n1.text END AS text FROM terms JOIN n1 ON terms.k = n1.k),
{_tokens("t3", "norm")},{_joined("n3", "t3", "keys")},{_tokens("t4", "n3")},{_joined("again", "t4", "keys", where=_NO_SIGNAL)}"""
    component = "CAST(CAST('0x' || substr(sha256(tok || ':' || i), 1, 8) AS UBIGINT) AS DOUBLE) / CAST(2147483648 AS DOUBLE) - 1"
    rounded = lambda *xs: ", ".join(f"round({x}, 9) AS {x}" if x == "score" else x for x in xs)
    hist = """WITH r AS (SELECT *, p_size % 11 = 0 AS no_c, p_size % 7 = 0 AS no_t FROM part),
o AS (SELECT *, CASE WHEN NOT no_c AND NOT no_t THEN row_number() OVER (PARTITION BY p_brand, p_name, no_c OR no_t ORDER BY p_partkey) END AS nth FROM r),
i AS (SELECT 'invalid_field_type' AS issue_type, 'ignored_field' AS action FROM o WHERE p_size % 13 = 0
 UNION ALL SELECT 'missing_column_name', 'skipped_column' FROM o WHERE no_c
 UNION ALL SELECT 'missing_column_table_name', 'skipped_column' FROM o WHERE NOT no_c AND no_t
 UNION ALL SELECT 'duplicate_column_identity', 'skipped_duplicate_column' FROM o WHERE nth > 1
 UNION ALL SELECT 'invalid_field_type', 'ignored_field' FROM o WHERE nth = 1 AND p_size % 5 = 0
 UNION ALL SELECT 'coerced_scalar_list_field', 'coerced_scalar_to_singleton_list' FROM o WHERE nth = 1 AND p_size % 3 = 0
 UNION ALL SELECT 'invalid_list_field_item', 'dropped_list_item' FROM o, range(2) WHERE nth = 1 AND p_size % 3 <> 0 AND p_size % 4 = 0)
SELECT issue_type, action, count(*) AS n FROM i GROUP BY issue_type, action"""
    covered = ", ".join(f"CASE WHEN contains(lower(text), {_lit(w)}) THEN {_lit(w)} END" for w in ("license", "the", "ation", "src", "*** ", "zzz"))
    hits = f"""WITH {_SEARCH}, {_BLANK}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex_rank DESC NULLS LAST, semantic_distance ASC NULLS LAST, id) AS hit_pos FROM every)
SELECT query_id, hit_pos, id, source AS resource_owner, 'all' AS resource_namespace, 'doc::' || id AS chunk_key, 'rule' AS chunk_type, {_NULL} AS table_name, {_NULL} AS column_name, CAST(id AS VARCHAR) AS rule_id,
{_NULL} AS raw_value, round(score, 9) AS score, round(lex_rank, 6) AS lex_rank, round(semantic_distance, 6) AS semantic_distance, lang AS payload, text AS text_exact, '' AS text_semantic
FROM best JOIN documents ON doc_id = id WHERE hit_pos <= {TOP_K}"""
    return {
        "hybrid_search_sql": hits,
        "hybrid_rrf_topk": f"""WITH {_SEARCH}, best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, lex_rank DESC NULLS LAST, semantic_distance ASC NULLS LAST, id) AS hit_pos FROM fused)
SELECT q AS query_id, hit_pos, id, round(score, 9) AS score, round(lex_rank, 6) AS lex_rank, round(semantic_distance, 6) AS semantic_distance, lang, n_chars FROM best JOIN documents ON doc_id = id WHERE hit_pos <= {TOP_K}""",
        "lex_topn": f"WITH {_SEARCH} SELECT q AS query_id, id, round(lex_rank, 6) AS lex_rank, lex_pos FROM lex",
        "asof_orders": """WITH e AS (SELECT event_id, user_id AS c, event_id * 7 % 2400 AS day FROM events),
o AS (SELECT o_custkey AS c, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey, o_orderstatus FROM orders),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY c, day ORDER BY o_orderkey DESC) = 1)
SELECT event_id, o_orderkey, o_orderstatus FROM e ASOF LEFT JOIN l ON e.c = l.c AND e.day >= l.day""",
        "price_bands": """WITH b AS (SELECT p_partkey, p_retailprice * p_size AS low, p_retailprice * p_size + CASE WHEN p_size = 50 THEN CAST(2000 AS DOUBLE) ELSE p_size / CAST(4 AS DOUBLE) END AS high FROM part),
p AS (SELECT l_extendedprice / l_quantity AS price FROM lineitem) SELECT p_partkey, count(*) AS n, max(price) AS largest FROM p JOIN b ON price >= low AND price < high GROUP BY p_partkey""",
        "user_sessions": f"""WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events),
g AS (SELECT *, coalesce(us - lag(us) OVER w > {GAP_HOURS} * CAST(3600000000 AS BIGINT), true) AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, user_id, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session, opens AS session_start,
round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {FRAME_HOURS} * CAST(3600000000 AS BIGINT) PRECEDING AND CURRENT ROW), 4) AS recent FROM g""",
        "policy_from_sketches": _policy(),
        "namespace_merge": _MERGED,
        "catalog_difference": _difference(),
        "unaccent_docs": """SELECT doc_id, md5(p) AS digest, length(p) AS n FROM (SELECT doc_id,
  replace(replace(replace(replace(strip_accents(replace(replace(replace(text, 'th', 'œ'), 'an', 'ł'), 'on', 'Æ')), 'œ', 'oe'), 'ł', 'l'), 'Æ', 'AE'), 'ß', 'ss') AS p FROM documents)""",
        "first_wins_stream": f"""WITH e AS (SELECT *, epoch_ms(ts) AS ms, date_diff('day', (SELECT min(ts) FROM events), ts) // {STRETCH_DAYS} + CAST(event_id % {BEHIND} = 0 AS BIGINT) AS stretch FROM events),
reached AS (SELECT stretch, max(max(ms)) OVER (ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_HOURS} * 3600000 AS watermark FROM e GROUP BY stretch),
seen AS (SELECT user_id, event_type, event_id, ts, ms < coalesce(watermark, 0) AS late FROM e JOIN reached USING (stretch)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM seen WHERE NOT late)
SELECT 'first' AS kind, user_id, event_type, event_id, true AS whole FROM ordered WHERE nth = 1 UNION ALL SELECT 'late', user_id, event_type, event_id, true FROM seen WHERE late""",
        "semantic_index_full": f"WITH {_SEARCH} SELECT q AS query_id, id, round(semantic_distance, 6) AS semantic_distance, sem_pos FROM sem",
        "sem_topn": f"WITH {_SEARCH} SELECT q AS query_id, id, round(semantic_distance, 6) AS semantic_distance, sem_pos FROM sem",
        "rrf_full_outer": f"WITH {_SEARCH} SELECT q AS query_id, id, round(score, 9) AS score, round(lex_rank, 6) AS lex_rank, round(semantic_distance, 6) AS semantic_distance FROM fused",
        "hybrid_search_hits": hits,
        "fts_rank_phrase": f"WITH {_PHRASES} SELECT q AS query_id, id, round(CAST(CAST(sum(r) AS FLOAT) AS DOUBLE), 5) AS lex_rank FROM part GROUP BY q, id",
        "namespace_replace": f"""WITH {_CAT} SELECT * FROM (SELECT 'column_definition' AS chunk_type, count(*) AS n FROM cols UNION ALL SELECT 'rule', count(*) FROM supplier
UNION ALL SELECT 'value_definition', CAST(sum(n) AS BIGINT) FROM card WHERE n <= {LIMIT}) WHERE n > 0""",
        "scope_filter_count": "SELECT source AS resource_owner, lang AS resource_namespace, count(*) AS n FROM documents GROUP BY source, lang",
        "prepare_rewrites": f"SELECT doc_id, md5(p) AS digest, length(p) AS n FROM (SELECT doc_id, {_prepare('text')} AS p FROM documents)",
        "tokenize_docs": f"{d_tokens}, keys AS (SELECT k FROM d),{_joined('j', 'tk', 'keys')} SELECT j.k AS doc_id, (SELECT count(*) FROM tk WHERE tk.k = j.k) AS n_tokens, md5(j.text) AS digest FROM j",
        "alias_expand": f"""{d_tokens}, e AS (SELECT k, tok, p * 2 AS p FROM tk UNION ALL SELECT k, canon, p * 2 + 1 FROM tk JOIN {_families(EMBEDDING_TERMS)} ON tok = member),
keys AS (SELECT k FROM d),{_joined("j", "e", "keys")} SELECT k AS doc_id, text AS expanded FROM j""",
        "dedupe_terms": "SELECT doc_id, CAST(list_unique(string_split(lower(text), ' ')) AS BIGINT) AS n_distinct, len(string_split(lower(text), ' ')) AS n_words FROM documents",
        "compact_sentence": f"SELECT doc_id, {_compact('text')} AS sentence FROM documents",
        "description_keywords": f"{d_tokens},{_keywords('kw', 'tk', 8)}, keys AS (SELECT k FROM d),{_joined('j', 'kw', 'keys')} SELECT k AS doc_id, text AS keywords FROM j",
        "build_text_exact": f"""WITH parts AS (SELECT p_partkey AS k, 1 AS part, p_brand AS text FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part UNION ALL SELECT p_partkey, 3, p_name FROM part),{_tokens("pt", "parts")},
keys AS (SELECT p_partkey AS k FROM part),{_joined("j", "pt", "keys")} SELECT k AS p_partkey, text AS text_exact FROM j""",
        "text_metrics": "SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in metrics.items()) + " FROM documents",
        "estimate_tokens": f"SELECT item_id, {_estimate('text')} AS tokens FROM benchmark",
        "collection_summary": f"""SELECT count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS chars_total, round(CAST(sum(length(text)) AS DOUBLE) / count(*), 3) AS chars_avg, max(length(text)) AS chars_max,
CAST(sum(strlen(text)) AS BIGINT) AS utf8_bytes_total, CAST(sum(e) AS BIGINT) AS estimated_tokens_total, round(CAST(sum(e) AS DOUBLE) / count(*), 3) AS estimated_tokens_avg FROM (SELECT text, {_estimate("text")} AS e FROM documents)""",
        "count_by_key": "SELECT coalesce(source, 'None') AS bucket, count(*) AS n FROM documents GROUP BY 1",
        "retrieval_inputs_batch": f"""{passes} SELECT norm.k AS item_id, norm.text AS normalized_query, CASE WHEN again.text <> '' THEN replace(again.text, ' ', ' OR ') ELSE norm.text END AS lexical_query,
trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS semantic_query, CASE WHEN again.text <> '' THEN again.text ELSE n3.text END AS keywords FROM norm JOIN again USING (k) JOIN n3 USING (k) JOIN d USING (k)""",
        "hash_embedding_tokens": f"""WITH d AS (SELECT DISTINCT p_name AS k, 0 AS part, p_name AS text FROM part),{_tokens("tk", "d")}, u AS (SELECT DISTINCT tok FROM tk),
c AS (SELECT tok, i, {component} AS x FROM u, range(24) r(i)), n AS (SELECT tok, sqrt(sum(x * x)) AS n FROM c GROUP BY tok)
SELECT c.tok AS token, i, round(x / n, 6) AS x FROM c JOIN n ON c.tok = n.tok""",
        "embed_text_docs": f"""{d_tokens}, e AS (SELECT k, tok FROM tk UNION ALL SELECT k, canon FROM tk JOIN {_families(EMBEDDING_TERMS)} ON tok = member),
w AS (SELECT k, tok, count(*) AS w FROM e GROUP BY k, tok), u AS (SELECT DISTINCT tok FROM w), c AS (SELECT tok, i, {component} AS x FROM u, range(24) r(i)),
n AS (SELECT tok, sqrt(sum(x * x)) AS n FROM c GROUP BY tok), s AS (SELECT k, i, sum(w * x / n) AS x FROM w JOIN c ON w.tok = c.tok JOIN n ON n.tok = c.tok GROUP BY k, i),
l AS (SELECT k, sqrt(sum(x * x)) AS n FROM s GROUP BY k) SELECT s.k AS doc_id, i, round(x / n, 6) AS x FROM s JOIN l ON s.k = l.k""",
        "column_definition_chunks": f"""WITH {_column_chunks()} SELECT 'column_definition::' || exact.k AS chunk_key, 'column_definition' AS chunk_type, cols.t AS table_name, cols.c AS column_name, {_NULL} AS rule_id, {_NULL} AS raw_value,
exact.text AS text_exact, {_compact("d")} AS text_semantic, coalesce(n, 0) AS value_cardinality, coalesce(n > {LIMIT}, false) AS mandatory FROM exact JOIN cols ON exact.k = cols.t || '::' || cols.c LEFT JOIN card ON cols.pos = card.col""",
        "value_definition_chunks": f"""WITH {_value_chunks()} SELECT 'value_definition::' || exact.k AS chunk_key, 'value_definition' AS chunk_type, t AS table_name, c AS column_name, {_NULL} AS rule_id, v AS raw_value, exact.text AS text_exact,
'For ' || t || '.' || c || ', ' || v || ' means ' || {_compact("gloss")} AS text_semantic FROM exact JOIN kept ON exact.k = kept.k""",
        "rule_chunks": f"""WITH {_rule_chunks()} SELECT 'rule::' || rule_id AS chunk_key, 'rule' AS chunk_type, {_NULL} AS table_name, {_NULL} AS column_name, rule_id, {_NULL} AS raw_value, exact.text AS text_exact,
{_compact("d")} AS text_semantic, CAST(n_refs AS BIGINT) AS n_columns FROM exact JOIN rules ON exact.k = rule_id""",
        "chunk_union": f"""WITH {_CAT}, rules AS (SELECT * FROM {_RULES}), u AS (SELECT 0 AS s, pos AS g, 0 AS i, 'column_definition::' || t || '::' || c AS chunk_key, 'column_definition' AS chunk_type FROM cols
UNION ALL SELECT 1, col, nth, 'value_definition::' || t || '::' || c || '::' || v, 'value_definition' FROM vals JOIN card USING (col, t, c) WHERE n <= {LIMIT}
UNION ALL SELECT 2, pos, 0, 'rule::' || rule_id, 'rule' FROM rules) SELECT row_number() OVER (ORDER BY s, g, i) AS id, chunk_key, chunk_type FROM u""",
        "rule_catalog": f"""WITH {_rule_chunks()} SELECT rule_id, exact.text AS text_exact, {_compact("d")} AS text_semantic, CAST(priority AS BIGINT) AS priority, CAST(n_terms AS BIGINT) AS n_triggers FROM exact JOIN rules ON exact.k = rule_id""",
        "value_cardinality": f"WITH {_CAT} SELECT t AS table_name, c AS column_name, n, n <= {LIMIT} AS indexed, n > {LIMIT} AS mandatory FROM card",
        "mandatory_columns": f"WITH {_CAT} SELECT t AS table_name, c AS column_name, n FROM card WHERE n > {LIMIT}",
        "value_indexing_summary": f"""WITH {_CAT} SELECT count(*) FILTER (n <= {LIMIT}) AS indexed_value_groups, CAST(coalesce(sum(n) FILTER (n <= {LIMIT}), 0) AS BIGINT) AS indexed_values, count(*) AS total_value_groups,
CAST(sum(n) AS BIGINT) AS total_values, count(*) FILTER (n > {LIMIT}) AS mandatory_description_columns, coalesce(string_agg(t || '::' || c, ',' ORDER BY t || '::' || c) FILTER (n > {LIMIT}), '') AS mandatory_description_labels FROM card""",
        "first_wins_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1",
        "rule_dedup_stateful": """WITH o AS (SELECT o_custkey AS k, o_orderkey AS p, o_orderstatus = 'F' AS x FROM orders), h AS (SELECT k, min(p) FILTER (NOT x) AS h FROM o GROUP BY k)
SELECT o.k AS rule_id, count(*) FILTER (coalesce(p > h, false)) AS n_duplicates, count(*) FILTER (x AND NOT coalesce(p > h, false)) AS n_dropped FROM o JOIN h ON o.k = h.k GROUP BY o.k""",
        "infer_table_name": """SELECT k AS column_name, min(t) AS table_name FROM (SELECT CAST(c_nationkey AS VARCHAR) AS k, c_mktsegment AS t FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)
GROUP BY k HAVING count(DISTINCT t) = 1""",
        "candidate_ref_parse": """SELECT page_id, CASE WHEN contains(url, '::') THEN split_part(url, '::', 1) WHEN contains(url, '.') THEN regexp_replace(url, '\\.[^.]*$', '') END AS table_name,
CASE WHEN contains(url, '::') THEN substr(url, instr(url, '::') + 2) WHEN contains(url, '.') THEN regexp_extract(url, '[^.]*$') END AS column_name FROM pages""",
        "resolve_column_identity": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN t WHEN p_size % 2 = 0 THEN coalesce(t, p_brand) ELSE t END AS table_name, p_name AS column_name
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_type END AS t FROM part)""",
        "unknown_refs_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
        "known_refs_semi": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment",
        "key_violations": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1",
        "foreign_key_orphans": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) GROUP BY lang",
        "issues_histogram": hist,
        **_issue_queries(),
        "keyword_coverage": f"SELECT doc_id, concat_ws(',', {covered}) AS covered FROM documents",
        "rollup_scores": f"WITH {_HITS} SELECT q AS query_id, rt AS table_name, rc AS column_name, round(score, 9) AS score, CASE WHEN a THEN 'a lines,' ELSE '' END || 'line,open,syn' AS coverage FROM scores",
        "rule_bonus": f"WITH {_HITS} SELECT rt AS table_name, rc AS column_name, rule_id, count(*) AS n, round(sum(points), 6) AS bonus FROM parts WHERE kind = 'rule' GROUP BY rt, rc, rule_id",
        "matched_values_top4": f"WITH {_HITS} SELECT q AS query_id, rt AS table_name, rc AS column_name, nth, v AS raw_value, {rounded('score')}, gloss AS value_gloss FROM mv4",
        "matched_rules_top4": f"WITH {_HITS} SELECT q AS query_id, rt AS table_name, rc AS column_name, nth, rule_id, {rounded('score')}, body AS text_semantic FROM mr4",
        "supporting_top6": f"WITH {_HITS} SELECT q AS query_id, rt AS table_name, rc AS column_name, nth, chunk_key, kind AS chunk_type, {rounded('score')} FROM sc6",
        "candidate_top5": f"""WITH {_HITS} SELECT query_id, table_name, column_name, rank, round(score, 9) AS score FROM (SELECT q AS query_id, rt AS table_name, rc AS column_name, score,
row_number() OVER (PARTITION BY q ORDER BY score DESC, CASE WHEN a THEN 4 ELSE 3 END DESC, rt, rc) AS rank FROM scores) WHERE rank <= 5""",
        "mandatory_injection": f"""WITH {_CANDIDATES} SELECT q AS query_id, CAST(section AS BIGINT) AS section, rank, t AS table_name, c AS column_name, short AS short_description, CAST(n AS BIGINT) AS n,
must AS mandatory_description_in_prompt, src AS injection_source FROM cand""",
        "prompt_projection": f"""WITH {_CANDIDATES}, r AS (SELECT q, rule_id, min(pos) AS pos FROM hits WHERE kind = 'rule' GROUP BY q, rule_id), rl AS (SELECT q, string_agg(rule_id, ',' ORDER BY pos) AS rules FROM r GROUP BY q),
cl AS (SELECT q, count(*) AS n, string_agg(t || '::' || c, ',' ORDER BY section, rank) AS columns FROM cand GROUP BY q)
SELECT o_orderkey AS query_id, coalesce(n, 0) AS n_columns, coalesce(columns, '') AS columns, coalesce(rules, '') AS rules FROM orders LEFT JOIN cl ON cl.q = o_orderkey LEFT JOIN rl ON rl.q = o_orderkey""",
        "retrieval_summary": f"""WITH {_CANDIDATES}, h AS (SELECT q, count(*) AS n, string_agg(chunk_key, ',' ORDER BY pos) FILTER (pos <= 5) AS keys, string_agg(t || '::' || c, ',' ORDER BY pos) FILTER (pos <= 5 AND kind <> 'rule') AS cols FROM hits GROUP BY q),
c AS (SELECT q, count(*) AS n, count(*) FILTER (section = 1) AS forced FROM cand GROUP BY q),
k AS (SELECT q, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT q, kind, count(*) AS n FROM hits GROUP BY q, kind) GROUP BY q),
v AS (SELECT top2.q, count(*) AS n FROM top2 JOIN mv4 ON top2.q = mv4.q AND top2.rt = mv4.rt AND top2.rc = mv4.rc GROUP BY top2.q), r AS (SELECT top2.q, count(*) AS n FROM top2 JOIN mr4 ON top2.q = mr4.q AND top2.rt = mr4.rt AND top2.rc = mr4.rc GROUP BY top2.q)
SELECT o_orderkey AS query_id, coalesce(h.n, 0) AS hit_count, kinds, CASE WHEN h.q IS NOT NULL THEN coalesce(keys, '') END AS keys, CASE WHEN h.q IS NOT NULL THEN coalesce(cols, '') END AS columns, coalesce(c.n, 0) AS candidate_column_count,
coalesce(v.n, 0) AS matched_value_count, coalesce(r.n, 0) AS matched_rule_count, coalesce(forced, 0) AS mandatory_injected_columns
FROM orders LEFT JOIN h ON h.q = o_orderkey LEFT JOIN k ON k.q = o_orderkey LEFT JOIN c ON c.q = o_orderkey LEFT JOIN v ON v.q = o_orderkey LEFT JOIN r ON r.q = o_orderkey""",
    }
