"""SQL for the operators that SQL can express, written for an independent engine."""

from __future__ import annotations

from lodestar.llm.common import LOWER, UPPER
from lodestar.llm.licenses import default_templates

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'"


def _grams() -> str:
    rows = []
    for n, t in enumerate(default_templates()):
        last = len(t.words) - t.k
        for j in range(last + 1):
            w = [*t.words[j : j + t.k], None][:3]
            rows.append(f"({n}, '{t.label}', {t.base}, {j}, {last + 1}, {len(t.words)}, {', '.join(map(_text, w))})")
    return "(VALUES " + ", ".join(rows) + ") g(template, label, base, place, n_grams, n_template, g0, g1, g2)"


LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS l FROM documents),
w AS (SELECT r, i, l[i + 1] AS w0, l[i + 2] AS w1, l[i + 3] AS w2 FROM (SELECT r, l, unnest(range(len(l))) AS i FROM d)),
v AS (SELECT DISTINCT r, template, label, base, n_grams, i - place AS diagonal, place FROM w JOIN {_grams()} ON w0 = g0 AND w1 = g1 AND (g2 IS NULL OR w2 = g2)),
o AS (SELECT r, template, label, base, n_grams, diagonal, count(*) AS own FROM v GROUP BY ALL),
m AS (SELECT o.r, o.template, o.label, o.n_grams, o.diagonal, own, count(DISTINCT place) AS every FROM o JOIN v ON o.r = v.r AND o.template = v.template AND v.diagonal BETWEEN o.diagonal AND o.diagonal + 8
  WHERE NOT o.base GROUP BY ALL HAVING count(DISTINCT place) >= 0.6 * o.n_grams),
n AS (SELECT * FROM m WHERE own >= 0.6 * n_grams OR NOT EXISTS (SELECT 1 FROM m AS x WHERE x.r = m.r AND x.template = m.template AND abs(x.diagonal - m.diagonal) <= 8
  AND (x.every > m.every OR x.every = m.every AND x.diagonal < m.diagonal))),
spans AS (SELECT r, label, true AS base, diagonal AS start, CAST(1 AS DOUBLE) AS cover FROM o WHERE base AND own = n_grams UNION ALL SELECT r, label, false, NULL, every / CAST(n_grams AS DOUBLE) FROM n),
f AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN f ON d.r = f.r"""

PERSPECTIVES = """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
j AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, '<|' || chat_role || '|>' || chr(10) || CASE WHEN chat_role = 'user' THEN speaker || ': ' ELSE '' END || text || chr(10) AS content FROM j),
s AS (SELECT *, row_number() OVER o - 1 AS position, sum(length(content)) OVER (o ROWS UNBOUNDED PRECEDING) AS stop FROM r
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position, speaker, chat_role, content, CAST(stop - length(content) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(chat_role = 'assistant' AS INTEGER) AS mask FROM s"""

_DIGEST = " || ".join(
    f"substr({_BASE32}, 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT p.page_id, strlen(p.html) AS n, sha1(p.html) AS h, first FROM p JOIN g ON p.html = g.html)
SELECT page_id, n AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM d"""

NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(c.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS l FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS l FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(l[i + 1 : i + 10], ' ') AS phrase, least(len(l), 10) AS n FROM (SELECT item, l, unnest(range(greatest(len(l) - 9, 1))) AS i FROM b WHERE len(l) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT r, n, i, array_to_string(l[i + 1 : i + n], ' ') AS phrase FROM (SELECT r, n, l, unnest(range(len(l) - n + 1)) AS i FROM d, sizes WHERE len(l) >= n)),
hits AS (SELECT r, item, i, runs.n FROM runs JOIN windows ON runs.phrase = windows.phrase AND runs.n = windows.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""


#: The table of the cyclic redundancy check, from its rule.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """SQL for the unsigned crc32 of ``text``, beside a row of ``crc``."""
    octets = f"list_transform(range(strlen({text})), lambda j: CAST('0x' || substr(hex(encode({text})), CAST(2 * j + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, crc.t[xor(a & 255, b) + 1])), 4294967295)"


RESAMPLE = f"""WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS l FROM documents),
w AS MATERIALIZED (SELECT r, unnest(l) AS word FROM d),
b AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
hashed AS MATERIALIZED (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc),
source AS (SELECT bucket, count(*) AS s FROM w JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM w) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g
  FROM source LEFT JOIN target USING (bucket)),
weighed AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(l) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)"""


def _merkle(lower: int = 7, upper: int = 4) -> str:
    """Level by level, from the nodes themselves: ``lower`` levels hold 8 ** 7 leaves of a language."""
    parts = [f"{_CRC_TABLE}"]
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts += [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(f'translate(text, {chr(39)}{UPPER}{chr(39)}, {chr(39)}{LOWER}{chr(39)})')} ELSE {leaf('text')} END AS claimed FROM documents, crc)",
        "t AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM d)",
        "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t)",
        "l0 AS MATERIALIZED (SELECT tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p)",
        "f0 AS MATERIALIZED (SELECT r, tree, pos, '' AS proof, claimed AS h FROM p)",
    ]

    def climb(k: int) -> None:
        above = f"SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{k} WHERE n > 1 GROUP BY tree, pos // 8 UNION ALL SELECT tree, pos, h FROM l{k} WHERE n = 1"
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({above}))")
        same = f"f{k} f JOIN l{k} l ON f.tree = l.tree AND f.pos // 8 = l.pos // 8"
        folded = (
            "SELECT r, f.tree, f.pos // 8 AS pos, f.proof || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos <> f.pos), '') AS proof, sha256(string_agg(CASE WHEN l.pos = f.pos THEN f.h ELSE l.h END, '' ORDER BY l.pos)) AS h "
            f"FROM {same} WHERE l.n > 1 GROUP BY r, f.tree, f.pos, f.proof, f.h UNION ALL SELECT r, f.tree, f.pos, f.proof, f.h FROM {same} WHERE l.n = 1"
        )
        parts.append(f"f{k + 1} AS MATERIALIZED ({folded})")

    for k in range(lower):
        climb(k)
    parts.append(f"subroots AS MATERIALIZED (SELECT tree AS lang_no, h AS subroot FROM l{lower})")
    first = lower + 1  # the subroots are the leaves of one more tree
    parts.append(f"l{first} AS MATERIALIZED (SELECT 0 AS tree, tree - 1 AS pos, h, count(*) OVER () AS n FROM l{lower})")
    parts.append(f"f{first} AS MATERIALIZED (SELECT r, 0 AS tree, tree - 1 AS pos, proof, h FROM f{lower})")
    for k in range(first, first + upper):
        climb(k)
    last = first + upper
    select = f"SELECT doc_id, leaf, subroot, l{last}.h AS root, sha256(proof) AS proof_sha256, f{last}.h AS folded_root, f{last}.h = l{last}.h AS verified FROM p JOIN f{last} USING (r) JOIN subroots ON p.tree = lang_no, l{last}"
    return "WITH " + ",\n".join(parts) + "\n" + select


MERKLE = _merkle()


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": LICENSES, "op6_perspectives": PERSPECTIVES, "op7_warc_roundtrip": WARC, "op8_vp_tree": NEAREST, "op10_decontaminate": DECONTAMINATE, "op12_importance_resampling": RESAMPLE, "op13_merkle_manifest": MERKLE}
