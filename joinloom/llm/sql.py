"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import licenses


def _licenses() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, texts in licenses.NOTICES.items() for t in texts)
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT license, {bigrams} AS b FROM (SELECT license, {words("text")} AS w FROM (VALUES {values}) v(license, text))),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM l),
a AS (SELECT doc_id, {bigrams} AS a FROM (SELECT doc_id, {words("unit")} AS w FROM u) WHERE len(list_distinct(w)) <= 60),
f AS (SELECT doc_id, license, a, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM a, t WHERE len(a) BETWEEN len(b) * 0.6 AND len(b) * 1.6)
SELECT doc_id, license, count(DISTINCT list_sort(a)) AS n_units, max(CAST(dice AS DOUBLE)) AS best_dice FROM f WHERE dice >= 0.8 GROUP BY ALL"""


#: Words that SQL sees as the operators do: only A-Z become lower case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARK_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACE_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+')"

SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_MARK_WORDS} AS w FROM documents), b AS (SELECT item_id, {_MARK_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS phrase,
  least(len(w), 10) AS size FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, s WHERE len(w) >= size),
m AS (SELECT g.doc_id, g.pos, g.size, p.item_id FROM g JOIN p ON p.size = g.size AND p.phrase = array_to_string(list_slice(g.w, g.pos, g.pos + g.size - 1), ' ')),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS i FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
c AS (SELECT word, count(*) AS n FROM t GROUP BY word),
v AS (SELECT DISTINCT item_id, list_sort(list_distinct(string_split(phrase, ' '))) AS words FROM p),
x AS (SELECT words, arg_min(word, coalesce(n, 0)) AS rarest FROM (SELECT DISTINCT words, unnest(words) AS word FROM v) LEFT JOIN c USING (word) GROUP BY words HAVING count(n) = count(*)),
y AS (SELECT t.doc_id, words, list_slice(w, greatest(pos - 19, 1), pos + 19) AS around, least(pos, 20) AS before FROM x JOIN t ON t.word = rarest JOIN d ON d.doc_id = t.doc_id),
z AS (SELECT DISTINCT doc_id, words FROM y WHERE list_has_all(around, words) AND len(list_filter(range(1, before + 1), lambda s: list_has_all(list_slice(around, s, s + 19), words))) > 0),
e AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM z JOIN v USING (words)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(e.items, '')) AS near_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
    "op4_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, o.b FROM r JOIN o ON o.a = r.other)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id""",
    "op1_license_scan": _licenses(),
    "op7_chat_format": """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\s'), '<', '\\l'), '[', '\\b') AS et, replace(replace(replace(replace(role, '\\', '\\s'), '<', '\\l'), '[', '\\b'), chr(10), '\\n') AS er FROM r),
p AS (SELECT *, lag(er) OVER (PARTITION BY conv_id ORDER BY turn, er, et) AS before FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + CASE WHEN before IS NULL OR before <> er THEN 24 + length(er) ELSE 8 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""",
}
