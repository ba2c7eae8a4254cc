"""SQL that gives the same rows as the queries it is named for; the others have no SQL form and are tested against brute force."""

from __future__ import annotations

from . import embedding_dedup, jaccard_join, quality_rules

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: Lower case of A-Z only.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach(node, other) AS (SELECT DISTINCT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links(a, b) AS (
  SELECT x.vec_id, y.vec_id FROM (SELECT DISTINCT vec_id, label, e FROM v) x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= {embedding_dedup.SIMILARITY}
), {_COMPONENTS}
SELECT e.vec_id, coalesce(n.n, 0)::bigint AS n_links, least(e.vec_id, coalesce(l.component, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.component, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {jaccard_join.WORDS - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - {jaccard_join.WORDS - 2}, 2))) t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links(a, b) AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE {jaccard_join.BELOW} * x.c >= {jaccard_join.ABOVE} * (na.n + nb.n - x.c)
), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(l.component, d.doc_id)) AS component_id, coalesce(k.n, 0)::bigint AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON l.node = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = d.doc_id"""

_SAID = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^\\#<:]', '', 'g')))"
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len("### ") + len(": ") + len("</turn>") + 1} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::bigint AS formatted_chars
FROM t GROUP BY conv_id"""


def _rules() -> str:
    tests = [(rule, above, below, c) for rule, (m, grid) in quality_rules.RULES.items() for above, below in [m.split(" / ")] for c in grid]
    measure = "coalesce({0}::double / nullif({1}, 0)::double, 0.0)"
    values = ", ".join(f"{{'rule': '{rule}', 'cutoff': {c}::double, 'hit': {measure.format(a, b)} > {c}}}" for rule, a, b, c in tests)
    share = quality_rules.RISK / len(quality_rules.RULES)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 2] AS k FROM d, unnest(range(1, greatest(len(w) - 1, 1))) t(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM d),
f AS (
  SELECT d.doc_id, d.lang, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims, length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS n_capitals,
    len(l.x) AS n_lines, (len(l.x) - len(list_distinct(l.x)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words
  FROM d JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
own AS (SELECT lang FROM held GROUP BY lang HAVING count(*) >= {quality_rules.LEAST_IN_STRATUM}),
tests AS (SELECT b.*, b.lang AS stratum, unnest([{values}], recursive := true) FROM b JOIN own ON b.lang IS NOT DISTINCT FROM own.lang),
counted AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (hit) AS k FROM tests WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
tail AS (
  SELECT stratum, rule, cutoff, n, k, CASE WHEN k > n * {share!r}::double THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}::double) + (n - i) * ln(1 - {share!r}::double))) FROM unnest(range(k + 1)) t(i)) END AS p FROM counted
), chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p <= {quality_rules.DELTA} / ((SELECT count(*) FROM own) * {len(tests)}) GROUP BY ALL),
bad AS (SELECT DISTINCT t.doc_id FROM tests t JOIN chosen c ON t.stratum IS NOT DISTINCT FROM c.stratum AND t.rule = c.rule AND t.cutoff = c.cutoff WHERE t.hit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""


SQL = {"op1_embedding_near_duplicates": EMBEDDINGS, "op2_quality_rules": _rules(), "op9_jaccard_join": JACCARD, "op10_chat_prefix_trees": CHAT}
