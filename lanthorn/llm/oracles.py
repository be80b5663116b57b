"""SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _components(nodes: str, links: str) -> str:
    """Further parts of a WITH: component(id, component_id) of nodes(id) and links(a, b)."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
    component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_components("v", "pairs")}
SELECT v.id AS vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.id) AS n_links, c.component_id, v.id = c.component_id AS kept FROM v JOIN component c ON c.id = v.id"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT item_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: w[i + 1 : i + k])) AS win FROM b),
dw AS (SELECT doc_id, k, i, w[i + 1 : i + k] AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_FOLDED}, {_WORDS}) AS w FROM documents),
d AS (SELECT id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM d),
pairs AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.g = q.g AND p.id < q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
{_components("d", "pairs")}
SELECT d.id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM d JOIN component c ON c.id = d.id"""

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (h) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_CONTROL = r"(<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|<unk>|</s>|<s>|\\)"
_SAID = "</s>[INST] ok [/INST]"
OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', 'x\\1', 'g')) AS n, length(regexp_replace(role, '{_CONTROL}', 'x\\1', 'g')) AS r FROM c),
f AS (SELECT *, CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 7 ELSE n + r + 16 END AS chars, CASE role WHEN 'assistant' THEN text ELSE '' END AS said FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(length(said)) AS BIGINT) AS loss_chars,
  sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3, "op6_decontamination": OP6, "op7_jaccard_join": OP7, "op8_substring_dedup": OP8, "op10_chat_tree": OP10}
