"""DuckDB SQL for the numbered queries that SQL can express."""

from lectern.llm.license_scan import TEMPLATES

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TEMPLATE_ROWS = ",\n  ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


def _bigrams(text: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


ORACLE: dict[str, str] = {
    "op4_license_scans": f"""
WITH templates(nr, license_id, text) AS (VALUES
  {TEMPLATE_ROWS}),
t AS (SELECT nr, license_id, {_bigrams("text")} AS b FROM templates),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(x, chr(10)), string_split_regex(x, '\\n[ \\t\\r]*\\n'), [x])) AS unit
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
u AS (SELECT doc_id, unit, {_bigrams("unit")} AS b FROM units),
scored AS (
  SELECT u.doc_id, u.unit, t.license_id, 2.0 * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM u JOIN t ON len(u.b) > 0 AND len(u.b) >= 0.6 * len(t.b) AND len(t.b) >= 0.6 * len(u.b)),
best AS (
  SELECT doc_id, unit, license_id, dice FROM scored WHERE dice >= 0.75
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license_id) = 1)
SELECT d.doc_id, count(b.unit) AS n_hits,
       coalesce(string_agg(DISTINCT b.license_id, ',' ORDER BY b.license_id), '') AS license_ids,
       CAST(round(max(b.dice), 6) AS DOUBLE) AS best_dice
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id""",
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, length(k.key) >= 10 AND o.owner <> k.doc_id AS dropped
  FROM keyed k JOIN owned o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tk
  FROM documents),
d AS (
  SELECT doc_id, text, tk, len(tk) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM t),
c AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         array_to_string(tk[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS prefix,
         array_to_string(tk[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS middle,
         array_to_string(tk[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c""",
}
