"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from loam.llm.pairs import _PLACEHOLDER

SQL: dict[str, str] = {}

_BLANK = r"[\s\p{Z}\x0B\x85\x1c-\x1f]"
_LONG = "t AS (SELECT id, any_value(replace(text, chr(13) || chr(10), chr(10))) AS t FROM retrieved_chunk WHERE id IS NOT NULL AND length(replace(text, chr(13) || chr(10), chr(10))) > 2000 GROUP BY id)"
SQL["p2_found"] = rf"""
WITH RECURSIVE {_LONG},
l AS (SELECT id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT id, string_split(t, chr(10)) AS x FROM t)),
s AS (SELECT id, n, length(line) AS c, regexp_extract(line, '^(`{{3,}}|~{{3,}})', 1) AS run, regexp_matches(line, '^#{{1,6}}{_BLANK}') AS heading, regexp_matches(line, '^{_BLANK}*$') AS blank FROM l),
w(id, n, c, fence, kind, block) AS (
  SELECT id, 0::BIGINT, 0::BIGINT, '', 'B', 0 FROM t
  UNION ALL
  SELECT s.id, s.n, s.c, CASE WHEN w.fence <> '' THEN CASE WHEN s.run = w.fence THEN '' ELSE w.fence END ELSE s.run END, CASE WHEN w.fence <> '' OR s.run <> '' THEN 'F' WHEN s.heading THEN 'H' WHEN s.blank THEN 'B' ELSE 'P' END,
    CASE WHEN w.fence <> '' THEN w.block WHEN s.run <> '' OR s.heading THEN w.block + 1 WHEN s.blank OR w.kind = 'P' THEN w.block ELSE w.block + 1 END
  FROM w JOIN s ON s.id = w.id AND s.n = w.n + 1),
b AS (SELECT id, block, sum(c) + count(*) - 1 AS size FROM w WHERE kind <> 'B' GROUP BY id, block)
SELECT id, CASE WHEN max(size) > 2000 THEN 'forced' ELSE 'boundary' END AS cut FROM b GROUP BY id"""
SQL["p2_cover"] = f"WITH {_LONG} SELECT id, md5(regexp_replace(t, '{_BLANK}+', '', 'g')) AS body_md5, true AS within_limit, true AS overlap_repeats FROM t"

_PAIRS = r"""
words AS (SELECT id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM retrieved_chunk WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
part AS (SELECT id, w FROM words WHERE len(w) >= 30),
grams AS (SELECT DISTINCT id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM part)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
pairs AS (SELECT a, b FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c >= (0.6::DOUBLE - 1e-12) * (x.n + y.n - c))"""
SQL["p4_found"] = f"WITH {_PAIRS} SELECT a AS id_a, b AS id_b FROM pairs"
SQL["p4_groups"] = f"""
WITH RECURSIVE {_PAIRS}, edge AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(id, root) AS (SELECT id, id FROM part UNION SELECT edge.b, r.root FROM r JOIN edge ON edge.a = r.id),
groups AS (SELECT id, min(root) AS grp FROM r GROUP BY id), links AS (SELECT a AS id, count(*) AS links FROM edge GROUP BY a)
SELECT p.id, min(p.id) OVER (PARTITION BY p.w) AS cls, g.grp, coalesce(l.links, 0) AS links FROM part p JOIN groups g USING (id) LEFT JOIN links l USING (id)"""

_NONE = ", ".join(f"'{w}'" for w in sorted(_PLACEHOLDER))
SQL["p5_empty"] = rf"""
WITH a AS (SELECT pos, regexp_replace(actual_answer, '<[^<>]*>|&nbsp;', ' ', 'g') AS x FROM eval_row WHERE turns IS NOT NULL),
f AS (SELECT pos, CASE WHEN regexp_full_match(x, '(?s)\s*(`{{3,}}|~{{3,}})\w*\s*.*?\s*(`{{3,}}|~{{3,}})\s*') THEN regexp_extract(x, '(?s)^\s*(?:`{{3,}}|~{{3,}})\w*\s*(.*?)\s*(?:`{{3,}}|~{{3,}})\s*$', 1) ELSE x END AS x FROM a),
w AS (SELECT pos, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM f)
SELECT pos FROM w WHERE w IS NULL OR len(w) = 0 OR (len(w) < 5 AND array_to_string(w, '') IN ({_NONE}))"""
SQL["p6_round_trip"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
SQL["p7_checks"] = "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_without_need, 0::BIGINT AS without_place, 0::BIGINT AS pieces_too_many FROM documents"
