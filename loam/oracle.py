"""DuckDB twins of the core's queries, for the side-by-side check."""

from __future__ import annotations

from loam.functions.text import EXAM_TELLS, STOPWORDS
from loam.oracle_packed import SQL as PACKED
from loam import queries_memory, queries_pages, queries_runs
from loam.queries import ALIASES, EVICTION_BUDGET, KB_BUDGET, REQUESTED_FROM, SCOPE

SQL: dict[str, str] = {"p3_found": PACKED}

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^@/?#]*@)?([^:/?#]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"


def _url(group: int, u: str = "url") -> str:
    return f"regexp_extract({u}, '{_URL}', {group})"


_URLS = "urls AS (SELECT id, CAST(generate_subscripts(source_urls, 1) - 1 AS INT) AS pos, unnest(source_urls) AS url FROM packet)"
_PATH = f"CASE WHEN {_url(4)} = '' THEN '/' ELSE {_url(4)} END"
_NORMAL = f"lower({_url(1)}) || '://' || lower({_url(2)}) || CASE WHEN {_url(3)} = '' OR (lower({_url(1)}) = 'http' AND {_url(3)} = '80') OR (lower({_url(1)}) = 'https' AND {_url(3)} = '443') THEN '' ELSE ':' || {_url(3)} END || {_PATH} || CASE WHEN {_url(5)} = '?' THEN '' ELSE {_url(5)} END"
_SEGS = f"list_filter(string_split({_url(4)}, '/'), lambda x: x <> '')"


def _stem(x: str) -> str:
    return rf"regexp_replace({x}, '\.[^.]*$', '')"


def _clean(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace({x}, '[/\\]', '_', 'g'), '^\.+', '')"
    return f"CASE WHEN {inner} = '' THEN '_' ELSE {inner} END"


SQL["url_functions"] = f"""
WITH {_URLS}
SELECT id, pos, {_NORMAL} AS normal, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^/?#]*)', 1)) AS host,
  CASE WHEN len({_SEGS}) = 0 THEN '' ELSE {_clean(_stem(f"list_last({_SEGS})"))} END AS slug,
  array_to_string(list_concat([{_clean(f"lower({_url(2)})")}], list_transform({_SEGS}, lambda s, i: {_clean(f"CASE WHEN i = len({_SEGS}) AND NOT ends_with({_url(4)}, '/') THEN {_stem('s')} ELSE s END")}), ['index.md']), '/') AS path,
  {_PATH} || {_url(5)} AS rest, regexp_matches(lower({_url(4)}), '\\.pdf$') AS asset,
  ({" OR ".join(f"starts_with({_NORMAL}, '{s}')" for s in SCOPE)}) AS scoped
FROM urls"""

_FIG = "list_filter(list_transform(regexp_extract_all({0}, '(\\d[\\d,.]*)', 1), lambda x: replace(regexp_replace(x, '[.,]+$', ''), ',', '')), lambda x: x <> '')"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(regexp_replace({{0}}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '([a-z]{{{{5,}}}})', 1), lambda w: w NOT IN ({_STOP}))"

SQL["text_functions"] = f"""
SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens, sha256(text) AS hash, substr(sha256(concat_ws('|', source, '0', sha256(text))), 1, 32) AS chunk_id,
  CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '…[truncated: showing 80 of ' || length(text) || ' chars]' END AS cut,
  CASE WHEN length(text) <= 200 THEN text ELSE left(text, 70) || chr(10) || '…[' || (length(text) - 140) || ' chars elided from the middle]…' || chr(10) || right(text, 70) END AS cut_middle,
  CASE WHEN length(text) <= 50 THEN text ELSE left(text, 50) || chr(10) || chr(10) || '[...truncated...]' END AS trimmed,
  array_to_string({_DISTINCT.format(_FIG.format("text"))}, ' ') AS figures, CAST(len({_WORDS.format("text")}) AS INT) AS words,
  CASE WHEN doc_id < 60 THEN doc_id || 's' WHEN doc_id < 3600 THEN (doc_id // 60) || 'm' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || 's' ELSE (doc_id // 3600) || 'h' || lpad(CAST(doc_id // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS duration
FROM documents WHERE text IS NOT NULL"""

_PARENT = r"regexp_extract(id, '^(.*)\.[^.]*$', 1)"
SQL["id_functions"] = f"""
SELECT id, {_PARENT} AS parent, replace(list_last(string_split(id, '.')), '-', ' ') AS short,
  'q-' || CASE WHEN length(id) * 997 >= 1000 THEN CAST(length(id) * 997 AS VARCHAR) ELSE lpad(CAST(length(id) * 997 AS VARCHAR), 4, '0') END AS question_id,
  (id = 'faq' OR starts_with(id, 'faq.')) AS faq, CASE WHEN {_PARENT} IN ('', id) THEN id ELSE id || '|' || {_PARENT} END AS ids
FROM packet"""

SQL["kind_functions"] = r"""
WITH p AS (SELECT DISTINCT kb_path, lower(regexp_extract(kb_path, '(\.[^./]+)$', 1)) AS ext FROM manifest_entry)
SELECT kb_path, CASE WHEN ext IN ('.md', '.markdown') THEN 'markdown' WHEN ext = '.txt' THEN 'text' WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.png', '.jpg', '.jpeg', '.gif', '.webp') THEN 'image' END AS kind,
  CASE ext WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS mime,
  string_split(kb_path, '/')[1] AS host
FROM p"""

SQL["heading_prefixes"] = r"""
WITH r AS (
  SELECT hit_id, text, list_filter(list_transform(coalesce(headings, []), lambda h: trim(h)), lambda h: h IS NOT NULL AND h <> '') AS path,
    trim(regexp_replace(string_split(ltrim(text), chr(10))[1], '^#+', '')) AS first
  FROM retrieved_chunk WHERE text IS NOT NULL),
k AS (SELECT hit_id, text, CASE WHEN len(path) > 0 AND first <> '' AND list_last(path) = first THEN path[1:len(path) - 1] ELSE path END AS kept FROM r)
SELECT hit_id, CASE WHEN len(kept) = 0 THEN text ELSE array_to_string(kept, ' > ') || chr(10) || chr(10) || text END AS prefixed FROM k"""

SQL["markdown_features"] = r"""
WITH t AS (SELECT hit_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM retrieved_chunk WHERE text IS NOT NULL),
p AS (SELECT hit_id, t, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '(?m)^<!--[ \t]*source:[^\n]*?-->[ \t]*$', '', 'g'), '(?m)^[ \t]*-{3,}[ \t]*$', '', 'g'), '\n\s*\n'), lambda b: regexp_replace(b, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS b FROM t)
SELECT hit_id, CAST(len(regexp_extract_all(t, '(?m)^#{1,6} ')) AS INT) AS headings, CAST(len(regexp_extract_all(t, '(?m)^\|[- :|]+\|[ \t]*$')) AS INT) AS tables, CAST(len(regexp_extract_all(t, '```')) // 2 AS INT) AS code_blocks,
  CAST(len(list_filter(regexp_extract_all(t, '!?\[[^\]]*\]\([^)]*\)'), lambda x: x[1] <> '!')) AS INT) AS links, CAST(len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]*\)')) AS INT) AS images,
  CAST(len(list_filter(b, lambda x: CASE WHEN regexp_matches(x, '^\|[^|\n]*[^|\n\s:\-][^|\n]*\|$') THEN length(trim(x[2:length(x) - 1])) ELSE length(x) END >= 120)) AS INT) AS paragraphs
FROM p"""

SQL["query_expand"] = "WITH q AS (SELECT pos, question, lower(question) AS low FROM eval_row WHERE question IS NOT NULL), a AS (SELECT pos, question, list_distinct_kept AS adds FROM (SELECT pos, question, list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){alias.lower()}($|[^\\p{{L}}\\p{{N}}_])') AND NOT contains(low, '{name.lower()}') THEN '{name}' END" for alias, name in ALIASES.items()
) + "], lambda x: x IS NOT NULL) AS list_distinct_kept FROM q)) SELECT pos, CASE WHEN len(adds) = 0 THEN question ELSE question || ' ' || array_to_string(adds, ' ') END AS expanded FROM a"

SQL["event_props"] = """
WITH j AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (k BETWEEN 0 AND 3) AS scores FROM j GROUP BY event_type"""


def _vector(distance: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
d AS (SELECT query_id, vec_id, {distance} AS distance FROM q, v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM d)
SELECT query_id, vec_id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 8"""


SQL["vector_topk_l2"] = _vector("sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))")
SQL["vector_topk_cosine"] = _vector("1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))")

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
SQL["bm25_topk"] = f"""
WITH q AS (SELECT DISTINCT pos AS query_id, unnest({_TERMS.format("question")}) AS term FROM eval_row WHERE pos % 50 = 0),
d AS (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents), totals AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
tf AS (SELECT doc_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), totals GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10"""

_HITS = "hits AS (SELECT * FROM retrieved_chunk WHERE query_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY hit_id) = 1)"


def _fusion(score: str, shown: str) -> str:
    return f"""
WITH {_HITS},
v AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_rank, hit_id) AS INT) AS vector_rank, count(*) OVER (PARTITION BY query_id) AS nv FROM hits WHERE vector_rank IS NOT NULL),
t AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fts_rank, hit_id) AS INT) AS fts_rank, count(*) OVER (PARTITION BY query_id) AS nt FROM hits WHERE fts_rank IS NOT NULL),
f AS (SELECT query_id, id, vector_rank, fts_rank, round({score}, 9) AS fused_score FROM v FULL JOIN t USING (query_id, id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, vector_rank ASC NULLS LAST, fts_rank ASC NULLS LAST, id) AS INT) AS rank FROM f)
SELECT query_id, id, vector_rank, fts_rank, {shown} rank FROM r WHERE rank <= 8"""


SQL["hybrid_rrf"] = _fusion("coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0)", "fused_score,")
SQL["hybrid_linear"] = _fusion("coalesce(0.6::DOUBLE * (1 - (vector_rank - 1)::DOUBLE / nv), 0) + coalesce(0.4::DOUBLE * (1 - (fts_rank - 1)::DOUBLE / nt), 0)", "fused_score,")
SQL["hybrid_none"] = _fusion("0.0::DOUBLE", "")

_SPANS = f"""{_HITS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC NULLS LAST, hit_id) AS rank FROM hits WHERE kb_path IS NOT NULL AND chunk_index IS NOT NULL),
single AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, kb_path, chunk_index ORDER BY rank, id) = 1),
runs AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, kb_path ORDER BY chunk_index) AS run FROM single),
spans AS (SELECT query_id, kb_path, run, arg_min_null(id, chunk_index) AS id, min(chunk_index) AS chunk_index, arg_min_null(headings, chunk_index) AS headings, arg_min_null(source_kind, rank) AS source_kind,
  arg_min_null(image_path, rank) AS image_path, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_index) AS text, CAST(sum(token_estimate) AS INT) AS token_estimate, min(rank) AS best FROM runs GROUP BY query_id, kb_path, run),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS INT) AS rank FROM spans)"""
_KEPT = f""",
sized AS (SELECT query_id, rank, CASE WHEN coalesce(token_estimate, 0) > 0 THEN token_estimate ELSE greatest(1, length(coalesce(text, '')) // 4) END AS t FROM placed),
fold(query_id, rank, used, kept, n) AS (
  SELECT query_id, rank, CAST(t AS BIGINT), true, 1 FROM sized WHERE rank = 1
  UNION ALL
  SELECT s.query_id, s.rank, CASE WHEN f.used + s.t <= {KB_BUDGET} THEN f.used + s.t ELSE f.used END, f.used + s.t <= {KB_BUDGET}, f.n + 1 FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.rank = f.rank + 1)"""
SQL["adjacent_merge"] = f"WITH {_SPANS} SELECT query_id, kb_path, chunk_index, id, md5(text) AS text_md5, token_estimate, source_kind, rank FROM placed"
SQL["budget_cap"] = f"WITH RECURSIVE {_SPANS}{_KEPT} SELECT query_id, rank, id, kept FROM placed JOIN fold USING (query_id, rank)"
SQL["retrieval_context"] = f"""
WITH RECURSIVE {_SPANS}{_KEPT},
b AS (SELECT query_id, kb_path, chunk_index, '[source: ' || kb_path || ' § ' || CASE WHEN len(coalesce(headings, [])) > 0 THEN array_to_string(headings, ' > ') ELSE '(no heading)' END || ']' || CASE WHEN coalesce(image_path, '') <> '' THEN ' [image: ' || image_path || ']' ELSE '' END || chr(10) || coalesce(text, '') AS block FROM placed JOIN fold USING (query_id, rank) WHERE kept),
c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY kb_path, chunk_index) AS body, list(kb_path ORDER BY kb_path, chunk_index) AS paths FROM b GROUP BY query_id)
SELECT query_id, md5('CONTEXT' || chr(10) || chr(10) || body) AS context_md5, array_to_string(list_filter(paths, lambda x, i: list_position(paths, x) = i), '|') AS cited FROM c"""
SQL["degraded_legs"] = f"WITH {_HITS}, p AS (SELECT query_id, count(vector_rank) AS v, count(fts_rank) AS t FROM hits GROUP BY query_id) SELECT query_id, CASE WHEN v > 0 THEN 'none' WHEN t = 0 THEN 'all' ELSE 'vector' END AS degraded FROM p"

_LATEST = "SELECT * FROM manifest_entry WHERE {0} QUALIFY row_number() OVER (PARTITION BY kb_path ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1"
SQL["manifest_diff"] = f"""
WITH first AS (SELECT kb_path, content_hash FROM manifest_entry WHERE kb_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kb_path ORDER BY indexed_at NULLS FIRST, content_hash NULLS FIRST) = 1),
old AS ({_LATEST.format("kb_path IS NOT NULL AND NOT regexp_matches(kb_path, '[.]pdf$')")})
SELECT kb_path, coalesce(f.content_hash, o.content_hash) AS content_hash, CASE WHEN f.content_hash IS NULL AND o.content_hash IS NOT NULL THEN 'removed' WHEN o.content_hash IS NULL THEN 'new' WHEN o.content_hash = f.content_hash THEN 'unchanged' ELSE 'changed' END AS state
FROM first f FULL JOIN old o USING (kb_path)"""
SQL["manifest_upsert"] = f"WITH l AS ({_LATEST.format('true')}) SELECT kb_path, CASE WHEN regexp_matches(kb_path, '[.]md$') THEN upper(content_hash) ELSE content_hash END AS content_hash, CASE WHEN regexp_matches(kb_path, '[.]md$') THEN 0 ELSE chunk_count END AS chunk_count FROM l"
SQL["model_stamps"] = "SELECT 'm' || (label % 2) AS embed_model, count(*) AS rows, array_to_string(list_sort(list_distinct(list(len(embedding)))), ',') AS lengths FROM embeddings GROUP BY 1"

_FILES = "files AS (SELECT parts[1:len(parts) - 1] AS segments, list_last(parts) AS name FROM (SELECT DISTINCT list_filter(string_split(kb_path, '/'), lambda s: s <> '') AS parts FROM manifest_entry WHERE kb_path IS NOT NULL))"
_KINDS = f"""{_FILES},
own AS (SELECT segments, count(*) AS files FROM files WHERE NOT list_contains(segments, 'assets') GROUP BY segments),
anc AS (SELECT segments, unnest(generate_series(0, len(segments) - 1)) AS k FROM own),
below AS (SELECT segments[1:k] AS segments, count(DISTINCT segments[k + 1]) AS subfolders FROM anc GROUP BY segments[1:k]),
folders AS (SELECT segments, coalesce(files, 0) AS files, coalesce(subfolders, 0) AS subfolders FROM own FULL JOIN below USING (segments))"""
SQL["folder_kinds"] = f"WITH {_KINDS} SELECT array_to_string(segments, '/') AS path, files, subfolders, CASE WHEN files > 0 AND subfolders > 0 THEN 'mixed' WHEN files > 0 THEN 'leaf' WHEN subfolders > 0 THEN 'node' ELSE 'empty' END AS kind FROM folders"
SQL["subtree_rollup"] = f"WITH {_KINDS}, up AS (SELECT segments, unnest(generate_series(0, len(segments))) AS k FROM folders) SELECT array_to_string(segments[1:k], '/') AS path, count(*) FILTER (len(segments) > k) AS descendants, CAST(max(len(segments) - k) AS INT) AS subtree_depth FROM up GROUP BY segments[1:k]"
SQL["folder_documents"] = r"""
WITH f AS (SELECT string_split(id, '.')[1] AS path, CASE WHEN regexp_matches(id, '[05]$') THEN 'index.md' ELSE array_to_string(string_split(id, '.')[2:], '-') || '.md' END AS name,
  '# ' || title || chr(10) || chr(10) || body || chr(10) || chr(10) || array_to_string(list_transform(assets, lambda a: '![](' || regexp_replace(a, '^assets/', 'assets/') || ')'), chr(10)) AS text, CASE WHEN length(title) % 3 = 0 THEN length(title) END AS p FROM packet),
g AS (SELECT path, name, arg_min(text, {'n': length(text), 't': text}) AS text, coalesce(min(p), 2147483647) AS p FROM f GROUP BY path, name),
d AS (SELECT path, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY name <> 'index.md', p, name) AS content, string_agg(name, '|' ORDER BY name <> 'index.md', p, name) AS source_files FROM g GROUP BY path)
SELECT path, md5(content) AS content_md5, source_files, CAST(greatest(1, length(content) // 4) AS INT) AS tokens FROM d"""
SQL["catalog_branches"] = "SELECT string_split(id, '.')[1] AS branch, count(*) AS entries FROM packet WHERE id <> '' GROUP BY 1 ORDER BY entries DESC, branch LIMIT 5"
SQL["catalog_round_trip"] = r"SELECT id, replace(id, '.', '/') AS path, CAST(len(string_split(id, '.')) AS INT) AS depth, trim(regexp_replace(title || ' | x', '\s+', ' ', 'g')) AS title, trim(regexp_replace(body, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS long FROM packet"
SQL["id_resolution"] = """
WITH asked AS (SELECT id || '.extra.part' AS id FROM packet UNION ALL SELECT 'no.' || id FROM packet UNION ALL SELECT id FROM packet),
tries AS (SELECT id, unnest(list_transform(generate_series(1, len(string_split(id, '.'))), lambda k: array_to_string(string_split(id, '.')[1:k], '.'))) AS known_id FROM asked),
best AS (SELECT id, known_id FROM tries WHERE known_id IN (SELECT id FROM packet) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(known_id) DESC) = 1)
SELECT a.id, b.known_id, CASE WHEN b.known_id IS NULL THEN a.id ELSE ltrim(substr(a.id, length(b.known_id) + 1), '.') END AS rest FROM asked a LEFT JOIN best b USING (id)"""

SQL["eviction_plan"] = f"""
WITH e AS (SELECT user_id AS call_id, 'p' || (event_id % 23) AS p, event_id AS r, ts >= TIMESTAMP '{REQUESTED_FROM}' AS later FROM events),
a AS (SELECT call_id, p, min(r) AS r FROM e WHERE NOT later GROUP BY call_id, p), q AS (SELECT call_id, p, min(r) AS r FROM e WHERE later GROUP BY call_id, p),
line AS (SELECT call_id, p, r, false AS fresh FROM a UNION ALL SELECT q.call_id, q.p, q.r, true FROM q LEFT JOIN a USING (call_id, p) WHERE a.p IS NULL),
cat AS (SELECT 'p' || i AS p, i * 7 % 19 + 1 AS tokens FROM range(22) t(i)),
s AS (SELECT line.*, cat.tokens IS NULL AND fresh AS unknown, sum(coalesce(tokens, 0)) OVER (PARTITION BY call_id ORDER BY fresh, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM line LEFT JOIN cat USING (p)),
o AS (SELECT call_id, list(p ORDER BY fresh, r) FILTER (NOT fresh) AS active, list(p ORDER BY r) FILTER (unknown) AS unknown, list(p ORDER BY r) FILTER (fresh) AS new, max(behind) FILTER (fresh) AS need,
  list(p ORDER BY fresh, r) FILTER (behind <= {EVICTION_BUDGET}) AS fit, list(p ORDER BY fresh, r) FILTER (behind > {EVICTION_BUDGET}) AS gone FROM s GROUP BY call_id),
x AS (SELECT *, CASE WHEN len(coalesce(unknown, [])) > 0 THEN 'unknown_packet_id' WHEN need > {EVICTION_BUDGET} THEN 'budget_exceeded' END AS error_reason FROM o)
SELECT call_id, coalesce(array_to_string(CASE WHEN error_reason IS NULL THEN fit ELSE active END, ','), '') AS after, CASE WHEN error_reason IS NULL THEN coalesce(array_to_string(gone, ','), '') ELSE '' END AS evicted,
  CASE WHEN error_reason IS NULL THEN coalesce(array_to_string(new, ','), '') ELSE '' END AS to_load, CASE error_reason WHEN 'unknown_packet_id' THEN unknown[1] WHEN 'budget_exceeded' THEN new[1] END AS error_id, error_reason
FROM x"""

_FLAT = "list_filter(coalesce({0}, []), lambda x, i: list_position({0}, x) = i)"
SQL["merged_calls"] = f"""
WITH c AS (SELECT coalesce(persona_id, '') AS message_id, item_id AS call_no, trim(coalesce(kind, '')) AS context, coalesce(source_packet_ids, []) AS requested, list_reverse(coalesce(source_packet_ids, [])) AS active FROM generated_item),
g AS (SELECT message_id, list(context ORDER BY call_no) FILTER (context <> '') AS context, flatten(list(requested ORDER BY call_no)) AS requested, flatten(list(active ORDER BY call_no)) AS active, count(*) AS calls FROM c GROUP BY message_id)
SELECT message_id, coalesce(array_to_string({_FLAT.format("context")}, '; '), '') AS context, array_to_string({_FLAT.format("requested")}, ',') AS requested, array_to_string({_FLAT.format("active")}, ',') AS active, calls FROM g"""
_F = _FIG.format("coalesce({0}, '')")
SQL["grounding_checks"] = f"""
WITH e AS (SELECT pos AS conv_id, {_F.format("actual_answer")} AS a, list_concat(list_concat({_F.format("question")}, CASE WHEN pos % 7 <> 0 THEN {_F.format("expected_answer")} ELSE [] END), ['2026', '01', '31']) AS known, pos % 7 <> 0 AS loaded FROM eval_row),
m AS (SELECT conv_id, loaded, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(known, x)))) AS missing FROM e)
SELECT conv_id, array_to_string(missing, ',') AS unsupported, CASE WHEN NOT loaded THEN 'nothing_loaded' WHEN len(missing) > 0 THEN 'unsupported_figures' END AS withheld FROM m"""

_EDGES = f"""inside AS (SELECT lag(url) OVER (PARTITION BY id ORDER BY pos) AS src, pos AS link_pos, url AS href FROM (SELECT id, generate_subscripts(source_urls, 1) - 1 AS pos, unnest(source_urls) AS url FROM packet)),
cited AS (SELECT item_id, generate_subscripts(source_packet_ids, 1) - 1 AS pos, unnest(source_packet_ids) AS id FROM generated_item),
urls AS (SELECT item_id, pos, generate_subscripts(source_urls, 1) - 1 AS k, unnest(source_urls) AS url FROM cited JOIN packet USING (id)),
across AS (SELECT a.url AS src, 100 * b.pos + b.k AS link_pos, b.url AS href FROM urls a JOIN urls b ON a.item_id = b.item_id AND b.pos = a.pos + 1),
edges AS (SELECT * FROM inside WHERE src IS NOT NULL UNION ALL SELECT * FROM across WHERE src IS NOT NULL)"""


def _norm(u: str) -> str:
    return _NORMAL.replace("(url,", f"({u},")


SQL["crawl_bfs"] = f"""
WITH RECURSIVE {_EDGES}, e AS (SELECT src, href, min(link_pos) AS p FROM (SELECT {_norm("src")} AS src, {_norm("href")} AS href, link_pos FROM edges) GROUP BY src, href),
seeds AS (SELECT url, min(p) AS p FROM (SELECT {_norm("u")} AS url, length(id) AS p FROM (SELECT id, unnest(source_urls) AS u FROM packet WHERE regexp_matches(id, '^faq'))) GROUP BY url),
w(url, hop, parent, pos, way) AS (
  SELECT url, 0, CAST(NULL AS VARCHAR), 0::BIGINT, [p::BIGINT] FROM seeds
  UNION ALL
  SELECT href, hop, src, p, way FROM (SELECT e.href, w.hop + 1 AS hop, e.src, e.p::BIGINT AS p, list_append(w.way, e.p::BIGINT) AS way, row_number() OVER (PARTITION BY e.href ORDER BY list_append(w.way, e.p::BIGINT), e.src) AS n FROM w JOIN e ON e.src = w.url WHERE w.hop < 3) WHERE n = 1)
SELECT url, CAST(hop AS INT) AS hop, parent, pos FROM w QUALIFY row_number() OVER (PARTITION BY url ORDER BY hop, way, parent) = 1"""
SQL["crawl_dispositions"] = f"""
WITH {_EDGES}, l AS (SELECT DISTINCT src AS referrer, length(src) % 4 AS depth, link_pos, href FROM edges), v AS (SELECT DISTINCT {_norm("u")} AS url FROM (SELECT unnest(source_urls) AS u FROM packet) WHERE length({_norm("u")}) % 3 = 0),
n AS (SELECT l.*, {_norm("href")} AS url, lower(regexp_extract({_norm("href")}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host, lower(regexp_extract(referrer, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^/?#]*)', 1)) AS from_host FROM l),
c AS (SELECT n.*, v.url IS NOT NULL AS seen, regexp_matches(lower({_url(4, "n.url")}), '[.]pdf$') AS asset FROM n LEFT JOIN v ON v.url = n.url),
d AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'unparseable' WHEN asset AND host <> from_host THEN 'asset_host' WHEN asset AND seen THEN 'visited' WHEN asset THEN 'asset' WHEN depth >= 3 THEN 'depth' WHEN NOT ({" OR ".join(f"starts_with(url, '{s}')" for s in SCOPE)}) THEN 'scope' WHEN seen THEN 'visited' ELSE 'follow' END AS disposition FROM c),
f AS (SELECT url, CASE WHEN disposition IN ('follow', 'asset') AND row_number() OVER (PARTITION BY url, disposition ORDER BY depth, referrer, link_pos) > 1 THEN 'visited' ELSE disposition END AS disposition FROM d)
SELECT disposition, count(f.disposition) AS links, coalesce(array_to_string(list_sort(list_distinct(list(f.url) FILTER (f.url IS NOT NULL)))[1:5], ' '), '') AS sample FROM (VALUES ('unparseable'), ('asset_host'), ('asset'), ('depth'), ('scope'), ('visited'), ('follow'), ('error')) r(disposition) LEFT JOIN f USING (disposition) GROUP BY disposition"""

SQL["host_pacing"] = """
WITH RECURSIVE r AS (SELECT 'h' || user_id AS host, event_id AS pos, epoch_us(ts) AS arrive, CAST(round(value * 100000) AS BIGINT) + CASE WHEN event_type = 'error' THEN 30000000 ELSE 5000000 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(host, pos, n, start_us, wait_us, next_allowed) AS (
  SELECT host, pos, n, arrive, 0::BIGINT, arrive + c FROM r WHERE n = 1
  UNION ALL
  SELECT r.host, r.pos, r.n, greatest(arrive, next_allowed), greatest(arrive, next_allowed) - arrive, greatest(arrive, next_allowed) + c FROM f JOIN r ON r.host = f.host AND r.n = f.n + 1)
SELECT host, pos, start_us, wait_us, next_allowed FROM f"""
SQL["markdown_link_slugs"] = r"""
WITH u AS (SELECT hit_id, list_transform(regexp_extract_all(text, '(?:^|[^!])\[[^\]]*\]\((https?://[^)\s]+)', 1), lambda x: regexp_replace(regexp_extract(regexp_replace(x, '[?#].*$', ''), '^https?://[^/]+/(?:.*/)?([^/]+)/*$', 1), '[.][^.]*$', '')) AS s FROM retrieved_chunk WHERE text IS NOT NULL),
d AS (SELECT hit_id, list_filter(list_filter(s, lambda x: x <> ''), lambda x, i: list_position(list_filter(s, lambda y: y <> ''), x) = i) AS s FROM u)
SELECT hit_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS slug FROM d"""

SQL["layout_collisions"] = f"""
WITH {_FILES}, f AS (SELECT * FROM files UNION ALL SELECT list_append(segments, regexp_replace(name, '[.][^.]*$', '')), 'index.md' FROM files WHERE length(name) % 2 = 0),
d AS (SELECT DISTINCT segments[1:k] AS segments FROM (SELECT segments, unnest(generate_series(1, len(segments))) AS k FROM f)), p AS (SELECT DISTINCT list_append(segments, regexp_replace(name, '[.]md$', '')) AS segments FROM f WHERE ends_with(name, '.md'))
SELECT array_to_string(segments, '/') AS path FROM d WHERE segments IN (SELECT segments FROM p)"""

SQL["kind_quota"] = """
WITH q(i, kind, n) AS (VALUES (0, 'simple', 2001), (1, 'medium', 2001), (2, 'complex', 2001), (3, 'hard-1', 2000), (4, 'hard-2', 2000)),
c AS (SELECT count(*) AS p, count(*) FILTER (len(assets) > 0) AS pics, count(*) FILTER (len(paragraphs) >= 3) AS three, count(*) FILTER (len(paragraphs) >= 1) AS one FROM packet),
a AS (SELECT kind, n, CAST(CASE WHEN kind = 'hard-2' THEN least(n, pics) WHEN kind = 'hard-1' AND p < 2 THEN 0 WHEN kind = 'complex' AND three = 0 THEN 0 WHEN one = 0 THEN 0 ELSE n END AS INT) AS allowed FROM q, c)
SELECT kind, n, allowed, CASE WHEN allowed >= n THEN NULL WHEN kind = 'hard-2' THEN 'too few packets with images' WHEN kind = 'hard-1' THEN 'fewer than two packets' WHEN kind = 'complex' THEN 'no packet with three paragraphs' ELSE 'no packet with a paragraph' END AS reason FROM a"""
SQL["packet_sample"] = """
WITH q(kind, n) AS (VALUES ('simple', 101), ('medium', 101), ('complex', 101), ('hard-1', 100), ('hard-2', 100)),
pool AS (SELECT kind, n, id, row_number() OVER (PARTITION BY kind ORDER BY sha256('7|' || kind || '|' || id), id) AS place FROM packet, q WHERE CASE kind WHEN 'hard-2' THEN len(assets) > 0 WHEN 'complex' THEN len(paragraphs) >= 3 ELSE len(paragraphs) >= 1 END),
top AS (SELECT *, max(place) OVER (PARTITION BY kind) AS size FROM pool WHERE place <= n), slots AS (SELECT kind, CAST(unnest(generate_series(1, n)) AS INT) AS item FROM q)
SELECT s.kind, item, id FROM slots s JOIN top t ON t.kind = s.kind AND t.place = (item - 1) % size + 1"""
SQL["packet_pairs"] = f"""
WITH h AS (SELECT id, {_PARENT} AS parent, sha256('0|' || id) AS h FROM packet), r AS (SELECT id, h, coalesce(lead(id) OVER (PARTITION BY parent ORDER BY h, id), first_value(id) OVER (PARTITION BY parent ORDER BY h, id)) AS other FROM h),
s AS (SELECT arg_min(id, h) AS x, arg_max(id, h) AS y FROM h)
SELECT id, CASE WHEN other <> id THEN other WHEN x <> id THEN x ELSE nullif(y, id) END AS other FROM r, s"""
SQL["paragraph_pick"] = """
WITH h AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY sha256('7|' || id || '|' || i), i) AS r FROM (SELECT id, unnest(generate_series(0, len(paragraphs) - 1)) AS i FROM packet)),
c AS (SELECT id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS chosen FROM h WHERE r <= 2 GROUP BY id)
SELECT id, coalesce(chosen, '') AS chosen, CAST(CASE WHEN least(2, len(paragraphs)) + least(3 - least(2, len(paragraphs)), 1) < 3 THEN least(3 - least(3 - least(2, len(paragraphs)), 1), len(paragraphs)) ELSE least(2, len(paragraphs)) END AS INT) AS take_a FROM packet LEFT JOIN c USING (id)"""
SQL["persona_round_robin"] = """
WITH i AS (SELECT item_id, (row_number() OVER (PARTITION BY kind ORDER BY item_id) - 1) % (SELECT count(*) FROM persona) AS seat FROM generated_item), p AS (SELECT persona_id, row_number() OVER (ORDER BY pos) - 1 AS seat FROM persona)
SELECT item_id, persona_id FROM i LEFT JOIN p USING (seat)"""
SQL["persona_topics"] = """
WITH m AS (SELECT persona_id, id, len(list_filter(coalesce(topics, []), lambda t: id = t OR starts_with(id, t || '.'))) > 0 AS hit FROM persona, packet), s AS (SELECT *, bool_or(hit) OVER (PARTITION BY persona_id) AS any_hit FROM m)
SELECT persona_id, id FROM s WHERE hit OR NOT any_hit"""
SQL["question_dedup"] = r"""
WITH k AS (SELECT item_id FROM generated_item WHERE question IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(question, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) ORDER BY item_id) = 1), n AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) AS i FROM k)
SELECT item_id, 'g-' || CASE WHEN length(i) >= 4 THEN i ELSE lpad(i, 4, '0') END AS question_id FROM n"""
_TELL = " OR ".join("regexp_matches(question, '" + p.replace("'", "''") + "')" for p in EXAM_TELLS.values())
_NUM = "list_filter(list_transform(regexp_extract_all({0}, '(\\d[\\d,.]*)', 1), lambda x: regexp_replace(x, '[.,]+$', '')), lambda x: x <> '')"
SQL["draft_checks"] = f"""
WITH b AS (SELECT item_id, string_agg(body, chr(10) ORDER BY pos) AS body FROM (SELECT item_id, generate_subscripts(source_packet_ids, 1) AS pos, unnest(source_packet_ids) AS id FROM generated_item) JOIN packet USING (id) GROUP BY item_id),
d AS (SELECT item_id, kind, persona_id, coalesce(source_packet_ids, []) AS needed, question, expected_answer, lower(regexp_replace(coalesce(body, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS b, lower(regexp_replace(coalesce(expected_answer, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS a FROM generated_item g LEFT JOIN b USING (item_id)),
w AS (SELECT *, {_WORDS.format("a")} AS words, list_filter({_NUM.format("a")}, lambda x: NOT list_contains({_NUM.format("b")}, x)) AS invented FROM d)
SELECT item_id, CASE WHEN kind = 'hard-1' AND trim(coalesce(persona_id, '')) = '' THEN 'persona_mismatch' WHEN trim(coalesce(question, '')) = '' OR trim(coalesce(expected_answer, '')) = '' THEN 'incomplete' WHEN {_TELL} THEN 'exam_framing'
  WHEN len(invented) > 0 OR (len(words) >= 6 AND len(list_filter(words, lambda x: contains(b, x)))::DOUBLE / len(words) < 0.6) THEN 'not_grounded' WHEN len(list_filter(needed, lambda x: length(x) % 7 = 0)) > 0 THEN 'citation' END AS reason FROM w"""

_STATS = "count(*) AS rows, count(score) AS scored, count(*) FILTER (score IS NULL) AS unscored, coalesce(round_even(avg(score), 3), 0.0) AS mean, coalesce(round_even(count(*) FILTER (score >= 2)::DOUBLE / nullif(count(score), 0), 3), 0.0) AS pass_rate, " + ", ".join(f"count(*) FILTER (score = {i}) AS h{i}" for i in range(4))
_PERSON = "coalesce(nullif(trim(persona), ''), '(unattributed)')"
_KIND_ROWS = "k(kind_pos, kind) AS (VALUES (0, 'simple'), (1, 'medium'), (2, 'complex'), (3, 'hard-1'), (4, 'hard-2'))"
SQL["eval_report"] = f"""
WITH e AS (SELECT kind, {_PERSON} AS persona, score FROM eval_row)
SELECT kind, persona, CASE grouping(kind, persona) WHEN 3 THEN 'total' WHEN 1 THEN 'kind' WHEN 2 THEN 'persona' ELSE 'cell' END AS level, {_STATS} FROM e GROUP BY GROUPING SETS ((kind, persona), (kind), (persona), ())"""
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("rows", "scored", "unscored", "mean", "pass_rate", "h0", "h1", "h2", "h3"))
SQL["eval_by_kind"] = f"WITH {_KIND_ROWS}, s AS (SELECT kind, {_STATS} FROM eval_row GROUP BY kind) SELECT kind_pos, kind, {_ZERO} FROM k LEFT JOIN s USING (kind)"
SQL["persona_kind_grid"] = f"SELECT {_PERSON} AS persona, " + ", ".join(f"round_even(avg(score) FILTER (kind = '{k}'), 3) AS \"{k}\"" for k in ("simple", "medium", "complex", "hard-1", "hard-2")) + " FROM eval_row GROUP BY 1"
SQL["eval_filter"] = "SELECT pos, question_id FROM eval_row WHERE kind IN ('simple', 'hard-1') AND NOT (score IS NOT NULL AND coalesce(actual_answer, '') <> '')"
_BASE = "b AS (SELECT pos, question_id, kind, CASE WHEN pos % 5 > 0 THEN CAST(pos * 7 % 4 AS INT) END AS score FROM eval_row)"
SQL["baseline_deltas"] = f"WITH {_BASE}, l AS (SELECT question_id, arg_max_null(score, pos) AS base_score FROM b GROUP BY question_id) SELECT pos, question_id, score, base_score, score - base_score AS delta FROM eval_row LEFT JOIN l USING (question_id)"
SQL["baseline_by_kind"] = f"""
WITH {_BASE}, {_KIND_ROWS}, x AS (SELECT kind, {_STATS} FROM eval_row GROUP BY kind), y AS (SELECT kind, {_STATS} FROM b GROUP BY kind)
SELECT kind_pos, kind, coalesce(x.mean, 0) AS mean, coalesce(y.mean, 0) AS base_mean, CASE WHEN x.scored > 0 AND y.scored > 0 THEN round_even(x.mean - y.mean, 3) END AS mean_delta, CASE WHEN x.scored > 0 AND y.scored > 0 THEN CAST(round_even((x.pass_rate - y.pass_rate) * 100, 0) AS INT) END AS pass_delta
FROM k LEFT JOIN x USING (kind) LEFT JOIN y USING (kind)"""
SQL["eval_merge"] = """
WITH r AS (SELECT question_id, max(pos) AS p FROM eval_row WHERE pos % 3 = 1 GROUP BY question_id)
SELECT pos, question_id, CASE WHEN pos % 3 > 0 THEN CASE WHEN p IS NULL THEN '[no_result]' ELSE 'answer ' || p END ELSE actual_answer END AS actual_answer,
  CASE WHEN pos % 3 > 0 THEN CASE WHEN p % 6 <= 3 THEN CAST(p % 6 AS INT) END ELSE score END AS score, CASE WHEN pos % 3 > 0 THEN 'executed' ELSE 'inherited' END AS origin
FROM eval_row LEFT JOIN r USING (question_id)"""
SQL["transcripts"] = """
WITH t AS (SELECT pos, coalesce(question, '') AS q, coalesce(remark, '') AS r, coalesce(persona, '') AS c, coalesce(actual_answer, '') AS a, actual_answer FROM eval_row),
s AS (SELECT *, 'USER: ' || q || chr(10) || chr(10) || 'BOT: ' || r || chr(10) || chr(10) || 'USER (clarifier): ' || c || chr(10) || chr(10) || 'BOT: ' || a AS whole, CASE WHEN regexp_matches(r, '[^\\s\\p{Z}]') AND regexp_matches(a, '[^\\s\\p{Z}]') THEN '[part 1 of 2]' || chr(10) || r || chr(10) || chr(10) || '[part 2 of 2]' || chr(10) || a WHEN regexp_matches(r, '[^\\s\\p{Z}]') THEN r WHEN regexp_matches(a, '[^\\s\\p{Z}]') THEN a END AS parts FROM t)
SELECT pos AS conv_id, md5(whole) AS transcript_md5, CAST(2 AS BIGINT) AS replies, md5(CASE WHEN pos % 4 <> 0 THEN coalesce(parts, actual_answer) ELSE actual_answer END) AS judged_md5 FROM s"""

SQL["event_windows"] = "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
SQL["event_sessions"] = """
WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
SQL["turn_reassembly"] = """
WITH t AS (SELECT event_id // 9 AS turn_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'final' WHEN 'click' THEN 'tool' ELSE 'delta' END AS kind, 't' || event_id AS text FROM events)
SELECT turn_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind = 'delta'), '') AS streamed, max(text) FILTER (kind = 'final') AS final, NOT bool_or(kind = 'final') AS failed, count(*) FILTER (kind = 'tool') AS tool_calls, count(*) FILTER (kind = 'error') AS errors, count(*) AS events FROM t GROUP BY turn_id"""
SQL["progress_totals"] = "SELECT count(*) AS done, coalesce(round(avg(score), 6), 0.0) AS mean, count(*) FILTER (score IS NULL) AS unscored, CAST(sum(pos * 10) AS BIGINT) AS elapsed_ms FROM eval_row WHERE turns IS NOT NULL"


def _level(n: int, rows: str, out: str) -> str:
    """One level of the collapse: rows of folders of n parts that may go, into their parents."""
    return f"""
o{n} AS (SELECT s FROM {rows} WHERE len(s) = {n} GROUP BY s HAVING bool_and(f = 'index.md' OR regexp_matches(f, '(?i)^index-.*[.](?:png|jpe?g|gif|webp|svg|bmp|tiff?)$')) AND bool_or(f = 'index.md')),
l{n} AS (SELECT s FROM o{n} WHERE s NOT IN (SELECT s[1:{n}] FROM {rows} WHERE len(s) > {n}) AND s NOT IN (SELECT list_append(s, regexp_replace(f, '[.]md$', '')) FROM {rows} WHERE len(s) = {n - 1} AND ends_with(f, '.md'))),
{out} AS (SELECT path, name, CASE WHEN l.s IS NULL THEN r.s ELSE r.s[1:{n - 1}] END AS s, CASE WHEN l.s IS NULL THEN f WHEN f = 'index.md' THEN list_last(r.s) || '.md' ELSE list_last(r.s) || substr(f, 6) END AS f FROM {rows} r LEFT JOIN l{n} l ON l.s = r.s)"""


_DEEPEST = 8  # of the test tables, with room
_LEVELS = ",".join(_level(n, f"r{n}", f"r{n - 1}") for n in range(_DEEPEST, 1, -1))
SQL["leaf_collapse"] = f"""
WITH {_FILES}, k AS (SELECT segments, name, regexp_replace(name, '[.][^.]*$', '') AS stem, length(name) % 3 AS m, length(name) % 2 AS e FROM files),
u AS (SELECT segments AS s, stem || '.md' AS f FROM k WHERE m = 0 UNION SELECT list_append(segments, stem), 'index.md' FROM k WHERE m <> 0 UNION SELECT list_append(segments, stem), 'index-' || stem || '.png' FROM k WHERE m = 1
  UNION SELECT list_concat(segments, [stem, 'deep']), 'index.md' FROM k WHERE m = 2 AND e = 0 UNION SELECT list_append(segments, stem), 'other.md' FROM k WHERE m = 2 AND e = 1),
r{_DEEPEST} AS (SELECT array_to_string(s, '/') AS path, f AS name, s, f FROM u),{_LEVELS}
SELECT path, name, array_to_string(s, '/') || '/' || f AS new_path FROM r1"""


SQL["session_memory"] = f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS call_no, 'p' || (event_id % 23) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(session, call_no, n, loaded, evicted, active, redundant, error_ids, error_reason) AS (
  SELECT DISTINCT session, 0::BIGINT, 0::BIGINT, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, '', CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT session, call_no, n, CASE WHEN held OR p = 'p22' THEN [] ELSE [p] END, CASE WHEN held OR p = 'p22' THEN [] ELSE line[1:k - 1] END, CASE WHEN held OR p = 'p22' THEN active ELSE line[k:] END, held, CASE WHEN p = 'p22' AND NOT held THEN p ELSE '' END,
    CASE WHEN p = 'p22' AND NOT held THEN 'unknown_packet_id' END
  FROM (SELECT e.session, e.call_no, e.n, e.p, w.active, list_contains(w.active, e.p) AS held, list_append(w.active, e.p) AS line,
      list_min(list_filter(generate_series(1, len(w.active) + 1), lambda k: list_sum(list_transform(list_append(w.active, e.p)[k:], lambda x: CAST(substr(x, 2) AS INT) * 7 % 19 + 1)) <= {EVICTION_BUDGET})) AS k
    FROM w JOIN e ON e.session = w.session AND e.n = w.n + 1))
SELECT session, call_no, array_to_string(loaded, ',') AS loaded, array_to_string(evicted, ',') AS evicted, array_to_string(active, ',') AS active_after, redundant, error_ids, error_reason FROM w WHERE n > 0"""

_WS = r"[ \t\n\x0B\f\r]"
_IMAGES = "replace(" + r"regexp_replace(regexp_replace(regexp_replace({0}, '(!\[[^\]]*\]\()(https?://|assets/)', '\1' || chr(1) || '\2', 'g'), '(!\[[^\]]*\]\()(?:[^)\s\x01]*/)?([^)\s/\x01]+)(\))', '\1assets/\2\3', 'g'), chr(1), '', 'g')" + ", chr(1), '')"
_ROW, _DELIMITER = r"^[ \t\x0B\f\r]*\|.*\|[ \t\x0B\f\r]*$", r"^[ \t\x0B\f\r]*\|(?:[ \t\x0B\f\r]*:?-+:?[ \t\x0B\f\r]*\|)+[ \t\x0B\f\r]*$"
SQL["markdown_tidied"] = f"""
WITH t AS (SELECT hit_id, string_split({_IMAGES.format("text")}, chr(10)) AS l FROM retrieved_chunk WHERE text IS NOT NULL),
r AS (SELECT hit_id, l, list_transform(l, lambda x: regexp_matches(x, '{_ROW}')) AS row, list_transform(l, lambda x: regexp_matches(x, '{_DELIMITER}')) AS rule FROM t),
f AS (SELECT hit_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN row[i] AND (i = 1 OR NOT row[i - 1]) AND coalesce(row[i + 1], false) AND NOT coalesce(rule[i + 1], false)
  THEN x || chr(10) || '|' || array_to_string(list_transform(string_split(regexp_replace(trim(x), '^[|]+|[|]+$', '', 'g'), '|'), lambda c: '---'), '|') || '|' ELSE x END), chr(10)) AS md FROM r)
SELECT hit_id, regexp_replace(regexp_replace(md, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') || chr(10) AS tidied FROM f"""

_KINDS_OF = "CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'markdown' END"
_EMPTY = r"^[\s\p{Z}\x0B\x85\x1c-\x1f]*$"
#: Segments of documents, then chunks of segments: one walk over the lines, one over the segments.
_CHUNKS = f"""
t AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_KINDS_OF} AS kind, {_KINDS_OF} <> 'text' AS md, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
l AS (SELECT doc, md, t, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc, md, t, string_split(t, chr(10)) AS x FROM t)),
o AS (SELECT doc, md, n, line, length(t) AS size, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY n) - length(line) - 1 AS a, regexp_extract(line, '^(`{{3,}}|~{{3,}})', 1) AS run, regexp_matches(line, '{_EMPTY}') AS blank,
  md AND regexp_matches(line, '^#{{1,6}}(?:[ \t]+.*?)?[ \t]*#*[ \t]*$') AS head, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, regexp_extract(line, '^#{{1,6}}(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$', 1) AS title FROM l),
w(doc, n, kind, open, seg) AS (
  SELECT doc, 0::BIGINT, '', '', 0 FROM t
  UNION ALL
  SELECT o.doc, o.n, CASE WHEN w.open <> '' THEN 'code' WHEN o.blank THEN 'blank' WHEN o.head THEN 'heading' WHEN o.md AND o.run <> '' THEN 'code' ELSE 'paragraph' END,
    CASE WHEN w.open <> '' THEN CASE WHEN o.run <> '' AND starts_with(o.line, w.open) THEN '' ELSE w.open END WHEN o.blank OR o.head OR NOT o.md THEN '' ELSE o.run END,
    CASE WHEN w.open <> '' THEN w.seg WHEN o.blank OR o.head OR (o.md AND o.run <> '') THEN w.seg + 1 WHEN w.kind = 'paragraph' THEN w.seg ELSE w.seg + 1 END
  FROM w JOIN o ON o.doc = w.doc AND o.n = w.n + 1),
s AS (SELECT w.doc, w.seg AS n, any_value(w.kind) AS kind, min(o.a) AS a, max(least(o.a + length(o.line) + 1, o.size)) AS z, any_value(o.level) AS level, any_value(CASE WHEN w.kind = 'heading' THEN o.title END) AS title FROM w JOIN o ON o.doc = w.doc AND o.n = w.n WHERE w.n > 0 GROUP BY w.doc, w.seg),
g AS (SELECT *, greatest(1, (z - a) // 4) AS size FROM s),
k(doc, n, path, held, a, z, tokens, hpath, out) AS (
  SELECT doc, 0, CAST([] AS STRUCT(l INT, t VARCHAR)[]), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0::BIGINT, CAST([] AS VARCHAR[]), CAST([] AS STRUCT(a BIGINT, z BIGINT, h VARCHAR[])[]) FROM t
  UNION ALL
  SELECT doc, n, path, NOT alone, CASE WHEN alone THEN NULL WHEN flush OR NOT held THEN solid_a ELSE coalesce(a, solid_a) END, CASE WHEN alone THEN NULL WHEN flush OR NOT held THEN solid_z ELSE coalesce(solid_z, z) END,
    CASE WHEN alone THEN 0 WHEN flush OR NOT held THEN size ELSE tokens + size END, CASE WHEN alone OR flush OR NOT held THEN now ELSE hpath END,
    list_concat(list_concat(out, CASE WHEN flush AND a IS NOT NULL THEN [{{'a': a, 'z': z, 'h': hpath}}] ELSE [] END), CASE WHEN alone THEN [{{'a': ga, 'z': gz, 'h': now}}] ELSE [] END)
  FROM (SELECT *, list_transform(path, lambda x: x.t) AS now FROM (SELECT k.doc, g.n, k.held, k.a, k.z, k.tokens, k.hpath, k.out, g.size, g.a AS ga, g.z AS gz, CASE WHEN g.kind <> 'blank' THEN g.a END AS solid_a, CASE WHEN g.kind <> 'blank' THEN g.z END AS solid_z,
      g.kind IN ('code', 'paragraph') AND g.size >= @TARGET AS alone, (g.kind IN ('code', 'paragraph') AND g.size >= @TARGET) OR (k.held AND k.tokens + g.size > @TARGET) AS flush,
      CASE WHEN g.kind = 'heading' AND NOT regexp_matches(g.title, '{_EMPTY}') THEN list_append(list_filter(k.path, lambda x: x.l < g.level), {{'l': CAST(g.level AS INT), 't': g.title}}) ELSE k.path END AS path
    FROM k JOIN g ON g.doc = k.doc AND g.n = k.n + 1))),
last AS (SELECT doc, list_concat(out, CASE WHEN a IS NOT NULL THEN [{{'a': a, 'z': z, 'h': hpath}}] ELSE [] END) AS out FROM k QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1),
c AS (SELECT doc, generate_subscripts(out, 1) AS n, unnest(out) AS c FROM last),
body AS (SELECT c.doc, c.n, c.c.a AS a, c.c.z AS z, c.c.h AS h, rtrim(substr(t.t, c.c.a + 1, c.c.z - c.c.a), chr(10)) AS body FROM c JOIN t USING (doc))"""
# what a chunk repeats of the one before: the first word start within 83 of its last 120 characters, else the last one
_PIECE = "right(v.whole, 120)"
_STARTS = f"list_filter(generate_series(1, length({_PIECE}) - 1), lambda i: substr({_PIECE}, i, 1) = ' ')"
_NEAR = f"list_filter({_STARTS}, lambda i: length({_PIECE}) - i <= 83)"
_LEAD = f"CASE WHEN len({_NEAR}) > 0 THEN substr({_PIECE}, CAST(list_min({_NEAR}) AS INT) + 1) WHEN len({_STARTS}) > 0 THEN substr({_PIECE}, CAST(list_max({_STARTS}) AS INT) + 1) ELSE {_PIECE} END"
SQL["chunk_documents"] = f"""
WITH RECURSIVE {_CHUNKS.replace("@TARGET", "200")},
v(doc, n, a, z, h, whole) AS (
  SELECT doc, n, a, z, h, trim(body, chr(10)) FROM body WHERE n = 1
  UNION ALL
  SELECT b.doc, b.n, b.a, b.z, b.h, trim(CASE WHEN {_LEAD} <> '' THEN {_LEAD} || chr(10) || chr(10) || b.body ELSE b.body END, chr(10)) FROM v JOIN body b ON b.doc = v.doc AND b.n = v.n + 1)
SELECT doc AS kb_path, t.kind AS source_kind, CAST(n - 1 AS INT) AS chunk_index, md5(whole) AS text_md5, CAST(a AS INT) AS char_start, CAST(z AS INT) AS char_end, array_to_string(h, ' > ') AS headings, CAST(greatest(1, length(whole) // 4) AS INT) AS token_estimate FROM v JOIN t USING (doc)"""


SQL["chunk_table_function"] = f"""
WITH RECURSIVE {_CHUNKS.replace("@TARGET", "500")}
SELECT doc AS kb_path, CAST(n - 1 AS INT) AS chunk_index, md5(trim(body, chr(10))) AS text_md5, CAST(a AS INT) AS char_start, CAST(z AS INT) AS char_end FROM body"""
SQL["chunk_estimator"] = f"""
WITH RECURSIVE {_CHUNKS.replace("@TARGET", "300").replace("(z - a) // 4", "(z - a) // 2")}
SELECT doc AS kb_path, CAST(n - 1 AS INT) AS chunk_index, md5(trim(body, chr(10))) AS text_md5, CAST(greatest(1, length(trim(body, chr(10))) // 2) AS INT) AS token_estimate FROM body"""
SQL["stored_text_index"] = SQL["bm25_topk"]
SQL |= {"stream_sessions": SQL["session_memory"], "stream_pacing": SQL["host_pacing"], "stream_windows": SQL["event_windows"]}
SQL |= queries_pages.SQL | queries_memory.SQL | queries_runs.SQL
