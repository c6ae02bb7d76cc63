"""Queries of trees, session memory and the index, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import calls, index, memory, retrieval, tree
from loam.queries import EVICTION_BUDGET, _calls, _files, _hits, _shown, _spans, query
from loam.queries_pages import _shared, _uri
from loam.session import staged
from loam.sources.tables import table

SQL: dict[str, str] = {}


# --- trees


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Packets as catalog rows: ids under dotted folder names, so that ids do not say where they stand."""
    return table(spark, folder, "packet").select(
        "id", F.concat(F.lit("kb.v1/"), F.replace("id", F.lit("."), F.lit("/"))).alias("path"), (F.size(F.split("id", r"\.")) + 1).alias("depth"), "title", F.col("body").alias("long"), T.rough_tokens(F.col("body")).alias("tokens"),
    )


@query
def id_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Ids resolved by their own row, an ancestor's folder, a descendant's folder or as they are; some folders are not what they seem."""
    rows = _rows(spark, folder)
    known = rows.where(F.length("id") % 5 > 0).select("id", "path")
    inner = F.regexp_extract("id", r"^(.*)\.[^.]*$", 1)
    asked = rows.select("id").unionByName(rows.select(inner.alias("id"))).unionByName(rows.select(F.concat("id", F.lit(".deep.er")).alias("id"))).unionByName(rows.select(F.concat(F.lit("none."), "id").alias("id"))).distinct()
    own = rows.select("path", "id")
    above = rows.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"), inner.alias("id")).distinct()
    below = rows.select(F.concat("path", F.lit("/deep/er")).alias("path"), F.when(F.length("title") % 2 == 0, F.concat("id", F.lit(".deep.er"))).otherwise("wrong").alias("id"))
    return tree.resolved_ids(asked, known, own.unionByName(above).unionByName(below))


SQL["id_candidates"] = r"""
WITH r AS (SELECT id, 'kb.v1/' || replace(id, '.', '/') AS path, regexp_extract(id, '^(.*)\.[^.]*$', 1) AS up, title, length(id) % 5 > 0 AS known FROM packet),
o AS (SELECT id, path FROM r UNION SELECT up, regexp_extract(path, '^(.*)/[^/]*$', 1) FROM r UNION SELECT CASE WHEN length(title) % 2 = 0 THEN id || '.deep.er' ELSE 'wrong' END, path || '/deep/er' FROM r),
a AS (SELECT id FROM r UNION SELECT up FROM r UNION SELECT id || '.deep.er' FROM r UNION SELECT 'none.' || id FROM r),
k AS (SELECT id, path FROM r WHERE known),
c AS (SELECT a.id, 0 AS rank, k.path FROM a JOIN k USING (id)
  UNION ALL SELECT a.id, 1, k.path || '/' || replace(substr(a.id, length(k.id) + 2), '.', '/') FROM a JOIN k ON starts_with(a.id, k.id || '.') QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY length(k.id) DESC) = 1
  UNION ALL SELECT a.id, 2, array_to_string(string_split(k.path, '/')[1:len(string_split(k.path, '/')) - d], '/') FROM a JOIN k ON starts_with(k.id, a.id || '.'), generate_series(1, 9) g(d) WHERE d <= len(string_split(substr(k.id, length(a.id) + 2), '.')) AND d < len(string_split(k.path, '/'))
  UNION ALL SELECT id, 3, replace(id, '.', '/') FROM a),
b AS (SELECT c.id, c.path, c.rank FROM c JOIN o ON o.path = c.path AND o.id = c.id QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY c.rank, c.path) = 1)
SELECT a.id, b.path, b.rank FROM a LEFT JOIN b USING (id)"""


@query
def catalog_children(spark: SparkSession, folder: str) -> DataFrame:
    """Entries right below each first-level branch, and the first level itself."""
    rows = _rows(spark, folder).select("id", (F.col("depth") - 1).alias("depth"))
    branches = rows.select(F.element_at(F.split("id", r"\."), 1).alias("id"), F.lit(1).alias("depth")).distinct()
    every = rows.unionByName(branches)
    below = tree.children(every, rows.select(F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("id")))
    return below.select("parent", "id").unionByName(tree.roots(every).select(F.lit("_root").alias("parent"), "id"))


SQL["catalog_children"] = r"""
WITH e AS (SELECT id, len(string_split(id, '.')) AS depth FROM packet UNION ALL SELECT DISTINCT string_split(id, '.')[1], 1 FROM packet), p AS (SELECT DISTINCT regexp_extract(id, '^(.*)\.[^.]*$', 1) AS id FROM packet)
SELECT p.id AS parent, e.id FROM e JOIN p ON p.id = regexp_extract(e.id, '^(.*)\.[^.]*$', 1) UNION ALL SELECT '_root', id FROM e WHERE depth = 1"""


@query
def catalog_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return tree.catalog_size(_rows(spark, folder))


SQL["catalog_sizes"] = r"""
WITH l AS (SELECT length('| `' || id || '` | `kb.v1/' || replace(id, '.', '/') || '/` | ' || (len(string_split(id, '.')) + 1) || ' | ' || replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '|', '\|') || ' | ' || replace(trim(regexp_replace(body, '\s+', ' ', 'g')), '|', '\|') || ' |') + 1 AS n, greatest(1, length(body) // 4) AS t FROM packet),
s AS (SELECT count(*) AS entries, CAST((sum(n) + length('| id | path | depth | title | long |') + 1 + length('|---|---|---|---|---|') + 1) // 4 AS BIGINT) AS catalog_tokens, CAST(sum(t) AS BIGINT) AS content_tokens FROM l)
SELECT *, catalog_tokens + content_tokens AS total_tokens FROM s"""


@query
def catalog_hydrated(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows with what their folders say; some folders cannot be read. Then all ids in play."""
    rows = _rows(spark, folder)
    folders = rows.where(F.length("title") % 4 > 0).select("path", F.when(F.length("title") % 2 == 0, "leaf").otherwise("mixed").alias("kind"), F.col("tokens").alias("token_size_estimate"), (F.col("tokens") - 1).alias("content_token_estimate"))
    full = tree.hydrated(rows.select("id", "path"), folders)
    waypoints = rows.select(F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("id"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).distinct()
    view = tree.catalog_view(rows.select("id", "path"), waypoints)
    return view.join(full.drop("path"), "id", "left").select("id", "path", "kind", "token_size_estimate", "content_token_estimate")


SQL["catalog_hydrated"] = r"""
WITH r AS (SELECT id, 'kb.v1/' || replace(id, '.', '/') AS path, length(title) AS n, CAST(greatest(1, length(body) // 4) AS INT) AS t FROM packet)
SELECT id, path, CASE WHEN n % 4 > 0 THEN CASE WHEN n % 2 = 0 THEN 'leaf' ELSE 'mixed' END END AS kind, CASE WHEN n % 4 > 0 THEN t END AS token_size_estimate, CASE WHEN n % 4 > 0 THEN t - 1 END AS content_token_estimate FROM r
UNION ALL SELECT DISTINCT regexp_extract(id, '^(.*)\.[^.]*$', 1), regexp_extract(path, '^(.*)/[^/]*$', 1), NULL, NULL, NULL FROM r WHERE regexp_extract(id, '^(.*)\.[^.]*$', 1) NOT IN (SELECT id FROM r)"""


@query
def build_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each folder with content in a run for one branch: built, kept or in the way."""
    folders = tree.folder_kinds(_files(spark, folder)).select("segments", "kind")
    some = _files(spark, folder).select(F.slice("segments", 1, 1).alias("s")).agg(F.min("s")).first()[0]
    scope = tree.partial_scope(folders, list(some))
    n = F.length(F.array_join("segments", "/"))
    earlier = folders.where(n % 3 > 0).select("segments", (n % 3 == 1).alias("generated"))
    return _shown(tree.kept_or_built(scope, earlier)).select("path", "kind", F.coalesce("generated", F.lit(False)).alias("generated"), "action")


SQL["build_plan"] = """
WITH files AS (SELECT parts[1:len(parts) - 1] AS segments FROM (SELECT DISTINCT list_filter(string_split(kb_path, '/'), lambda s: s <> '') AS parts FROM manifest_entry WHERE kb_path IS NOT NULL)),
own AS (SELECT DISTINCT segments FROM files WHERE NOT list_contains(segments, 'assets')), up AS (SELECT DISTINCT segments[1:k] AS segments FROM (SELECT segments, unnest(generate_series(0, len(segments) - 1)) AS k FROM own)),
f AS (SELECT coalesce(own.segments, up.segments) AS s, CASE WHEN own.segments IS NULL THEN 'node' WHEN up.segments IS NULL THEN 'leaf' ELSE 'mixed' END AS kind FROM own FULL JOIN up ON own.segments = up.segments),
m AS (SELECT min(segments[1:1]) AS one FROM files), p AS (SELECT array_to_string(s, '/') AS path, kind, len(s) AS d, length(array_to_string(s, '/')) % 3 AS n FROM f, m WHERE s[1:1] = one OR len(s) = 0)
SELECT path, kind, n = 1 AS generated, CASE WHEN n = 0 THEN 'build' WHEN n = 2 THEN 'foreign' WHEN d = 0 THEN 'build' ELSE 'keep' END AS action FROM p"""


@query
def stub_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Folders with content only, summarised offline, and by a model that fails now and then."""
    docs = table(spark, folder, "packet").select(F.split("id", r"\.").alias("segments"), F.when(F.length("id") % 6 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")).alias("content"))

    def model(text: str) -> str:
        if len(text) % 3 == 0:
            raise TimeoutError("busy")
        return '{"title": " T ", "long_description": "' + str(len(text)) + '"}' if len(text) % 3 == 1 else "none"

    rows = tree.catalog(docs).join(docs.select("segments", calls.summaries(F.col("content"), model).alias("s")), "segments")
    return rows.select("id", "path", "depth", "title", "long", F.col("s.title").alias("model_title"), F.col("s.long").alias("model_long"), F.regexp_extract(F.coalesce("s.error", F.lit("")), "^[A-Za-z_]+", 0).alias("error"))


SQL["stub_summaries"] = r"""
WITH d AS (SELECT id, title, body, length('# ' || title || chr(10) || chr(10) || body) AS n, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#')) AS l FROM packet WHERE length(id) % 6 <> 0)
SELECT id, replace(id, '.', '/') AS path, CAST(len(string_split(id, '.')) AS INT) AS depth, trim(title) AS title, regexp_extract(coalesce(l[1], ''), '^(.*?[.!?])(?:\s|$)', 1) AS long, CASE WHEN n % 3 = 1 THEN 'T' END AS model_title, CASE WHEN n % 3 = 1 THEN CAST(n AS VARCHAR) END AS model_long,
  CASE n % 3 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN '' ELSE 'malformed_summary' END AS error FROM d"""


@query
def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, ids and paths of folders, and lists of ids as models write them."""
    parts = F.split("id", r"\.")
    raw = F.when(F.length("id") % 3 == 0, F.concat(F.lit('["'), "id", F.lit('"]'))).when(F.length("id") % 3 == 1, F.col("id"))
    return table(spark, folder, "packet").select("id", T.folder_title(F.element_at(parts, 2)).alias("title"), T.dotted_id(F.slice(parts, 1, 2)).alias("branch"), T.naive_path(F.col("id")).alias("path"), T.well_formed_ids(raw).alias("sound"), T.loaded_json(F.concat(F.lit(' {"a": '), raw, F.lit("} "))).alias("arguments"))


SQL["folder_names"] = r"""
SELECT id, array_to_string(list_transform(string_split(replace(replace(string_split(id, '.')[2], '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, array_to_string(string_split(id, '.')[1:2], '.') AS branch, replace(id, '.', '/') AS path, length(id) % 3 <> 1 AS sound,
  CASE length(id) % 3 WHEN 0 THEN '{"a": ["' || id || '"]}' ELSE '{}' END AS arguments FROM packet"""


# --- memory


@query
def active_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """What sessions hold against what is claimed: the same, in another order, with other members, or nothing."""
    held, _ = _calls(spark, folder)
    claim = F.when(F.col("call_id") % 4 == 0, F.col("active")).when(F.col("call_id") % 4 == 1, F.reverse("active")).when(F.col("call_id") % 4 == 2, F.col("requested")).otherwise(F.array().cast("array<string>"))
    rows = held.select("call_id", memory.reconciled(F.col("active"), claim).alias("r"))
    return rows.select("call_id", F.array_join("r.effective", ",").alias("effective"), F.col("r.drift").alias("drift"))


_HELD = """e AS (SELECT user_id AS call_id, 'p' || (event_id % 23) AS p, min(event_id) AS r, ts >= TIMESTAMP '2024-01-30' AS later FROM events GROUP BY user_id, event_id % 23, later),
c AS (SELECT call_id, coalesce(list(p ORDER BY r) FILTER (NOT later), []) AS active, coalesce(list(p ORDER BY r) FILTER (later), []) AS requested FROM e GROUP BY call_id)"""
SQL["active_reconcile"] = f"""
WITH {_HELD}, k AS (SELECT *, CASE call_id % 4 WHEN 0 THEN active WHEN 1 THEN list_reverse(active) WHEN 2 THEN requested ELSE [] END AS claim FROM c), f AS (SELECT *, list_concat(active, list_filter(claim, lambda x: NOT list_contains(active, x))) AS line FROM k)
SELECT call_id, array_to_string(line, ',') AS effective, CASE WHEN len(claim) > 0 AND claim <> line THEN CASE WHEN list_sort(claim) = list_sort(line) THEN 'order' ELSE 'membership' END END AS drift FROM f"""


@query
def preload_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that start with what users asked for: unknown ids are passed over, too much at once is refused."""
    starts, catalog = _calls(spark, folder)
    out = memory.preloaded(starts.select(F.col("call_id").alias("session"), F.col("requested").alias("ids")), catalog, 30)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("session", text("requested"), text("skipped_unknown"), text("loaded"), F.col("tokens_used").cast("long").alias("tokens_used"), "budget_exceeded")


SQL["preload_batches"] = f"""
WITH {_HELD}, k AS (SELECT call_id AS session, list_filter(requested, lambda x: x <> 'p22') AS ids, list_filter(requested, lambda x: x = 'p22') AS gone FROM c),
t AS (SELECT *, coalesce(list_sum(list_transform(ids, lambda x: CAST(substr(x, 2) AS INT) * 7 % 19 + 1)), 0) AS n FROM k)
SELECT session, array_to_string(ids, ',') AS requested, array_to_string(gone, ',') AS skipped_unknown, CASE WHEN n <= 30 THEN array_to_string(ids, ',') ELSE '' END AS loaded, CAST(CASE WHEN n <= 30 THEN n ELSE 0 END AS BIGINT) AS tokens_used, n > 30 AS budget_exceeded FROM t"""


@query
def stale_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions over a catalog with rows whose folder is gone: how often calls were redundant, stale or unknown."""
    e = table(spark, folder, "events")
    asked = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("call_no"), F.array().cast("array<string>").alias("claimed"), F.array(F.concat(F.lit("p"), (F.col("event_id") % 23).cast("string"))).alias("requested"))
    sizes = {f"p{i}": i * 7 % 19 + 1 for i in range(22)}
    deltas = staged(memory.session_fold(asked, sizes, 10_000, frozenset(p for p in sizes if p not in ("p3", "p7"))), "deltas")
    reasons = deltas.groupBy("session").agg(F.count_if(F.col("error_reason") == "stale_catalog").alias("stale"), F.count_if(F.col("error_reason") == "unknown_packet_id").alias("unknown"), F.sum(F.size("loaded")).alias("loaded"))
    return memory.redundant_rates(deltas).join(reasons, "session")


SQL["stale_sessions"] = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id % 23 AS p, row_number() OVER (PARTITION BY user_id, event_id % 23 ORDER BY event_id) AS n FROM events)
SELECT session, count(*) AS calls, count(*) FILTER (p <> 22 AND n > 1) AS redundant, round_even(count(*) FILTER (p <> 22 AND n > 1)::DOUBLE / count(*), 3) AS rate, count(*) FILTER (p IN (3, 7) AND n = 1) AS stale, count(*) FILTER (p = 22) AS unknown, count(*) FILTER (p NOT IN (3, 7, 22) AND n = 1) AS loaded FROM e GROUP BY session"""


@query
def packet_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Packets as message blocks, from the storage that holds their artefacts and pictures."""
    p = table(spark, folder, "packet")
    artefacts = p.where(F.length("id") % 5 > 0).select(F.col("id").alias("path"), F.col("body").alias("text"))
    assets = p.select(F.col("id").alias("path"), F.explode("assets").alias("name")).distinct()
    found = memory.stored(p.select(F.col("id").alias("path"), "title"), artefacts, assets)
    docs = found.where("has_compiled").select(F.col("path").alias("id"), "title", F.col("compiled").alias("content"))
    blocks = memory.packets(docs, found.select(F.col("path").alias("id"), F.explode("assets").alias("filename")))
    return blocks.select("id", F.size("blocks").alias("blocks"), F.md5(F.col("blocks")[0]["text"]).alias("text_md5"), F.array_join(F.transform(F.slice("blocks", 2, 1000), lambda b: F.concat(b["kind"], F.lit(" "), b["mime"], F.lit(" "), b["filename"])), "|").alias("images"))


SQL["packet_blocks"] = """
WITH p AS (SELECT id, title, body, list_sort(list_distinct(coalesce(assets, []))) AS a FROM packet WHERE length(id) % 5 > 0)
SELECT id, CAST(1 + len(a) AS INT) AS blocks, md5('# ' || title || ' (' || id || ')' || chr(10) || chr(10) || body) AS text_md5, array_to_string(list_transform(a, lambda x: 'image image/png ' || x), '|') AS images FROM p"""


@query
def tool_results(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls of turns: loads, needless catalog reads, unknown tools; ids in every form a model gives them."""
    e = table(spark, folder, "events")
    name = F.when(F.col("event_type") == "error", "search").when(F.col("event_type") == "signup", "get_catalog").otherwise("check_and_load_kb")
    p = F.concat(F.lit("p"), (F.col("event_id") % 23).cast("string"))
    forms = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), p, F.lit('", "p1"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"['), p, F.lit(', p1]"'))).otherwise(F.concat(F.lit('"'), p, F.lit('"')))
    args = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"context": "c", "requested_packet_ids": '), forms, F.lit("}")))
    out = memory.tool_outcomes(e.select((F.col("event_id") / 5).cast("long").alias("turn_id"), F.col("event_id").alias("call_no"), name.alias("name"), args.alias("arguments")))
    return out.select("turn_id", "call_no", "name", "outcome", F.array_join("requested", ",").alias("requested"), "context", "malformed", "reminder")


SQL["tool_results"] = """
WITH e AS (SELECT event_id // 5 AS turn_id, event_id AS call_no, CASE event_type WHEN 'error' THEN 'search' WHEN 'signup' THEN 'get_catalog' ELSE 'check_and_load_kb' END AS name, event_id % 7 = 0 AS broken, event_id % 3 AS form, 'p' || (event_id % 23) AS p FROM events),
l AS (SELECT *, name = 'check_and_load_kb' AS load, sum((name = 'check_and_load_kb')::INT) OVER (PARTITION BY turn_id ORDER BY call_no) AS nth FROM e)
SELECT turn_id, call_no, name, CASE WHEN load THEN 'load' WHEN name = 'get_catalog' THEN 'catalog' ELSE 'unknown' END AS outcome, CASE WHEN load THEN CASE WHEN broken THEN '' WHEN form = 2 OR p = 'p1' THEN p ELSE p || ',p1' END END AS requested, CASE WHEN broken THEN '' ELSE 'c' END AS context,
  load AND NOT broken AND form > 0 AS malformed, load AND nth > 1 AS reminder FROM l"""


# --- index and messages


@query
def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs over packets as files: all new, some changed and some gone, none changed; then the tables of the last version."""
    store = index.IndexStore(spark, _uri(_shared(spark, "index")))
    p = table(spark, folder, "packet")
    of = lambda rows, text: rows.select(F.concat("id", F.lit(".md")).alias("kb_path"), F.when(F.length("id") % 9 == 0, "image").otherwise("markdown").alias("source_kind"), text.alias("text"), T.file_hash(text).alias("content_hash"), F.length(text).cast("long").alias("bytes"), F.lit(0.0).alias("mtime"))
    first = of(p.where(F.length("id") % 4 > 0), F.col("body"))
    second = of(p.where(F.length("id") % 7 > 0), F.when(F.length("id") % 5 == 0, F.concat("title", F.lit("\n\n"), "body")).otherwise(F.col("body")))
    now = F.lit("2026-01-01").cast("timestamp")
    runs = [index.run_index(store, f, "stub", prune=True, now=now) for f in (first, second, second)]
    counts = spark.createDataFrame([(k, s, n) for k, run in enumerate(runs) for s, n in run.items()], "run int, state string, files long")
    kb = store.read("kb")
    per = kb.groupBy("kb_path").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size("vector")).alias("dim"), F.max("image_path").alias("image"), F.countDistinct("id").alias("ids"), F.max(F.get_json_object("metadata", "$.embed_model")).alias("model"))
    sound = store.read("manifest").join(per, "kb_path", "left").select("kb_path", "content_hash", ((F.coalesce("chunks", F.lit(0)) == F.col("chunk_count")) & (F.col("chunks") == F.col("ids")) & (F.col("dim") == index.DIM) & (F.col("model") == "stub")).alias("sound"), F.col("image").alias("image"))
    return sound.select(F.lit(-1).alias("run"), "kb_path", F.concat_ws(" ", "content_hash", F.col("sound").cast("string"), F.coalesce("image", F.lit("-"))).alias("found")).unionByName(counts.select("run", F.col("state").alias("kb_path"), F.col("files").cast("string").alias("found")))


SQL["index_runs"] = """
WITH p AS (SELECT id, id || '.md' AS kb_path, length(id) % 4 > 0 AS one, length(id) % 7 > 0 AS two, length(id) % 5 = 0 AS edited, length(id) % 9 = 0 AS image, sha256(CASE WHEN length(id) % 5 = 0 THEN title || chr(10) || chr(10) || body ELSE body END) AS h FROM packet)
SELECT -1 AS run, kb_path, h || ' true ' || CASE WHEN image THEN kb_path ELSE '-' END AS found FROM p WHERE two
UNION ALL SELECT 0, s, CAST(CASE s WHEN 'new' THEN (SELECT count(*) FROM p WHERE one) ELSE 0 END AS VARCHAR) FROM (VALUES ('new'), ('changed'), ('unchanged'), ('removed')) v(s)
UNION ALL SELECT 1, s, CAST(CASE s WHEN 'new' THEN (SELECT count(*) FROM p WHERE two AND NOT one) WHEN 'changed' THEN (SELECT count(*) FROM p WHERE one AND two AND edited) WHEN 'unchanged' THEN (SELECT count(*) FROM p WHERE one AND two AND NOT edited) ELSE (SELECT count(*) FROM p WHERE one AND NOT two) END AS VARCHAR) FROM (VALUES ('new'), ('changed'), ('unchanged'), ('removed')) v(s)
UNION ALL SELECT 2, s, CAST(CASE s WHEN 'unchanged' THEN (SELECT count(*) FROM p WHERE two) ELSE 0 END AS VARCHAR) FROM (VALUES ('new'), ('changed'), ('unchanged'), ('removed')) v(s)"""


@query
def stored_text_index(spark: SparkSession, folder: str) -> DataFrame:
    """The text index of all documents on disk, and a search that reads it: the same scores as without it."""
    stored = retrieval.TextIndex(spark, _uri(_shared(spark, "postings")) + "/t").refresh(table(spark, folder, "documents"), "doc_id")
    asked = table(spark, folder, "eval_row").where(F.col("pos") % 50 == 0).select(F.col("pos").alias("query_id"), F.col("question").alias("query"))
    return retrieval.bm25_top_k(stored, asked, 10).select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query
def hit_records(spark: SparkSession, folder: str) -> DataFrame:
    """Hits as records without nulls."""
    out = retrieval.hit_records(table(spark, folder, "retrieved_chunk"))
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("blank"), F.sum("token_estimate").alias("tokens"), F.sum(F.size("headings")).alias("headings"), F.count_if(F.col("source_kind") == "text").alias("texts"))


SQL["hit_records"] = "SELECT query_id, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS blank, CAST(sum(coalesce(token_estimate, 0)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(coalesce(headings, []), lambda h: h IS NOT NULL))) AS BIGINT) AS headings, count(*) FILTER (coalesce(source_kind, 'text') = 'text') AS texts FROM retrieved_chunk WHERE id IS NOT NULL GROUP BY query_id"


@query
def described_images(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures described by a model that is down for some and says nothing of others, and offline."""

    def model(path: str) -> str:
        if len(path) % 3 == 0:
            raise TimeoutError("busy")
        return " a figure " if len(path) % 3 == 1 else " "

    names = table(spark, folder, "packet").select("id", F.explode("assets").alias("a")).select(F.concat("id", F.lit("/"), "a").alias("path")).distinct()
    rows = names.select("path", index.described(F.col("path"), model).alias("d"), index.described(F.col("path")).alias("o"))
    return rows.select("path", F.col("d.text").alias("text"), F.col("d.error").alias("error"), F.col("o.text").alias("offline"))


SQL["described_images"] = r"""
WITH p AS (SELECT DISTINCT id || '/' || unnest(assets) AS path FROM packet)
SELECT path, CASE WHEN length(path) % 3 = 1 THEN 'a figure' END AS text, CASE length(path) % 3 WHEN 0 THEN 'TimeoutError: busy' WHEN 2 THEN 'empty_clarifier_output' END AS error, replace(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', ''), '-', ' ') AS offline FROM p"""


@query
def question_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of each query's turn: system, what was said before, the question under its context."""
    out = retrieval.context(_spans(spark, folder).where("kept"))
    history = F.when(F.length("query_id") % 2 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content"))))
    sent = out.select("query_id", retrieval.messages(F.lit("Be exact."), history, F.col("context"), F.col("query_id")).alias("m"), "context")
    return sent.select("query_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), (F.element_at("m", -1)["content"] == F.concat("context", F.lit("\n\nQUESTION\n"), "query_id")).alias("asked"), F.col("m")[0]["content"].alias("system"))


SQL["question_messages"] = "SELECT DISTINCT query_id, CASE WHEN length(query_id) % 2 = 0 THEN 'system,user,user' ELSE 'system,user' END AS roles, true AS asked, 'Be exact.' AS system FROM retrieved_chunk WHERE query_id IS NOT NULL AND id IS NOT NULL AND kb_path IS NOT NULL AND chunk_index IS NOT NULL"


@query
def over_fetched(spark: SparkSession, folder: str) -> DataFrame:
    """How many hits each leg gives for the hits wanted, per query."""
    per = _hits(spark, folder).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = spark.createDataFrame([(k, retrieval.over_fetch(k)) for k in (1, 3, 8)], "k int, fetched int")
    return per.crossJoin(F.broadcast(sizes)).select("query_id", "k", F.least(F.col("hits"), F.col("fetched").cast("long")).alias("fetched"))  # three rows


SQL["over_fetched"] = """
WITH h AS (SELECT query_id, count(DISTINCT id) AS hits FROM retrieved_chunk WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY query_id)
SELECT query_id, CAST(k AS INT) AS k, least(hits, greatest(2 * k, k + 4)) AS fetched FROM h, (VALUES (1), (3), (8)) v(k)"""
