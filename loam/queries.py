"""Every query of the core, by name. Each takes (spark, folder of tables) and gives a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import markdown as M
from loam.functions import text as T
from loam.functions import url as U
from loam.operators import crawl, evalrun, evalset, index, memory, retrieval, tree
from loam.operators.chunking import chunked
from loam.operators.packed import unpack
from loam.session import small
from loam.sources.tables import table
from loam.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "retrieval_context"
ALIASES = {"EP": "Employment Pass", "levy bill": "foreign worker levy", "API": "programming interface", "virus scanner": "malware scan"}
SCOPE = ["https://help.yoris.test/", "https://zetard.example/handbook/", "https://vaskis.test/"]
KB_BUDGET, EVICTION_BUDGET, REQUESTED_FROM = 1200, 60, "2024-01-30"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every packed field that holds two or more."""

    def of(name: str, key: str, field: str) -> DataFrame:
        values = unpack(table(spark, folder, name), key, field, least=2)
        return values.select(F.lit(name).alias("tab"), "row_key", "val_pos", "val")

    return of("eval_row", "pos", "source").unionByName(of("generated_item", "item_id", "source_urls"))


# --- scalar functions


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packet").select("id", F.posexplode("source_urls").alias("pos", "url"))


@query
def url_functions(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, folder).select(
        "id", "pos", U.normalize_url(F.concat(F.lit(" "), F.upper(F.regexp_extract(u, "^(https?://)", 1)), F.regexp_replace(u, "^https?://", ""), F.lit("#x "))).alias("normal"), U.host_of(u).alias("host"),
        U.slug_of(u).alias("slug"), U.output_path(u).alias("path"), U.strip_host(u).alias("rest"), U.is_asset_url(u).alias("asset"), U.in_scope(u, SCOPE).alias("scoped"),
    )


@query
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, folder, "documents").where(t.isNotNull())
    return rows.select(
        "doc_id", T.rough_tokens(t).alias("tokens"), T.file_hash(t).alias("hash"), T.chunk_id(F.col("source"), F.lit(0), T.file_hash(t)).alias("chunk_id"), T.truncated(t, 80).alias("cut"),
        T.truncated_middle(t, 200).alias("cut_middle"), T.trimmed(t, 50).alias("trimmed"), F.array_join(T.figures(t), " ").alias("figures"), F.size(T.content_words(t)).alias("words"), T.duration(F.col("doc_id")).alias("duration"),
    )


@query
def id_functions(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("id")
    return table(spark, folder, "packet").select(
        "id", T.parent_id(i).alias("parent"), T.short_name(i).alias("short"), T.question_id("q", F.length(i) * 997).alias("question_id"), T.in_subtree(i, F.lit("faq")).alias("faq"),
        F.array_join(T.id_list(F.concat(F.lit('["'), i, F.lit('", "'), T.parent_id(i), F.lit('","'), i, F.lit('"], '))), "|").alias("ids"),
    )


@query
def kind_functions(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("kb_path")
    return table(spark, folder, "manifest_entry").select(p, T.source_kind(p).alias("kind"), T.mime_of(p).alias("mime"), tree.segments_of(p)[0].alias("host")).distinct()


@query
def heading_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieved_chunk").where(F.col("text").isNotNull())
    return rows.select("hit_id", T.heading_prefix(F.col("text"), F.col("headings")).alias("prefixed"))


@query
def markdown_features(spark: SparkSession, folder: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    rows = table(spark, folder, "retrieved_chunk").where(F.col("text").isNotNull()).select("hit_id", M.feature_counts(text).alias("c"), F.size(M.paragraphs(text)).alias("paragraphs"))
    return rows.select("hit_id", *[F.col("c")[k].alias(k) for k in ("headings", "tables", "code_blocks", "links", "images")], "paragraphs")


@query
def markdown_link_slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieved_chunk").where(F.col("text").isNotNull())
    return rows.select("hit_id", F.posexplode(M.link_slugs(F.col("text"))).alias("pos", "slug"))


@query
def markdown_tidied(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieved_chunk").where(F.col("text").isNotNull())
    return rows.select("hit_id", M.tidied(M.rewritten_images(F.col("text"))).alias("tidied"))


@query
def query_expand(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_row").where(F.col("question").isNotNull()).select("pos", T.expanded(F.col("question"), ALIASES).alias("expanded"))


@query
def event_props(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", T.salvaged_json(F.concat(F.lit("Sure: "), "props"), "k int").alias("j"))
    return rows.groupBy("event_type").agg(F.count("j.k").alias("n"), F.sum("j.k").alias("total"), F.count(T.valid_score(F.col("j.k"))).alias("scores"))


# --- retrieval


@query
def vector_topk_l2(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    return _vector(spark, folder, "l2")


@query
def vector_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder, "cosine")


def _vector(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    queries = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.vector_top_k_blocks(v, queries, 8, "vec_id", "embedding", metric)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), "rank")


@query
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: the question of every row whose pos is divisible by 50, against all documents."""
    asked = table(spark, folder, "eval_row").where(F.col("pos") % 50 == 0).select(F.col("pos").alias("query_id"), F.col("question").alias("query"))
    found = retrieval.bm25_top_k(table(spark, folder, "documents"), asked, 10, "doc_id")
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of each query once: what is delivered again counts at its first."""
    rows = table(spark, folder, "retrieved_chunk").where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("hit_id"))).where("__n = 1").drop("__n")


def _fusion(spark: SparkSession, folder: str, how: str) -> DataFrame:
    hits = _hits(spark, folder)
    leg = lambda c: hits.where(F.col(c).isNotNull()).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(c, "hit_id")).alias("rank"))
    return retrieval.fused(leg("vector_rank"), leg("fts_rank"), how, 8)


@query
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _fusion(spark, folder, "rrf")


@query
def hybrid_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _fusion(spark, folder, "linear")


@query
def hybrid_none(spark: SparkSession, folder: str) -> DataFrame:
    return _fusion(spark, folder, "none").drop("fused_score")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(spark, folder).where(F.col("kb_path").isNotNull() & F.col("chunk_index").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("fused_score"), "hit_id"))
    return hits.withColumn("rank", rank)


@query
def adjacent_merge(spark: SparkSession, folder: str) -> DataFrame:
    spans = retrieval.merged_adjacent(_ranked(spark, folder))
    return spans.select("query_id", "kb_path", "chunk_index", "id", F.md5(F.col("text")).alias("text_md5"), "token_estimate", "source_kind", "rank")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.budget_cap(retrieval.merged_adjacent(_ranked(spark, folder)), KB_BUDGET)


@query
def budget_cap(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("query_id", "rank", "id", "kept")


@query
def retrieval_context(spark: SparkSession, folder: str) -> DataFrame:
    """Hits to context: merge, budget, source order, format."""
    out = retrieval.context(_spans(spark, folder).where("kept"))
    return out.select("query_id", F.md5(F.col("context")).alias("context_md5"), F.array_join("cited", "|").alias("cited"))


@query
def degraded_legs(spark: SparkSession, folder: str) -> DataFrame:
    per = _hits(spark, folder).groupBy("query_id").agg(F.count("vector_rank").alias("v"), F.count("fts_rank").alias("t"))
    return per.select("query_id", F.coalesce(retrieval.degraded(F.col("v") > 0, F.col("v"), F.col("t")), F.lit("none")).alias("degraded"))


# --- index


@query
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each path as the candidate, against the whole manifest."""
    rows = table(spark, folder, "manifest_entry").where(F.col("kb_path").isNotNull())
    first = rows.groupBy("kb_path").agg(F.min_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"))
    return index.manifest_diff(first, rows.where(~F.col("kb_path").rlike(r"\.pdf$")), prune=True)


@query
def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = index.latest(table(spark, folder, "manifest_entry")).select("kb_path", "content_hash", "chunk_count")
    fresh = rows.where(F.col("kb_path").rlike(r"\.md$")).select("kb_path", F.upper("content_hash").alias("content_hash"), F.lit(0).alias("chunk_count"))
    return index.upserted(rows, fresh, fresh.select("kb_path", F.lit("changed").alias("state")))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "text").when(F.col("doc_id") % 4 == 1, "html").when(F.col("doc_id") % 4 == 2, "pdf").otherwise("markdown")
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("kb_path"), kind.alias("source_kind"), "text")


@query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every kind of source: pages, converted files and plain texts."""
    out = chunked(_documents(spark, folder), target=200, overlap=20)
    return out.select("kb_path", "source_kind", "chunk_index", F.md5("text").alias("text_md5"), "char_start", "char_end", F.array_join("headings", " > ").alias("headings"), "token_estimate")


@query
def model_stamps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.concat(F.lit('{"embed_model":"m'), (F.col("label") % 2).cast("string"), F.lit('"}')).alias("metadata"), F.col("embedding").alias("vector"))
    return index.model_stamps(rows).select("embed_model", "rows", F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").alias("lengths"))


# --- trees


def _files(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "manifest_entry").where(F.col("kb_path").isNotNull()).select("kb_path").distinct()
    parts = tree.segments_of(F.col("kb_path"))
    return paths.select(F.slice(parts, 1, F.size(parts) - 1).alias("segments"), F.element_at(parts, -1).alias("name"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("segments", F.array_join("segments", "/")).withColumnRenamed("segments", "path")


@query
def folder_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(tree.folder_kinds(_files(spark, folder)))


@query
def subtree_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(tree.subtree_rollup(tree.folder_kinds(_files(spark, folder)).select("segments")))


@query
def folder_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Packets as files of the folder their id names, with the pictures they cite."""
    parts = F.split("id", r"\.")
    pictures = F.array_join(F.transform("assets", lambda a: F.concat(F.lit("![]("), F.regexp_replace(a, "^assets/", "img/"), F.lit(")"))), "\n")
    files = table(spark, folder, "packet").select(
        F.slice(parts, 1, 1).alias("segments"), F.when(F.element_at(parts, -1).rlike("[05]$"), "index.md").otherwise(F.concat(F.array_join(F.slice(parts, 2, 9), "-"), F.lit(".md"))).alias("name"),
        F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n\n"), pictures).alias("text"), F.when(F.length("title") % 3 == 0, F.length("title")).cast("int").alias("link_position"),
    )
    files = files.groupBy("segments", "name").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text"), F.min("link_position").alias("link_position"))
    docs = tree.folder_documents(files)
    return _shown(docs).select("path", F.md5(F.col("content")).alias("content_md5"), F.array_join("source_files", "|").alias("source_files"), "tokens")


@query
def catalog_branches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "packet").select("id")
    return tree.largest_branches(rows, 5)


@query
def catalog_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "packet").select("id", F.replace("id", F.lit("."), F.lit("/")).alias("path"), F.size(F.split("id", r"\.")).alias("depth"), F.concat("title", F.lit(" | x")).alias("title"), F.regexp_replace("body", r"\s+", " ").alias("long"), F.split("id", r"\.").alias("segments"))
    parsed = tree.parsed_catalog(tree.rendered_catalog(rows), "catalog")
    return parsed.select("id", "path", "depth", "title", F.trim("long").alias("long"))


@query
def id_resolution(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "packet").select("id")
    asked = known.select(F.concat("id", F.lit(".extra.part")).alias("id")).unionByName(known.select(F.concat(F.lit("no."), "id").alias("id"))).unionByName(known)
    return tree.longest_known_prefix(asked, known)


# --- memory


def _calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "events")
    # each user's events of the first 29 days ask for what is active, the later ones for what is requested; the first mention counts
    later = F.col("ts").cast("timestamp") >= F.to_timestamp(F.lit(REQUESTED_FROM))
    first = e.groupBy("user_id", later.alias("later"), F.concat(F.lit("p"), (F.col("event_id") % 23).cast("string")).alias("p")).agg(F.min("event_id").alias("r"))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("r", "p")))), lambda x: x["p"])  # noqa: E731 - at most 23
    calls = first.groupBy(F.col("user_id").alias("call_id")).agg(ordered(~F.col("later")).alias("active"), ordered(F.col("later")).alias("requested"))
    catalog = spark.range(22).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), ((F.col("id") * 7) % 19 + 1).cast("int").alias("tokens"))
    return calls, catalog


@query
def eviction_plan(spark: SparkSession, folder: str) -> DataFrame:
    calls, catalog = _calls(spark, folder)
    out = memory.eviction_plan(calls, catalog, EVICTION_BUDGET)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("call_id", text("after"), text("evicted"), text("to_load"), "error_id", "error_reason")


@query
def session_memory(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    calls = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("call_no"), F.array().cast("array<string>").alias("claimed"), F.array(F.concat(F.lit("p"), (F.col("event_id") % 23).cast("string"))).alias("requested"))
    out = memory.session_fold(calls, {f"p{i}": i * 7 % 19 + 1 for i in range(22)}, EVICTION_BUDGET)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("session", "call_no", text("loaded"), text("evicted"), text("active_after"), "redundant", text("error_ids"), "error_reason")


@query
def merged_calls(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "generated_item")
    calls = g.select(F.coalesce("persona_id", F.lit("")).alias("message_id"), F.col("item_id").alias("call_no"), F.coalesce("kind", F.lit("")).alias("context"), "source_packet_ids", F.reverse("source_packet_ids").alias("active"))
    out = memory.merged_calls(calls.withColumnRenamed("source_packet_ids", "requested"))
    return out.select("message_id", "context", F.array_join("requested", ",").alias("requested"), F.array_join("active", ",").alias("active"), "calls")


@query
def grounding_checks(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "eval_row")
    part = lambda n, role, c: e.select(F.col("pos").alias("conv_id"), F.lit(n).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text"))
    turns = part(1, "user", "question").unionByName(part(2, "tool", "expected_answer").where("conv_id % 7 <> 0")).unionByName(part(3, "assistant", "actual_answer"))
    out = memory.grounding_checks(turns, F.lit("2026-01-31"))
    return out.select("conv_id", F.array_join("unsupported", ",").alias("unsupported"), "withheld")


# --- crawl


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links: each URL of a packet to its next, and each URL of each packet an item cites to each URL of the next one."""
    packets = table(spark, folder, "packet")
    after = Window.partitionBy("id").orderBy("pos")
    inside = packets.select("id", F.posexplode("source_urls").alias("pos", "href")).select(F.lag("href").over(after).alias("src"), F.col("pos").alias("link_pos"), "href")
    cited = table(spark, folder, "generated_item").select("item_id", F.posexplode("source_packet_ids").alias("pos", "id"))
    urls = cited.join(packets.select("id", F.posexplode("source_urls").alias("k", "href")), "id")
    following = urls.select("item_id", (F.col("pos") - 1).alias("pos"), (100 * F.col("pos") + F.col("k")).alias("link_pos"), "href")
    across = urls.select("item_id", "pos", F.col("href").alias("src")).join(following, ["item_id", "pos"]).select("src", "link_pos", "href")
    return inside.unionByName(across).where(F.col("src").isNotNull())


@query
def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    seeds = table(spark, folder, "packet").where(F.col("id").rlike("^faq")).select(F.explode("source_urls").alias("url"), F.length("id").alias("pos"))
    return crawl.bfs(edges, seeds, 3)


def _dispositions(spark: SparkSession, folder: str) -> DataFrame:
    links = _edges(spark, folder).select(F.col("src").alias("referrer"), (F.length("src") % 4).alias("depth"), "link_pos", "href")
    visited = table(spark, folder, "packet").select(F.explode("source_urls").alias("url")).select(U.normalize_url(F.col("url")).alias("url")).where(F.length("url") % 3 == 0).distinct()
    return crawl.dispositions(links.dropDuplicates(["referrer", "link_pos", "href"]), visited, SCOPE, 3)


@query
def crawl_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.disposition_counts(_dispositions(spark, folder), ["unparseable", "asset_host", "asset", "depth", "scope", "visited", "follow", "error"], 5).select("disposition", "links", F.array_join("sample", " ").alias("sample"))


def _in_us(paced: DataFrame) -> DataFrame:
    return paced.select("host", "pos", *[F.round(F.col(c) * 1e6).cast("long").alias(c.replace("_s", "_us")) for c in ("start_s", "wait_s", "next_allowed")])


@query
def host_pacing(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    requests = e.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.col("event_id").alias("pos"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrive_s"), (F.col("value") / 10).alias("took_s"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.lit(30.0).alias("retry_s"))
    return _in_us(crawl.paced(requests))


@query
def leaf_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three files as the index page of a folder of their own, some with a picture or another page beside it."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    own = F.concat("segments", F.array(stem))
    at = lambda s, n: F.struct(s.alias("segments"), n.alias("name"))
    many = F.when(F.length("name") % 3 == 0, F.array(at(F.col("segments"), F.concat(stem, F.lit(".md"))))).when(
        F.length("name") % 3 == 1, F.array(at(own, F.lit("index.md")), at(own, F.concat(F.lit("index-"), stem, F.lit(".png"))))
    ).when(F.length("name") % 2 == 0, F.array(at(own, F.lit("index.md")), at(F.concat(own, F.array(F.lit("deep"))), F.lit("index.md")))).otherwise(F.array(at(own, F.lit("index.md")), at(own, F.lit("other.md"))))
    files = _files(spark, folder).select(F.inline(many)).distinct()
    out = crawl.collapsed(files)
    return out.select(F.array_join("segments", "/").alias("path"), "name", F.concat_ws("/", F.array_join("new_segments", "/"), "new_name").alias("new_path"))


@query
def layout_collisions(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    deep = files.where(F.length("name") % 2 == 0).select(F.concat("segments", F.array(F.regexp_replace("name", r"\.[^.]*$", ""))).alias("segments"), F.lit("index.md").alias("name"))
    return _shown(crawl.layout_collisions(files.unionByName(deep)))


# --- question sets


@query
def kind_quota(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.feasibility(table(spark, folder, "packet"), evalset.quota(spark, 10_003))


@query
def packet_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.sampled_packets(table(spark, folder, "packet"), evalset.quota(spark, 503), seed=7)


@query
def packet_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return evalset.paired(table(spark, folder, "packet"))


@query
def paragraph_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "packet")
    return rows.select("id", F.array_join(F.transform(evalset.chosen_paragraphs(F.col("paragraphs"), 2, F.col("id"), 7), lambda x: x.cast("string")), ",").alias("chosen"), evalset.pair_quota(F.size("paragraphs"), F.lit(1))["a"].alias("take_a"))


@query
def persona_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "generated_item").select("item_id", "kind")
    return evalset.round_robin(items, table(spark, folder, "persona"), "item_id").select("item_id", "persona_id")


@query
def persona_topics(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "persona").select("persona_id", "topics")
    pool = table(spark, folder, "packet").select("id").join(small(people, evalset.ROSTER, "personas"), F.lit(True)).withColumn("kind", F.lit("simple"))
    return evalset.biased(pool, F.col("topics")).select("persona_id", "id")


@query
def question_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = evalset.deduplicated(table(spark, folder, "generated_item").where(F.col("question").isNotNull()), pos="item_id")
    return evalset.numbered(kept.withColumn("pos", F.col("item_id")), "g", per_block=1000).select("item_id", "question_id")


@query
def draft_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts against all packets they draw on; ids of a length that 7 divides are not cited, hard questions of nobody do not fit anybody."""
    items = table(spark, folder, "generated_item").select("item_id", "kind", "persona_id", "question", "expected_answer", F.coalesce("source_packet_ids", F.array().cast("array<string>")).alias("needed"))
    bodies = items.select("item_id", F.posexplode("needed").alias("pos", "id")).join(table(spark, folder, "packet").select("id", "body"), "id")
    joined = bodies.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("body"))
    mismatch = F.when((F.col("kind") == "hard-1") & (F.coalesce(F.trim("persona_id"), F.lit("")) == ""), "nobody asks").otherwise("")
    rows = items.join(joined, "item_id", "left").withColumn("persona_mismatch", mismatch).withColumn("cited", F.filter("needed", lambda i: F.length(i) % 7 != 0))
    return evalset.drafts_checked(rows).select("item_id", "reason")


# --- evaluation


@query
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.report(table(spark, folder, "eval_row"))


@query
def eval_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.by_kind(table(spark, folder, "eval_row"))


@query
def persona_kind_grid(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.persona_kind_grid(table(spark, folder, "eval_row"))


@query
def eval_filter(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.filtered(table(spark, folder, "eval_row"), ["simple", "hard-1"], None, skip_completed=True).select("pos", "question_id")


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_row").withColumn("score", F.when(F.col("pos") % 5 > 0, F.pmod(F.col("pos") * 7, F.lit(4)).cast("int")))


@query
def baseline_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.baseline_deltas(table(spark, folder, "eval_row"), _baseline(spark, folder))


@query
def baseline_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return evalrun.baseline_by_kind(table(spark, folder, "eval_row"), _baseline(spark, folder))


@query
def eval_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eval_row").withColumn("run", F.col("pos") % 3 > 0)
    results = rows.where(F.col("pos") % 3 == 1).groupBy("question_id").agg(F.max("pos").alias("p")).select("question_id", F.concat(F.lit("answer "), F.col("p").cast("string")).alias("actual_answer"), F.pmod("p", F.lit(6)).cast("int").alias("score"), F.lit("r").alias("remark"), F.lit(1).alias("turns"), F.lit("t").alias("transcript"))
    return evalrun.merged(rows, results).select("pos", "question_id", "actual_answer", "score", "origin")


@query
def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "eval_row")
    part = lambda n, role, source, c: e.select(F.col("pos").alias("conv_id"), F.lit(n).alias("turn"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.coalesce(c, F.lit("")).alias("text"))
    turns = part(1, "user", "user", "question").unionByName(part(2, "bot", "bot", "remark")).unionByName(part(3, "user", "clarifier", "persona")).unionByName(part(4, "bot", "bot_final", "actual_answer"))
    out = evalrun.transcripts(turns)
    ended = e.select(F.col("pos").alias("conv_id"), F.when(F.col("pos") % 4 == 0, "max_turns").otherwise("answer").alias("terminated_by"), "actual_answer")
    return out.join(evalrun.judged_text(turns, ended), "conv_id").select("conv_id", F.md5(F.col("transcript")).alias("transcript_md5"), "replies", F.md5(F.col("judged")).alias("judged_md5"))


# --- streams, as batches


@query
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return stream.windowed(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = stream.sessions(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


def _turn_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kinds = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "assistant.final").when(F.col("event_type") == "click", "tool.call").otherwise("assistant.delta")
    return e.select((F.col("event_id") / 9).cast("long").alias("turn_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"))


@query
def turn_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return stream.turns(_turn_events(spark, folder))


@query
def progress_totals(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "eval_row").where(F.col("turns").isNotNull())
    return stream.progress(e.select("question_id", "score", (F.col("pos") * 10).alias("elapsed_ms")))


# queries by area; each adds itself to QUERIES and its twin to the SQL of its module
from loam import queries_memory, queries_pages, queries_runs  # noqa: E402, F401
