"""Queries of addresses, pages, files and artefacts, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import html as H
from loam.functions import markdown as M
from loam.functions import text as T
from loam.functions import url as U
from loam.operators import crawl
from loam.operators.chunking import chunked, register_chunker
from loam.queries import _documents, _urls, query
from loam.session import checkpoint_dir, staged
from loam.sources import files as S
from loam.sources import prompts
from loam.sources.tables import table

SQL: dict[str, str] = {}
_URL_ROWS = "u AS (SELECT id, CAST(generate_subscripts(source_urls, 1) - 1 AS INT) AS pos, unnest(source_urls) AS url FROM packet)"


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as workers' file functions name it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/loam-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path.removeprefix("file://")


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path


# --- addresses


@query
def retry_after_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds, dates and words as a server sends them."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    later = F.date_format(ts + F.make_dt_interval(secs=F.floor("value")), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(later, F.lit(" GMT"))).otherwise("soon")
    return table(spark, folder, "events").select("event_id", U.retry_after_seconds(header, ts).alias("seconds"))


SQL["retry_after_headers"] = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN floor(value) END AS seconds FROM events"


@query
def url_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every form against every address, and the endpoint of each address."""
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.lit(h).alias("href")) for k, h in (("rooted", "/a/b.html"), ("relative", "c.html?x=1"), ("above", "../d/./e"), ("query", "?q=2"), ("scheme", "//other.test/f"), ("whole", "https://other.test/g"))])
    rows = _urls(spark, folder).select("id", "pos", "url", F.inline(forms))
    return rows.select("id", "pos", "form", U.absolute_url(F.col("url"), F.col("href")).alias("joined"), U.endpoint_url(F.concat("url", F.lit("/"))).alias("endpoint"))


SQL["url_joins"] = rf"""
WITH {_URL_ROWS}, p AS (SELECT *, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT *, CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS dir FROM p),
a AS (SELECT *, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END AS up, regexp_replace(url || '/', '/+$', '') || '/v1/traces' AS endpoint FROM d)
SELECT id, pos, form, CASE form WHEN 'rooted' THEN root || '/a/b.html' WHEN 'relative' THEN root || dir || 'c.html?x=1' WHEN 'above' THEN root || up || 'd/e' WHEN 'query' THEN root || path || '?q=2' WHEN 'scheme' THEN scheme || '//other.test/f' ELSE 'https://other.test/g' END AS joined, endpoint
FROM a, (VALUES ('rooted'), ('relative'), ('above'), ('query'), ('scheme'), ('whole')) f(form)"""


@query
def common_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The one host of each packet's addresses."""
    return _urls(spark, folder).groupBy("id").agg(U.common_host(F.col("url")).alias("host"), F.count(F.lit(1)).alias("urls"))


SQL["common_hosts"] = f"WITH {_URL_ROWS}, h AS (SELECT id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM u) SELECT id, CASE WHEN min(host) = max(host) THEN min(host) END AS host, count(*) AS urls FROM h GROUP BY id"


# --- pages


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


_LEAD = "This page was put together from the paragraphs of a packet so that its main part is long enough to be told from the menu above it and from the footer below it, whatever the packet itself has to say on its subject, which may be little."


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Packets as web pages: menu, main part with paragraphs, pictures and links, footer; each third in a form that holds the page."""
    cat = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), "")
    main = F.concat(
        F.lit("<main><h1>"), _escaped(F.col("title")), F.lit(f"</h1><p>{_LEAD}</p>"), cat(F.col("paragraphs"), lambda p: F.concat(F.lit("<p>"), _escaped(p), F.lit("</p>"))),
        cat(F.col("assets"), lambda a: F.concat(F.lit('<p><img alt="fig" src="/'), a, F.lit('"></p>'))), F.lit("<ul>"),
        cat(F.col("source_urls"), lambda u: F.concat(F.lit('<li><a href="'), _escaped(u), F.lit('">source</a></li>'))), F.lit("</ul></main>"),
    )
    body = F.when(F.length("id") % 3 == 0, F.concat(F.lit("<form>"), main, F.lit("</form>"))).otherwise(main)
    page = F.concat(F.lit("<html><head><title>"), _escaped(F.col("title")), F.lit('</title><script>x()</script></head><body><nav><a href="/home">Home</a> <a href="#top">Top</a></nav>'), body, F.lit('<footer><a href="mailto:a@b.test">Mail</a></footer></body></html>'))
    return table(spark, folder, "packet").select("id", "title", page.alias("html"))


@query
def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Title, links, pictures and main part of pages."""
    page = H.converted(F.col("html"), F.lit("https://kb.test/x/"), F.lit("index"))
    rows = _pages(spark, folder).select("id", page.alias("p"))
    return rows.select(
        "id", F.col("p.title").alias("title"), F.array_join("p.links", " ").alias("links"), F.array_join(F.transform("p.images", lambda i: F.concat(i["remote"], F.lit(">"), i["local"])), " ").alias("images"), F.col("p.extracted").alias("extracted"),
        F.md5("p.markdown").alias("markdown_md5"), F.size(M.hrefs(F.lit('<a href=" /a ">x</a><a href="tel:1">y</a>'))).alias("kept_hrefs"),
    )


_NAMES = "list_transform(coalesce(assets, []), lambda a, i: {'a': a, 'n': len(list_filter(assets[1:i - 1], lambda x: x = a))})"
SQL["html_pages"] = f"""
WITH p AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(paragraphs, []) AS ps, list_filter(coalesce(assets, []), lambda a, i: list_position(assets, a) = i) AS once, coalesce(assets, []) AS assets, source_urls AS urls FROM packet),
m AS (SELECT *, list_filter(list_concat(list_concat(['# ' || title, '{_LEAD}'], list_transform(ps, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))), list_concat(list_transform(assets, lambda a: '![fig](index-' || string_split(a, '/')[-1] || ')'),
  CASE WHEN len(urls) > 0 THEN [array_to_string(list_transform(urls, lambda u: '- [source](' || u || ')'), chr(10))] ELSE [] END)), lambda x: x <> '') AS blocks FROM p)
SELECT id, title, array_to_string(list_concat(['https://kb.test/home'], urls), ' ') AS links, array_to_string(list_transform(once, lambda a: 'https://kb.test/' || a || '>index-' || string_split(a, '/')[-1]), ' ') AS images, true AS extracted,
  md5(array_to_string(blocks, chr(10) || chr(10))) AS markdown_md5, 1 AS kept_hrefs FROM m"""


@query
def html_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without a main part are kept whole, and so are all where nothing is to be extracted; titles are put on top where missing."""
    short = F.concat(F.lit("<p>"), _escaped(F.left("title", F.lit(40))), F.lit("</p>"))
    page = H.converted(short, F.lit("https://kb.test/"), F.lit("index"))
    rows = table(spark, folder, "packet").select("id", "title", page.alias("p"))
    return rows.select("id", F.col("p.extracted").alias("extracted"), F.col("p.fallback_reason").alias("reason"), M.with_title(F.col("p.markdown"), F.col("title")).alias("markdown"), M.retained_pct(F.col("p.markdown"), F.concat(F.col("p.markdown"), F.lit("0123456789"))).alias("retained"))


SQL["html_fallback"] = r"""
WITH t AS (SELECT id, title, trim(regexp_replace(left(title, 40), '\s+', ' ', 'g')) AS md FROM packet)
SELECT id, false AS extracted, 'too_short' AS reason, '# ' || title || chr(10) || chr(10) || md AS markdown, round_even(100.0::DOUBLE * length(md) / (length(md) + 10), 1) AS retained FROM t"""


@query
def image_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Which attribute names a picture, and what its references and small ones leave behind."""
    packets = table(spark, folder, "packet").select("id", F.posexplode("assets").alias("k", "a"))
    n = F.length("id") % 4
    src = F.when(n == 0, F.col("a")).when(n == 1, "data:image/gif;base64,R0").otherwise("")
    chosen = M.image_source(src, [F.when(n == 1, F.concat(F.lit("lazy/"), "a")), F.when(n == 2, F.concat(F.lit(" "), "a"))], F.when(n == 3, F.concat("a", F.lit(" 2x, other.png 1x"))))
    md = F.concat(F.lit("See ![x]("), "a", F.lit(') and ![y](x'), "a", F.lit(") and ![z]("), "a", F.lit(' "t").'))
    images = F.array(F.struct(F.lit("r1").alias("remote"), F.col("a").alias("local")), F.struct(F.lit("r2").alias("remote"), F.lit("fig").alias("local")))
    return packets.select("id", "k", chosen.alias("source"), M.without_image(md, F.col("a")).alias("without"), F.array_join(F.transform(M.referenced_images(md, images), lambda i: i["remote"]), ",").alias("referenced"))


SQL["image_choices"] = """
WITH a AS (SELECT id, CAST(generate_subscripts(assets, 1) - 1 AS INT) AS k, unnest(assets) AS a FROM packet)
SELECT id, k, CASE length(id) % 4 WHEN 1 THEN 'lazy/' || a ELSE a END AS source, 'See  and ![y](x' || a || ') and .' AS without, 'r1' AS referenced FROM a"""


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packet").select("id", F.posexplode("assets").alias("k", "a")).select(F.col("id").alias("page"), F.element_at(F.split("a", "/"), -1).alias("name"), ((F.length("page") * 977 + F.col("k") * 131) % 5000).alias("size"))


@query
def small_images(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without references to pictures under 2,000 bytes, and how many pictures they keep."""
    refs = F.array_join(F.transform("assets", lambda a: F.concat(F.lit("![f]("), F.element_at(F.split(a, "/"), -1), F.lit(")"))), " ")
    pages = table(spark, folder, "packet").select(F.col("id").alias("page"), F.concat("title", F.lit(" "), refs).alias("markdown"))
    shown, kept = crawl.without_small_images(pages, _images(spark, folder), 2000)
    n = kept.groupBy("page").agg(F.count(F.lit(1)).alias("kept"))
    return shown.join(n, "page", "left").select("page", "markdown", F.coalesce("kept", F.lit(0)).alias("kept"))


SQL["small_images"] = r"""
WITH a AS (SELECT id, title, generate_subscripts(assets, 1) - 1 AS k, string_split(unnest(assets), '/')[-1] AS name FROM packet), s AS (SELECT *, (length(id) * 977 + k * 131) % 5000 AS size FROM a),
g AS (SELECT id, string_agg('![f](' || name || ')', ' ' ORDER BY k) AS refs, list(name) FILTER (size < 2000) AS gone, count(*) FILTER (size >= 2000) AS kept FROM s GROUP BY id)
SELECT p.id AS page, p.title || ' ' || coalesce(CASE WHEN len(gone) > 0 THEN array_to_string(list_transform(string_split(refs, ' '), lambda r: CASE WHEN list_contains(gone, regexp_extract(r, '\((.*)\)', 1)) THEN '' ELSE r END), ' ') ELSE refs END, '') AS markdown, coalesce(kept, 0) AS kept
FROM packet p LEFT JOIN g ON g.id = p.id"""


@query
def fetched_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through a client that fails, refuses, retries and serves by the address alone."""

    def get(url: str) -> tuple[str, int, str, bytes]:
        n = len(url)
        if n % 11 == 0:
            raise TimeoutError("slow")
        kind = ("text/html; charset=utf-8", "application/pdf", "image/png", "")[n % 4]
        return url, (404 if n % 7 == 0 else 503 if n % 13 == 0 else 200), kind, b"x" * n

    urls = _urls(spark, folder).select("url").distinct()
    out = crawl.routed(S.fetched(urls, get))
    return out.select("url", "status", "route", "error", F.length("content").alias("bytes"))


SQL["fetched_routes"] = f"""
WITH {_URL_ROWS}, d AS (SELECT DISTINCT url, length(url) AS n FROM u), s AS (SELECT *, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN 404 WHEN n % 13 = 0 THEN 503 ELSE 200 END AS status FROM d)
SELECT url, CAST(status AS INT) AS status, CASE WHEN status IS NULL THEN 'error' WHEN status >= 400 THEN 'non-2xx' WHEN n % 4 = 0 THEN 'html' WHEN n % 4 = 1 OR ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'unsupported-type' END AS route,
  CASE WHEN status IS NULL THEN 'TimeoutError: slow' WHEN status >= 400 THEN 'http_' || status END AS error, CASE WHEN status IS NOT NULL THEN CAST(n AS INT) END AS bytes FROM s"""


@query
def pdf_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each file as the pages of a document."""
    chunks = table(spark, folder, "retrieved_chunk").where(F.col("text").isNotNull() & F.col("kb_path").isNotNull() & F.col("chunk_index").isNotNull())
    pages = chunks.groupBy("kb_path", F.col("chunk_index").alias("page")).agg(F.min("text").alias("text"))
    return S.pdf_sections(pages).select("kb_path", F.md5("text").alias("text_md5"))


SQL["pdf_sections"] = """
WITH p AS (SELECT kb_path, chunk_index AS page, min(text) AS text FROM retrieved_chunk WHERE text IS NOT NULL AND kb_path IS NOT NULL AND chunk_index IS NOT NULL GROUP BY kb_path, chunk_index)
SELECT kb_path, md5(string_agg('## Page ' || page || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM p GROUP BY kb_path"""


@query
def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Each picture of a group of packets once, at its first page: pictures of one name have one content."""
    images = table(spark, folder, "packet").select(F.element_at(F.split("id", r"\."), 1).alias("kb_path"), F.length("id").alias("page"), F.explode("assets").alias("a")).select("kb_path", "page", F.concat("a", F.lit("@"), F.col("page").cast("string")).alias("name"), F.col("a").cast("binary").alias("content"))
    return S.first_images(images.distinct()).select("kb_path", "page", "name")


SQL["page_images"] = """
WITH a AS (SELECT DISTINCT string_split(id, '.')[1] AS kb_path, CAST(length(id) AS INT) AS page, unnest(assets) AS a FROM packet)
SELECT kb_path, page, a || '@' || page AS name FROM a QUALIFY row_number() OVER (PARTITION BY kb_path, a ORDER BY page, a || '@' || page) = 1"""


@query
def image_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of pictures by their leading bytes, and their data addresses."""
    heads = F.array(*[F.lit(h) for h in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "52494646", "0000")])
    content = F.unhex(F.concat(F.element_at(heads, (F.length("id") % 5 + 1).cast("int")), F.hex("id")))
    return table(spark, folder, "packet").select("id", T.magic_ext(content).alias("ext"), T.data_url(content, T.mime_of(F.concat("id", T.magic_ext(content)))).alias("address"), T.content_tokens(F.col("body"), F.size("assets")).alias("tokens"))


SQL["image_bytes"] = """
WITH h AS (SELECT id, body, len(assets) AS n, length(id) % 5 AS k, unhex(['89504E470D0A1A0A', 'FFD8FFE0', '474946383961', '52494646', '0000'][length(id) % 5 + 1]) || encode(id) AS c FROM packet)
SELECT id, ['.png', '.jpg', '.gif', '.webp', '.bin'][k + 1] AS ext, 'data:' || ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'application/octet-stream'][k + 1] || ';base64,' || to_base64(c) AS address, CAST(greatest(1, length(body) // 4) + n * 1500 AS INT) AS tokens FROM h"""


@query
def asset_places(spark: SparkSession, folder: str) -> DataFrame:
    """The page that owns each picture, and what it is called in its owner's folder."""
    cited = table(spark, folder, "packet").select("id", F.length("id").alias("n"), F.posexplode("assets").alias("link_pos", "asset"))
    first = crawl.first_citers(cited.select("asset", "id", "link_pos", F.struct("n", "id").alias("visit_order")))
    name = F.element_at(F.split("asset", "/"), -1)
    wanted = first.select("asset", F.col("id").alias("owner"), F.element_at(F.split("id", r"\."), 1).alias("folder"), F.regexp_replace(name, r"-\d+\.png$", "").alias("stem"), F.lit(".png").alias("ext"), F.col("asset").alias("pos"))
    return crawl.numbered_names(wanted).select("asset", "owner", "folder", "name")


SQL["asset_places"] = r"""
WITH c AS (SELECT id, length(id) AS n, generate_subscripts(assets, 1) AS p, unnest(assets) AS asset FROM packet), f AS (SELECT asset, id FROM c QUALIFY row_number() OVER (PARTITION BY asset ORDER BY n, id, p) = 1),
w AS (SELECT asset, id AS owner, string_split(id, '.')[1] AS folder, regexp_replace(string_split(asset, '/')[-1], '-\d+\.png$', '') AS stem FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY asset) AS k FROM w)
SELECT asset, owner, folder, stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.png' AS name FROM r"""


@query
def provenance_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Where pages stand once their folders have been turned into files."""
    urls = _urls(spark, folder).select(U.output_path(F.col("url")).alias("path"), "url").groupBy("path").agg(F.min("url").alias("url"))
    moves = urls.where(F.length("path") % 2 == 0).select(F.col("path").alias("old_path"), F.regexp_replace("path", r"/index\.md$", ".md").alias("new_path"))
    return crawl.provenance(urls, moves)


@query
def sidecar_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecars of folders, written and read: documents and pictures with their addresses, links that lead to files here in their order."""
    packets = table(spark, folder, "packet").select(F.element_at(F.split("id", r"\."), 1).alias("folder"), F.element_at(F.split("id", r"\."), -1).alias("slug"), "id", "assets", "source_urls")
    docs = packets.select("folder", F.concat("slug", F.lit(".md")).alias("name"), F.lit("document").alias("kind"), F.get("source_urls", F.lit(0)).alias("url"))
    pics = packets.select("folder", F.explode("assets").alias("a")).select("folder", F.element_at(F.split("a", "/"), -1).alias("name"), F.lit("image").alias("kind"), F.col("a").alias("url")).distinct()
    links = packets.select("folder", "slug", F.length("id").alias("link_pos")).unionByName(packets.select("folder", F.concat(F.lit("no-"), "slug").alias("slug"), F.lit(0).alias("link_pos")))
    written = staged(crawl.sidecars(docs.unionByName(pics), links), "sidecars")
    rows = written.select("folder", S.sidecar_of(F.col("sidecar")).alias("s"))
    return rows.select("folder", F.array_join("s.link_order", ",").alias("link_order"), F.size("s.documents").alias("documents"), F.coalesce(F.size("s.images"), F.lit(0)).alias("images"), F.array_join(F.transform(F.array_sort(F.map_entries("s.documents")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), " ").alias("sources"))


SQL["sidecar_round_trip"] = """
WITH p AS (SELECT string_split(id, '.')[1] AS folder, string_split(id, '.')[-1] AS slug, length(id) AS n, assets, source_urls[1] AS url FROM packet),
o AS (SELECT folder, string_agg(slug, ',' ORDER BY n, slug) AS link_order, count(*) AS documents, string_agg(slug || '.md=' || coalesce(url, ''), ' ' ORDER BY slug || '.md') AS sources FROM p GROUP BY folder),
i AS (SELECT folder, count(DISTINCT a) AS images FROM (SELECT folder, unnest(assets) AS a FROM p) GROUP BY folder)
SELECT folder, link_order, CAST(documents AS INT) AS documents, CAST(coalesce(images, 0) AS INT) AS images, sources FROM o LEFT JOIN i USING (folder)"""


@query
def html_favours(spark: SparkSession, folder: str) -> DataFrame:
    """How many links of a page's list are left by each mode of extraction, and whether its menu is."""
    rows = _pages(spark, folder)
    out = None
    for favour in H.FAVOUR:
        page = H.converted(F.col("html"), F.lit("https://kb.test/x/"), F.lit("index"), partial(H.convert, favour=favour))
        part = rows.select("id", F.lit(favour).alias("favour"), page["markdown"].alias("md")).select("id", "favour", (F.size(F.split("md", r"\[source\]")) - 1).alias("sources"), F.contains("md", F.lit("[Home]")).alias("menu"))
        out = part if out is None else out.unionByName(part)
    return out


SQL["html_favours"] = "SELECT id, f AS favour, CAST(CASE f WHEN 'precision' THEN 0 ELSE len(source_urls) END AS INT) AS sources, false AS menu FROM packet, (VALUES ('precision'), ('balanced'), ('recall')) v(f)"


# --- files


@query
def kb_files(spark: SparkSession, folder: str) -> DataFrame:
    """Packets written as files of a knowledge base, walked and read again; pictures beside an artefact are left out."""
    root = _shared(spark, "kb")
    base = F.replace("id", F.lit("."), F.lit("/"))
    packets = table(spark, folder, "packet")
    pages = packets.select(F.concat(base, F.lit("/_page.md")).alias("path"), F.col("body").alias("text"))
    notes = packets.where(F.length("id") % 3 == 0).select(F.concat(base, F.lit("/.note.txt")).alias("path"), F.col("title").alias("text"))
    pics = packets.where(F.size("assets") > 0).select(F.concat(base, F.lit("/assets/fig.png")).alias("path"), F.lit("png").alias("text"))
    built = packets.where(F.length("id") % 2 == 0).select(F.concat(base, F.lit(f"/{S.ARTEFACT}")).alias("path"), F.lit(S.MARKER).alias("text"))
    written = S.write_files(pages.unionByName(notes).unionByName(pics).unionByName(built), root)
    found = staged(S.walk(spark, root), "walked")
    texts = S.text_of(found)
    return texts.select("kb_path", "source_kind", "bytes", F.md5("text").alias("text_md5"), F.array_join("walk_key", "/").alias("walk_key"), F.lit(written).alias("written"))


SQL["kb_files"] = """
WITH p AS (SELECT id, replace(id, '.', '/') AS base, title, body, len(assets) > 0 AS pics FROM packet),
f AS (SELECT base || '/_page.md' AS kb_path, 'markdown' AS source_kind, body AS text, '_page.md' AS name, base FROM p UNION ALL SELECT base || '/.note.txt', 'text', title, '.note.txt', base FROM p WHERE length(id) % 3 = 0
  UNION ALL SELECT base || '/assets/fig.png', 'image', NULL, 'fig.png', base || '/assets' FROM p WHERE pics AND length(id) % 2 = 1),
n AS (SELECT count(*) + count(*) FILTER (length(id) % 3 = 0) + count(*) FILTER (pics) + count(*) FILTER (length(id) % 2 = 0) AS written FROM p)
SELECT kb_path, source_kind, CAST(coalesce(octet_length(encode(text)), 3) AS BIGINT) AS bytes, md5(text) AS text_md5, array_to_string(list_transform(string_split(base, '/'), lambda s: '1' || s), '/') || '/0' || name AS walk_key, CAST(written AS BIGINT) AS written FROM f, n"""


@query
def compiled_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artefacts with front matter, written and scanned for packets; those without an id or a long paragraph are no packets."""
    p = table(spark, folder, "packet")
    none = F.lit(None)
    matter = F.struct(F.when(F.length("title") % 5 > 0, F.col("id")).otherwise("").alias("id"), F.col("title").alias("title"), none.cast("string").alias("long_description"), T.rough_tokens(F.col("body")).alias("token_size_estimate"), F.lit("leaf").alias("kind"), F.col("source_urls").alias("source_urls"))
    text = S.compiled_text(matter, F.when(F.length("id") % 7 == 0, F.lit("| id |\n")), F.col("body"))
    written = staged(p.select(F.replace("id", F.lit("."), F.lit("/")).alias("path"), text.alias("text")), "artefacts")
    marked = written.select("path", T.has_marker(F.col("text"), S.MARKER).alias("generated"))
    found = S.packet_scan(written)
    return found.join(marked, "path").select("path", "id", "title", F.md5("body").alias("body_md5"), F.size("paragraphs").alias("paragraphs"), F.array_join("source_urls", " ").alias("urls"), "generated")


SQL["compiled_artefacts"] = r"""
WITH p AS (SELECT *, trim(body, chr(10) || chr(9) || chr(13) || chr(12) || chr(11) || ' ') AS b FROM packet WHERE length(title) % 5 > 0),
n AS (SELECT *, len(list_filter(list_transform(regexp_split_to_array(b, '\n\s*\n'), lambda x: trim(x, chr(10) || chr(9) || chr(13) || chr(12) || chr(11) || ' ')), lambda x: length(x) >= 120)) AS k FROM p)
SELECT replace(id, '.', '/') AS path, id, title, md5(b) AS body_md5, CAST(k AS INT) AS paragraphs, array_to_string(source_urls, ' ') AS urls, true AS generated FROM n WHERE k > 0"""


@query
def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as a JSON-lines log, torn lines among them, and read again."""
    path = _shared(spark, "log")
    e = table(spark, folder, "events")
    line = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("event"), "user_id", "value"))
    torn = F.when(F.col("event_id") % 10 == 3, F.left(line, F.lit(20))).otherwise(line)
    e.select(torn.alias("value")).write.mode("overwrite").text(f"{_uri(path)}/lines")
    rows = S.read_log(spark, f"{_uri(path)}/lines")
    return rows.groupBy("level", "event").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first"), F.countDistinct(F.col("data")["user_id"]).alias("users"))


SQL["log_lines"] = "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS event, count(*) AS n, epoch_us(min(ts)) AS first, count(DISTINCT user_id) AS users FROM events WHERE event_id % 10 <> 3 GROUP BY event_type"


@query
def eval_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows written to one CSV file and read again: quotes, line breaks, empty and missing fields."""
    path = f"{_shared(spark, 'csv')}/rows.csv"
    written = S.write_eval_csv(table(spark, folder, "eval_row"), path)
    rows = S.read_eval_csv(spark, path)
    return rows.select("pos", "question_id", F.md5(F.concat_ws("|", *[c for c in S.EVAL_COLUMNS if c not in ("score", "turns", "question_id")])).alias("row_md5"), "score", "turns", F.lit(written).alias("written"))


SQL["eval_csv_round_trip"] = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS p, count(*) OVER () AS written FROM eval_row)
SELECT CAST(p AS BIGINT) AS pos, question_id, md5(concat_ws('|', coalesce(kind, ''), coalesce(persona, ''), coalesce(question, ''), coalesce(expected_answer, ''), coalesce(source, ''), coalesce(actual_answer, ''), coalesce(remark, ''), coalesce(transcript, ''))) AS row_md5, score, turns, CAST(written AS BIGINT) AS written FROM r"""


@query
def persona_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The roster as a CSV file, read and checked."""
    path = f"{_shared(spark, 'csv')}/personas.csv"
    S.write_eval_csv(table(spark, folder, "persona").withColumn("topics", F.array_join("topics", "; ")), path, S.PERSONA_COLUMNS)
    return S.read_personas(spark, path).select("pos", "persona_id", "persona_name", "persona_description", F.array_join("topics", ",").alias("topics"))


SQL["persona_csv_round_trip"] = "SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, persona_id, persona_name, persona_description, array_to_string(topics, ',') AS topics FROM persona"


@query
def options_and_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Options from TOML, and each persona's prompt: an operator's file wins over the packaged text."""
    options = S.load_options(text='budget = 9000\n[retrieval]\ntop_k = 5\nreranker = "linear"\n[aliases]\nEP = "Employment Pass"\n')
    packaged = prompts.packaged()
    root = _shared(spark, "prompts")
    own = {"evalgen.answer_rules": "Answer for the operator.", "evalgen.persona_framing": "You are $persona_name. $persona_description"}
    prompts.check(own)
    for name, replaced in own.items():
        with open(f"{root}/{prompts.file_names()[name]}", "w", encoding="utf-8") as f:
            f.write(replaced)
    rules = S.prompt("evalgen.answer_rules", packaged, root)
    text = S.prompt("evalgen.persona_framing", packaged, root, persona_name="\u0001", persona_description=rules)
    rows = table(spark, folder, "persona")
    shown = F.concat_ws(" ", *[F.lit(str(v)) for v in (options.budget, options.top_k, options.reranker, options.chunk_target, options.aliases["EP"])])
    return rows.select("persona_id", F.replace(F.lit(text), F.lit("\u0001"), F.col("persona_name")).alias("prompt"), shown.alias("options"))


SQL["options_and_prompts"] = "SELECT persona_id, 'You are ' || persona_name || '. Answer for the operator.' AS prompt, '9000 5 linear 500 Employment Pass' AS options FROM persona"


# --- chunks in SQL and by another measure


@query
def chunk_table_function(spark: SparkSession, folder: str) -> DataFrame:
    """The chunker as a table function of SQL."""
    register_chunker(spark)
    _documents(spark, folder).createOrReplaceTempView("loam_documents")
    return spark.sql("SELECT kb_path, c.chunk_index, md5(c.text) AS text_md5, c.char_start, c.char_end FROM loam_documents, LATERAL chunk_document(text, source_kind, 500, 0) c")


@query
def chunk_estimator(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by an estimator of the caller's: two characters a token."""
    out = chunked(_documents(spark, folder), target=300, overlap=0, est=lambda t: max(1, len(t) // 2))
    return out.select("kb_path", "chunk_index", F.md5("text").alias("text_md5"), "token_estimate")


_PATH_OF = r"regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"
SQL["provenance_paths"] = rf"""
WITH {_URL_ROWS}, s AS (SELECT url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, ends_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS slash, list_filter(string_split({_PATH_OF}, '/'), lambda x: x <> '') AS parts FROM u),
o AS (SELECT url, array_to_string(list_concat(list_concat([host], list_transform(parts, lambda x, i: CASE WHEN regexp_replace(regexp_replace(CASE WHEN i = len(parts) AND NOT slash THEN regexp_replace(x, '\.[^.]*$', '') ELSE x END, '\\', '_', 'g'), '^\.+', '') = '' THEN '_' ELSE regexp_replace(regexp_replace(CASE WHEN i = len(parts) AND NOT slash THEN regexp_replace(x, '\.[^.]*$', '') ELSE x END, '\\', '_', 'g'), '^\.+', '') END)), ['index.md']), '/') AS path FROM s),
g AS (SELECT path, min(url) AS url FROM o GROUP BY path)
SELECT CASE WHEN length(path) % 2 = 0 THEN regexp_replace(path, '/index\.md$', '.md') ELSE path END AS path, url FROM g"""
