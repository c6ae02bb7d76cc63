"""Link graphs: bounded traversal, why each link was or was not followed, and the shape of the mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.markdown import without_image
from loam.functions.url import asset_host_allowed, in_scope, is_asset_url, normalize_url
from loam.operators.ranking import PER_BLOCK
from loam.session import staged

RETRYABLE = (429, 503)
HTML_TYPES, PDF_TYPES = ("text/html", "application/xhtml+xml"), ("application/pdf",)
DELAY_S = 5.0


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, scope: list[str] | None = None) -> DataFrame:
    """``(url, hop, parent, pos)`` of every page reached within ``depth`` hops, once, at its first discovery.

    ``edges(src, link_pos, href)``, ``seeds(url, pos)``. One join and one anti-join per hop. Pages are discovered as a queue
    would: seeds by ``pos``, then the links of each page in their order, pages in the order they were discovered in. A
    page's place in that order is the list of places on the way to it, compared from the left, so no hop is ranked in one
    task. Where the same way leads to a page twice, the lesser parent counts. Each hop is a table in the shared folder,
    so the plan does not grow.
    """
    links = edges.select(normalize_url(F.col("src")).alias("src"), F.col("link_pos").cast("long").alias("link_pos"), normalize_url(F.col("href")).alias("href"))
    if scope:
        links = links.where(in_scope(F.col("href"), scope))
    links = staged(links.groupBy("src", "href").agg(F.min("link_pos").alias("link_pos")), "links")
    place = F.col("pos").cast("long") if "pos" in seeds.columns else F.lit(0).cast("long")
    frontier = seeds.select(normalize_url(F.col("url")).alias("url"), place.alias("p")).groupBy("url").agg(F.min("p").alias("p"))
    frontier = frontier.select("url", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("pos"), F.array("p").alias("way"))
    seen = frontier = staged(frontier, "hop")
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("url").alias("src"), "way").join(links, "src")
        first = F.min(F.struct(F.concat("way", F.array("link_pos")).alias("way"), "src", "link_pos"))
        fresh = step.groupBy(F.col("href").alias("url")).agg(first.alias("f")).join(seen.select("url"), "url", "left_anti")
        frontier = staged(fresh.select("url", F.lit(hop).alias("hop"), F.col("f.src").alias("parent"), F.col("f.link_pos").alias("pos"), F.col("f.way").alias("way")), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("way")


def dispositions(links: DataFrame, visited: DataFrame, scope: list[str], max_depth: int, extra_hosts: list[str] | None = None) -> DataFrame:
    """What becomes of each link of ``links(referrer, depth, link_pos, href)``: one reason, in a fixed order of tests.

    unparseable; asset of another host, asset visited, asset (free of scope and depth); depth; scope; visited; follow.
    ``depth`` is the referrer's. Where several links of one batch name a page, the first is followed.
    A link listed again (same referrer, depth, place and target) is one link.
    """
    rows = links.distinct().withColumn("url", normalize_url(F.col("href")))
    rows = rows.join(visited.select(F.col("url"), F.lit(True).alias("__seen")).distinct(), "url", "left")
    seen = F.coalesce("__seen", F.lit(False))
    asset = is_asset_url(F.col("url"))
    why = (
        F.when(~F.coalesce(F.col("url").rlike(r"^https?://[^/?#]+"), F.lit(False)), "unparseable")
        .when(asset & ~asset_host_allowed(F.col("url"), F.col("referrer"), extra_hosts), "asset_host").when(asset & seen, "visited").when(asset, "asset")
        .when(F.col("depth") >= max_depth, "depth").when(~in_scope(F.col("url"), scope), "scope").when(seen, "visited").otherwise("follow")
    )
    rows = rows.withColumn("disposition", why).drop("__seen")
    # the first of a page's links is a minimum, so a page that everything links to is no hot window
    chosen = F.col("disposition").isin("follow", "asset")
    key = F.struct("depth", "referrer", "link_pos")
    first = rows.where(chosen).groupBy("url", "disposition").agg(F.min(key).alias("__first"))
    both = rows.join(first, ["url", "disposition"], "left")
    again = chosen & (key != F.col("__first"))
    return both.withColumn("disposition", F.when(again, "visited").otherwise(F.col("disposition"))).drop("__first")


def disposition_counts(rows: DataFrame, reasons: list[str], sample: int = 3) -> DataFrame:
    """Every reason with its count, those of 0 too, largest first then by name, and the first ``sample`` of its links.

    A negative sample means all: ask for it only where a report is to hold every link. Otherwise each task keeps its
    first links before anything is gathered.
    """
    listed = rows.sparkSession.createDataFrame([(r,) for r in reasons], "disposition string")
    counts = rows.groupBy("disposition").agg(F.count(F.lit(1)).alias("links"))
    both = listed.join(counts, "disposition", "left")
    if sample:
        urls = rows.select("disposition", "url").where(F.col("url").isNotNull()).distinct()
        if sample > 0:
            urls = urls.withColumn("__n", F.row_number().over(Window.partitionBy("disposition").orderBy("url"))).where(F.col("__n") <= sample)
        both = both.join(urls.groupBy("disposition").agg(F.array_sort(F.collect_list("url")).alias("sample")), "disposition", "left")
    else:
        both = both.withColumn("sample", F.lit(None).cast("array<string>"))
    return both.select("disposition", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample")).orderBy(F.desc("links"), "disposition")


def routed(pages: DataFrame) -> DataFrame:
    """``pages(url, status, content_type, error)`` with ``route``: error, non-2xx, html, pdf (by type or by name) or unsupported-type."""
    kind = F.lower(F.trim(F.regexp_replace(F.coalesce("content_type", F.lit("")), ";.*$", "")))
    route = (
        F.when(F.col("status").isNull(), "error").when(F.col("status") >= 400, "non-2xx").when(kind.isin(*HTML_TYPES), "html")
        .when(kind.isin(*PDF_TYPES) | F.lower("url").endswith(".pdf"), "pdf").otherwise("unsupported-type")
    )
    return pages.withColumn("route", route)


def image_kept(size: Column, least: int) -> Column:
    """Whether an image is large enough; 0 keeps all."""
    return F.lit(True) if least <= 0 else size >= least


def without_small_images(pages: DataFrame, images: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``pages(page, markdown)`` without references to images under ``least`` bytes, and the ``images(page, name, size)`` that stay."""
    small = images.where(~image_kept(F.col("size"), least)).groupBy("page").agg(F.array_sort(F.collect_set("name")).alias("__gone"))  # images of one page
    both = pages.join(small, "page", "left")
    md = F.aggregate(F.coalesce("__gone", F.array().cast("array<string>")), F.col("markdown"), without_image)
    return both.withColumn("markdown", md).drop("__gone"), images.where(image_kept(F.col("size"), least))


def first_citers(citations: DataFrame) -> DataFrame:
    """The page that owns each asset: the first to cite it by ``visit_order``, then place."""
    n = F.row_number().over(Window.partitionBy("asset").orderBy("visit_order", "link_pos"))
    return citations.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def numbered_names(wanted: DataFrame) -> DataFrame:
    """``stem.ext``, then ``stem-2.ext`` and on: names of files that want the same one in a folder, in ``pos`` order."""
    n = F.row_number().over(Window.partitionBy("folder", "stem", "ext").orderBy("pos"))
    rows = wanted.withColumn("__n", n)
    return rows.withColumn("name", F.concat("stem", F.when(F.col("__n") > 1, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(""), "ext")).drop("__n")


def collapsed(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``files(segments, name)`` with leaf folders turned into files: ``a/x/index.md`` becomes ``a/x.md``.

    Deepest folders first. A folder goes if it holds only its index page and that page's images and no ``x.md`` stands
    beside it; host folders stay. Each level is a table in the shared folder, so the plan does not grow. Adds ``new_segments, new_name``; one join per level.
    """
    rows = files.withColumn("new_segments", F.col("segments")).withColumn("new_name", F.col("name"))
    depth = max_depth if max_depth is not None else (files.agg(F.max(F.size("segments"))).first()[0] or 0)
    for level in range(depth, 1, -1):
        here = F.size("new_segments") == level
        own = (F.col("new_name") == "index.md") | F.col("new_name").rlike(r"(?i)^index-.*\.(?:png|jpe?g|gif|webp|svg|bmp|tiff?)$")
        folder = rows.where(here).groupBy("new_segments").agg(F.bool_and(own).alias("only_own"), F.bool_or(F.col("new_name") == "index.md").alias("has_page"))
        below = rows.where(F.size("new_segments") > level).select(F.slice("new_segments", 1, level).alias("new_segments")).distinct()
        leaf = folder.where("only_own and has_page").select("new_segments").join(below, "new_segments", "left_anti")
        pages = rows.where((F.size("new_segments") == level - 1) & F.endswith("new_name", F.lit(".md"))).select(F.concat("new_segments", F.array(F.regexp_replace("new_name", r"\.md$", ""))).alias("new_segments")).distinct()
        leaf = leaf.join(pages, "new_segments", "left_anti").withColumn("__leaf", F.lit(True))
        name = F.element_at("new_segments", -1)
        moved = F.when(F.col("new_name") == "index.md", F.concat(name, F.lit(".md"))).otherwise(F.concat(name, F.substring("new_name", 6, 10_000)))
        rows = rows.join(leaf, "new_segments", "left")
        rows = rows.select(
            *files.columns, F.when(F.col("__leaf"), F.slice("new_segments", 1, level - 1)).otherwise(F.col("new_segments")).alias("new_segments"),
            F.when(F.col("__leaf"), moved).otherwise(F.col("new_name")).alias("new_name"),
        )
        rows = staged(rows, "level")  # the rows are read four times a level: a plan of all levels would be a tower
    return rows


def layout_collisions(files: DataFrame) -> DataFrame:
    """Folders that stand beside a page of their name."""
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.slice("segments", 1, k))).alias("segments")).distinct()
    pages = files.where(F.endswith("name", F.lit(".md"))).select(F.concat("segments", F.array(F.regexp_replace("name", r"\.md$", ""))).alias("segments")).distinct()
    return folders.join(pages, "segments", "left_semi")


def provenance(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``files(path, url)`` under their final paths."""
    return files.join(moves.select(F.col("old_path").alias("path"), "new_path"), "path", "left").select(F.coalesce("new_path", "path").alias("path"), "url")


def sidecars(files: DataFrame, links: DataFrame) -> DataFrame:
    """``(folder, sidecar)`` JSON: where each document and image came from, and the order of links that lead to files here."""
    place = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "url")))))
    base = files.groupBy("folder").agg(place("document").alias("documents"), place("image").alias("images"))
    stems = files.where(F.col("kind") == "document").select("folder", F.regexp_replace("name", r"\.[^.]*$", "").alias("slug")).where(F.col("slug") != "index").distinct()
    order = links.join(stems, ["folder", "slug"], "left_semi").groupBy("folder", "slug").agg(F.min("link_pos").alias("p"))
    ordered = order.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "slug"))), lambda x: x["slug"]).alias("link_order"))
    full = base.join(ordered, "folder", "left")
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    return full.select("folder", F.to_json(F.struct(F.col("link_order"), empty("documents").alias("documents"), empty("images").alias("images"))).alias("sidecar"))


PACED = "host string, pos long, start_s double, wait_s double, next_allowed double"


def paced(requests: DataFrame, delay_s: float = DELAY_S, per_block: int = PER_BLOCK) -> DataFrame:
    """How long each request of a host had to wait: ``requests(pos, host, arrive_s, took_s, status, retry_s)``.

    A host's next request starts no sooner than ``delay_s`` after the end of the one before, or as long as the server
    asked on 429 and 503. With c the time from a request's start to the next one's earliest, request i starts at the
    greatest of arrive_j + c_j + ... + c_(i-1) over j up to i: a running sum and a running maximum, which are taken by
    blocks of ``pos`` and then over the blocks, so that no task sees a whole host. Times count in microseconds; ``pos``
    is unique within a host; a null time is taken as 0.
    """
    us = lambda c: F.coalesce(F.round(F.col(c).cast("double") * 1e6), F.lit(0)).cast("long")
    asked = F.when(F.col("status").isin(*RETRYABLE), us("retry_s")).otherwise(0)
    rows = requests.select(F.lower("host").alias("host"), F.col("pos").cast("long").alias("pos"), us("arrive_s").alias("arrive"), (us("took_s") + F.greatest(F.lit(round(delay_s * 1e6)), asked)).alias("c"))
    rows = rows.withColumn("block", F.floor(F.col("pos") / per_block))
    inside = Window.partitionBy("host", "block").orderBy("pos")
    local = rows.withColumn("s", F.sum("c").over(inside) - F.col("c")).withColumn("lead", F.max(F.col("arrive") - F.col("s")).over(inside))
    blocks = local.groupBy("host", "block").agg(F.sum("c").alias("sum"), F.max("lead").alias("most"))
    before = Window.partitionBy("host").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).withColumn("ahead", F.max(F.col("most") - F.col("before")).over(before)).select("host", "block", "before", "ahead")
    start = F.col("before") + F.col("s") + F.greatest(F.col("ahead"), F.col("lead") - F.col("before"))
    out = local.join(blocks, ["host", "block"]).withColumn("start", start)
    return out.select("host", "pos", (F.col("start") / 1e6).alias("start_s"), ((F.col("start") - F.col("arrive")) / 1e6).alias("wait_s"), ((F.col("start") + F.col("c")) / 1e6).alias("next_allowed"))
