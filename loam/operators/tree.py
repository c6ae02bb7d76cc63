"""Folder trees: kinds, roll-ups, catalog, and the one document each folder becomes.

Folders are keyed by ``segments ARRAY<STRING>``: arrays order trees the way a walk does, joined paths do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.markdown import escaped_cell, rewritten_images, unescaped_cell
from loam.functions.text import dotted_id, naive_path, parent_id, rough_tokens

ROOT = "_root"
COLUMNS = ("id", "path", "depth", "title", "long")


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def with_ancestors(files: DataFrame, segments: str = "segments") -> DataFrame:
    """One row per file and folder above it, the root (no segments) included; ``up`` is the distance."""
    n = F.size(segments)
    rows = files.select("*", F.explode(F.sequence(F.lit(0), n)).alias("up"))
    return rows.withColumn("ancestor", F.slice(segments, 1, n - F.col("up")))


def folder_kinds(files: DataFrame) -> DataFrame:
    """``(segments, kind, files, subfolders)`` of every folder of ``files(segments, name)``, waypoints included.

    leaf: own files only; node: subfolders only; mixed: both; a folder with neither does not exist here. ``assets``
    folders are no subfolders.
    """
    real = files.where(~F.array_contains("segments", "assets"))
    own = real.groupBy("segments").agg(F.count(F.lit(1)).alias("files"))
    above = with_ancestors(own.select("segments")).where(F.col("up") > 0)
    child = F.element_at("segments", (F.size("ancestor") + 1).cast("int"))
    below = above.groupBy(F.col("ancestor").alias("segments")).agg(F.countDistinct(child).alias("subfolders"))
    both = own.join(below, "segments", "full_outer").select("segments", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("subfolders", F.lit(0)).alias("subfolders"))
    kind = F.when((F.col("files") > 0) & (F.col("subfolders") > 0), "mixed").when(F.col("files") > 0, "leaf").when(F.col("subfolders") > 0, "node").otherwise("empty")
    return both.withColumn("kind", kind)


def subtree_rollup(folders: DataFrame) -> DataFrame:
    """``(segments, descendants, subtree_depth)``: folders below, and how far down they go. One pass, no recursion."""
    pairs = with_ancestors(folders.select("segments"))
    return pairs.groupBy(F.col("ancestor").alias("segments")).agg(F.count_if(F.col("up") > 0).alias("descendants"), F.max("up").alias("subtree_depth"))


def reading_order(name: Column, link_position: Column) -> list[Column]:
    """Sort keys of a folder's sources: the index page, then as linked, then by name."""
    return [(name != "index.md").cast("int"), F.coalesce(link_position, F.lit(2**31 - 1)), name]


def folder_documents(files: DataFrame) -> DataFrame:
    """``(segments, content, source_files, tokens)`` of each folder of ``files(segments, name, text, link_position)``."""
    keys = reading_order(F.col("name"), F.col("link_position"))
    part = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], rewritten_images(F.col("text")).alias("text"))
    ordered = F.array_sort(F.collect_list(part))  # the files of one folder
    content = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n---\n\n")
    out = files.groupBy("segments").agg(content.alias("content"), F.transform(ordered, lambda x: x["k2"]).alias("source_files"))
    return out.withColumn("tokens", rough_tokens(F.col("content")))


def stub_summary(content: Column) -> Column:
    """The offline summary: the first line without its marks, and the first sentence after it."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    title = F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), "^#+", ""))
    body = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")))
    long = F.regexp_extract(F.coalesce(F.try_element_at(body, F.lit(1)), F.lit("")), r"^(.*?[.!?])(?:\s|$)", 1)
    return F.struct(title.alias("title"), long.alias("long"))


def catalog(documents: DataFrame, summary: Column | None = None) -> DataFrame:
    """``(id, path, depth, title, long, segments)`` of folders with content, in walk order by ``segments``."""
    summary = stub_summary(F.col("content")) if summary is None else summary
    rows = documents.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").withColumn("__s", summary)
    return rows.select(
        dotted_id(F.col("segments")).alias("id"), F.array_join("segments", "/").alias("path"), F.size("segments").alias("depth"),
        F.col("__s.title").alias("title"), F.col("__s.long").alias("long"), "segments",
    )


def catalog_line(id_: Column, path: Column, depth: Column, title: Column, long: Column) -> Column:
    shown = F.when(id_ == "", ROOT).otherwise(id_)
    folder = F.when(path == "", "").otherwise(F.concat(path, F.lit("/")))
    return F.concat(F.lit("| `"), shown, F.lit("` | `"), folder, F.lit("` | "), depth.cast("string"), F.lit(" | "), escaped_cell(title), F.lit(" | "), escaped_cell(F.coalesce(long, F.lit(""))), F.lit(" |"))


def rendered_catalog(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The catalog as one Markdown table per group of ``by`` (one in all without it)."""
    line = catalog_line(*[F.col(c) for c in COLUMNS])
    ordered = F.array_sort(F.collect_list(F.struct("segments", line.alias("line"))))
    head = "| " + " | ".join(COLUMNS) + " |\n|" + "---|" * len(COLUMNS) + "\n"
    return rows.groupBy(*(by or [])).agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("catalog"), F.count(F.lit(1)).alias("entries"))


def parsed_catalog(texts: DataFrame, col: str = "catalog", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(pos, id, path, depth, title, long)`` of rendered tables; lines that do not line up are left out."""
    lines = texts.select(*keep, F.posexplode(F.split(F.col(col), "\n")).alias("pos", "line"))
    line = F.trim(F.col("line"))
    rows = lines.where(line.rlike(r"^\|.*\|$") & ~line.rlike(r"^\|[\s:|\-]+\|$"))
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: unescaped_cell(c))
    rows = rows.withColumn("c", cells).where(F.size("c") >= 4)
    depth = F.element_at("c", 3).try_cast("int")
    id_ = F.regexp_replace(F.element_at("c", 1), "^`+|`+$", "")
    return rows.where(depth.isNotNull()).select(
        *keep, "pos", F.when(id_ == ROOT, "").otherwise(id_).alias("id"), F.regexp_replace(F.element_at("c", 2), "^[`/ ]+|[`/ ]+$", "").alias("path"),
        depth.alias("depth"), F.element_at("c", 4).alias("title"), F.coalesce(F.try_element_at("c", F.lit(5)), F.lit("")).alias("long"),
    )


def largest_branches(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first-level branches with most entries, ties by name."""
    branch = F.element_at(F.split("id", r"\."), 1)
    return rows.where(F.col("id") != "").groupBy(branch.alias("branch")).agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "branch").limit(n)


def kept_or_built(plan: DataFrame, earlier: DataFrame, force: bool = False) -> DataFrame:
    """Which folders are built: all with ``force``, else those without an artefact, and the root always; foreign files stop the run."""
    both = plan.join(earlier.select("segments", "generated"), "segments", "left")
    action = F.when(F.col("generated").isNull(), "build").when(~F.col("generated"), "foreign").when(F.lit(force) | (F.size("segments") == 0), "build").otherwise("keep")
    return both.withColumn("action", action)


def partial_scope(folders: DataFrame, only: list[str]) -> DataFrame:
    """Folders to rebuild for one subtree: it and everything below, and its ancestors."""
    path = F.array(*[F.lit(s) for s in only])
    n = len(only)
    inside = F.slice("segments", 1, max(n, 1)) == path if n else F.lit(True)
    above = F.slice(path, 1, F.size("segments")) == F.col("segments")
    return folders.where(inside | ((F.size("segments") < n) & above))


def catalog_size(rows: DataFrame) -> DataFrame:
    """``(entries, catalog_tokens, content_tokens, total_tokens)`` of a catalog and what it names, without rendering it: lines are summed up.

    ``rows`` has the catalog's columns and ``tokens``, those of the folder's content.
    """
    head = "| " + " | ".join(COLUMNS) + " |\n|" + "---|" * len(COLUMNS) + "\n"
    line = catalog_line(*[F.col(c) for c in COLUMNS])
    per = rows.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.length(line) + 1), F.lit(0)).alias("__chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("content_tokens"))
    sized = per.withColumn("catalog_tokens", F.greatest(F.lit(1), F.floor((F.col("__chars") + len(head)) / 4)).cast("long"))
    return sized.select("entries", "catalog_tokens", F.col("content_tokens").cast("long").alias("content_tokens"), (F.col("content_tokens") + F.col("catalog_tokens")).cast("long").alias("total_tokens"))


def hydrated(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Catalog rows with ``kind`` and token counts of ``folders(path, kind, token_size_estimate, content_token_estimate)``; null where a folder cannot be read."""
    return rows.join(folders.select("path", "kind", "token_size_estimate", "content_token_estimate"), "path", "left")


def children(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``(parent, id)``: the entries right below each of ``of(id)``, by their ids."""
    return rows.select(parent_id(F.col("id")).alias("parent"), "id").join(of.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")


def roots(rows: DataFrame) -> DataFrame:
    """The first-level entries, whatever the root is called."""
    return rows.where(F.col("depth") == 1)


def candidate_paths(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, rank, path)``: folders that an id may name, best first; ``known(id, path)`` are catalog rows.

    0: the id's own row; 1: the longest known ancestor's folder and the rest of the id below it; 2: a known descendant's
    folder, cut by one to as many parts as lie between; 3: the id with slashes. Each is a guess but the first.
    """
    asked = requests.select("id").distinct()
    own = asked.join(known, "id").select("id", F.lit(0).alias("rank"), "path")
    above = longest_known_prefix(asked, known).where(F.col("known_id").isNotNull() & (F.col("known_id") != F.col("id")))
    above = above.join(known.select(F.col("id").alias("known_id"), F.col("path").alias("base")), "known_id")
    hung = above.select("id", F.lit(1).alias("rank"), F.concat_ws("/", F.nullif("base", F.lit("")), naive_path(F.col("rest"))).alias("path"))
    parts = F.split("id", r"\.")
    tops = known.select("path", F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("id"), k.alias("k")))).alias("t"))
    below = tops.where(F.col("t.k") < F.col("n")).select(F.col("t.id").alias("id"), "path", (F.col("n") - F.col("t.k")).alias("down")).join(asked, "id", "left_semi")
    segments = F.split("path", "/")
    cut = below.select("id", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.col("down")), lambda d: d < F.size(segments)), lambda d: F.array_join(F.slice(segments, 1, F.size(segments) - d), "/"))).alias("path"))
    trimmed = cut.select("id", F.lit(2).alias("rank"), "path")
    naive = asked.select("id", F.lit(3).alias("rank"), naive_path(F.col("id")).alias("path"))
    return own.unionByName(hung).unionByName(trimmed).unionByName(naive).where(F.col("path") != "").groupBy("id", "path").agg(F.min("rank").alias("rank")).select("id", "rank", "path")


def resolved_ids(requests: DataFrame, known: DataFrame, artefacts: DataFrame) -> DataFrame:
    """``(id, path, rank)``: each id's folder, the best candidate whose artefact says it is that id's; null where none does.

    ``artefacts(path, id)`` are the folders' own ids. Ties of rank go to the lesser path.
    """
    sound = candidate_paths(requests, known).join(artefacts.select("path", F.col("id").alias("__own")), "path").where(F.col("__own") == F.col("id"))
    best = sound.groupBy("id").agg(F.min(F.struct("rank", "path")).alias("b")).select("id", "b.path", "b.rank")
    return requests.select("id").distinct().join(best, "id", "left")


def catalog_view(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(id, path)`` of all ids in play: the catalog, first rows of equal ids first, and folders resolved beside it."""
    first = rows.groupBy("id").agg(F.min("path").alias("path"))
    more = resolved.where(F.col("path").isNotNull()).select("id", "path").join(first, "id", "left_anti")
    return first.unionByName(more)


def longest_known_prefix(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, known_id, rest)``: each dotted id hung from its longest known ancestor (or itself); null where none is known."""
    parts = F.split("id", r"\.")
    tries = requests.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("known_id"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.length("known_id").desc()))
    found = tries.join(known.select(F.col("id").alias("known_id")), "known_id", "left_semi").withColumn("__n", best).where(F.col("__n") == 1)
    out = requests.join(found.select("id", "known_id"), "id", "left")
    return out.select("id", "known_id", F.expr("if(known_id is null, id, ltrim('.', substring(id, length(known_id) + 1)))").alias("rest"))
