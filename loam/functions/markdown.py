"""Markdown and HTML column functions; those that need a parser are pandas functions in ``html.py``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a feature of a page.
FEATURES = {
    "headings": r"(?md)(^#{1,6} )", "tables": r"(?md)(^\|[- :|]+\|[ \t]*$)", "links": r"((?<!!)\[[^\]]*\]\([^)]*\))", "images": r"(!\[[^\]]*\]\([^)]*\))",
}


def feature_counts(md: Column) -> Column:
    """``MAP<STRING,INT>`` of headings, tables, links, images and pairs of fences."""
    parts = []
    for name, pattern in FEATURES.items():
        parts += [F.lit(name), F.size(F.regexp_extract_all(md, F.lit(pattern), F.lit(1)))]
    fences = F.floor(F.size(F.regexp_extract_all(md, F.lit("(```)"), F.lit(1))) / 2).cast("int")
    return F.create_map(*parts, F.lit("code_blocks"), fences)


def hrefs(html: Column) -> Column:
    """Link targets in document order, without scripts, mail, phone and fragments; repeats stay."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:javascript:|mailto:|tel:|#)"))


def image_source(src: Column, lazy: list[Column], srcset: Column) -> Column:
    """``src`` unless empty or inline data; then the lazy attributes; then the first of ``srcset``."""
    usable = [F.when((F.trim(c) != "") & ~F.startswith(F.trim(c), F.lit("data:")), F.trim(c)) for c in [src, *lazy]]
    first = F.element_at(F.split(F.trim(F.element_at(F.split(srcset, ","), 1)), r"\s+"), 1)
    return F.coalesce(*usable, F.when(first != "", first))


def with_title(md: Column, title: Column) -> Column:
    missing = title.isNotNull() & (title != "") & ~F.startswith(F.ltrim(md), F.lit("# "))
    return F.when(missing, F.concat(F.lit("# "), title, F.lit("\n\n"), md)).otherwise(md)


def with_table_delimiters(md: Column) -> Column:
    """A delimiter row under the first row of each run of table rows that lacks one."""
    lines = F.split(md, "\n")
    # fixed values: a row and a delimiter row
    row, delimiter = r"^\s*\|.*\|\s*$", r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$"

    def fixed(line: Column, i: Column) -> Column:
        at = lambda k: F.coalesce(F.try_element_at(lines, i + 1 + k), F.lit(""))
        first = line.rlike(row) & ((i == 0) | ~F.coalesce(F.try_element_at(lines, F.when(i > 0, i).otherwise(1)), F.lit("")).rlike(row))
        lacking = first & at(1).rlike(row) & ~at(1).rlike(delimiter)
        cells = F.size(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"))
        return F.when(lacking, F.concat(line, F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), cells), "|"), F.lit("|"))).otherwise(line)

    return F.array_join(F.transform(lines, fixed), "\n")


def tidied(md: Column) -> Column:
    """Runs of blank lines become one, ends are trimmed, one line feed closes."""
    return F.concat(F.regexp_replace(F.regexp_replace(with_table_delimiters(md), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def retained_pct(md: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.bround(100.0 * F.length(md) / F.length(text), 1)).otherwise(F.lit(0.0))


def without_image(md: Column, name: Column) -> Column:
    """The text without references to one image."""
    return F.regexp_replace(md, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), name, F.lit(r'\E(?:\s+"[^"]*")?\)')), F.lit(""))


def rewritten_images(md: Column, folder: str = "assets") -> Column:
    """Relative image references moved to the assets folder."""
    return F.regexp_replace(md, rf"(!\[[^\]]*\]\()(?!https?://|{folder}/)(?:[^)\s]*/)?([^)\s/]+)(\))", rf"$1{folder}/$2$3")


def referenced_images(md: Column, images: Column) -> Column:
    """Those of ``ARRAY<STRUCT<remote,local>>`` whose local name is the target of some reference, alone or before a title."""
    return F.filter(images, lambda i: F.regexp_like(md, F.concat(F.lit(r"\]\(\s*\Q"), i["local"], F.lit(r"\E[\s)\"]"))))


def link_slugs(md: Column) -> Column:
    """Last segments of absolute links, at first mention."""
    urls = F.regexp_extract_all(md, F.lit(r"(?<!!)\[[^\]]*\]\((https?://[^)\s]+)"), F.lit(1))
    last = F.transform(urls, lambda u: F.regexp_replace(F.regexp_extract(F.regexp_replace(u, r"[?#].*$", ""), r"^https?://[^/]+/(?:.*/)?([^/]+)/*$", 1), r"\.[^.]*$", ""))
    return F.array_distinct(F.filter(last, lambda s: s != ""))


def escaped_cell(text: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def unescaped_cell(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("\\|"), F.lit("|"))


def between(text: Column, begin: str, end: str) -> Column:
    """Text between two markers; null where either is missing."""
    found = F.regexp_extract(text, rf"(?s)\Q{begin}\E(.*?)\Q{end}\E", 1)
    return F.when(text.rlike(rf"(?s)\Q{begin}\E.*?\Q{end}\E"), F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def section(text: Column, heading: str, begin: str | None = None, end: str | None = None) -> Column:
    """A delimited section, else the text under its second-level heading, else ''."""
    under = F.regexp_extract(text, rf"(?ms)^##\s+{heading}\s*$(.*?)(?=^##\s+\S|\z)", 1)
    plain = F.regexp_replace(under, r"^\s+|\s+$", "")
    if begin is None or end is None:
        return plain
    marked = F.regexp_replace(between(text, begin, end), rf"(?m)^##\s+{heading}\s*$\n?", "")
    return F.coalesce(F.regexp_replace(marked, r"^\s+|\s+$", ""), plain)


def without_front_matter(text: Column, marker: str) -> Column:
    bare = F.regexp_replace(text, rf"^\Q{marker}\E[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", ""), r"^\n+", "")


def paragraphs(body: Column, least: int = 120) -> Column:
    """Blocks between blank lines of at least ``least`` characters; a block that is one table cell is prose."""
    clean = F.regexp_replace(F.regexp_replace(body, r"(?md)^<!--[ \t]*source:[^\n]*?-->[ \t]*$", ""), r"(?md)^[ \t]*-{3,}[ \t]*$", "")
    blocks = F.transform(F.split(clean, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    prose = F.transform(blocks, lambda b: F.when(b.rlike(r"^\|[^|\n]*[^|\n\s:\-][^|\n]*\|$"), F.trim(F.regexp_replace(b, r"^\||\|$", ""))).otherwise(b))
    return F.filter(prose, lambda b: F.length(b) >= least)
