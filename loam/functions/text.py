"""Text, token, hash, JSON and formatting column functions. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_TOKENS = 1500
#: Words that carry no evidence in a grounding check.
STOPWORDS = (
    "that this then than with from into over under also more most must need when where which while what your their there these those they them will would should could been being have has had are was were "
    "the and for not but any all each per may can does depends applies apply based only same such other"
).split()
#: Exam framing in a question, by the reason given for rejecting it.
EXAM_TELLS = {
    "references the source": r"(?i)\b(?:according to|as stated (?:in|on)|as (?:described|listed|set out) (?:in|on|above)|based on the (?:document|passage|text|content|packet)|per the (?:document|guidance|passage)|in the (?:table|section|passage|document|text|packet|paragraph)s? (?:above|below|provided|shown))\b",
    "enumeration scaffolding": r"(?i)\b(?:which of the following|list (?:all|the) |name (?:all|the) (?:two|three|four|five|six)\b|state the (?:two|three|four|five|six)\b|what are the (?:two|three|four|five|six)\b|how many (?:criteria|conditions|requirements|categories|steps)\b)",
}
#: Media types by extension, and extensions by leading bytes.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
MAGIC = {"89504E470D0A1A0A": ".png", "FFD8FF": ".jpg", "474946383761": ".gif", "474946383961": ".gif", "424D": ".bmp", "52494646": ".webp", "49492A00": ".tif", "4D4D002A": ".tif"}


def rough_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def content_tokens(text: Column, images: Column) -> Column:
    return rough_tokens(text) + images * IMAGE_TOKENS


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def chunk_id(path: Column, index: Column, content_hash: Column) -> Column:
    """First 32 hex digits of the hash of path, place and content."""
    return F.substring(F.sha2(F.concat_ws("|", path, index.cast("string"), content_hash), 256), 1, 32)


def heading_prefix(text: Column, headings: Column) -> Column:
    """The heading path in front of a chunk, without the part the chunk opens with."""
    path = F.filter(F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: h.isNotNull() & (h != ""))
    first = F.trim(F.regexp_replace(F.element_at(F.split(F.ltrim(text), "\n"), 1), r"^#+", ""))
    repeated = (F.size(path) > 0) & (first != "") & (F.try_element_at(path, F.lit(-1)) == first)
    kept = F.when(repeated, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    return F.when(F.size(kept) == 0, text).otherwise(F.concat(F.array_join(kept, " > "), F.lit("\n\n"), text))


def figures(text: Column, keep_commas: bool = False) -> Column:
    """Distinct numbers of a text in order; separators at their end do not count, commas inside only if kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,.]*)"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"[.,]+$", ""))
    if not keep_commas:
        bare = F.transform(bare, lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(squeezed(text), F.lit(r"([a-z]{5,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def grounding_ratio(answer: Column, body: Column) -> Column:
    """Share of the answer's distinctive words that occur in the body; null with fewer than six of them."""
    words = content_words(answer)
    present = F.filter(words, lambda w: F.contains(squeezed(body), w))
    return F.when(F.size(words) >= 6, F.size(present) / F.size(words))


def invented_figures(answer: Column, body: Column) -> Column:
    return F.array_except(figures(squeezed(answer), keep_commas=True), figures(squeezed(body), keep_commas=True))


def is_grounded(answer: Column, body: Column, least: float = 0.6) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.size(invented_figures(answer, body)) == 0) & (F.coalesce(grounding_ratio(answer, body), F.lit(1.0)) >= least)


def exam_tell(question: Column) -> Column:
    """Why a question reads like an exam, or null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(EXAM_TELLS.items()):
        out = F.when(question.rlike(pattern), F.lit(reason)).otherwise(out)
    return out


def parent_id(id_: Column) -> Column:
    """The dotted id above, '' at the top."""
    return F.regexp_extract(id_, r"^(.*)\.[^.]*$", 1)


def in_subtree(id_: Column, topic: Column) -> Column:
    return (id_ == topic) | F.startswith(id_, F.concat(topic, F.lit(".")))


def naive_path(id_: Column) -> Column:
    """The folder a dotted id names if no folder's own name holds a dot."""
    return F.replace(id_, F.lit("."), F.lit("/"))


def loaded_json(text: Column) -> Column:
    """A model's arguments as an object's text; what is no JSON object becomes ``{}``."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(bare.rlike(r"(?s)^\{.*\}$") & F.from_json(bare, "map<string,string>").isNotNull(), bare).otherwise("{}")


def dotted_id(segments: Column) -> Column:
    return F.array_join(segments, ".")


def folder_title(name: Column) -> Column:
    return F.initcap(F.trim(F.translate(name, "-_", "  ")))


def short_name(id_: Column) -> Column:
    return F.replace(F.element_at(F.split(id_, r"\."), -1), F.lit("-"), F.lit(" "))


def question_id(prefix: str, n: Column) -> Column:
    """``prefix-0001``; numbers of five digits and more stay whole."""
    digits = n.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))


def truncated(text: Column, limit: int) -> Column:
    """Cut at the end, saying how much was cut. The wording of this note and of the two below."""
    if limit <= 0:
        return text
    note = F.concat(F.lit(f"…[truncated: showing {limit} of "), F.length(text).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), note))


def truncated_middle(text: Column, limit: int, marker: int = 60) -> Column:
    """Cut in the middle, both ends kept."""
    if limit <= marker * 2:
        return truncated(text, limit)
    half = (limit - marker) // 2
    cut = F.concat(F.left(text, F.lit(half)), F.lit("\n…["), (F.length(text) - 2 * half).cast("string"), F.lit(" chars elided from the middle]…\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def trimmed(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("\n\n[...truncated...]")))


def duration(seconds: Column) -> Column:
    """``42s``, ``3m05s``, ``1h02m``."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    m = F.floor(s / 60).cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.format_string("%dm%02ds", m, s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(m / 60).cast("long"), m % 60))
    )


def source_kind(path: Column) -> Column:
    """What a file is by its extension; null where it is nothing to index."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".txt", "text").when(ext.isin(".html", ".htm"), "html").when(ext == ".pdf", "pdf")
        .when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp"), "image")
    )


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for name, kind in MIME.items():
        out = F.when(ext == name, F.lit(kind)).otherwise(out)
    return out


def magic_ext(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(".bin")
    for magic, ext in reversed(MAGIC.items()):
        out = F.when(F.startswith(head, F.lit(magic)), F.lit(ext)).otherwise(out)
    return out


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def salvaged_json(text: Column, schema: str) -> Column:
    """A model's JSON: the whole text, or the widest braces in it."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```\w*\s*|\s*```\s*$", ""))
    whole = F.when(bare.rlike(r"(?s)^\{.*\}$"), F.from_json(bare, schema))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.when(inner != "", F.from_json(inner, schema)))


def valid_score(score: Column) -> Column:
    """0 to 3, else null."""
    return F.when(score.between(0, 3), score)


def id_list(raw: Column) -> Column:
    """Distinct ids of a JSON or plain list written as text, in order; an object gives none."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^,+|,+$", ""))
    parts = F.split(text, r"[,\s]+")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[\[\]]+|[\[\]]+$", ""), r"^[\"']+|[\"']+$", "")))
    found = F.array_distinct(F.filter(bare, lambda p: p != ""))
    return F.when(F.startswith(text, F.lit("{")), F.array().cast("array<string>")).otherwise(found)


def well_formed_ids(raw: Column) -> Column:
    """Whether a JSON argument is null or a list of strings."""
    return raw.isNull() | F.coalesce(F.trim(raw).rlike(r'^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$'), F.lit(False))


def has_marker(text: Column, marker: str, within: int = 2048) -> Column:
    return F.instr(F.substring(text, 1, within), marker) > 0


def expanded(query: Column, aliases: dict[str, str]) -> Column:
    """A query with the corpus's own names appended for the aliases it uses, as whole words, unless it names them already."""
    low = F.lower(query)
    adds = []
    for alias, name in aliases.items():
        alias, name = (alias or "").strip().lower(), (name or "").strip()
        if alias and name:
            used = low.rlike(rf"(?U)(?<!\w)\Q{alias}\E(?!\w)") & ~F.contains(low, F.lit(name.lower()))
            adds.append(F.when(used, F.lit(name)))
    if not adds:
        return query
    found = F.array_distinct(F.filter(F.array(*adds), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 0, query).otherwise(F.concat(query, F.lit(" "), F.array_join(found, " ")))
