"""Documents into chunks under a token target, with the heading path each chunk starts under.

Segments are headings, fences, paragraphs and blank lines with their character spans in text with LF line ends. They
are packed greedily by their token estimates; headings annotate and never force a break; a paragraph or fence at or
over the target stands alone; the tail of the chunk before is repeated in front and is not counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "struct<text:string,char_start:int,char_end:int,headings:array<string>,token_estimate:int>"
MARKDOWN_KINDS = ("markdown", "html", "pdf")
_TITLE = re.compile(r"^(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_RUN = re.compile(r"^(`{3,}|~{3,})")


def rough(text: str) -> int:
    return max(1, len(text) // 4)


@dataclass
class Segment:
    kind: str
    start: int
    end: int
    level: int = 0
    title: str = ""


def segments(text: str, markdown: bool) -> list[Segment]:
    """The segments of a text whose line ends are LF; together they cover it."""
    out: list[Segment] = []
    at = 0
    open_run: str | None = None
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        end = min(at, len(text))
        last = out[-1] if out else None
        if open_run is not None:
            last.end = end
            if (m := _RUN.match(line)) and line.startswith(open_run):
                open_run = None
        elif not line.strip():
            out.append(Segment("blank", start, end))
        elif markdown and (m := _TITLE.match(line)):
            out.append(Segment("heading", start, end, len(m[1]), m[2] or ""))
        elif markdown and (m := _RUN.match(line)):
            open_run = m[1]
            out.append(Segment("code", start, end))
        elif last is not None and last.kind == "paragraph" and last.end == start:
            last.end = end
        else:
            out.append(Segment("paragraph", start, end))
    return out


@dataclass
class _Path:
    """Headings in force: one per level, a new one ends all deeper ones; a heading without text changes nothing."""

    by_level: dict[int, str] = field(default_factory=dict)

    def see(self, level: int, title: str) -> None:
        if title.strip():
            self.by_level = {k: v for k, v in self.by_level.items() if k < level} | {level: title}

    def now(self) -> list[str]:
        return [self.by_level[k] for k in sorted(self.by_level)]


def tail(text: str, tokens: int, est: Callable[[str], int]) -> str:
    """The last words of a text, about ``tokens`` of them by the estimate."""
    if tokens <= 0:
        return ""
    piece = text[-6 * tokens :]
    words = [m.start() for m in re.finditer(r"(?<= )[^ ]|(?<= ) ", piece)]
    starts = [w for w in words if w < len(piece)] or [0]
    for start in starts:
        if est(piece[start:]) <= tokens:
            return piece[start:]
    return piece[starts[-1] :]


def chunks(source: str, markdown: bool = True, target: int = 500, overlap: int = 60, est: Callable[[str], int] = rough) -> list[dict]:
    """The chunks of a document."""
    text = source.replace("\r\n", "\n")
    path, out = _Path(), []
    held: list[Segment] = []
    held_tokens, held_path, lead = 0, [], ""

    def put(first: Segment, last: Segment, headings: list[str]) -> None:
        nonlocal lead
        body = text[first.start : last.end].rstrip("\n")
        whole = (f"{lead}\n\n{body}" if lead else body).strip("\n")
        out.append({"text": whole, "char_start": first.start, "char_end": last.end, "headings": headings, "token_estimate": est(whole)})
        lead = tail(whole, overlap, est)

    def flush() -> None:
        nonlocal held, held_tokens
        solid = [s for s in held if s.kind != "blank"]
        if solid:
            put(solid[0], solid[-1], held_path)
        held, held_tokens = [], 0

    for segment in segments(text, markdown):
        if segment.kind == "heading":
            path.see(segment.level, segment.title)
        size = est(text[segment.start : segment.end])
        alone = segment.kind in ("code", "paragraph") and size >= target
        if alone or (held and held_tokens + size > target):
            flush()
        if alone:
            put(segment, segment, path.now())
            continue
        if not held:
            held_path = path.now()
        held.append(segment)
        held_tokens += size
    flush()
    return out


def chunked(docs: DataFrame, path_col: str = "kb_path", kind_col: str = "source_kind", text_col: str = "text", target: int = 500, overlap: int = 60, est: Callable[[str], int] = rough, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(kb_path, source_kind, chunk_index, text, char_start, char_end, headings, token_estimate, <keep>)``.

    A map over the documents: no shuffle. Null texts have no chunks; an estimator can be injected. Columns to keep are
    carried along with each chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, kind, k, *c.values(), *kept)
                for path, kind, text, *kept in zip(batch["kb_path"], batch["source_kind"], batch["text"], *[batch[c] for c in keep])
                for k, c in enumerate(chunks(text, kind in MARKDOWN_KINDS, target, overlap, est) if text else [])
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["kb_path", "source_kind", "chunk_index", "text", "char_start", "char_end", "headings", "token_estimate", *keep])

    schema = "kb_path string, source_kind string, chunk_index int, text string, char_start int, char_end int, headings array<string>, token_estimate int" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(path_col).cast("string").alias("kb_path"), F.col(kind_col).alias("source_kind"), F.col(text_col).alias("text"), *keep).mapInPandas(run, schema)


def register_chunker(spark, name: str = "chunk_document") -> None:
    """The chunker as a table function for SQL: ``SELECT … FROM docs, LATERAL chunk_document(text, kind, 500, 60)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, text string, char_start int, char_end int, headings array<string>, token_estimate int")
    class ChunkDocument:
        def eval(self, text: str, kind: str, target: int, overlap: int):
            for k, c in enumerate(chunks(text, kind in MARKDOWN_KINDS, target, overlap) if text else []):
                yield k, c["text"], c["char_start"], c["char_end"], c["headings"], c["token_estimate"]

    spark.udtf.register(name, ChunkDocument)
