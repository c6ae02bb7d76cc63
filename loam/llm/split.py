"""Items over a size limit, cut at natural boundaries into pieces under it, with overlap.

Method: balanced targets. The least number of pieces is computed, equal-length targets are placed, each target is
snapped to the strongest boundary near it, and a piece is added as long as any piece breaks the limit.

Defined results
- CRLF counts as LF; lengths are code points;
- null texts and texts of at most ``limit`` characters give one piece (null gives none) from ``split_all``,
  and none from ``split_oversized``;
- blank lines around a cut belong to no piece; all other characters belong to exactly one body;
- if every natural block fits the limit, all cuts lie between blocks (``boundary``); else the item is ``forced``
  and cuts inside a block fall on line ends, sentence ends, white space or, last, any character;
- the overlap of a piece is the end of the one before, at most ``overlap`` characters and never so many that the
  piece breaks the limit; it starts at a word where it can;
- repeated ids give one result each (ids carry equal texts); ties between boundaries go to the one nearest the
  target, then to the left.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 240

_FENCE = re.compile(r"(`{3,}|~{3,})")
_HEADING = re.compile(r"#{1,6}\s")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”»)\]]*\s+|[。！？]")
_SPACE = re.compile(r"\s+")

SPANS = "struct<cut:string,pieces:array<struct<piece_no:int,overlap_start:int,body_start:int,body_end:int>>>"


def natural_blocks(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, rank)`` of each block; the end leaves out the line feed after it; rank 2 marks headings."""
    blocks: list[tuple[int, int, int]] = []
    start: int | None = None
    end = at = 0
    fence: str | None = None

    def close() -> None:
        nonlocal start
        if start is not None:
            blocks.append((start, end, 1))
            start = None

    for line in text.split("\n"):
        stop = at + len(line)
        if fence is not None:
            end = stop
            run = _FENCE.match(line)
            if run and run.group(1) == fence:
                fence = None
                close()
        elif run := _FENCE.match(line):
            close()
            fence, start, end = run.group(1), at, stop
        elif not line.strip():
            close()
        elif _HEADING.match(line):
            close()
            blocks.append((at, stop, 2))
        else:
            start, end = (at if start is None else start), stop
        at = stop + 1
    close()
    return blocks


def _inner_cuts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places inside an oversized block where it may be cut, with their strength."""
    cuts: dict[int, int] = {}
    for m in _SPACE.finditer(text, start, end):
        cuts[m.end()] = 3 if "\n" in m.group() else 1
    for m in _SENTENCE.finditer(text, start, end):
        cuts[m.end()] = max(cuts.get(m.end(), 0), 2)
    return sorted((at, strength) for at, strength in cuts.items() if start < at < end)


def balanced_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """``cut`` and ``(overlap_start, body_start, body_end)`` of each piece of an item."""
    blocks = natural_blocks(text)
    if not blocks:
        return "boundary", []
    forced = any(end - start > limit for start, end, _ in blocks)
    # units: stretches that are never cut; a unit's strength is that of the boundary at its start
    starts, ends, strengths = [], [], []
    for start, end, rank in blocks:
        inner = _inner_cuts(text, start, end) if end - start > limit else []
        edges = [start, *(at for at, _ in inner), end]
        power = [3 + rank, *(s for _, s in inner)]
        for left, right, strength in zip(edges, edges[1:], power):
            for k, at in enumerate(range(left, right, limit)):  # runs without any white space
                starts.append(at)
                ends.append(min(at + limit, right))
                strengths.append(0 if k else strength)
    n = len(starts)

    def length(i: int, j: int) -> int:
        return ends[j - 1] - starts[i]

    def greedy(i: int) -> int:
        """The farthest unit boundary that a piece from unit i can end at."""
        return max(i + 1, bisect_right(ends, starts[i] + limit))

    needed, i = 0, 0
    while i < n:
        i, needed = greedy(i), needed + 1
    total = ends[-1] - starts[0]
    # the overlap counts toward a piece's size, so equal targets are planned with it where blocks allow
    pieces = max(needed, -(-max(1, total - overlap) // max(1, limit - overlap)))
    cuts: list[int] = []
    while True:
        cuts, at, ok = [], 0, True
        for k in range(1, pieces):
            target = starts[0] + total * k / pieces
            last = greedy(at)
            low, high = at + 1, min(last, n - 1)
            if low > high:
                ok = at >= n - 1
                break
            reach = total / pieces / 3
            near_low = max(low, bisect_left(starts, target - reach))
            near_high = min(high, bisect_right(starts, target + reach) - 1)
            if near_low > near_high:  # nothing near: the boundary closest to the target that keeps the limit
                near_low = near_high = min(max(bisect_left(starts, target), low), high)
            at = min(range(near_low, near_high + 1), key=lambda u: (-strengths[u], abs(starts[u] - target), u))
            cuts.append(at)
        if ok and all(length(i, j) <= limit for i, j in zip([0, *cuts], [*cuts, n])):
            break
        if pieces >= n:
            cuts = list(range(1, n))
            break
        pieces += 1
    out = []
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, n])):
        body, stop = starts[i], ends[j - 1]
        lead = body
        if k:
            before = ends[i - 1]
            gap = body - before  # the blank lines between the pieces count, since the piece is one stretch of text
            room = min(overlap, limit - (stop - body) - gap)
            if room > 0:
                floor = max(before - room, out[-1][1])
                word = _SPACE.search(text, floor, before) if floor > 0 and not text[floor - 1].isspace() else None
                lead = word.end() if word and word.end() < before else (floor if floor < before else body)
        out.append((lead, body, stop))
    return ("forced" if forced else "boundary"), out


def _normal(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _cutter(limit: int, overlap: int):
    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            cut, pieces = [], []
            for text in texts:
                kind, found = balanced_spans(text, limit, overlap)
                cut.append(kind)
                pieces.append([{"piece_no": k, "overlap_start": a, "body_start": b, "body_end": c} for k, (a, b, c) in enumerate(found)])
            yield pd.DataFrame({"cut": cut, "pieces": pieces})

    return spans


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple[str, ...] = (), latest: str | None = None) -> DataFrame:
    """One row per distinct oversized id: ``(id, <keep>, text, cut, pieces)``.

    Only oversized rows leave the scan, and they are made distinct before Python sees them. The kept columns are those
    of one row of the id: of the rows with most of them filled the one with the greatest ``latest``, then the greatest
    values, so that the choice does not depend on the order of rows.
    """
    long = df.select(F.col(id_col).alias("id"), _normal(F.col(text_col)).alias("text"), *[F.col(c) for c in keep], *([F.col(latest).alias("__latest")] if latest else [])).where(F.length("text") > limit)
    if keep:
        filled = sum((F.col(c).isNotNull().cast("int") for c in keep[1:]), F.col(keep[0]).isNotNull().cast("int"))
        best = F.struct(filled.alias("__filled"), *([F.col("__latest")] if latest else []), *keep)
        distinct = long.groupBy("id").agg(F.first("text").alias("text"), F.max(best).alias("__best")).select("id", "text", *[F.col("__best")[c].alias(c) for c in keep])
    else:
        distinct = long.dropDuplicates(["id"])
    cut = distinct.withColumn("__spans", _cutter(limit, overlap)("text"))
    return cut.select("id", *keep, "text", F.col("__spans.cut").alias("cut"), F.col("__spans.pieces").alias("pieces"))


def pieces_of(cut: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of what ``split_oversized`` gave, with the piece's text."""
    rows = cut.select("id", *keep, "text", "cut", F.explode("pieces").alias("p"))
    return rows.select(
        "id", *keep, "cut", F.col("p.piece_no").alias("piece_no"),
        F.substring(F.col("text"), F.col("p.overlap_start") + 1, F.col("p.body_end") - F.col("p.overlap_start")).alias("piece"),
        (F.col("p.body_start") - F.col("p.overlap_start")).alias("overlap"),
    )
