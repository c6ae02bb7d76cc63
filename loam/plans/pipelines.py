"""The three lines of work end to end: question to context, tree to catalog, evaluation to report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import expanded
from loam.operators import evalrun, retrieval, tree


@dataclass
class Retrieved:
    hits: DataFrame
    spans: DataFrame
    context: DataFrame


def retrieve(kb: DataFrame, questions: DataFrame, vectors: list[tuple[str, list[float]]], k: int = 8, budget: int = 6000, how: str = "rrf", aliases: dict[str, str] | None = None, metric: str = "l2") -> Retrieved:
    """Questions ``(query_id, query)`` against an index: expand, two legs, fuse, merge neighbours, fit the budget, format."""
    asked = questions.withColumn("query", expanded(F.col("query"), aliases or {}))
    n = retrieval.over_fetch(k)
    near = retrieval.vector_top_k(kb, vectors, n, metric=metric)
    text = retrieval.bm25_top_k(kb, asked, n)
    fused = retrieval.fused(near, text, how, k)
    columns = ("id", "kb_path", "chunk_index", "text", "headings", "token_estimate", "source_kind", "image_path")
    hits = kb.select(*columns).join(fused, "id")
    spans = retrieval.budget_cap(retrieval.merged_adjacent(hits), budget)
    return Retrieved(hits, spans, retrieval.context(spans.where("kept")))


def build_catalog(files: DataFrame) -> DataFrame:
    """``files(segments, name, text, link_position)`` to catalog rows with kind and roll-ups, one per folder with content."""
    documents = tree.folder_documents(files)
    kinds = tree.folder_kinds(files)
    rolled = tree.subtree_rollup(kinds.select("segments"))
    return tree.catalog(documents).join(kinds.select("segments", "kind"), "segments").join(rolled, "segments").join(documents.select("segments", "tokens"), "segments")


def evaluate(rows: DataFrame, spec: str | None, results: DataFrame, baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """Selection, merge, report and baseline of one run."""
    chosen = evalrun.selected_by_ids(rows, spec) if spec else rows.withColumn("run", F.lit(True))
    out = evalrun.merged(chosen, results)
    made = {"rows": out, "scope": evalrun.scope_summary(out), "report": evalrun.report(out), "by_kind": evalrun.by_kind(out)}
    if baseline is not None:
        made |= {"deltas": evalrun.baseline_deltas(out, baseline), "kind_deltas": evalrun.baseline_by_kind(out, baseline)}
    return made
