"""The active set of a session: which packets stay loaded under a token budget.

Admission is first in, first out by first load: asking again for a loaded packet does not move it. One transition
function serves the batch fold and the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import figures, id_list, loaded_json, mime_of, well_formed_ids

BUDGET = 32_000
DELTA = "session string, call_no long, loaded array<string>, evicted array<string>, active_after array<string>, redundant boolean, error_ids array<string>, error_reason string"


@dataclass
class Plan:
    after: list[str]
    evicted: list[str] = field(default_factory=list)
    to_load: list[str] = field(default_factory=list)
    error_id: str | None = None
    error_reason: str | None = None


def plan(active: list[str], requested: list[str], tokens: dict[str, int], budget: int = BUDGET) -> Plan:
    """What a request does to an active set. An unknown id or a request that cannot fit changes nothing."""
    unknown = [p for p in requested if p not in tokens]
    if unknown:
        return Plan(list(active), error_id=unknown[0], error_reason="unknown_packet_id")
    new = [p for p in dict.fromkeys(requested) if p not in active]
    # the last mention of an id is its place
    both = active + new
    line = [p for i, p in enumerate(both) if p not in both[i + 1 :]]
    sizes = [tokens.get(p, 0) for p in line]
    keep_from, room = len(line), budget
    while keep_from and sizes[keep_from - 1] <= room:
        keep_from -= 1
        room -= sizes[keep_from]
    first_new = line.index(new[0]) if new else len(line)
    if keep_from > first_new:
        return Plan(list(active), error_id=new[0], error_reason="budget_exceeded")
    return Plan(line[keep_from:], line[:keep_from], new)


def eviction_plan(calls: DataFrame, catalog: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The same for many independent calls, without Python: ``calls(call_id, active, requested)``, ``catalog(id, tokens)``.

    The survivors are the longest suffix of active and new ids that fits: a running sum from the end. Gives
    ``(call_id, after, evicted, to_load, error_id, error_reason)``.
    """
    ids = calls.select("call_id", "active", "requested", F.array_distinct(F.concat("active", F.array_except("requested", "active"))).alias("line"))
    rows = ids.select("call_id", F.posexplode_outer("line").alias("pos", "id"), "active", "requested")
    sized = rows.join(catalog.select("id", "tokens"), "id", "left")
    behind = Window.partitionBy("call_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fresh = ~F.array_contains("active", F.col("id"))
    sized = sized.withColumn("__behind", F.sum(F.coalesce("tokens", F.lit(0))).over(behind)).withColumn("__new", fresh & F.col("id").isNotNull())
    item = F.struct("pos", "id", "__behind", "__new", (F.col("__new") & F.col("tokens").isNull()).alias("unknown"))
    line = F.array_sort(F.collect_list(item))  # the ids of one call
    per = sized.groupBy("call_id").agg(F.first("active").alias("active"), F.first("requested").alias("requested"), F.filter(line, lambda x: x["id"].isNotNull()).alias("line"))
    names = lambda c: F.transform(c, lambda x: x["id"])
    unknown = F.filter("requested", lambda r: F.exists("line", lambda x: (x["id"] == r) & x["unknown"]))
    new = F.filter("line", lambda x: x["__new"])
    too_big = (F.size(new) > 0) & (F.get(new, F.lit(0))["__behind"] > budget)
    error = F.when(F.size(unknown) > 0, "unknown_packet_id").when(too_big, "budget_exceeded")
    failed = error.isNotNull()
    none = F.array().cast("array<string>")
    return per.select(
        "call_id",
        F.when(failed, F.col("active")).otherwise(names(F.filter("line", lambda x: x["__behind"] <= budget))).alias("after"),
        F.when(failed, none).otherwise(names(F.filter("line", lambda x: x["__behind"] > budget))).alias("evicted"),
        F.when(failed, none).otherwise(names(new)).alias("to_load"),
        F.when(F.size(unknown) > 0, F.get(unknown, F.lit(0))).when(too_big, F.get(new, F.lit(0))["id"]).alias("error_id"), error.alias("error_reason"),
    )


def reconciled(active: Column, claimed: Column) -> Column:
    """``struct<effective,drift>``: what was loaded keeps its order, what is claimed beside it follows.

    ``drift`` says how a claim differs from that: in ``membership`` or only in ``order``; null where it does not, or claims nothing.
    """
    effective = F.array_distinct(F.concat(active, claimed))
    same = (F.size(F.array_except(effective, claimed)) == 0) & (F.size(F.array_except(claimed, effective)) == 0)
    drift = F.when((F.size(claimed) > 0) & (claimed != effective), F.when(same, "order").otherwise("membership"))
    return F.struct(effective.alias("effective"), drift.alias("drift"))


def step(active: list[str], claimed: list[str], requested: list[str], tokens: dict[str, int], budget: int, present: frozenset[str] | None = None) -> tuple[list[str], dict]:
    """One call of a session: known order and new claims, redundancy, unknown ids beside those that load.

    Ids that the catalog names and ``present`` lacks are stale: they take their place, but nothing is loaded for them.
    """
    line = list(dict.fromkeys([*active, *claimed]))
    wanted = list(dict.fromkeys(requested))
    out = {"loaded": [], "evicted": [], "redundant": bool(wanted) and all(p in line for p in wanted), "error_ids": [], "error_reason": None}
    if out["redundant"]:
        return line, out
    unknown = [p for p in wanted if p not in tokens]
    known = [p for p in wanted if p in tokens]
    if unknown:
        out |= {"error_ids": unknown, "error_reason": "unknown_packet_id"}
    if known:
        found = plan(line, known, tokens, budget)
        if found.error_reason:
            out |= {"error_ids": [*out["error_ids"], found.error_id], "error_reason": found.error_reason}
        else:
            line = found.after
            gone = [p for p in found.to_load if present is not None and p not in present]
            out |= {"loaded": [p for p in found.to_load if p not in gone], "evicted": found.evicted}
            if gone:
                out |= {"error_ids": [*out["error_ids"], *gone], "error_reason": out["error_reason"] or "stale_catalog"}
    return line, out


def session_fold(calls: DataFrame, tokens: dict[str, int], budget: int = BUDGET, present: frozenset[str] | None = None) -> DataFrame:
    """Deltas of all sessions' calls in order: ``calls(session, call_no, claimed, requested)``.

    A session's calls come one after the other by nature; sessions are spread by key, and a session's rows reach its
    task in order as an iterator, so none is gathered whole. ``tokens`` is the catalog of one knowledge base.
    """
    held = calls.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple[str | None, list[str]] = (None, [])
        for batch in batches:
            out = []
            for session, call_no, claimed, requested in zip(batch["session"], batch["call_no"], batch["claimed"], batch["requested"]):
                active = state[1] if state[0] == session else []
                active, d = step(active, list(claimed) if claimed is not None else [], list(requested) if requested is not None else [], held.value, budget, present)
                state = (session, active)
                out.append((session, call_no, d["loaded"], d["evicted"], list(active), d["redundant"], d["error_ids"], d["error_reason"]))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTA.split(", ")])

    ordered = calls.select("session", F.col("call_no").cast("long").alias("call_no"), "claimed", "requested").repartition("session").sortWithinPartitions("session", "call_no")
    return ordered.mapInPandas(run, DELTA)


def redundant_rates(deltas: DataFrame) -> DataFrame:
    """``(session, calls, redundant, rate)`` of the deltas of sessions."""
    out = deltas.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.count_if("redundant").alias("redundant"))
    return out.withColumn("rate", F.bround(F.col("redundant") / F.col("calls"), 3))


def preloaded(starts: DataFrame, catalog: DataFrame, budget: int = BUDGET) -> DataFrame:
    """What sessions start with: known ids in one call, unknown ones passed over. ``starts(session, ids)``, ``catalog(id, tokens)``.

    Gives ``(session, requested, skipped_unknown, loaded, tokens_used, budget_exceeded)``; a session that exceeds the
    budget must not start.
    """
    rows = starts.select("session", F.posexplode_outer("ids").alias("pos", "id"))
    known = rows.join(catalog.select("id", "tokens"), "id", "left")
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep & F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"])
    per = known.groupBy("session").agg(ordered(F.col("tokens").isNotNull()).alias("requested"), ordered(F.col("tokens").isNull()).alias("skipped_unknown"))
    none = F.array().cast("array<string>")
    plans = eviction_plan(per.select(F.col("session").alias("call_id"), none.alias("active"), "requested"), catalog, budget)
    used = plans.select("call_id", F.explode("after").alias("id")).join(catalog.select("id", "tokens"), "id").groupBy("call_id").agg(F.sum("tokens").alias("tokens_used"))
    done = plans.join(used, "call_id", "left").select(F.col("call_id").alias("session"), F.col("to_load").alias("loaded"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce(F.col("error_reason") == "budget_exceeded", F.lit(False)).alias("budget_exceeded"))
    return per.join(done, "session")


def tool_outcomes(calls: DataFrame) -> DataFrame:
    """What becomes of tool calls ``(turn_id, call_no, name, arguments)``; arguments are a model's JSON text.

    ``outcome`` is load, catalog (it stands in the prompt already) or unknown; loads have their ids, whether the ids came
    in another form than asked for, and whether the turn had loaded before, which is what a reminder answers.
    """
    args = loaded_json(F.col("arguments"))
    raw = F.get_json_object(args, "$.requested_packet_ids")
    load = F.col("name") == "check_and_load_kb"
    outcome = F.when(load, "load").when(F.col("name") == "get_catalog", "catalog").otherwise("unknown")
    nth = F.sum(load.cast("int")).over(Window.partitionBy("turn_id").orderBy("call_no"))  # the calls of one turn
    return calls.select(
        "turn_id", "call_no", "name", outcome.alias("outcome"), F.when(load, id_list(raw)).alias("requested"), F.left(F.coalesce(F.get_json_object(args, "$.context"), F.lit("")), F.lit(512)).alias("context"),
        (load & ~well_formed_ids(raw)).alias("malformed"), (load & (nth > 1)).alias("reminder"),
    )


def merged_calls(calls: DataFrame) -> DataFrame:
    """Load calls of one message as one: ids and contexts at first appearance. ``calls(message_id, call_no, context, requested, active)``."""
    rows = F.array_sort(F.collect_list(F.struct("call_no", "context", "requested", "active")))
    flat = lambda c: F.array_distinct(F.flatten(F.transform(rows, lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    contexts = F.array_distinct(F.filter(F.transform(rows, lambda x: F.trim(x["context"])), lambda x: x != ""))
    return calls.groupBy("message_id").agg(F.array_join(contexts, "; ").alias("context"), flat("requested").alias("requested"), flat("active").alias("active"), F.count(F.lit(1)).alias("calls"))


def packets(documents: DataFrame, images: DataFrame) -> DataFrame:
    """``(id, blocks)``: a header, the content, then the images by name."""
    block = lambda kind, text, mime, name: F.struct(F.lit(kind).alias("kind"), text.alias("text"), mime.alias("mime"), name.alias("filename"))
    none = F.lit(None).cast("string")
    pics = images.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("filename")), lambda f: block("image", none, mime_of(f), f)).alias("pics"))
    text = F.array(block("text", F.concat(F.lit("# "), "title", F.lit(" ("), "id", F.lit(")\n\n"), "content"), none, none))
    return documents.join(pics, "id", "left").select("id", F.when(F.col("pics").isNull(), text).otherwise(F.concat(text, "pics")).alias("blocks"))


def stored(paths: DataFrame, artefacts: DataFrame, assets: DataFrame) -> DataFrame:
    """The storage of a knowledge base as a join: ``paths(path)`` with ``has_compiled``, ``compiled`` and the names of ``assets(path, name)``."""
    names = assets.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("assets"))  # of one folder
    both = paths.join(artefacts.select("path", F.col("text").alias("compiled")), "path", "left").join(names, "path", "left")
    return both.withColumn("has_compiled", F.col("compiled").isNotNull()).withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))


def unsupported_figures(answer: Column, asker: Column, tool_text: Column, today: Column) -> Column:
    """Figures of an answer that neither the packets seen, the asker nor the date hold."""
    known = F.array_union(F.array_union(figures(tool_text), figures(asker)), figures(today.cast("string")))
    return F.array_except(figures(answer), known)


def grounding_checks(turns: DataFrame, today: Column) -> DataFrame:
    """Per conversation and assistant turn, whether the answer is withheld: nothing loaded yet, or figures from nowhere.

    ``turns(conv_id, turn, role, text)`` with roles user, tool, assistant. What was said before counts, all of it.
    """
    found = figures(F.col("text"))
    # the first turn that holds a figure is enough, so nothing grows along a conversation
    first = turns.where(F.col("role") != "assistant").select("conv_id", "turn", F.explode(found).alias("figure")).groupBy("conv_id", "figure").agg(F.min("turn").alias("since"))
    loaded = turns.where(F.col("role") == "tool").groupBy("conv_id").agg(F.min("turn").alias("loaded"))
    answers = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.explode_outer(F.array_except(found, figures(today.cast("string")))).alias("figure"))
    checked = answers.join(first, ["conv_id", "figure"], "left").join(loaded, "conv_id", "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("figure").isNotNull() & (F.col("since").isNull() | (F.col("since") > F.col("turn"))), F.col("figure"))))
    rows = checked.groupBy("conv_id", "turn").agg(missing.alias("unsupported"), F.coalesce(F.max(F.col("loaded") <= F.col("turn")), F.lit(False)).alias("any"))
    reason = F.when(~F.col("any"), "nothing_loaded").when(F.size("unsupported") > 0, "unsupported_figures")
    return rows.select("conv_id", "turn", "unsupported", reason.alias("withheld"))


def coerced_ids(raw: object) -> list[str]:
    """An argument that should be a list of ids, as one: JSON text, plain text, nested lists; an object gives none."""
    if raw is None or isinstance(raw, dict):
        return []
    if isinstance(raw, (list, tuple, set)):
        return list(dict.fromkeys(i for x in raw for i in coerced_ids(x)))
    text = str(raw).strip().strip(",").strip()
    if text[:1] in "[{" and text:
        try:
            parsed = json.loads(text)
        except json.JSONDecodeError:
            parsed = None
        if parsed is not None:
            return coerced_ids(parsed)
    parts = (p.strip("[]").strip("\"'").strip() for p in text.replace(",", " ").split())
    return list(dict.fromkeys(p for p in parts if p))
