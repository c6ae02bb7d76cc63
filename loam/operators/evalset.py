"""Question sets: how many of each kind, from which packets, for whom, and which drafts are accepted.

Choices are by a seeded hash of the ids, so a run can be repeated on any cluster; there is no generator state.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import EXAM_TELLS, data_url, exam_tell, in_subtree, is_grounded, mime_of, parent_id, question_id
from loam.operators.calls import json_object
from loam.operators.ranking import PER_BLOCK, placed
from loam.session import bounded_rows, small

PER_RING = 100_000
ROSTER = 10_000  # personas are a short list; more is a mistake
KINDS = ("simple", "medium", "complex", "hard-1", "hard-2")


def split_total(total: int) -> dict[str, int]:
    """A total over the five kinds; the remainder goes to the first ones."""
    if total < 0:
        raise ValueError("a total cannot be negative")
    base, more = divmod(total, len(KINDS))
    return {kind: base + (i < more) for i, kind in enumerate(KINDS)}


def quota(spark: SparkSession, total: int) -> DataFrame:
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(split_total(total).items())], "kind_pos int, kind string, n int")


def eligible(kind: Column, paragraphs: Column, assets: Column) -> Column:
    """Whether a packet can carry a question of a kind: images for hard-2, three paragraphs for complex, one for the rest."""
    n = F.coalesce(F.size(F.filter(paragraphs, lambda p: p.isNotNull())), F.lit(0))
    return F.when(kind == "hard-2", F.coalesce(F.size(assets), F.lit(0)) > 0).when(kind == "complex", n >= 3).otherwise(n >= 1)


def feasibility(packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(kind, n, allowed, reason)``: hard-2 at most one per packet with images; hard-1 needs two packets, complex one with three paragraphs."""
    counts = packets.agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.size("assets") > 0).alias("with_images"), F.count_if(F.size("paragraphs") >= 3).alias("with_three"), F.count_if(F.size("paragraphs") >= 1).alias("with_one")
    )
    rows = wanted.crossJoin(F.broadcast(counts))  # one row
    allowed = (
        F.when(F.col("kind") == "hard-2", F.least("n", F.col("with_images").cast("int"))).when((F.col("kind") == "hard-1") & (F.col("packets") < 2), 0)
        .when((F.col("kind") == "complex") & (F.col("with_three") == 0), 0).when(F.col("with_one") == 0, 0).otherwise(F.col("n"))
    )
    reason = (
        F.when(F.col("allowed") >= F.col("n"), None).when(F.col("kind") == "hard-2", "too few packets with images").when(F.col("kind") == "hard-1", "fewer than two packets")
        .when(F.col("kind") == "complex", "no packet with three paragraphs").otherwise("no packet with a paragraph")
    )
    return rows.withColumn("allowed", allowed.cast("int")).select("kind", "n", "allowed", reason.cast("string").alias("reason"))


def seeded(seed: int, *parts: Column) -> Column:
    """A repeatable order: hex of a hash, the same in every engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def sampled_packets(packets: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """``(kind, item, id)``: packets for each kind without repeats until all eligible ones are used, then from the start again."""
    asked = [(r["kind"], r["n"]) for r in bounded_rows(wanted.where(F.col("n") > 0).select("kind", "n"), 100, "kinds")]
    if not asked:
        return packets.limit(0).select(F.lit("").alias("kind"), F.lit(0).alias("item"), "id")
    most = max(n for _, n in asked)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in asked])
    pool = packets.select("id", "paragraphs", "assets", F.explode(kinds).alias("k")).select("id", "paragraphs", "assets", "k.*").where(eligible(F.col("kind"), F.col("paragraphs"), F.col("assets")))
    pool = pool.select("kind", "n", "id", seeded(seed, F.col("kind"), F.col("id")).alias("h"))
    # the first of each hash range, then the first of those: no kind's pool is gathered in one task
    part = Window.partitionBy("kind", F.substring("h", 1, 2)).orderBy("h", "id")
    front = pool.withColumn("place", F.row_number().over(part)).where(F.col("place") <= most)
    ranked = front.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("h", "id"))).where(F.col("place") <= F.col("n")).select("kind", "n", "id", "place")
    sizes = ranked.groupBy("kind").agg(F.max("place").alias("size"))
    slots = wanted.where(F.col("n") > 0).select("kind", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("item"))
    turn = slots.join(sizes, "kind").withColumn("place", F.pmod(F.col("item") - 1, F.col("size")) + 1)
    return turn.join(ranked.select("kind", "place", "id"), ["kind", "place"]).select("kind", "item", "id")


def biased(pool: DataFrame, topics: Column) -> DataFrame:
    """Packets under a persona's topics, or the whole pool where none is. ``pool(persona_id, id, …)``; a bias, never a filter."""
    match = F.coalesce(F.exists(topics, lambda t: in_subtree(F.col("id"), t)), F.lit(False))
    rows = pool.withColumn("__match", match)
    some = F.bool_or("__match").over(Window.partitionBy("persona_id", "kind"))
    return rows.withColumn("__some", some).where(~F.col("__some") | F.col("__match")).drop("__some", "__match")


def chosen_paragraphs(paragraphs: Column, n: int, key: Column, seed: int = 0) -> Column:
    """Places of ``n`` paragraphs of a packet, ascending; all if there are fewer."""
    tagged = F.transform(paragraphs, lambda p, i: F.struct(seeded(seed, key, i.cast("string")).alias("h"), i.alias("i")))
    return F.array_sort(F.transform(F.slice(F.array_sort(tagged), 1, n), lambda x: x["i"]))


def pair_quota(a: Column, b: Column) -> Column:
    """How many paragraphs of two packets make three: two of the first and one of the second, shifted where one is short."""
    take_a = F.least(F.lit(2), a)
    take_b = F.least(3 - take_a, b)
    again_a = F.when(take_a + take_b < 3, F.least(3 - take_b, a)).otherwise(take_a)
    return F.struct(again_a.alias("a"), take_b.alias("b"))


def paired(packets: DataFrame, seed: int = 0) -> DataFrame:
    """``(id, other)``: each packet with a sibling under the same parent if it has one, else with any other.

    Siblings stand in rings by their hash and each takes the next, so no pair list is built; a parent of very many
    has several rings. Those without siblings get a stand-in.
    """
    rows = packets.select("id", parent_id(F.col("id")).alias("parent"), seeded(seed, F.col("id")).alias("h"))
    rings = rows.groupBy("parent").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / PER_RING)).cast("int").alias("rings"))
    rows = rows.join(rings, "parent").withColumn("ring", F.pmod(F.xxhash64("id"), F.col("rings")))
    ring = Window.partitionBy("parent", "ring").orderBy("h", "id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = rows.withColumn("other", F.coalesce(F.lead("id").over(ring), F.first("id").over(whole)))
    alone = near.where(F.col("other") == F.col("id")).select("id", "h", "parent")
    spare = rows.agg(F.min_by("id", "h").alias("x"), F.max_by("id", "h").alias("y"))  # two stand-ins
    far = alone.crossJoin(F.broadcast(spare)).select("id", F.when(F.col("x") != F.col("id"), F.col("x")).otherwise(F.nullif("y", "id")).alias("other"))
    return near.where(F.col("other") != F.col("id")).select("id", "other").unionByName(far)


def round_robin(items: DataFrame, personas: DataFrame, pos: str = "item") -> DataFrame:
    """Item i of a kind, by the number ``pos``, goes to persona i mod P, in roster order."""
    roster = [r["persona_id"] for r in bounded_rows(personas.orderBy("pos").select("persona_id"), ROSTER, "personas")]
    if not roster:
        return items.withColumn("persona_id", F.lit(None).cast("string"))
    seats = F.array(*[F.lit(p) for p in roster])
    seated = placed(items, ["kind"], pos, "__i")
    return seated.withColumn("persona_id", F.element_at(seats, (F.pmod(F.col("__i") - 1, F.lit(len(roster))) + 1).cast("int"))).drop("__i")


def matched(items: DataFrame, personas: DataFrame) -> DataFrame:
    """Every item for every persona: the same grounding, so their answers compare. The roster is a short list."""
    return items.join(small(personas.select("persona_id", "pos"), ROSTER, "personas"), F.lit(True))


def drafts_checked(drafts: DataFrame) -> DataFrame:
    """``reason`` a draft is rejected for, or null. ``drafts(question, expected_answer, body, persona_mismatch, cited, needed)``."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(~blank("persona_mismatch"), "persona_mismatch").when(blank("question") | blank("expected_answer"), "incomplete").when(exam_tell(F.col("question")).isNotNull(), "exam_framing")
        .when(~is_grounded(F.col("expected_answer"), F.col("body")), "not_grounded").when(F.size(F.array_except("needed", "cited")) > 0, "citation")
    )
    return drafts.withColumn("reason", reason.cast("string"))


def first_valid(drafts: DataFrame, key: list[str]) -> DataFrame:
    """Of several attempts the first accepted one."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("attempt"))
    return drafts.where(F.col("reason").isNull()).withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def framing(name: Column, description: Column) -> Column:
    """Who asks, as a prompt says it; nothing where nobody is named."""
    text = F.concat(F.lit("You are "), name, F.lit(". "), F.coalesce(description, F.lit("")))
    return F.when(name.isNull() | (F.trim(name) == ""), F.lit("")).otherwise(F.trim(text))


def image_block(content: Column, name: Column) -> Column:
    """An image as a message block: its kind and a data address."""
    return F.struct(F.lit("image_url").alias("type"), data_url(content, mime_of(name)).alias("url"))


def stub_draft(kind: str, packet: dict, other: dict | None, picked: list[str], asked_by: str) -> str:
    """The offline stand-in for a generator: JSON that repeats what the item is grounded in."""
    return json.dumps({
        "question": f"What is said about {packet['title']}?", "expected_answer": " ".join(picked), "cited_paragraph_indices": list(range(len(picked))),
        "cited_packet_ids": [packet["id"], *([other["id"]] if other else [])], "image_reference": (packet["assets"] or [""])[0],
    }, ensure_ascii=False)


GENERATED = "kind string, item int, id string, other string, persona_id string, question string, expected_answer string, attempts int, reason string, error string"
#: Characters of a packet and of a paragraph that a prompt holds.
MOST_CONTENT = {"simple": 20_000, "medium": 6_000, "hard-2": 15_000}


def generated(slots: DataFrame, packets: DataFrame, generate: Callable[..., str] = stub_draft, attempts: int = 3, seed: int = 0) -> DataFrame:
    """One draft for each of ``slots(kind, item, ids, other, persona_id, framing)``, tried up to ``attempts`` times.

    ``ids`` are packets in the order they are tried: content that a persona would not ask about is left for the next one,
    any other fault is tried again. A draft's checks are those of its kind: two texts, three paragraphs cited, both
    packets cited, an image named; exam framing counts only where somebody asks. ``generate(kind, packet, other, picked,
    framing)`` gives a model's JSON. A slot without a sound draft keeps its reason: no_eligible_packet,
    persona_content_mismatch, exam_framing or validation_failed_or_llm_error.
    """
    body = F.struct("id", "title", "body", "paragraphs", "assets")
    wanted = slots.select("kind", "item", "other", "persona_id", "framing", F.posexplode_outer("ids").alias("try_no", "id"))
    held = packets.select("id", body.alias("packet"))
    tries = wanted.join(held, "id", "left").groupBy("kind", "item", "other", "persona_id", "framing").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("packet").isNotNull(), F.struct("try_no", "packet")))), lambda x: x["packet"]).alias("packets"))  # as many as attempts
    both = tries.join(held.select(F.col("id").alias("other"), F.col("packet").alias("second")), "other", "left")

    def plain(packet) -> dict | None:
        """A packet with lists where Arrow has arrays or nothing."""
        if packet is None or not isinstance(packet, dict):
            return None
        return {**packet, **{c: [] if packet[c] is None else list(packet[c]) for c in ("paragraphs", "assets")}}

    def chosen(packet: dict, n: int) -> list[str]:
        texts = packet["paragraphs"]
        order = sorted(range(len(texts)), key=lambda i: (hashlib.sha256(f"{seed}|{packet['id']}|{i}".encode()).hexdigest(), i))
        return [texts[i] for i in sorted(order[:n])]

    def grounding(kind: str, packet: dict, other: dict | None) -> list[str] | None:
        if kind in ("simple", "hard-2"):
            return None if kind == "hard-2" and not packet["assets"] else [(packet["body"] or "")[: MOST_CONTENT[kind]]]
        own = len(packet["paragraphs"])
        if kind == "medium":
            return [p[: MOST_CONTENT[kind]] for p in chosen(packet, 1)] or None
        if kind == "complex":
            return chosen(packet, 3) if own >= 3 else None
        if other is None:
            return None
        theirs = len(other["paragraphs"])
        take_a = min(2, own)
        take_b = min(3 - take_a, theirs)
        take_a = min(3 - take_b, own) if take_a + take_b < 3 else take_a
        return [*chosen(packet, take_a), *chosen(other, take_b)] if take_a + take_b >= 3 else None

    def fault(kind: str, data: dict, packet: dict, other: dict | None, asked_by: str) -> tuple[str, str]:
        if str(data.get("persona_mismatch") or "").strip():
            return "persona_content_mismatch", str(data["persona_mismatch"]).strip()
        question = str(data.get("question") or "").strip()
        if not question or not str(data.get("expected_answer") or "").strip():
            return "validation_failed_or_llm_error", "missing question or expected_answer"
        if kind == "complex" and len({i for i in data.get("cited_paragraph_indices") or [] if isinstance(i, int)}) < 3:
            return "validation_failed_or_llm_error", "fewer than three paragraphs cited"
        if kind == "hard-1" and not {packet["id"], other["id"]} <= set(data.get("cited_packet_ids") or []):
            return "validation_failed_or_llm_error", "not both packets cited"
        if kind == "hard-2" and not str(data.get("image_reference") or "").strip():
            return "validation_failed_or_llm_error", "no image named"
        tell = next((reason for reason, pattern in EXAM_TELLS.items() if re.search(pattern, question)), None) if asked_by else None
        return ("exam_framing", tell) if tell else ("", "")

    def one(kind: str, found: list[dict], other: dict | None, asked_by: str) -> tuple:
        at, reason, error, made = 0, "no_eligible_packet", "", 0
        while made < attempts and at < len(found):
            packet = found[at]
            picked = grounding(kind, packet, other)
            made += 1
            if picked is None:
                reason, error, at = "validation_failed_or_llm_error", "the packet cannot carry this kind", at + 1
                continue
            try:
                data = json_object(generate(kind, packet, other, picked, asked_by)) or {}
                reason, error = fault(kind, data, packet, other, asked_by)
            except Exception as wrong:  # noqa: BLE001 - a failed call is an attempt
                data, reason, error = {}, "validation_failed_or_llm_error", f"{type(wrong).__name__}: {wrong}"
            if not reason:
                return packet["id"], str(data["question"]).strip(), str(data["expected_answer"]).strip(), made, None, None
            at += reason == "persona_content_mismatch"
        return (found[min(at, len(found) - 1)]["id"] if found else None), None, None, made, reason, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                id_, question, answer, made, reason, error = one(r.kind, [plain(p) for p in r.packets], plain(r.second), r.framing or "")
                out.append((r.kind, r.item, id_, r.other, r.persona_id, question, answer, made, reason, error))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in GENERATED.split(", ")])

    return both.mapInPandas(run, GENERATED)


def resample_order(slots: DataFrame, packets: DataFrame, attempts: int, seed: int = 0) -> DataFrame:
    """``slots(kind, item, id)`` with ``ids``: the slot's packet, then the next of its kind's order, as many as attempts."""
    n = packets.agg(F.count(F.lit(1)).alias("n"))
    ranked = placed(packets.select("id", F.conv(F.substring(seeded(seed, F.col("id")), 1, 13), 16, 10).cast("long").alias("h")), [], "h", "place", per_block=1 << 44)
    spots = slots.join(ranked.select("id", "place"), "id").crossJoin(F.broadcast(n))  # one row
    later = spots.select("kind", "item", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda k: F.pmod(F.col("place") - 1 + k, F.col("n")) + 1)).alias("try_no", "place"))
    found = later.where(F.col("try_no") < F.col("n")).join(ranked.select("place", "id"), "place")
    return found.groupBy("kind", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("try_no", "id"))), lambda x: x["id"]).alias("ids"))


def deduplicated(rows: DataFrame, question: str = "question", pos: str = "pos") -> DataFrame:
    """The first of equal questions, without regard to case and outer blanks."""
    key = F.lower(F.regexp_replace(question, r"^\s+|\s+$", ""))
    first = rows.groupBy(key.alias("__key")).agg(F.min(pos).alias(pos))
    return rows.join(first.select(pos), pos, "left_semi")


def numbered(rows: DataFrame, prefix: str = "q", pos: str = "pos", per_block: int = PER_BLOCK) -> DataFrame:
    """Accepted rows with ids in ``pos`` order."""
    return placed(rows, [], pos, "__i", per_block).withColumn("question_id", question_id(prefix, F.col("__i"))).drop("__i")


def selected_personas(personas: DataFrame, flags: list[str]) -> DataFrame:
    """A subset in roster order; unknown names are an error that lists them all."""
    if not flags:
        return personas.orderBy("pos")
    asked = personas.sparkSession.createDataFrame([(i, f) for i, f in enumerate(dict.fromkeys(flags))], "flag int, persona_id string")
    missing = [r["persona_id"] for r in asked.join(personas, "persona_id", "left_anti").orderBy("flag").collect()]  # no more than were asked for
    if missing:
        raise ValueError(f"unknown personas: {', '.join(missing)}")
    return personas.join(F.broadcast(asked.select("persona_id")), "persona_id", "left_semi").orderBy("pos")
