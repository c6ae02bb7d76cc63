"""Evaluation runs: which rows run, what came back, and the scored report with its baseline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import valid_score
from loam.operators.calls import clarified, classified, judged
from loam.operators.evalset import KINDS
from loam.session import bounded_arrow

NO_PERSONA = "(unattributed)"


def completed() -> Column:
    return F.col("score").isNotNull() & (F.coalesce("actual_answer", F.lit("")) != "")


def filtered(rows: DataFrame, kinds: list[str] | None = None, personas: list[str] | None = None, skip_completed: bool = False) -> DataFrame:
    out = rows
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if personas:
        out = out.where(F.coalesce("persona", F.lit("")).isin(personas))
    return out.where(~completed()) if skip_completed else out


def parse_ids(spec: str) -> list[tuple[str, str]]:
    """``a,b..c`` as spans; a lone id is a span of itself."""
    spans = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        ends = [e.strip() for e in part.split("..")]
        if len(ends) > 2 or any(not e for e in ends) or "..." in part:
            raise ValueError(f"{part!r} is no id and no start..end span")
        spans.append((ends[0], ends[-1]))
    if not spans:
        raise ValueError("no ids to run")
    return spans


def selected_by_ids(rows: DataFrame, spec: str) -> DataFrame:
    """Rows with ``run``: whether the spec names them, spans by file position. Unknown ids are listed all at once."""
    spark = rows.sparkSession
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(parse_ids(spec))], "span int, a string, b string")
    first = rows.groupBy("question_id").agg(F.min("pos").alias("p"))
    ends = spans.join(first.select(F.col("question_id").alias("a"), F.col("p").alias("lo")), "a", "left").join(first.select(F.col("question_id").alias("b"), F.col("p").alias("hi")), "b", "left")
    named = ends.orderBy("span").collect()  # as many rows as the spec has parts
    unknown = list(dict.fromkeys(x for r in named for x, p in ((r["a"], r["lo"]), (r["b"], r["hi"])) if p is None))
    if unknown:
        raise ValueError(f"unknown question ids: {', '.join(unknown)}")
    backwards = [f"{r['a']}..{r['b']}" for r in named if r["hi"] < r["lo"]]
    if backwards:
        raise ValueError(f"spans that end before they start: {', '.join(backwards)}")
    ranges = F.broadcast(ends.select("lo", "hi"))  # as many rows as the spec has parts
    hit = rows.select("pos", "question_id").join(ranges, F.col("pos").between(F.col("lo"), F.col("hi")), "left_semi").select("question_id").distinct().withColumn("run", F.lit(True))
    return rows.join(hit, "question_id", "left").withColumn("run", F.coalesce("run", F.lit(False)))


def selected(rows: DataFrame, ids: str | None = None, kinds: list[str] | None = None, personas: list[str] | None = None, skip_completed: bool = False) -> DataFrame:
    """Rows with ``run``. Ids name the rows to run, so a second selector beside them is an error."""
    given = [name for name, used in (("kinds", kinds), ("personas", personas), ("skip_completed", skip_completed)) if used]
    if ids is not None:
        if given:
            raise ValueError(f"ids cannot be combined with {', '.join(given)}")
        return selected_by_ids(rows, ids)
    kept = filtered(rows, kinds, personas, skip_completed).select("pos").withColumn("run", F.lit(True))
    return rows.join(kept, "pos", "left").withColumn("run", F.coalesce("run", F.lit(False)))


def session_id(question_id: Column, shared: str | None = None, seed: int = 0) -> Column:
    """The session of a row's exchange: one for all if shared, else with the row's id and eight hex digits that a run repeats."""
    if shared is not None:
        return F.lit(shared)
    return F.concat(F.lit("eval-"), question_id, F.lit("-"), F.left(F.sha2(F.concat_ws("|", F.lit(str(seed)), question_id), 256), F.lit(8)))


def final_marked(turns: DataFrame) -> DataFrame:
    """The last bot turn of each conversation has the source ``bot_final``."""
    last = turns.where(F.col("role") == "bot").groupBy("conv_id").agg(F.max("turn").alias("__last"))
    both = turns.join(last, "conv_id", "left")
    final = (F.col("role") == "bot") & (F.col("turn") == F.col("__last"))
    return both.withColumn("source", F.when(final, "bot_final").otherwise(F.col("source"))).drop("__last")


def merged(rows: DataFrame, results: DataFrame, whole_file: bool = True) -> DataFrame:
    """Results on their rows; a row that ran and has none is ``[no_result]``; rows that did not run stay as they are.

    ``results(question_id, actual_answer, score, remark, turns, transcript)``; a score that is no 0 to 3 is unscored.
    """
    new = results.select("question_id", *[F.col(c).alias(f"__{c}") for c in ("actual_answer", "score", "remark", "turns", "transcript")], F.lit(True).alias("__hit"))
    both = rows.join(new, "question_id", "left")
    run, hit = F.col("run"), F.coalesce("__hit", F.lit(False))
    keep = [c for c in rows.columns if c not in ("actual_answer", "score", "remark", "turns", "transcript", "run")]
    out = both.select(
        *keep, F.when(run, F.when(hit, F.col("__actual_answer")).otherwise("[no_result]")).otherwise(F.col("actual_answer")).alias("actual_answer"),
        F.when(run, valid_score(F.col("__score"))).otherwise(F.col("score")).alias("score"), F.when(run, F.col("__remark")).otherwise(F.col("remark")).alias("remark"),
        F.when(run, F.col("__turns")).otherwise(F.col("turns")).alias("turns"), F.when(run, F.col("__transcript")).otherwise(F.col("transcript")).alias("transcript"),
        F.when(run, "executed").otherwise("inherited").alias("origin"),
    )
    return out if whole_file else out.where(F.col("origin") == "executed")


def scope_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("origin") == "executed").alias("executed"), F.count_if(F.col("origin") == "inherited").alias("inherited"), F.count_if((F.col("origin") == "inherited") & (F.coalesce("actual_answer", F.lit("")) == "")).alias("empty_inherited"))


def stats() -> list[Column]:
    """Count, scored, unscored, mean and pass rate over the scored, histogram. Nothing scored counts as 0, not as null."""
    score = F.col("score")
    return [
        F.count(F.lit(1)).alias("rows"), F.count(score).alias("scored"), F.count_if(score.isNull()).alias("unscored"), F.coalesce(F.bround(F.avg(score), 3), F.lit(0.0)).alias("mean"),
        F.coalesce(F.bround(F.count_if(score >= 2) / F.nullif(F.count(score), F.lit(0)), 3), F.lit(0.0)).alias("pass_rate"), *[F.count_if(score == i).alias(f"h{i}") for i in range(4)],
    ]


def with_persona(rows: DataFrame) -> DataFrame:
    return rows.withColumn("persona", F.coalesce(F.nullif(F.trim("persona"), F.lit("")), F.lit(NO_PERSONA)))


def report(rows: DataFrame) -> DataFrame:
    """Overall, by kind, by persona and for each cell in one pass: ``level`` is total, kind, persona or cell."""
    level = F.when(F.grouping_id() == 3, "total").when(F.grouping_id() == 1, "kind").when(F.grouping_id() == 2, "persona").otherwise("cell")
    sets = with_persona(rows).groupingSets([["kind", "persona"], ["kind"], ["persona"], []], "kind", "persona")
    return sets.agg(level.alias("level"), *stats())


def by_kind(rows: DataFrame) -> DataFrame:
    """The five kinds in order, those without rows too; other kinds count in the total only."""
    kinds = rows.sparkSession.createDataFrame(list(enumerate(KINDS)), "kind_pos int, kind string")
    found = rows.groupBy("kind").agg(*stats())
    zero = {c: 0 for c in found.columns if c != "kind"}
    return kinds.join(found, "kind", "left").fillna(zero)


def persona_kind_grid(rows: DataFrame) -> DataFrame:
    """Mean per persona and kind, personas down, kinds across; null where nothing was scored."""
    return with_persona(rows).groupBy("persona").pivot("kind", list(KINDS)).agg(F.bround(F.avg("score"), 3))


def baseline_deltas(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(question_id, score, base_score, delta)``; the last of equal ids counts in the baseline; null unless both are scored."""
    last = baseline.groupBy("question_id").agg(F.max_by("score", "pos").alias("base_score"))
    return rows.join(last, "question_id", "left").select("pos", "question_id", "score", "base_score", (F.col("score") - F.col("base_score")).alias("delta"))


def baseline_by_kind(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per kind the change of the mean and, in whole points, of the pass rate."""
    a, b = by_kind(rows), by_kind(baseline).select("kind", F.col("mean").alias("base_mean"), F.col("pass_rate").alias("base_pass"), F.col("scored").alias("base_scored"))
    both = a.join(b, "kind")
    either = (F.col("scored") > 0) & (F.col("base_scored") > 0)
    return both.select(
        "kind_pos", "kind", "mean", "base_mean", F.when(either, F.bround(F.col("mean") - F.col("base_mean"), 3)).alias("mean_delta"),
        F.when(either, F.bround((F.col("pass_rate") - F.col("base_pass")) * 100).cast("int")).alias("pass_delta"),
    )


def shown_percent(rate: Column) -> Column:
    """A rate as the whole percent that is shown: cut off, not rounded."""
    return (rate * 100).cast("int")


def largest_bin(stats_rows: DataFrame) -> Column:
    return F.greatest(*[F.col(f"h{i}") for i in range(4)])


def row_view(rows: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One line of the report per row: score, replies, change, where it came from."""
    out = rows.withColumn("long_exchange", F.coalesce("turns", F.lit(0)) > 1)
    if baseline is not None:
        out = out.join(baseline_deltas(rows, baseline).select("pos", "base_score", "delta"), "pos", "left")
    return out


def transcripts(turns: DataFrame) -> DataFrame:
    """``(conv_id, transcript, replies)``; ``turns(conv_id, turn, role, source, text)``."""
    # fixed values: the speakers' tags
    tag = F.when(F.col("source") == "clarifier", "USER (clarifier)").when(F.col("source") == "user", "USER").when(F.col("source") == "error", "EVALRUN").otherwise(F.upper("role"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(tag, F.lit(": "), "text").alias("line"))))
    replies = F.count_if((F.col("role") == "bot") & F.col("source").isin("bot", "bot_final"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"), replies.alias("replies"))


def judged_text(turns: DataFrame, ended: DataFrame, scope: str = "conversation") -> DataFrame:
    """What a judge reads: the last reply, or all labelled parts; only where the exchange ended in an answer or a refusal.

    ``ended(conv_id, terminated_by, actual_answer)``.
    """
    said = turns.where((F.col("role") == "bot") & F.col("text").rlike(r"(?U)\S"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    all_ = said.groupBy("conv_id").agg(parts.alias("parts"))
    n = F.size("parts")
    labelled = F.array_join(F.transform("parts", lambda t, i: F.concat(F.lit("[part "), (i + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit("]\n"), t)), "\n\n")
    whole = F.when(n == 1, F.get("parts", F.lit(0))).when(n > 1, labelled)
    good = F.col("terminated_by").isin("answer", "refusal") & F.lit(scope == "conversation")
    return ended.join(all_, "conv_id", "left").select("conv_id", F.when(good, F.coalesce(whole, "actual_answer")).otherwise(F.col("actual_answer")).alias("judged"))


EXCHANGE = "question_id string, actual_answer string, score int, remark string, turns int, transcript string, terminated_by string"


def exchanged(rows: DataFrame, ask: Callable[[str, list[dict]], str], classify: Callable[[str], str], judge: Callable[[str, str, str, str], str], clarify: Callable[[str, str], str] | None = None, max_turns: int = 5) -> DataFrame:
    """Rows run against injected clients: ask, classify, clarify while it asks back, judge. Errors become sentinels, never failures.

    Classifier and clarifier are tried twice, the judge three times; what they then fall back on is in ``calls``.
    """

    def one(question: str, expected: str) -> tuple:
        turns: list[dict] = []
        message, ended, answer = question, "max_turns", ""
        for _ in range(max_turns):
            turns.append({"role": "user", "source": "user" if not turns else "clarifier", "text": message})
            try:
                answer = ask(message, turns)
            except Exception as error:  # noqa: BLE001 - a row's failure is its result
                answer, ended = f"[chat_error] {type(error).__name__}", "error"
                turns.append({"role": "system", "source": "error", "text": answer})
                break
            turns.append({"role": "bot", "source": "bot", "text": answer})
            kind, _ = classified(lambda: classify(answer))  # noqa: B023 - called at once
            if kind != "clarify":
                ended = kind
                turns[-1]["source"] = "bot_final"
                break
            message = clarified(lambda: clarify(question, answer))[0] if clarify else question  # noqa: B023
            if not message:
                ended = "clarify_failed"
                break
        tags = {"clarifier": "USER (clarifier)", "user": "USER", "error": "EVALRUN"}
        text = "\n\n".join(f"{tags.get(t['source'], t['role'].upper())}: {t['text']}" for t in turns)
        score, remark = judged(lambda: judge(question, expected, answer, text))
        return answer, score, remark, sum(t["source"] in ("bot", "bot_final") for t in turns), text, ended

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(q, *one(text or "", expected or "")) for q, text, expected in zip(batch["question_id"], batch["question"], batch["expected_answer"])]
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in EXCHANGE.split(", ")])
                yield frame.astype({"score": "Int64"})

    return rows.select("question_id", "question", "expected_answer").mapInPandas(run, EXCHANGE)


def harness_results(lines: DataFrame, col: str = "value") -> DataFrame:
    """Results of either JSON layout of a harness, by question id; entries without one are left out."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(col, p) for p in paths])
    out = lines.select(
        get("$.vars.question_id", "$.metadata.question_id", "$.testCase.vars.question_id").alias("question_id"), get("$.response.metadata.actual_answer", "$.metadata.actual_answer", "$.response.output").alias("actual_answer"),
        get("$.response.metadata.score", "$.metadata.score").try_cast("int").alias("score"), get("$.response.metadata.remark", "$.metadata.remark").alias("remark"),
        get("$.response.metadata.turns", "$.metadata.turns").try_cast("int").alias("turns"), get("$.response.metadata.transcript", "$.metadata.transcript").alias("transcript"),
    )
    return out.where(F.col("question_id").isNotNull() & (F.col("question_id") != ""))


def harness_tests(rows: DataFrame) -> DataFrame:
    """One JSON test per row, in file order."""
    return rows.select("pos", F.to_json(F.struct(F.struct("question_id", "kind", "persona", "question", "expected_answer").alias("vars"))).alias("test"))


def harness_config(rows: DataFrame, title: str, provider: str) -> DataFrame:
    """``(pos, yaml)``: a harness configuration, its head at -1 and one entry for each row; quoted strings are JSON, so YAML.

    Written in ``pos`` order the parts are one file.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    named = ("question_id", "kind", "question", "expected_answer")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    entry = F.concat(
        F.lit("- description: "), quoted(F.concat(text("question_id"), F.lit(" ["), text("kind"), F.lit("]"))), F.lit("\n  vars:"),
        *[F.concat(F.lit(f"\n    {c}: "), quoted(text(c))) for c in named],
        F.lit("\n  metadata:"), *[F.concat(F.lit(f"\n    {c}: "), quoted(text(c))) for c in ("kind", "question_id")], F.lit("\n"),
    )
    head = f"description: {json.dumps(title, ensure_ascii=False)}\nproviders:\n- {json.dumps('file://' + provider)}\nprompts:\n- '{{{{question}}}}'\ntests:\n"
    first = rows.sparkSession.createDataFrame([(-1, head)], "pos long, yaml string")
    return first.unionByName(rows.select(F.col("pos").cast("long").alias("pos"), entry.alias("yaml")))


def escaped_html(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit("—"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def report_pages(rows: DataFrame, per_page: int = 1000, columns: tuple[str, ...] = ("question_id", "kind", "persona", "question", "expected_answer", "actual_answer", "score", "remark", "turns")) -> DataFrame:
    """``(page, rows, html)``: the row table in pages of ``per_page`` places of ``pos``, made by the workers."""
    cells = [F.concat(F.lit("<td>"), escaped_html(F.col(c)), F.lit("</td>")) for c in columns]
    shown = rows.select(F.floor(F.col("pos") / per_page).cast("long").alias("page"), "pos", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("tr"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tr"))), lambda x: x["tr"]), "")  # at most per_page rows
    head = "<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>"
    return shown.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), F.concat(F.lit(head), body, F.lit("</tbody></table>")).alias("html"))


def render_report(rows: DataFrame, title: str = "Evaluation", baseline: DataFrame | None = None, most_rows: int = 100_000, most_personas: int = 10_000) -> str:
    """A self-contained page. Its tables are collected, so more rows or personas than given are an error: use ``report_pages``."""
    import html

    def table(frame: pd.DataFrame) -> str:
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in frame.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('—' if pd.isna(v) else str(v))}</td>" for v in r) + "</tr>" for r in frame.itertuples(index=False))
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    total = rows.agg(*stats()).toPandas()
    kinds = by_kind(rows).orderBy("kind_pos").drop("kind_pos").toPandas()
    parts = [f"<h1>{html.escape(title)}</h1>", "<h2>Overall</h2>", table(total), "<h2>By kind</h2>", table(kinds)]
    if not rows.where(F.coalesce(F.trim("persona"), F.lit("")) != "").isEmpty():
        parts += ["<h2>By persona and kind</h2>", table(bounded_arrow(persona_kind_grid(rows).orderBy("persona"), most_personas, "personas").to_pandas())]
    if baseline is not None:
        parts += ["<h2>Against the baseline</h2>", table(baseline_by_kind(rows, baseline).orderBy("kind_pos").drop("kind_pos").toPandas())]
    view = rows.orderBy("pos").select("question_id", "kind", "persona", "question", "expected_answer", "actual_answer", "score", "remark", "turns")
    parts += ["<h2>Rows</h2>", table(bounded_arrow(view, most_rows, "rows of a page").to_pandas())]
    style = "<style>body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px;vertical-align:top}</style>"
    return "<!doctype html><html><head><meta charset='utf-8'><title>" + html.escape(title) + f"</title>{style}</head><body>" + re.sub(r">\s+<", "><", "".join(parts)) + "</body></html>"
