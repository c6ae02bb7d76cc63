"""Queries of question sets, evaluation runs and streams, each with its DuckDB twin."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators import calls, crawl, evalrun, evalset, memory
from loam.queries import EVICTION_BUDGET, _in_us, _turn_events, query
from loam.queries_pages import _shared, _uri
from loam.session import staged
from loam.sources.tables import table
from loam.streaming import events as stream

SQL: dict[str, str] = {}


# --- question sets


@query
def matched_personas(spark: SparkSession, folder: str) -> DataFrame:
    """Every question for every persona with an even place, chosen in roster order."""
    roster = table(spark, folder, "persona")
    flags = [r["persona_id"] for r in roster.where(F.col("pos") % 2 == 0).orderBy(F.desc("pos")).collect()]  # a fixed table
    chosen = evalset.selected_personas(roster, flags)
    return evalset.matched(table(spark, folder, "generated_item").select("item_id"), chosen).select("item_id", "persona_id", "pos")


SQL["matched_personas"] = "SELECT item_id, p.persona_id, pos FROM generated_item, persona p WHERE pos % 2 = 0"


def _slots(spark: SparkSession, folder: str) -> DataFrame:
    """A slot of every kind for each packet, with the packet after it and the one beside it, and every second persona-free."""
    p = table(spark, folder, "packet").select("id", F.lit(0).alias("pos"))
    after = evalset.paired(table(spark, folder, "packet"), seed=3)
    kinds = F.explode(F.transform(F.array(*[F.lit(k) for k in evalset.KINDS]), lambda k, i: F.struct(k.alias("kind"), i.alias("i"))))
    rows = p.join(after, "id").select("id", "other", kinds.alias("k")).select("id", "other", "k.kind", F.length("id").alias("item"), "k.i")
    asked = (F.length("id") + F.col("i")) % 2 == 0
    return rows.select(
        F.concat("kind", F.lit(" "), "id").alias("slot"), "kind", "item", F.array("id", "other").alias("ids"), F.when(F.col("kind") == "hard-1", F.col("other")).alias("other"),
        F.when(asked, "someone").alias("persona_id"), evalset.framing(F.when(asked, "Someone"), F.lit("Asks a lot.")).alias("framing"),
    )


def _model(kind: str, packet: dict, other: dict | None, picked: list[str], asked_by: str) -> str:
    """A model that finds some packets beside the point, frames some questions as exams and fails on some."""
    n = len(packet["id"])
    if n % 13 == 0:
        raise TimeoutError("busy")
    if asked_by and n % 11 == 0:
        return '{"persona_mismatch": "not my field"}'
    draft = evalset.stub_draft(kind, packet, other, picked, asked_by)
    return draft.replace("What is said about", "According to the page, what is") if n % 7 == 0 else draft


@query
def generated_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts of all five kinds, sampled again where a packet does not fit, and the reasons of those given up."""
    slots = _slots(spark, folder)
    out = evalset.generated(slots.withColumn("kind", F.col("kind")).withColumn("persona_id", F.concat_ws("|", "slot", F.coalesce("persona_id", F.lit("")))), table(spark, folder, "packet"), _model, attempts=3, seed=7)
    return out.select(F.split("persona_id", r"\|")[0].alias("slot"), "id", "question", F.md5("expected_answer").alias("answer_md5"), "attempts", "reason")


SQL["generated_questions"] = r"""
WITH h AS (SELECT id, regexp_extract(id, '^(.*)\.[^.]*$', 1) AS parent, sha256('3|' || id) AS h FROM packet), r AS (SELECT id, coalesce(lead(id) OVER (PARTITION BY parent ORDER BY h, id), first_value(id) OVER (PARTITION BY parent ORDER BY h, id)) AS o FROM h),
z AS (SELECT arg_min(id, h) AS x, arg_max(id, h) AS y FROM h), q AS (SELECT id, CASE WHEN o <> id THEN o WHEN x <> id THEN x ELSE nullif(y, id) END AS other FROM r, z),
g AS (SELECT id, i, n, row_number() OVER (PARTITION BY id ORDER BY sha256('7|' || id || '|' || i), i) AS rk, p FROM (SELECT id, len(paragraphs) AS n, generate_subscripts(paragraphs, 1) - 1 AS i, unnest(paragraphs) AS p FROM packet)),
b AS (SELECT id, title, body, len(assets) AS pics, len(paragraphs) AS n, length(id) AS l, (SELECT string_agg(p, ' ' ORDER BY i) FROM g WHERE g.id = packet.id AND rk <= 1) AS p1, (SELECT string_agg(p, ' ' ORDER BY i) FROM g WHERE g.id = packet.id AND rk <= 2) AS p2, (SELECT string_agg(p, ' ' ORDER BY i) FROM g WHERE g.id = packet.id AND rk <= 3) AS p3 FROM packet),
s AS (SELECT k.kind || ' ' || q.id AS slot, k.kind, k.i, q.id, q.other, (length(q.id) + k.i) % 2 = 0 AS asked FROM q, (VALUES ('simple', 0), ('medium', 1), ('complex', 2), ('hard-1', 3), ('hard-2', 4)) k(kind, i)),
t AS (SELECT s.*, u.step, c.id AS cid, c.title, c.l, CASE kind WHEN 'simple' THEN left(c.body, 20000) WHEN 'hard-2' THEN CASE WHEN c.pics > 0 THEN left(c.body, 15000) END WHEN 'medium' THEN left(c.p1, 6000) WHEN 'complex' THEN CASE WHEN c.n >= 3 THEN c.p3 END
    ELSE CASE WHEN least(2, c.n) + least(3 - least(2, c.n), o.n) >= 3 THEN CASE WHEN c.n >= 2 THEN c.p2 ELSE c.p1 END || ' ' || CASE WHEN c.n >= 2 THEN o.p1 ELSE o.p2 END WHEN c.n >= 3 AND o.n = 0 THEN c.p3 END END AS answer
  FROM s, (VALUES (1), (2)) u(step), b c, b o WHERE c.id = CASE u.step WHEN 1 THEN s.id ELSE s.other END AND o.id = s.other),
v AS (SELECT *, CASE WHEN answer IS NULL THEN 'skip' WHEN l % 13 = 0 THEN 'fail' WHEN asked AND l % 11 = 0 THEN 'mismatch' WHEN asked AND l % 7 = 0 THEN 'exam' ELSE 'ok' END AS state FROM t),
w AS (SELECT a.slot, a.cid AS c1, a.state AS s1, a.title AS t1, a.answer AS a1, a.l AS l1, d.cid AS c2, d.state AS s2, d.title AS t2, d.answer AS a2, d.l AS l2 FROM v a JOIN v d ON d.slot = a.slot AND a.step = 1 AND d.step = 2),
e AS (SELECT *, CASE WHEN s1 = 'ok' THEN 1 WHEN s1 IN ('skip', 'mismatch') AND s2 = 'ok' THEN 2 END AS won, CASE WHEN s1 IN ('skip', 'mismatch') THEN s2 ELSE s1 END AS final FROM w)
SELECT slot, CASE WHEN won = 1 OR s1 IN ('fail', 'exam') THEN c1 ELSE c2 END AS id,
  CASE won WHEN 1 THEN trim(CASE WHEN l1 % 7 = 0 THEN 'According to the page, what is ' ELSE 'What is said about ' END || t1 || '?') WHEN 2 THEN trim(CASE WHEN l2 % 7 = 0 THEN 'According to the page, what is ' ELSE 'What is said about ' END || t2 || '?') END AS question,
  md5(CASE won WHEN 1 THEN trim(a1, chr(10) || chr(9) || chr(13) || ' ') WHEN 2 THEN trim(a2, chr(10) || chr(9) || chr(13) || ' ') END) AS answer_md5,
  CAST(CASE won WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE CASE WHEN s1 IN ('fail', 'exam') OR s2 IN ('fail', 'exam') THEN 3 ELSE 2 END END AS INT) AS attempts,
  CASE WHEN won IS NULL THEN CASE final WHEN 'exam' THEN 'exam_framing' WHEN 'mismatch' THEN 'persona_content_mismatch' ELSE 'validation_failed_or_llm_error' END END AS reason
FROM e"""


@query
def accepted_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the drafts that items of a kind and persona gave, the first that passed its checks."""
    items = table(spark, folder, "generated_item").select("item_id", "kind", F.coalesce("persona_id", F.lit("")).alias("persona_id"), F.when(F.length("question") % 3 == 0, "exam_framing").alias("reason"), F.col("item_id").alias("attempt"))
    return evalset.first_valid(items, ["kind", "persona_id"]).select("kind", "persona_id", "item_id")


SQL["accepted_attempts"] = "SELECT kind, coalesce(persona_id, '') AS persona_id, min(item_id) AS item_id FROM generated_item WHERE question IS NULL OR length(question) % 3 <> 0 GROUP BY kind, coalesce(persona_id, '')"


@query
def resample_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The packets that each packet's slot is sampled from, in turn."""
    packets = table(spark, folder, "packet")
    slots = packets.select(F.lit("simple").alias("kind"), F.row_number().over(evalset.Window.orderBy("id")).alias("item"), "id")  # a fixed table
    return evalset.resample_order(slots, packets, 3, seed=5).select("item", F.array_join("ids", ",").alias("ids"))


SQL["resample_orders"] = """
WITH p AS (SELECT id, row_number() OVER (ORDER BY id) AS item, row_number() OVER (ORDER BY substr(sha256('5|' || id), 1, 13)) - 1 AS place, count(*) OVER () AS n FROM packet)
SELECT CAST(a.item AS INT) AS item, a.id || ',' || b.id || ',' || c.id AS ids FROM p a JOIN p b ON b.place = (a.place + 1) % a.n JOIN p c ON c.place = (a.place + 2) % a.n"""


@query
def persona_framings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "persona").select("persona_id", evalset.framing(F.when(F.col("pos") % 3 > 0, F.col("persona_name")), F.col("persona_description")).alias("framing"), evalset.image_block(F.col("persona_id").cast("binary"), F.lit("a.png"))["url"].alias("url"))


SQL["persona_framings"] = "SELECT persona_id, CASE WHEN pos % 3 > 0 THEN trim('You are ' || persona_name || '. ' || coalesce(persona_description, '')) ELSE '' END AS framing, 'data:image/png;base64,' || to_base64(encode(persona_id)) AS url FROM persona"


# --- evaluation


def _spec(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Rows once per id, and a selection: one id, and a span between two others, all by their place."""
    rows = table(spark, folder, "eval_row").where(F.coalesce(F.trim("question_id"), F.lit("")) != "")
    once = rows.groupBy("question_id").agg(F.min("pos").alias("pos"))
    ends = once.agg(F.min_by("question_id", "pos").alias("a"), F.max_by("question_id", "pos").alias("z"), F.min_by("question_id", F.abs(F.col("pos") - 100)).alias("m")).first()
    return rows, f"{ends['a']}, {ends['m']}..{ends['z']}"


@query
def eval_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a list of ids and spans names, and what a run over them inherits."""
    rows, spec = _spec(spark, folder)
    return evalrun.selected(rows, ids=spec).select("pos", "question_id", "run")


_ONCE = "r AS (SELECT * FROM eval_row WHERE trim(coalesce(question_id, '')) <> ''), o AS (SELECT question_id, min(pos) AS pos FROM r GROUP BY question_id), m AS (SELECT min(pos) AS a, max(pos) AS z FROM o), n AS (SELECT pos AS m FROM o ORDER BY abs(pos - 100), question_id LIMIT 1)"
SQL["eval_selected"] = f"WITH {_ONCE}, h AS (SELECT DISTINCT question_id FROM r, m, n WHERE pos = m.a OR pos BETWEEN n.m AND m.z) SELECT pos, question_id, question_id IN (SELECT question_id FROM h) AS run FROM r"


@query
def selector_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Selections that are no selections, and what each is refused for."""
    rows, spec = _spec(spark, folder)
    a, z = spec.split(", ")[0], spec.rpartition("..")[2]
    tries = {"backwards": {"ids": f"{z}..{a}"}, "unknown": {"ids": "nope-1,nope-2"}, "half": {"ids": f"{a}.."}, "empty": {"ids": " , "}, "both": {"ids": a, "kinds": ["simple"]}, "sound": {"ids": a}, "filter": {"kinds": ["simple"], "skip_completed": True}}
    out = []
    for name, selector in tries.items():
        try:
            evalrun.selected(rows, **selector)
            out.append((name, "fine"))
        except ValueError as wrong:
            out.append((name, "refused " + str(sum(w in str(wrong) for w in ("nope-1", "nope-2", "kinds")))))
    return spark.createDataFrame(out, "name string, result string")


SQL["selector_errors"] = "SELECT * FROM (VALUES ('backwards', 'refused 0'), ('unknown', 'refused 2'), ('half', 'refused 0'), ('empty', 'refused 0'), ('both', 'refused 1'), ('sound', 'fine'), ('filter', 'fine')) v(name, result)"


@query
def scope_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What a partial run executed and inherited."""
    rows = evalrun.selected(table(spark, folder, "eval_row"), kinds=["simple", "complex"])
    results = rows.where("run").groupBy("question_id").agg(F.max("score").alias("score")).select("question_id", F.lit("a").alias("actual_answer"), "score", F.lit("").alias("remark"), F.lit(1).alias("turns"), F.lit("").alias("transcript"))
    return evalrun.scope_summary(evalrun.merged(rows, results))


SQL["scope_summaries"] = "SELECT count(*) FILTER (kind IN ('simple', 'complex')) AS executed, count(*) FILTER (coalesce(kind, '') NOT IN ('simple', 'complex')) AS inherited, count(*) FILTER (coalesce(kind, '') NOT IN ('simple', 'complex') AND coalesce(actual_answer, '') = '') AS empty_inherited FROM eval_row"


@query
def report_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the percent shown and the longest bar; and per row what the report's table says."""
    rows = table(spark, folder, "eval_row")
    kinds = evalrun.by_kind(rows)
    bars = kinds.select("kind", evalrun.shown_percent(F.col("pass_rate")).cast("long").alias("a"), evalrun.largest_bin(kinds).cast("long").alias("b"))
    view = evalrun.row_view(rows, rows.withColumn("score", F.lit(1))).groupBy(F.concat(F.lit("long "), F.col("long_exchange").cast("string")).alias("kind")).agg(F.count(F.lit(1)).alias("a"), F.coalesce(F.sum("delta"), F.lit(0)).alias("b"))
    return bars.unionByName(view)


SQL["report_bars"] = """
WITH k(kind) AS (VALUES ('simple'), ('medium'), ('complex'), ('hard-1'), ('hard-2')), s AS (SELECT kind, score FROM eval_row), f AS (SELECT kind, coalesce(round_even(count(*) FILTER (score >= 2)::DOUBLE / nullif(count(score), 0), 3), 0) AS rate, greatest(count(*) FILTER (score = 0), count(*) FILTER (score = 1), count(*) FILTER (score = 2), count(*) FILTER (score = 3)) AS b FROM s GROUP BY kind),
d AS (SELECT turns, score - CASE WHEN question_id IS NOT NULL THEN 1 END AS delta FROM eval_row)
SELECT kind, CAST(trunc(coalesce(rate, 0) * 100) AS BIGINT) AS a, CAST(coalesce(b, 0) AS BIGINT) AS b FROM k LEFT JOIN f USING (kind)
UNION ALL SELECT 'long ' || (coalesce(turns, 0) > 1), count(*), CAST(coalesce(sum(delta), 0) AS BIGINT) FROM d GROUP BY 1"""


@query
def report_row_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The report's row table in pages."""
    rows = table(spark, folder, "eval_row")
    return evalrun.report_pages(rows, 100, ("question_id", "question", "score")).select("page", "rows", F.md5("html").alias("html_md5"))


_HTML = "replace(replace(replace(replace(coalesce(CAST({0} AS VARCHAR), '—'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SQL["report_row_pages"] = f"""
WITH r AS (SELECT pos // 100 AS page, pos, '<tr>' || '<td>' || {_HTML.format("question_id")} || '</td><td>' || {_HTML.format("question")} || '</td><td>' || {_HTML.format("score")} || '</td></tr>' AS tr FROM eval_row)
SELECT page, count(*) AS rows, md5('<table><thead><tr><th>question_id</th><th>question</th><th>score</th></tr></thead><tbody>' || string_agg(tr, '' ORDER BY pos) || '</tbody></table>') AS html_md5 FROM r GROUP BY page"""


@query
def report_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The self-contained page of a whole evaluation: its sections and rows."""
    rows = table(spark, folder, "eval_row")
    page = evalrun.render_report(rows.withColumn("actual_answer", F.lit("a")).withColumn("remark", F.lit("<r>")), "Run & more", rows, most_rows=10_000_000)
    return spark.createDataFrame([("rows", page.count("&lt;r&gt;")), ("sections", page.count("<h2>")), ("title", page.count("Run &amp; more"))], "what string, n long")


SQL["report_sections"] = "SELECT 'rows' AS what, count(*) AS n FROM eval_row UNION ALL SELECT 'sections', 5 UNION ALL SELECT 'title', 2"


@query
def harness_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as tests and as a configuration of a harness, and results of both of its layouts read back."""
    rows = table(spark, folder, "eval_row")
    tests = evalrun.harness_tests(rows)
    layout = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('{"vars": '), F.get_json_object("test", "$.vars"), F.lit(', "response": {"metadata": {"score": 2, "actual_answer": "x"}}}'))).otherwise(
        F.concat(F.lit('{"testCase": '), F.col("test"), F.lit(', "metadata": {"score": 9, "turns": "2"}, "response": {"output": "y"}}'))
    )
    read = evalrun.harness_results(tests.select("pos", layout.alias("value"))).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.max("actual_answer").alias("answer"), F.max("turns").alias("turns"))
    config = evalrun.harness_config(rows, "Run", "/p.py").where(F.col("pos") >= 0)
    first = F.regexp_extract("yaml", r'^- description: "(.*) \[.*\]"\n', 1)
    listed = config.groupBy(first.alias("question_id")).agg(F.sum(F.size(F.split("yaml", "\n"))).alias("lines"))
    return read.join(listed, "question_id", "left")


SQL["harness_files"] = """
SELECT question_id, count(*) AS n, CAST(max(CASE WHEN pos % 2 = 0 THEN 2 ELSE 9 END) AS INT) AS score, max(CASE WHEN pos % 2 = 0 THEN 'x' ELSE 'y' END) AS answer, CAST(max(CASE WHEN pos % 2 = 1 THEN 2 END) AS INT) AS turns, CAST(sum(10) AS BIGINT) AS lines FROM eval_row WHERE coalesce(question_id, '') <> '' GROUP BY question_id"""


@query
def exchange_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Questions put to a chatbot that answers, asks back, refuses or breaks; classifier and judge that fail and recover, or do not."""

    def ask(message: str, turns: list[dict]) -> str:
        n = len(message)
        if n % 17 == 0:
            raise RuntimeError("down")
        return "which one?" if n % 5 == 0 else "no" if n % 3 == 0 else "yes"

    def classify(reply: str) -> str:
        return '{"category": "clarify"}' if "?" in reply else "refusal" if reply == "no" else "gibberish"

    def judge(question: str, expected: str, answer: str, transcript: str) -> str:
        if len(question) % 4 == 0:
            raise TimeoutError("slow")
        return f'```json\n{{"score": {len(answer) % 5}, "remark": ""}}\n```'

    rows = table(spark, folder, "eval_row").where(F.col("question").isNotNull()).select(F.col("pos").cast("string").alias("question_id"), "question", "expected_answer")
    out = evalrun.exchanged(rows, ask, classify, judge, lambda question, reply: "the first" if len(question) % 2 else "", 3)
    return out.select(F.col("question_id").cast("long").alias("pos"), "actual_answer", "score", "remark", "turns", "terminated_by", F.md5("transcript").alias("transcript_md5"))


SQL["exchange_runs"] = """
WITH q AS (SELECT pos, question, length(question) AS n FROM eval_row WHERE question IS NOT NULL),
a AS (SELECT *, CASE WHEN n % 17 = 0 THEN '[chat_error] RuntimeError' WHEN n % 5 = 0 THEN CASE WHEN n % 2 = 1 THEN 'no' ELSE 'which one?' END WHEN n % 3 = 0 THEN 'no' ELSE 'yes' END AS answer,
  CASE WHEN n % 17 = 0 THEN 'error' WHEN n % 5 = 0 THEN CASE WHEN n % 2 = 1 THEN 'refusal' ELSE 'clarify_failed' END WHEN n % 3 = 0 THEN 'refusal' ELSE 'answer' END AS ended FROM q)
SELECT pos, answer AS actual_answer, CASE WHEN n % 4 = 0 OR length(answer) % 5 = 4 THEN NULL ELSE CAST(length(answer) % 5 AS INT) END AS score, CASE WHEN n % 4 = 0 THEN '[judge_failed] TimeoutError: slow' WHEN length(answer) % 5 = 4 THEN '[judge_failed] invalid_score: 4' ELSE '(no remark)' END AS remark,
  CAST(CASE WHEN ended = 'error' THEN 0 WHEN n % 5 = 0 AND n % 2 = 1 THEN 2 ELSE 1 END AS INT) AS turns, ended AS terminated_by,
  md5('USER: ' || question || chr(10) || chr(10) || CASE WHEN ended = 'error' THEN 'EVALRUN: ' || answer WHEN n % 5 = 0 AND n % 2 = 1 THEN 'BOT: which one?' || chr(10) || chr(10) || 'USER (clarifier): the first' || chr(10) || chr(10) || 'BOT: no' ELSE 'BOT: ' || answer END) AS transcript_md5 FROM a"""


@query
def final_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The session of each row, and which of its bot turns is the final one."""
    e = table(spark, folder, "eval_row")
    turns = e.select(F.col("pos").alias("conv_id"), "question_id", F.explode(F.sequence(F.lit(1), F.coalesce("turns", F.lit(0)) * 2 + 1)).alias("turn")).withColumn("role", F.when(F.col("turn") % 2 == 1, "user").otherwise("bot")).withColumn("source", F.col("role"))
    marked = evalrun.final_marked(turns)
    return marked.groupBy("conv_id").agg(F.max(F.when(F.col("source") == "bot_final", F.col("turn"))).alias("final"), F.count_if(F.col("source") == "bot_final").alias("finals"), F.first(evalrun.session_id(F.coalesce("question_id", F.lit("")), seed=1)).alias("session"))


SQL["final_turns"] = "SELECT pos AS conv_id, CASE WHEN coalesce(turns, 0) > 0 THEN CAST(turns * 2 AS INT) END AS final, CAST((coalesce(turns, 0) > 0)::INT AS BIGINT) AS finals, 'eval-' || coalesce(question_id, '') || '-' || left(sha256('1|' || coalesce(question_id, '')), 8) AS session FROM eval_row"


@query
def model_failures(spark: SparkSession, folder: str) -> DataFrame:
    """What errors mean for a run, counted by event."""
    names = F.array(*[F.lit(n) for n in ("Timeout", "AuthenticationError", "ValueError", "RateLimitError", "NotFoundError")])
    return table(spark, folder, "events").groupBy(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("error")).agg(F.count(F.lit(1)).alias("n")).select("error", "n", calls.failure_class(F.col("error")).alias("means"))


SQL["model_failures"] = "SELECT ['Timeout', 'AuthenticationError', 'ValueError', 'RateLimitError', 'NotFoundError'][event_id % 5 + 1] AS error, count(*) AS n, ['retryable', 'unavailable', 'item', 'retryable', 'unavailable'][event_id % 5 + 1] AS means FROM events GROUP BY event_id % 5"


# --- events and streams


@query
def event_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Events numbered within their turn, by time."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return stream.numbered_events(e, "user_id").select("event_id", "seq")


SQL["event_numbers"] = "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events"


@query
def turn_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and times of each turn."""
    out = stream.turn_metrics(_turn_events(spark, folder))
    begun = _turn_events(spark, folder).withColumn("kind", F.when(F.col("seq") % 9 == 0, "start").otherwise(F.col("kind")))
    late = stream.turn_latency(begun).select("turn_id", F.round("first_token_ms", 3).alias("latency_ms"))
    return out.join(late, "turn_id").select("turn_id", "tool_calls", "deltas", "errors", "output_chars", F.round("first_token_ms", 3).alias("first_token_ms"), F.round("total_ms", 3).alias("total_ms"), "latency_ms")


SQL["turn_measures"] = """
WITH e AS (SELECT event_id // 9 AS turn_id, event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'assistant.final' WHEN 'click' THEN 'tool.call' ELSE 'assistant.delta' END AS kind FROM events), b AS (SELECT *, event_id % 9 = 0 AS start FROM e)
SELECT turn_id, count(*) FILTER (kind = 'tool.call') AS tool_calls, count(*) FILTER (kind = 'assistant.delta') AS deltas, count(*) FILTER (kind = 'error') AS errors, CAST(coalesce(max(length('t' || event_id)) FILTER (kind = 'assistant.final'), 0) AS INT) AS output_chars,
  round((epoch_us(min(ts) FILTER (kind = 'assistant.delta')) - epoch_us(min(ts))) / 1000, 3) AS first_token_ms, round((epoch_us(max(ts) FILTER (kind = 'assistant.final')) - epoch_us(min(ts))) / 1000, 3) AS total_ms,
  round((epoch_us(min(ts) FILTER (kind = 'assistant.delta' AND NOT start)) - epoch_us(min(ts) FILTER (start))) / 1000, 3) AS latency_ms FROM b GROUP BY turn_id"""


@query
def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of a model that does not stream as events, as messages of a channel, and as a trace."""
    replies = table(spark, folder, "eval_row").where(F.col("actual_answer").isNotNull()).select(F.col("pos").alias("turn_id"), F.col("actual_answer").alias("text"))
    sent = stream.transcription(stream.as_events(replies))
    blocks = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text")), F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text")))
    traced = replies.select("turn_id", F.md5(F.get_json_object(stream.trace_payload(F.lit("tool"), blocks, 400), "$.content")).alias("trace_md5"))
    read = F.from_json("message", "seq int, kind string, turn_id string, text string")
    rows = sent.select("turn_id", read.alias("m"), "seq")
    frame = F.regexp_replace(stream.sse_frame(F.struct("m.seq", "m.kind")), r"\s+$", "")
    return rows.join(traced, "turn_id").select("turn_id", "seq", F.col("m.kind").alias("kind"), F.md5("m.text").alias("text_md5"), "trace_md5", frame.alias("frame"))


SQL["event_messages"] = """
WITH r AS (SELECT pos AS turn_id, actual_answer AS text, actual_answer || chr(10) || '[image]' AS t FROM eval_row WHERE actual_answer IS NOT NULL)
SELECT turn_id, seq, kind, md5(text) AS text_md5, md5(CASE WHEN length(t) <= 400 THEN t ELSE left(t, 170) || chr(10) || '…[' || (length(t) - 340) || ' chars elided from the middle]…' || chr(10) || right(t, 170) END) AS trace_md5, 'data: {"seq":' || seq || ',"kind":"' || kind || '"}' AS frame
FROM r, (VALUES (1, 'assistant.delta'), (2, 'assistant.final')) k(seq, kind)"""


@query
def tool_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments of tool calls put together from fragments; what is no JSON object is empty."""
    e = table(spark, folder, "events")
    whole = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('["'), F.col("event_id").cast("string"), F.lit('"]'))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "event_type")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("seq"), F.substring(whole, k * 9 + 1, F.when(k < 3, F.lit(9)).otherwise(1000)).alias("arguments")))
    parts = e.select(F.col("event_id").alias("call_id"), F.lit(0).alias("index"), F.inline(cut)).withColumn("name", F.when(F.col("seq") == 0, "load"))
    return stream.fragments(parts)


SQL["tool_fragments"] = """SELECT event_id AS call_id, 0 AS index, 'load' AS name, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{"id":' || event_id || ',"event_type":"' || event_type || '"}' END AS arguments FROM events"""


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of each user's events, cut into pieces of eleven characters; the last frame of each is unfinished."""
    e = table(spark, folder, "events").where(F.col("event_id") % 3 == 0)
    frame = F.concat(F.lit("id: 1\r\ndata: "), F.col("event_id").cast("string"), F.lit("\r\ndata:"), F.col("event_type"), F.lit("\r\n\r\n"))
    whole = e.groupBy("user_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))), lambda x: x["f"]), ""), F.lit("data: unfin")).alias("t"))
    n = F.ceil(F.length("t") / 11).cast("int")
    return whole.select(F.col("user_id").alias("stream_id"), F.inline(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("seq"), F.substring(F.col("t"), k * 11 + 1, F.lit(11)).alias("data")))))


@query
def sse_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Server-sent events put together again from pieces that cut them anywhere."""
    return stream.sse_frames(_pieces(spark, folder))


SQL["sse_live"] = SQL["sse_streams"] = "SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame_no, event_id || chr(10) || event_type AS data FROM events WHERE event_id % 3 = 0"


@query
def sse_live(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of pieces in two batches, with state per stream: a frame cut between them waits."""
    root = _uri(_shared(spark, "pieces"))
    pieces = _pieces(spark, folder)
    half = F.col("seq") * 2 < F.max("seq").over(Window.partitionBy("stream_id"))
    cut = staged(pieces.withColumn("late", ~half), "cut")
    for late in (False, True):
        cut.where(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(root)
    live = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(root)
    return _drained(stream.sse_stream(live), "frames")


@query
def barge_ins(spark: SparkSession, folder: str) -> DataFrame:
    """Turns that the user's next words cut short."""
    ts = F.col("ts").cast("timestamp")
    ended = F.when(F.col("event_type") != "error", ts + F.make_dt_interval(hours=F.floor(F.col("value") / 10).cast("int")))
    return stream.interrupted(table(spark, folder, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn_id"), ts.alias("started"), ended.alias("ended"))).select("turn_id", "interrupted")


SQL["barge_ins"] = """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts + to_hours(CAST(floor(value / 10) AS INT)) END AS ended, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT event_id AS turn_id, later IS NOT NULL AND (ended IS NULL OR later < ended) AS interrupted FROM e"""


@query
def long_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of each user that had to wait over twice the delay."""
    e = table(spark, folder, "events")
    requests = e.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("pos"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrive_s"), (F.col("value") * 1000).alias("took_s"), F.lit(200).alias("status"), F.lit(None).cast("double").alias("retry_s"))
    return stream.long_waits(crawl.paced(requests)).groupBy("host").agg(F.count(F.lit(1)).alias("waits"))


SQL["long_waits"] = """
WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS host, epoch_us(ts) / 1e6 AS arrive, value * 1000 AS took, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(host, n, wait_s, next_allowed) AS (SELECT host, n, 0.0::DOUBLE, arrive + took + 5 FROM r WHERE n = 1 UNION ALL SELECT r.host, r.n, greatest(arrive, next_allowed) - arrive, greatest(arrive, next_allowed) + took + 5 FROM f JOIN r ON r.host = f.host AND r.n = f.n + 1)
SELECT host, count(*) AS waits FROM f WHERE wait_s > 10 GROUP BY host"""


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"file://{folder}" if folder.startswith("/") else folder)


def _drained(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there, as a table in the shared folder; in complete mode the last result counts."""
    spark = rows.sparkSession
    root = _uri(_shared(spark, name))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number if mode == 'append' else 0}")

    running = rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out").drop("batch")


@query
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session memory as a stream with state per session: the same deltas as the batch fold."""
    e = _event_stream(spark, folder)
    asked = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("call_no"), F.array().cast("array<string>").alias("claimed"), F.array(F.concat(F.lit("p"), (F.col("event_id") % 23).cast("string"))).alias("requested"))
    out = _drained(stream.session_stream(asked, {f"p{i}": i * 7 % 19 + 1 for i in range(22)}, EVICTION_BUDGET), "sessions")
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("session", "call_no", text("loaded"), text("evicted"), text("active_after"), "redundant", text("error_ids"), "error_reason")


@query
def stream_pacing(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting times as a stream with state per host: the same as in a batch."""
    e = _event_stream(spark, folder)
    requests = e.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.col("event_id").alias("pos"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrive_s"), (F.col("value") / 10).alias("took_s"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.lit(30.0).alias("retry_s"))
    return _in_us(_drained(stream.host_rates(requests), "pacing"))


@query
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows as a stream: the same as in a batch."""
    e = _event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(stream.windowed(e, "1 hour"), "windows", "complete").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Events delivered twice count once."""
    e = _event_stream(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    twice = e.select("event_id", "ts", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _drained(stream.once(twice, ["event_id"], "40 days"), "once").groupBy((F.col("event_id") % 100).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


SQL["stream_once"] = "SELECT event_id % 100 AS part, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_id % 100"


@query
def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Progress lines of a run, torn ones among them, tailed as a stream."""
    path = _uri(_shared(spark, "progress")) + "/lines"
    e = table(spark, folder, "eval_row").where(F.col("turns").isNotNull())
    line = F.to_json(F.struct(F.when(F.col("pos") % 9 == 0, "other").otherwise("row_done").alias("event"), "question_id", "kind", F.when(F.col("pos") % 8 == 0, F.lit("n/a")).otherwise(F.col("score").cast("string")).alias("score"), "turns", (F.col("pos") * 10).alias("elapsed_ms")))
    e.select(F.when(F.col("pos") % 7 == 0, F.left(line, F.lit(15))).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return _drained(stream.progress(stream.progress_lines(spark, path)), "totals", "complete")


SQL["progress_stream"] = """
WITH e AS (SELECT CASE WHEN pos % 8 <> 0 THEN score END AS score, pos FROM eval_row WHERE turns IS NOT NULL AND pos % 7 <> 0 AND pos % 9 <> 0)
SELECT count(*) AS done, coalesce(round(avg(score), 6), 0) AS mean, count(*) FILTER (score IS NULL) AS unscored, CAST(sum(pos * 10) AS BIGINT) AS elapsed_ms FROM e"""


@query
def row_callbacks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a stream handed to a callback, one by one, as they come."""
    seen: dict[str, list[float]] = {}

    def on_row(row: dict) -> None:
        held = seen.setdefault(row["event_type"], [0, 0.0])
        held[0] += 1
        held[1] += row["value"]

    started = stream.for_each_row(_event_stream(spark, folder), on_row).option("checkpointLocation", _uri(_shared(spark, "callback"))).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.createDataFrame([(k, n, round(v, 2)) for k, (n, v) in seen.items()], "event_type string, n long, total double")


SQL["row_callbacks"] = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"


@query
def emitted_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress lines that workers append each to a file of its own, and the estimate of what is left."""
    root = _shared(spark, "emitted")
    rows = table(spark, folder, "eval_row").where(F.col("turns").isNotNull()).select("pos", "question_id", "score")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pos, question_id, score in zip(batch["pos"], batch["question_id"], batch["score"]):
                stream.emit_progress(f"{root}/{os.getpid()}.jsonl", event="row_done", question_id=question_id, score=None if pd.isna(score) else int(score), elapsed_ms=int(pos))
            yield pd.DataFrame({"n": [len(batch)]})

    rows.mapInPandas(emit, "n long").agg(F.sum("n")).collect()
    lines = stream.progress_lines(spark, _uri(root), stream=False)
    return stream.progress(lines).select("done", "mean", "unscored", "elapsed_ms", F.round(stream.eta_seconds(F.col("done"), 1_000_000, F.lit(100.0)), 3).alias("eta_s"))


SQL["emitted_progress"] = "SELECT count(*) AS done, coalesce(round(avg(score), 6), 0) AS mean, count(*) FILTER (score IS NULL) AS unscored, CAST(sum(pos) AS BIGINT) AS elapsed_ms, round(100.0::DOUBLE / count(*) * (1000000 - count(*)), 3) AS eta_s FROM eval_row WHERE turns IS NOT NULL"
