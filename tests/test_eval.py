"""Question sets and evaluation runs: known cases, files, reports."""

import pytest
from pyspark.sql import functions as F

from loam.operators import evalrun, evalset
from loam.plans.pipelines import evaluate
from loam.sources import files

PACKETS = "id string, title string, body string, paragraphs array<string>, assets array<string>"
ROW = "pos long, question_id string, kind string, persona string, question string, expected_answer string, actual_answer string, score int, remark string, turns int, transcript string"


def rows(spark, specs):
    return spark.createDataFrame([(k, q, kind, persona, "q", "e", a, s, "", 1, "") for k, (q, kind, persona, a, s) in enumerate(specs)], ROW)


@pytest.mark.parametrize("total,want", [(100, [20] * 5), (12, [3, 3, 2, 2, 2]), (0, [0] * 5)])
def test_split(total, want):
    assert list(evalset.split_total(total).values()) == want


def test_feasible(spark):
    packets = spark.createDataFrame([("a", "t", "b", ["p"], ["i"])], PACKETS)
    got = {r["kind"]: (r["allowed"], r["reason"]) for r in evalset.feasibility(packets, evalset.quota(spark, 25)).collect()}
    assert got == {"simple": (5, None), "medium": (5, None), "complex": (0, "no packet with three paragraphs"), "hard-1": (0, "fewer than two packets"), "hard-2": (1, "too few packets with images")}


def test_sampling(spark):
    packets = spark.createDataFrame([(f"b.p{i}", "t", "b", ["x"] * (i % 4), ["i"] if i % 2 else []) for i in range(12)], PACKETS)
    got = evalset.sampled_packets(packets, evalset.quota(spark, 60), seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["kind"], []).append(r["id"])
    assert {k: len(v) for k, v in by.items()} == dict.fromkeys(evalset.KINDS, 12)
    assert all(by["simple"].count(i) in (1, 2) for i in by["simple"]) and len(set(by["simple"])) == 9 and len(set(by["complex"])) == 3 and len(set(by["hard-2"])) == 6
    assert sorted(map(tuple, got)) == sorted(map(tuple, evalset.sampled_packets(packets.repartition(5), evalset.quota(spark, 60), seed=3).collect()))
    pairs = {r["id"]: r["other"] for r in evalset.paired(spark.createDataFrame([("a.x",), ("a.y",), ("b.z",), ("c.w",)], "id string")).collect()}
    assert pairs["a.x"] == "a.y" and pairs["a.y"] == "a.x" and pairs["b.z"] not in (None, "b.z") and pairs["c.w"] not in (None, "c.w")
    assert evalset.paired(spark.createDataFrame([("a.x",)], "id string")).first()["other"] is None


@pytest.mark.parametrize("a,b,want", [(5, 5, (2, 1)), (1, 5, (1, 2)), (5, 0, (3, 0)), (0, 5, (0, 3)), (2, 1, (2, 1))])
def test_pair_quota(spark, a, b, want):
    assert tuple(spark.range(1).select(evalset.pair_quota(F.lit(a), F.lit(b)).alias("q")).first()["q"]) == want


def test_personas(spark):
    people = spark.createDataFrame([(1, "cand", ["x"]), (0, "hr", ["b"])], "pos long, persona_id string, topics array<string>")
    items = spark.createDataFrame([(k, kind) for k, kind in enumerate(["simple"] * 4 + ["medium"] * 2)], "item long, kind string")
    assert [r["persona_id"] for r in evalset.round_robin(items, people).orderBy("item").collect()] == ["hr", "cand"] * 3
    assert evalset.matched(items, people).count() == 12
    pool = spark.createDataFrame([("a.p",), ("b.q",), ("b",), ("bc",)], "id string").crossJoin(people.select("persona_id", "topics")).withColumn("kind", F.lit("k"))
    got = {}
    for r in evalset.biased(pool, F.col("topics")).collect():
        got.setdefault(r["persona_id"], set()).add(r["id"])
    assert got == {"hr": {"b.q", "b"}, "cand": {"a.p", "b.q", "b", "bc"}}
    assert [r["persona_id"] for r in evalset.selected_personas(people, []).collect()] == ["hr", "cand"]
    with pytest.raises(ValueError, match="zz, yy"):
        evalset.selected_personas(people, ["zz", "hr", "yy"])


def test_places_by_blocks(spark):
    from loam.operators.ranking import placed

    df = spark.range(500).selectExpr("id * 3 as pos", "if(id % 7 = 0, null, cast(id % 3 as string)) as k")
    got = {r["pos"]: r["n"] for r in placed(df, ["k"], "pos", "n", per_block=40).collect()}
    want, seen = {}, {}
    for i in range(500):
        k = None if i % 7 == 0 else i % 3
        seen[k] = seen.get(k, 0) + 1
        want[i * 3] = seen[k]
    assert got == want


def test_drafts(spark):
    body = "The foreign worker levy applies to holders whose permits were issued before the deadline."
    drafts = [(1, 1, "Which of the following?", body, body, "", [], []), (1, 2, "When does it apply?", body, body, "", [], []), (1, 3, "When?", body, body, "", [], []), (2, 1, "When?", "In 9 days", body, "", [], []), (2, 2, "When?", body, body, "off", [], []), (2, 3, "When?", body, body, "", ["a", "b"], ["a"]), (3, 1, "", body, body, "", [], [])]
    df = spark.createDataFrame(drafts, "slot int, attempt int, question string, expected_answer string, body string, persona_mismatch string, needed array<string>, cited array<string>")
    checked = evalset.drafts_checked(df)
    assert {(r["slot"], r["attempt"]): r["reason"] for r in checked.collect()} == {(1, 1): "exam_framing", (1, 2): None, (1, 3): None, (2, 1): "not_grounded", (2, 2): "persona_mismatch", (2, 3): "citation", (3, 1): "incomplete"}
    assert [(r["slot"], r["attempt"]) for r in evalset.first_valid(checked, ["slot"]).collect()] == [(1, 2)]
    q = spark.createDataFrame([(0, "A?"), (1, " a? "), (2, "b"), (3, "A?\n")], "pos long, question string")
    assert [(r["pos"], r["question_id"]) for r in evalset.numbered(evalset.deduplicated(q), "g", per_block=2).orderBy("pos").collect()] == [(0, "g-0001"), (2, "g-0002")]
    chosen = spark.range(1).select(evalset.chosen_paragraphs(F.array(*[F.lit(str(i)) for i in range(6)]), 3, F.lit("k")).alias("c")).first()["c"]
    assert len(chosen) == 3 and chosen == sorted(chosen)


SET = [("q-0001", "simple", "hr", "a", 3), ("b-0002", "medium", "cand", "", 1), ("q-0003", "simple", "hr", "a", 0), ("b-0004", "other", "", "a", None)]


@pytest.mark.parametrize("spec,want", [("b-0004,q-0001", ["q-0001", "b-0004"]), ("q-0001..q-0003", ["q-0001", "b-0002", "q-0003"]), (" b-0002 , ,b-0002", ["b-0002"])])
def test_ids(spark, spec, want):
    got = evalrun.selected_by_ids(rows(spark, SET), spec).where("run").orderBy("pos").collect()
    assert [r["question_id"] for r in got] == want


@pytest.mark.parametrize("spec,match", [("x-1,q-0001,y-2", "x-1, y-2"), ("b-0004..q-0001", "b-0004..q-0001"), ("..b", "span"), ("a..", "span"), ("a..b..c", "span"), ("", "no ids"), (",", "no ids")])
def test_bad_ids(spark, spec, match):
    with pytest.raises(ValueError, match=match):
        evalrun.selected_by_ids(rows(spark, SET), spec)


def test_filters(spark):
    df = rows(spark, SET)
    assert [r["question_id"] for r in evalrun.filtered(df, personas=["hr"], skip_completed=True).collect()] == []
    assert evalrun.filtered(df, kinds=["simple", "medium"]).count() == 3 and evalrun.filtered(df, personas=[""]).count() == 1


def test_merge_and_report(spark):
    results = spark.createDataFrame([("q-0001", "new", 7, "r", 1, "t")], "question_id string, actual_answer string, score int, remark string, turns int, transcript string")
    made = evaluate(rows(spark, SET), "q-0001..b-0002", results, rows(spark, SET))
    got = {r["question_id"]: (r["actual_answer"], r["score"], r["origin"]) for r in made["rows"].collect()}
    assert got == {"q-0001": ("new", None, "executed"), "b-0002": ("[no_result]", None, "executed"), "q-0003": ("a", 0, "inherited"), "b-0004": ("a", None, "inherited")}
    assert tuple(made["scope"].first()) == (2, 2, 0)
    assert {r["question_id"]: r["delta"] for r in made["deltas"].collect()} == {"q-0001": None, "b-0002": None, "q-0003": 0, "b-0004": None}
    kinds = evalrun.by_kind(rows(spark, SET)).orderBy("kind_pos").collect()
    assert [(r["kind"], r["rows"], r["mean"], r["pass_rate"]) for r in kinds][:3] == [("simple", 2, 1.5, 0.5), ("medium", 1, 1.0, 0.0), ("complex", 0, 0.0, 0.0)]
    levels = {(r["level"], r["kind"], r["persona"]): r["rows"] for r in evalrun.report(rows(spark, SET)).collect()}
    assert levels["total", None, None] == 4 and levels["persona", None, "(unattributed)"] == 1 and levels["cell", "simple", "hr"] == 2
    grid = {r["persona"]: r["simple"] for r in evalrun.persona_kind_grid(rows(spark, SET)).collect()}
    assert grid == {"hr": 1.5, "cand": None, "(unattributed)": None}
    assert spark.range(1).select(evalrun.shown_percent(F.lit(0.29)).alias("p")).first()["p"] == 28
    page = evalrun.render_report(rows(spark, SET), "T<", rows(spark, SET))
    assert "T&lt;" in page and "By persona" in page and page.count("<tr>") > 10
    assert "By persona" not in evalrun.render_report(rows(spark, [(q, k, "", a, s) for q, k, _, a, s in SET]))


def test_last_baseline_row_counts(spark):
    base = rows(spark, [("q", "simple", "", "a", 3), ("q", "simple", "", "a", 1)])
    assert evalrun.baseline_deltas(rows(spark, [("q", "simple", "", "a", 3)]), base).first()["delta"] == 2


def test_judged(spark):
    turns = [(1, 1, "user", "user", "q"), (1, 2, "bot", "bot", "one"), (1, 3, "user", "clarifier", "c"), (1, 4, "bot", "bot_final", "two"), (2, 1, "user", "user", "q"), (2, 2, "bot", "bot_final", "only"), (3, 1, "user", "user", "q"), (3, 2, "system", "error", "boom")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, source string, text string")
    ended = spark.createDataFrame([(1, "answer", "two"), (2, "refusal", "only"), (3, "error", "[chat_error]")], "conv_id int, terminated_by string, actual_answer string")
    got = {r["conv_id"]: r["judged"] for r in evalrun.judged_text(df, ended).collect()}
    assert got == {1: "[part 1 of 2]\none\n\n[part 2 of 2]\ntwo", 2: "only", 3: "[chat_error]"}
    assert {r["conv_id"]: r["judged"] for r in evalrun.judged_text(df, ended, "final").collect()}[1] == "two"
    text = {r["conv_id"]: (r["transcript"], r["replies"]) for r in evalrun.transcripts(df).collect()}
    assert text[1] == ("USER: q\n\nBOT: one\n\nUSER (clarifier): c\n\nBOT: two", 2) and text[3] == ("USER: q\n\nEVALRUN: boom", 0)


def test_exchange(spark):
    def ask(message, turns):
        if "crash" in message:
            raise RuntimeError("no")
        return "what exactly?" if len(turns) == 1 else "done"

    got = {r["question_id"]: r for r in evalrun.exchanged(rows(spark, SET).withColumn("question", F.when(F.col("pos") == 1, "crash").otherwise("q")), ask, lambda a: "clarify" if "?" in a else "answer", lambda q, e, a, t: '{"score": true}' if a == "done" else '{"score": 9}', lambda q, a: "this").collect()}
    assert (got["q-0001"]["actual_answer"], got["q-0001"]["turns"], got["q-0001"]["terminated_by"], got["q-0001"]["score"]) == ("done", 2, "answer", None)
    assert got["b-0002"]["actual_answer"] == "[chat_error] RuntimeError" and got["b-0002"]["terminated_by"] == "error" and "EVALRUN" in got["b-0002"]["transcript"]


def test_harness(spark):
    lines = ['{"vars":{"question_id":"a"},"response":{"metadata":{"actual_answer":"x","score":2}}}', '{"metadata":{"question_id":"b","actual_answer":"y","score":true}}', '{"vars":{}}', "broken"]
    got = {r["question_id"]: (r["actual_answer"], r["score"]) for r in evalrun.harness_results(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"a": ("x", 2), "b": ("y", None)}
    assert '"question_id":"q-0001"' in evalrun.harness_tests(rows(spark, SET)).first()["test"]


def test_eval_csv(spark, tmp_path):
    path = str(tmp_path / "set.csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('question_id,kind,question,expected_answer,actual_answer,score,remark,extra\nq-1,simple,"a ""b""\nc — d",e,x,3,r,z\n,simple,no id,e,,,,\nq-2,medium,q,e,,two,,\n')
    df = files.read_eval_csv(spark, path)
    got = df.orderBy("pos").collect()
    assert [(r["question_id"], r["question"], r["score"], r["persona"]) for r in got] == [("q-1", 'a "b"\nc — d', 3, ""), ("q-2", "q", None, "")]
    out = str(tmp_path / "out.csv")
    assert files.write_eval_csv(df, out) == 2
    raw = open(out, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" not in raw
    assert files.read_eval_csv(spark, out).orderBy("pos").collect() == got
    files.write_eval_csv(df, out, files.SET_COLUMNS)
    assert open(out, encoding="utf-8-sig").readline().strip().split(",") == list(files.SET_COLUMNS)
    with open(path, "w") as f:
        f.write("question_id,kind\nq,simple\n")
    with pytest.raises(ValueError, match="question"):
        files.read_eval_csv(spark, path)


def test_persona_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("persona_id,persona_name,persona_description,topics\nhr,HR,Works,a.b; c\ncand,C,Seeks,\n")
    assert [(r["persona_id"], r["topics"]) for r in files.read_personas(spark, str(path)).orderBy("pos").collect()] == [("hr", ["a.b", "c"]), ("cand", [])]
    path.write_text("persona_id,persona_name,persona_description\nHR!,H,\nx,X,y\nx,X,y\n")
    with pytest.raises(ValueError, match="line 2.*blank persona_description.*line 4"):
        files.read_personas(spark, str(path))
