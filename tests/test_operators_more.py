"""Model calls, selection, resolution, preload, discovery order, versions of the index, stored postings."""

import types

import pytest
from pyspark.sql import functions as F

from loam.functions import markdown as M
from loam.functions import text as T
from loam.operators import calls, crawl, evalrun, evalset, index, memory, retrieval, tree
from loam.session import checkpoint_dir


class RateLimitError(Exception):
    pass


class AuthenticationError(Exception):
    pass


def test_calls_are_tried_again():
    assert calls.judged(calls.replayed([RateLimitError("x"), "no json", '```json\n{"score": 2, "remark": " ok "}\n```'])) == (2, "ok")
    assert calls.judged(calls.replayed(['{"score": true}', '{"score": 7}', "{}"])) == (None, "[judge_failed] malformed_judge_output: '{}'")
    assert calls.classified(calls.replayed(['{"category": "maybe"}', 'Sure: {"category": "refusal"}'])) == ("refusal", "")
    assert calls.classified(calls.replayed(["?", "?"]))[0] == "answer"
    assert calls.clarified(calls.replayed([" ", " \n"])) == ("", "empty_clarifier_output")
    assert calls.summarised(calls.replayed(['{"long_description": "d"}'])) == (("Untitled", "d"), "")
    with pytest.raises(calls.ModelUnavailable):
        calls.judged(calls.replayed([AuthenticationError("key"), '{"score": 1}']))


def test_selectors(spark):
    rows = spark.createDataFrame([(0, "a", "simple", "p", None, ""), (1, "b", "medium", "q", 3, "x"), (2, "c", "simple", None, 1, "y")], "pos long, question_id string, kind string, persona string, score int, actual_answer string")
    with pytest.raises(ValueError, match="kinds, skip_completed"):
        evalrun.selected(rows, ids="a", kinds=["simple"], skip_completed=True)
    run = lambda **k: {r["question_id"] for r in evalrun.selected(rows, **k).where("run").collect()}
    assert run(ids="a..b") == {"a", "b"} and run(kinds=["simple"]) == {"a", "c"} and run(kinds=["simple"], skip_completed=True) == {"a"} and run() == {"a", "b", "c"}


def test_report_pages_and_bounds(spark):
    rows = spark.createDataFrame([(k, f"q{k}", "simple", "<p>", f'a & "b" {k}', "e", "x", 1, None, 1) for k in range(5)], "pos long, question_id string, kind string, persona string, question string, expected_answer string, actual_answer string, score int, remark string, turns int")
    pages = {r["page"]: r for r in evalrun.report_pages(rows, 2).collect()}
    assert {k: r["rows"] for k, r in pages.items()} == {0: 2, 1: 2, 2: 1}
    assert "a &amp; &quot;b&quot; 4" in pages[2]["html"] and "&lt;p&gt;" in pages[2]["html"] and "—" in pages[2]["html"]
    with pytest.raises(ValueError, match="rows of a page"):
        evalrun.render_report(rows, most_rows=4)
    assert evalrun.report_pages(rows.limit(0)).count() == 0


def test_discovery_order(spark):
    edges = [("http://x/s", 0, "http://x/z"), ("http://x/s", 1, "http://x/a"), ("http://x/z", 5, "http://x/t"), ("http://x/a", 0, "http://x/t"), ("http://x/t", 0, "http://x/s")]
    got = {r["url"]: (r["hop"], r["parent"], r["pos"]) for r in crawl.bfs(spark.createDataFrame(edges, "src string, link_pos int, href string"), spark.createDataFrame([("http://x/s",)], "url string"), 5).collect()}
    # z was discovered before a, though a comes first in the alphabet
    assert got == {"http://x/s": (0, None, 0), "http://x/z": (1, "http://x/s", 0), "http://x/a": (1, "http://x/s", 1), "http://x/t": (2, "http://x/z", 5)}


def test_routes_and_small_images(spark):
    pages = spark.createDataFrame([("u/a", 200, "TEXT/HTML; x", None), ("u/b.PDF", 200, "", None), ("u/c", 200, "image/png", None), ("u/d", 410, "text/html", None), ("u/e", None, None, "err")], "url string, status int, content_type string, error string")
    assert {r["url"]: r["route"] for r in crawl.routed(pages).collect()} == {"u/a": "html", "u/b.PDF": "pdf", "u/c": "unsupported-type", "u/d": "non-2xx", "u/e": "error"}
    md = spark.createDataFrame([("p", "a ![x](s.png) b ![y](big.png)"), ("q", "none")], "page string, markdown string")
    images = spark.createDataFrame([("p", "s.png", 5), ("p", "big.png", 50)], "page string, name string, size int")
    shown, kept = crawl.without_small_images(md, images, 10)
    assert {r["page"]: r["markdown"] for r in shown.collect()} == {"p": "a  b ![y](big.png)", "q": "none"} and kept.count() == 1
    assert crawl.without_small_images(md, images, 0)[1].count() == 2


def test_disposition_samples(spark):
    rows = spark.createDataFrame([("scope", f"u{k}") for k in (3, 1, 2, 1)] + [("depth", None)], "disposition string, url string")
    got = {r["disposition"]: (r["links"], r["sample"]) for r in crawl.disposition_counts(rows, ["scope", "depth", "error"], 2).collect()}
    assert got == {"scope": (4, ["u1", "u2"]), "depth": (1, []), "error": (0, [])}
    assert {r["disposition"]: r["sample"] for r in crawl.disposition_counts(rows, ["scope"], -1).collect()} == {"scope": ["u1", "u2", "u3"]}


def test_images_are_referenced_by_their_whole_names(spark):
    md = '![](xa.png) ![](a.png.bak) ![](b.png "t") ![]( c.png)'
    images = F.array(*[F.struct(F.lit(n).alias("remote"), F.lit(n).alias("local")) for n in ("a.png", "b.png", "c.png", "d.png")])
    got = spark.range(1).select(F.transform(M.referenced_images(F.lit(md), images), lambda i: i["local"]).alias("x")).first()["x"]
    assert got == ["b.png", "c.png"]


def test_resolution(spark):
    known = spark.createDataFrame([("a", "kb.x/a"), ("a.b.c", "kb.x/a/b.1/c")], "id string, path string")
    artefacts = spark.createDataFrame([("kb.x/a", "a"), ("kb.x/a/b.1", "a.b"), ("kb.x/a/n/m", "a.n.m"), ("z/y", "z.y"), ("w", "other")], "path string, id string")
    asked = spark.createDataFrame([(i,) for i in ("a", "a.b", "a.n.m", "z.y", "w", "a", "")], "id string")
    got = {r["id"]: (r["path"], r["rank"]) for r in tree.resolved_ids(asked, known, artefacts).collect()}
    assert got == {"a": ("kb.x/a", 0), "a.b": ("kb.x/a/b.1", 2), "a.n.m": ("kb.x/a/n/m", 1), "z.y": ("z/y", 3), "w": (None, None), "": (None, None)}
    assert tree.resolved_ids(asked.limit(0), known, artefacts).count() == 0


def test_catalog_size_is_that_of_the_rendered_table(spark):
    rows = spark.createDataFrame([("a", "a", 1, "T | x", "long\n text", 10, ["a"]), ("a.b", "a/b", 2, "U", None, 5, ["a", "b"])], "id string, path string, depth int, title string, long string, tokens int, segments array<string>")
    text = tree.rendered_catalog(rows).first()["catalog"]
    got = tree.catalog_size(rows).first()
    assert (got["entries"], got["catalog_tokens"], got["total_tokens"]) == (2, max(1, len(text) // 4), 15 + len(text) // 4)
    assert tree.catalog_size(rows.limit(0)).first()["entries"] == 0


def test_preload(spark):
    catalog = spark.createDataFrame([("a", 10), ("b", 20)], "id string, tokens int")
    starts = spark.createDataFrame([("s", ["b", "x", "a"]), ("t", []), ("u", None), ("v", ["x"]), ("w", ["a", "b"])], "session string, ids array<string>")
    got = {r["session"]: r for r in memory.preloaded(starts, catalog, 30).collect()}
    assert got["s"]["loaded"] == ["b", "a"] and got["s"]["skipped_unknown"] == ["x"] and got["s"]["tokens_used"] == 30
    assert all(not got[k]["loaded"] and not got[k]["budget_exceeded"] for k in "tuv")
    assert memory.preloaded(starts, catalog, 25).where("budget_exceeded").count() == 2


def test_drift_and_stale_rows(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    drift = lambda a, c: spark.range(1).select(memory.reconciled(a, c)["drift"].alias("d")).first()["d"]
    assert [drift(arr("a", "b"), c) for c in (arr("a", "b"), arr("b", "a"), arr("a"), arr(), arr("a", "b", "c"))] == [None, "order", "membership", None, None]
    line, d = memory.step(["a"], [], ["b", "c"], {"a": 1, "b": 1, "c": 1}, 10, frozenset(["c"]))
    assert line == ["a", "b", "c"] and d["loaded"] == ["c"] and d["error_ids"] == ["b"] and d["error_reason"] == "stale_catalog"


def test_versions_of_the_index(spark, tmp_path):
    store = index.IndexStore(spark, f"file://{tmp_path}/ix")
    assert store.version() is None and store.read("kb") is None
    one, two = spark.range(1), spark.range(2)
    store.write(one, one)
    two.write.parquet(f"file://{tmp_path}/ix/v-halfway/kb")  # a run that ended before its mark
    assert store.read("kb").count() == 1
    second = store.write(two, two)
    assert store.version() == second and store.read("manifest").count() == 2
    store.drop()
    assert store.version() is None
    store.write(one, one)
    assert store.read("kb").count() == 1


def test_stored_postings_give_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "Beta gamma"), (3, ""), (4, None), (5, "delta alpha")], "id long, text string")
    asked = spark.createDataFrame([("q", "beta alpha"), ("r", "nothing"), ("s", None)], "query_id string, query string")
    direct = [tuple(r) for r in retrieval.bm25_top_k(docs, asked, 3).orderBy("query_id", "rank").collect()]
    stored = retrieval.TextIndex(spark, f"file://{tmp_path}/p").refresh(docs)
    assert direct == [tuple(r) for r in retrieval.bm25_top_k(stored, asked, 3).orderBy("query_id", "rank").collect()] and [r[1] for r in direct] == [1, 2, 5]
    assert stored.read(["beta"]).where("term = 'beta'").count() == 2
    assert retrieval.bm25_top_k(docs.limit(0), asked, 3).count() == 0


def test_generated(spark):
    packets = spark.createDataFrame([("p", "T", "body", ["x", "y"], []), ("q", "U", "other", ["z"], ["i.png"])], "id string, title string, body string, paragraphs array<string>, assets array<string>")
    slots = [("simple", 1, ["p"], None), ("complex", 2, ["p", "q"], None), ("hard-1", 3, ["p"], "q"), ("hard-2", 4, ["p", "q"], None), ("medium", 5, ["gone"], None), ("medium", 6, None, None)]
    df = spark.createDataFrame([(k, i, ids, o, None, "") for k, i, ids, o in slots], "kind string, item int, ids array<string>, other string, persona_id string, framing string")
    got = {r["item"]: r for r in evalset.generated(df, packets).collect()}
    assert got[1]["expected_answer"] == "body" and got[3]["expected_answer"].split(" ")[2] == "z" and got[4]["id"] == "q"
    assert got[2]["reason"] == "validation_failed_or_llm_error" and {got[5]["reason"], got[6]["reason"]} == {"no_eligible_packet"}
    assert evalset.generated(df.limit(0), packets).count() == 0


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_arguments(spark):
    got = spark.range(1).select(*[T.loaded_json(F.lit(x)).alias(f"c{k}") for k, x in enumerate(['{"a": 1}', "[1]", "{", None, ' {"b": "c"} '])]).first()
    assert list(got) == ['{"a": 1}', "{}", "{}", "{}", '{"b": "c"}']
