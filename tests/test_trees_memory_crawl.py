"""Trees, session memory and link graphs: known cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import crawl, memory, tree

PATHS = ["billing/overview.md", "billing/refunds/p.md", "billing/refunds/chargebacks/c.md", "auth/sso/saml/s.md"]


def files(spark, paths):
    rows = [(p.split("/")[:-1], p.split("/")[-1], f"# {p}\n\nText of {p}. More.", None) for p in paths]
    return spark.createDataFrame(rows, "segments array<string>, name string, text string, link_position int")


def test_catalog(spark):
    df = files(spark, PATHS)
    rows = tree.catalog(tree.folder_documents(df)).orderBy("segments").collect()
    assert [r["id"] for r in rows] == ["auth.sso.saml", "billing", "billing.refunds", "billing.refunds.chargebacks"]
    assert (rows[0]["depth"], rows[0]["path"], rows[0]["title"], rows[0]["long"]) == (3, "auth/sso/saml", "auth/sso/saml/s.md", "Text of auth/sso/saml/s.md.")
    kinds = {"/".join(r["segments"]): r["kind"] for r in tree.folder_kinds(df).collect()}
    assert kinds == {"": "node", "auth": "node", "auth/sso": "node", "auth/sso/saml": "leaf", "billing": "mixed", "billing/refunds": "mixed", "billing/refunds/chargebacks": "leaf"}
    rolled = {"/".join(r["segments"]): (r["descendants"], r["subtree_depth"]) for r in tree.subtree_rollup(tree.folder_kinds(df).select("segments")).collect()}
    assert rolled[""] == (6, 3) and rolled["billing"] == (2, 2) and rolled["auth/sso/saml"] == (0, 0)


def test_walk_order(spark):
    df = files(spark, ["a-b/x.md", "a/x.md", "a/c/x.md"])
    assert [r["path"] for r in tree.catalog(tree.folder_documents(df)).orderBy("segments").collect()] == ["a", "a/c", "a-b"]


def test_reading_order(spark):
    rows = [([], n, n, p) for n, p in [("zeta.md", 1), ("alpha.md", None), ("index.md", None), ("beta.md", 0)]]
    df = spark.createDataFrame(rows, "segments array<string>, name string, text string, link_position int")
    assert tree.folder_documents(df).first()["source_files"] == ["index.md", "beta.md", "zeta.md", "alpha.md"]


def test_catalog_text(spark):
    df = files(spark, [*PATHS, "top.md"])
    rows = tree.catalog(tree.folder_documents(df)).withColumn("title", F.concat("title", F.lit(" | x")))
    text = tree.rendered_catalog(rows)
    assert text.first()["catalog"].splitlines()[2].startswith("| `_root` | `` | 0 |") and text.first()["entries"] == 5
    back = tree.parsed_catalog(text).collect()
    assert {(r["id"], r["path"], r["title"]) for r in back} == {(r["id"], r["path"], r["title"]) for r in rows.collect()}
    broken = spark.createDataFrame([("| a | b |\n| `x` | `x/` | one | t | l |\n| `y` | `y/` | 1 | t |\nplain",)], "catalog string")
    assert [(r["id"], r["long"]) for r in tree.parsed_catalog(broken).collect()] == [("y", "")]
    assert [r["branch"] for r in tree.largest_branches(rows, 2).collect()] == ["billing", "auth"]


def test_rebuild(spark):
    folders = tree.folder_kinds(files(spark, PATHS)).select("segments")
    got = {"/".join(r["segments"]) for r in tree.partial_scope(folders, ["billing", "refunds"]).collect()}
    assert got == {"", "billing", "billing/refunds", "billing/refunds/chargebacks"}
    earlier = spark.createDataFrame([(["billing"], True), (["auth"], False), ([], True)], "segments array<string>, generated boolean")
    plan = {"/".join(r["segments"]): r["action"] for r in tree.kept_or_built(folders, earlier).collect()}
    assert (plan["billing"], plan["auth"], plan[""], plan["auth/sso"]) == ("keep", "foreign", "build", "build")


def test_prefix(spark):
    known = spark.createDataFrame([("a.b",), ("a.b.c",), ("x",)], "id string")
    asked = spark.createDataFrame([("a.b.c.d.e",), ("a.bz",), ("x",)], "id string")
    got = {r["id"]: (r["known_id"], r["rest"]) for r in tree.longest_known_prefix(asked, known).collect()}
    assert got == {"a.b.c.d.e": ("a.b.c", "d.e"), "a.bz": (None, "a.bz"), "x": ("x", "")}


CASES = [
    ({"a": 100, "b": 200, "c": 300}, ["a"], ["b"], 1000, (["a", "b"], [], ["b"], None, None)),
    ({"a": 400, "b": 400, "c": 400}, ["a", "b"], ["c"], 1000, (["b", "c"], ["a"], ["c"], None, None)),
    ({"a": 100, "b": 100, "c": 100}, ["a", "b", "c"], ["a"], 1000, (["a", "b", "c"], [], [], None, None)),
    ({"a": 100}, ["a"], ["nope"], 1000, (["a"], [], [], "nope", "unknown_packet_id")),
    ({"big": 5000}, [], ["big"], 1000, ([], [], [], "big", "budget_exceeded")),
    ({"a": 400, "b": 400, "c": 400, "d": 400}, ["a", "b", "c"], ["d"], 1000, (["c", "d"], ["a", "b"], ["d"], None, None)),
]


@pytest.mark.parametrize("tokens,active,requested,budget,want", CASES)
def test_eviction_cases(tokens, active, requested, budget, want):
    p = memory.plan(active, requested, tokens, budget)
    assert (p.after, p.evicted, p.to_load, p.error_id, p.error_reason) == want


def one_by_one(active, requested, tokens, budget):
    """Evict from the front until it fits; never one just asked for."""
    unknown = [p for p in requested if p not in tokens]
    if unknown:
        return active, [], [], unknown[0], "unknown_packet_id"
    new = [p for p in dict.fromkeys(requested) if p not in active]
    line, gone = active + new, []
    while sum(tokens.get(p, 0) for p in line) > budget and line:
        if line[0] in new:
            return active, [], [], line[0], "budget_exceeded"
        gone.append(line.pop(0))
    return line, gone, new, None, None


def test_eviction_against_the_loop(spark):
    rng = random.Random(5)
    tokens = {f"p{i}": rng.choice([0, 1, 2, 5, 9]) for i in range(9)}
    calls, want = [], {}
    for k in range(400):
        active = rng.sample([*tokens], rng.randrange(0, 6))
        requested = [rng.choice([*tokens, "zz"]) if rng.random() < 0.1 else rng.choice([*tokens]) for _ in range(rng.randrange(0, 4))]
        requested = list(dict.fromkeys(requested))
        calls.append((k, active, requested))
        want[k] = one_by_one(active, requested, tokens, 12)
        p = memory.plan(active, requested, tokens, 12)
        assert (p.after, p.evicted, p.to_load, p.error_id, p.error_reason) == want[k]
    df = spark.createDataFrame(calls, "call_id long, active array<string>, requested array<string>")
    catalog = spark.createDataFrame([*tokens.items()], "id string, tokens int")
    for r in memory.eviction_plan(df, catalog, 12).collect():
        assert (r["after"], r["evicted"], r["to_load"], r["error_id"], r["error_reason"]) == want[r["call_id"]], calls[r["call_id"]]


def test_sessions(spark):
    calls = [("s", 1, [], ["a", "b"]), ("s", 2, [], ["a"]), ("s", 3, ["c"], ["d", "zz"]), ("t", 1, [], ["big"]), ("s", 4, [], ["b"])]
    df = spark.createDataFrame(calls, "session string, call_no long, claimed array<string>, requested array<string>")
    got = {(r["session"], r["call_no"]): r for r in memory.session_fold(df, {"a": 4, "b": 4, "c": 4, "d": 4, "big": 99}, 12).collect()}
    assert got["s", 1]["active_after"] == ["a", "b"] and got["s", 2]["redundant"] and got["s", 2]["loaded"] == []
    assert (got["s", 3]["active_after"], got["s", 3]["evicted"], got["s", 3]["error_ids"]) == (["b", "c", "d"], ["a"], ["zz"])
    assert got["t", 1]["error_reason"] == "budget_exceeded" and got["t", 1]["active_after"] == []
    assert got["s", 4]["redundant"]
    assert memory.session_fold(df.limit(0), {}, 1).count() == 0


def test_packets_and_calls(spark):
    docs = spark.createDataFrame([("a.b", "T", "body"), ("c", "U", "x")], "id string, title string, content string")
    pics = spark.createDataFrame([("a.b", "z.png"), ("a.b", "a.jpg")], "id string, filename string")
    blocks = {r["id"]: [(b["kind"], b["text"], b["mime"], b["filename"]) for b in r["blocks"]] for r in memory.packets(docs, pics).collect()}
    assert blocks["a.b"] == [("text", "# T (a.b)\n\nbody", None, None), ("image", None, "image/jpeg", "a.jpg"), ("image", None, "image/png", "z.png")] and len(blocks["c"]) == 1
    calls = spark.createDataFrame([(1, 1, "x", ["b", "a"], ["q"]), (1, 2, "x", ["a", "c"], None), (1, 3, "y", None, ["q", "r"])], "message_id int, call_no int, context string, requested array<string>, active array<string>")
    row = memory.merged_calls(calls).first()
    assert (row["context"], row["requested"], row["active"], row["calls"]) == ("x; y", ["b", "a", "c"], ["q", "r"], 3)


def test_grounding(spark):
    turns = [(1, 1, "user", "I earn $5,600"), (1, 2, "assistant", "ok"), (1, 3, "tool", "takes 2 weeks"), (1, 4, "assistant", "5600 and 2 weeks, by 31"), (1, 5, "assistant", "45 days"), (1, 6, "tool", "45 days"), (1, 7, "assistant", "45")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = {r["turn"]: (r["unsupported"], r["withheld"]) for r in memory.grounding_checks(df, F.lit("2026-01-31")).collect()}
    assert got == {2: ([], "nothing_loaded"), 4: ([], None), 5: (["45"], "unsupported_figures"), 7: ([], None)}


def reached(edges, seeds, depth):
    seen, front = {s: 0 for s in seeds}, list(seeds)
    for hop in range(1, depth + 1):
        front = sorted({h for s, _, h in edges if s in front} - set(seen))
        seen |= dict.fromkeys(front, hop)
    return seen


def test_bfs(spark):
    rng = random.Random(8)
    pages = [f"http://h.test/{i}" for i in range(40)]
    edges = [(rng.choice(pages), k, rng.choice(pages)) for k in range(90)] + [(pages[0], 0, pages[0])]
    df = spark.createDataFrame(edges, "src string, link_pos int, href string")
    seeds = spark.createDataFrame([(pages[0],), (pages[0] + "#x",)], "url string")
    for depth in (0, 2, 5):
        assert {r["url"]: r["hop"] for r in crawl.bfs(df, seeds, depth).collect()} == reached(edges, [pages[0]], depth)


def test_dispositions(spark):
    seed = "https://a.test/docs/"
    links = [(seed, 0, 0, "mailto:x"), (seed, 0, 1, "https://b.test/f.pdf"), (seed, 9, 2, "https://a.test/f.pdf"), (seed, 0, 3, "https://a.test/docs/p"), (seed, 0, 4, "https://a.test/docs/p#y"), (seed, 2, 5, "https://a.test/docs/q"), (seed, 0, 6, "https://a.test/other"), (seed, 0, 7, "https://a.test/docs/")]
    df = spark.createDataFrame(links, "referrer string, depth int, link_pos int, href string")
    visited = spark.createDataFrame([(seed,)], "url string")
    rows = crawl.dispositions(df, visited, [seed], 2)
    assert {r["link_pos"]: r["disposition"] for r in rows.collect()} == {0: "unparseable", 1: "asset_host", 2: "asset", 3: "follow", 4: "visited", 5: "depth", 6: "scope", 7: "visited"}
    counts = [(r["disposition"], r["links"], len(r["sample"])) for r in crawl.disposition_counts(rows, ["visited", "error", "asset"], 1).collect()]
    assert counts == [("visited", 2, 1), ("asset", 1, 1), ("error", 0, 0)]


def test_layout(spark):
    names = [("h", "index.md"), ("h/a", "index.md"), ("h/a", "index-p.png"), ("h/b", "index.md"), ("h/b/c", "index.md"), ("h/d", "index.md"), ("h", "d.md"), ("h/e", "index.md"), ("h/e", "notes.txt")]
    df = spark.createDataFrame([(d.split("/"), n) for d, n in names], "segments array<string>, name string")
    got = {("/".join(r["segments"]), r["name"]): "/".join([*r["new_segments"], r["new_name"]]) for r in crawl.collapsed(df).collect()}
    assert got == {
        ("h", "index.md"): "h/index.md", ("h/a", "index.md"): "h/a.md", ("h/a", "index-p.png"): "h/a-p.png", ("h/b", "index.md"): "h/b/index.md", ("h/b/c", "index.md"): "h/b/c.md",
        ("h/d", "index.md"): "h/d/index.md", ("h", "d.md"): "h/d.md", ("h/e", "index.md"): "h/e/index.md", ("h/e", "notes.txt"): "h/e/notes.txt",
    }
    assert ["/".join(r["segments"]) for r in crawl.layout_collisions(df).collect()] == ["h/d"]


def test_pacing(spark):
    rows = [("A.test", 1, 0.0, 1.0, 200, None), ("a.test", 2, 2.0, 1.0, 429, 30.0), ("a.test", 3, 7.0, 0.0, 503, 1.0), ("b.test", 4, 7.0, 1.0, 200, 60.0), ("b.test", 5, 8.0, 1.0, 200, None)]
    df = spark.createDataFrame(rows, "host string, pos long, arrive_s double, took_s double, status int, retry_s double")
    assert {r["pos"]: r["wait_s"] for r in crawl.paced(df).collect()} == {1: 0.0, 2: 4.0, 3: 30.0, 4: 0.0, 5: 5.0}


def test_pacing_by_blocks(spark):
    """A host's waits do not depend on how its requests are cut into blocks, and are those of a walk through them."""
    rng = random.Random(2)
    rows, at = [], {"h": 0.0, "g": 0.0}
    for pos in range(60):
        host = rng.choice("hhhg")
        at[host] += rng.choice([0.0, 0.5, 3.0, 20.0, 90.0])
        rows.append((host, pos, at[host], rng.choice([0.25, 4.0]), rng.choice([200, 200, 429]), rng.choice([None, 1.0, 40.0])))
    want, free = {}, {}
    for host, pos, arrive, took, status, retry in rows:
        start = max(arrive, free.get(host, arrive))
        free[host] = start + took + max(5.0, (retry or 0.0) if status == 429 else 0.0)
        want[pos] = start - arrive
    df = spark.createDataFrame(rows, "host string, pos long, arrive_s double, took_s double, status int, retry_s double")
    for per_block in (1, 3, 100):
        assert {r["pos"]: r["wait_s"] for r in crawl.paced(df, per_block=per_block).collect()} == want


def test_names_and_sidecars(spark):
    wanted = spark.createDataFrame([("f", "doc", ".md", 2), ("f", "doc", ".md", 1), ("g", "doc", ".md", 3)], "folder string, stem string, ext string, pos int")
    assert sorted((r["pos"], r["name"]) for r in crawl.numbered_names(wanted).collect()) == [(1, "doc.md"), (2, "doc-2.md"), (3, "doc.md")]
    cited = spark.createDataFrame([("x.pdf", "p2", 2, 0), ("x.pdf", "p1", 1, 5)], "asset string, page string, visit_order int, link_pos int")
    assert crawl.first_citers(cited).first()["page"] == "p1"
    df = spark.createDataFrame([("f", "index.md", "document", "u0"), ("f", "a.md", "document", "u1"), ("f", "b.md", "document", "u2"), ("f", "p.png", "image", "u3")], "folder string, name string, kind string, url string")
    links = spark.createDataFrame([("f", "b", 0), ("f", "gone", 1), ("f", "a", 2), ("f", "b", 3)], "folder string, slug string, link_pos int")
    from loam.sources.files import sidecar_of

    got = crawl.sidecars(df, links).select(sidecar_of(F.col("sidecar")).alias("s")).first()["s"]
    assert got["link_order"] == ["b", "a"] and got["documents"]["a.md"] == "u1" and got["images"] == {"p.png": "u3"}
    assert spark.range(1).select(sidecar_of(F.lit("{broken")).alias("s")).first()["s"] is None
    moved = crawl.provenance(spark.createDataFrame([("a/index.md", "u")], "path string, url string"), spark.createDataFrame([("a/index.md", "a.md")], "old_path string, new_path string"))
    assert moved.first()["path"] == "a.md"


def test_leaf_collapse_query_takes_every_depth(spark, tmp_path):
    from loam.queries import QUERIES

    spark.createDataFrame([("h/a/b/c/d/e/f/g.md",), ("h/a/b.md",)], "kb_path string").write.parquet(f"{tmp_path}/manifest_entry.parquet")
    got = {(r["path"], r["name"]): r["new_path"] for r in QUERIES["leaf_collapse"](spark, str(tmp_path)).collect()}
    # the query gives each page a picture beside it, which moves with it
    deep, kept = "h/a/b/c/d/e/f/g", "h/a/b"
    assert got == {(deep, "index.md"): f"{deep}.md", (deep, "index-g.png"): f"{deep}-g.png", (kept, "index.md"): f"{kept}/index.md", (kept, "index-b.png"): f"{kept}/index-b.png"}


def test_catalog_round_trip_of_whole_bodies(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/packet.parquet").select("id", F.trim(F.regexp_replace("body", r"\s+", " "))).collect()]
    rows += [("odd.a", "word " * 40 + r"a | b \ c \| d \\ e || f \n g"), ("odd.b", "x" * 500 + "|"), ("odd.c", "word " * 30 + "` <br> [a](b) &amp; * _ #")]
    df = spark.createDataFrame(rows, "id string, long string").select("id", F.replace("id", F.lit("."), F.lit("/")).alias("path"), F.size(F.split("id", r"\.")).alias("depth"), F.lit("t").alias("title"), "long", F.split("id", r"\.").alias("segments"))
    assert {(r["id"], r["long"].strip()) for r in tree.parsed_catalog(tree.rendered_catalog(df), "catalog").collect()} == set(rows)
