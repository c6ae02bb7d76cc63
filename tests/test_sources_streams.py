"""Files, artefacts, configuration; streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from loam.operators import crawl, memory
from loam.sources import files
from loam.streaming import events as E


def test_walk(spark, tmp_path):
    for name in ["b/x.MD", "a.txt", "_seg/y.html", "_p.md", "b/skip.exe", "b/compiled.md", "b/assets/i.png", "c/assets/i.png", "c/z.jpeg"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"data \xff" if name == "a.txt" else b"<p>hi</p>" if name.endswith("html") else b"x")
    got = files.walk(spark, str(tmp_path)).orderBy("walk_key").collect()
    assert [(r["kb_path"], r["source_kind"]) for r in got] == [("_p.md", "markdown"), ("a.txt", "text"), ("_seg/y.html", "html"), ("b/x.MD", "markdown"), ("c/z.jpeg", "image"), ("c/assets/i.png", "image")]
    assert files.walk(spark, str(tmp_path), images=False).count() == 4
    texts = {r["kb_path"]: r["text"] for r in files.text_of(files.walk(spark, str(tmp_path))).collect()}
    assert texts["a.txt"] == "data �" and texts["_seg/y.html"] == "hi" and texts["c/z.jpeg"] is None
    seen = {r["kb_path"] for r in files.files_of(spark, str(tmp_path), str(tmp_path)).collect()}
    assert seen == {"a.txt", "b/x.MD", "b/assets/i.png", "c/assets/i.png", "c/z.jpeg"}
    listed = spark.createDataFrame([("b/compiled.md",), ("b/assets/i.png",), ("c/assets/i.png",)], "kb_path string")
    assert {r["kb_path"] for r in files.pruned_assets(listed).collect()} == {"b/compiled.md", "c/assets/i.png"}


def test_artefacts(spark, tmp_path):
    matter = F.struct(F.lit("a.b").alias("id"), F.lit("T").alias("title"), F.lit("leaf").alias("kind"), F.lit(7).alias("token_size_estimate"), F.array(F.lit("u")).alias("source_urls"))
    text = spark.range(1).select(F.lit("a/b/compiled.md").alias("path"), files.compiled_text(matter, F.lit(None), F.lit("para " * 30)).alias("text"))
    row = files.packet_scan(text).first()
    assert (row["id"], row["title"], row["source_urls"], row["paragraphs"]) == ("a.b", "T", ["u"], [("para " * 30).strip()])
    yaml = spark.createDataFrame([("<!-- m -->\n---\nid: x\nkind: odd\ntoken_size_estimate: 5\nimage_urls:\n  p.png: u\n---\nbody",), ("no matter",), ("---\n[broken\n---\n",)], "text string")
    got = [r["m"] for r in yaml.select(files.front_matter(F.col("text")).alias("m")).collect()]
    assert (got[0]["id"], got[0]["kind"], got[0]["content_token_estimate"], got[0]["image_urls"]) == ("x", "leaf", 5, {"p.png": "u"}) and got[1]["id"] is None and got[2]["id"] is None
    assert files.write_files(text, str(tmp_path)) == 1 and (tmp_path / "a/b/compiled.md").read_text().startswith(files.MARKER)


def test_pdf_and_fetch(spark):
    pages = spark.createDataFrame([("f", 2, " two "), ("f", 1, "one")], "kb_path string, page int, text string")
    assert files.pdf_sections(pages).first()["text"] == "## Page 1\n\none\n\n## Page 2\n\ntwo"
    pics = spark.createDataFrame([("f", 2, "b", bytearray(b"x")), ("f", 1, "a", bytearray(b"x")), ("f", 3, "c", bytearray(b"y"))], "kb_path string, page int, name string, content binary")
    assert sorted(r["name"] for r in files.first_images(pics).collect()) == ["a", "c"]

    def get(url):
        if "down" in url:
            raise OSError("no route")
        return url + "/", 503 if "busy" in url else 200, "text/html", b"<p>x</p>"

    df = spark.createDataFrame([("http://a",), ("http://busy",), ("http://down",)], "url string")
    got = {r["url"]: (r["status"], r["error"]) for r in files.fetched(df, get).collect()}
    assert got == {"http://a": (200, None), "http://busy": (503, "http_503"), "http://down": (None, "OSError: no route")}


def test_options_and_prompts(tmp_path):
    o = files.load_options(text='[index]\nchunk_target = 40\n[retrieval]\nreranker = "linear"\n[aliases]\nEP = "Pass"\n')
    assert (o.chunk_target, o.reranker, o.aliases, o.top_k) == (40, "linear", {"EP": "Pass"}, 8)
    for bad in ('[r]\nreranker = "x"', "[r]\ntop_k = 0"):
        with pytest.raises(ValueError):
            files.load_options(text=bad)
    packaged = {"a.b": "Hello $name"}
    assert files.prompt("a.b", packaged, name="X") == "Hello X"
    (tmp_path / "a-b.md").write_text("Own $name")
    assert files.prompt("a.b", packaged, str(tmp_path), name="X") == "Own X"
    with pytest.raises(KeyError):
        files.prompt("a.b", packaged)
    with pytest.raises(ValueError):
        files.prompt("zz", packaged)


def test_log(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text('{"ts":"2024-01-01T00:00:00Z","level":"info","event":"e","n":3}\nbroken\n')
    rows = files.read_log(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["data"]["n"] == "3" and rows[0]["event"] == "e"


def test_progress(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    path = str(folder / "a.jsonl")
    for k, score in enumerate([3, 1, None, True]):
        E.emit_progress(path, event="row_done", question_id=f"q{k}", kind="simple", score=score, turns=1, elapsed_ms=10)
    E.emit_progress(path, event="other", score=0)
    E.emit_progress("/nowhere/at/all.jsonl", event="row_done")
    with open(path, "a") as f:
        f.write('{"event":"row_done","sc')
    want = E.progress(E.progress_lines(spark, str(folder), stream=False)).collect()
    assert (want[0]["done"], want[0]["mean"], want[0]["unscored"]) == (4, 2.0, 2)
    got = E.run_available(E.progress(E.progress_lines(spark, str(folder))), "progress_out", str(tmp_path / "ck"), "complete")
    assert got == want
    assert spark.range(1).select(E.eta_seconds(F.lit(2), 10, F.lit(4.0)).alias("e")).first()["e"] == 16.0
    seen = []
    query = E.for_each_row(E.progress_lines(spark, str(folder)), seen.append).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["question_id"] for r in seen) == ["q0", "q1", "q2", "q3"]


def stream_of(spark, df, folder):
    df.write.parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_turns(spark, tmp_path):
    rows = [(1, 1, "start", None), (1, 3, "assistant.delta", "b"), (1, 2, "assistant.delta", "a"), (1, 4, "assistant.final", "ab"), (2, 1, "start", None), (2, 2, "assistant.delta", "x"), (2, 3, "error", "e")]
    df = spark.createDataFrame(rows, "turn_id int, seq int, kind string, text string")
    got = {r["turn_id"]: (r["streamed"], r["final"], r["failed"], r["errors"]) for r in E.turns(df).collect()}
    assert got == {1: ("ab", "ab", False, 0), 2: ("x", None, True, 1)}
    live = E.run_available(E.turns(stream_of(spark, df, tmp_path / "t")), "turns_out", str(tmp_path / "ck"), "complete")
    assert sorted(live) == sorted(E.turns(df).collect())


def test_fragments_and_frames(spark):
    parts = spark.createDataFrame([("c", 0, 1, "load", '{"a"'), ("c", 0, 2, None, ": 1}"), ("c", 1, 1, "x", "{bad")], "call_id string, index int, seq int, name string, arguments string")
    assert {r["index"]: (r["name"], json.loads(r["arguments"])) for r in E.fragments(parts).collect()} == {0: ("load", {"a": 1}), 1: ("x", {})}
    pieces = spark.createDataFrame([("s", 1, "data: a\n"), ("s", 2, "\r\ndata: b\ndata: c\n\nda"), ("s", 3, "ta: late")], "stream_id string, seq int, data string")
    assert [(r["frame_no"], r["data"]) for r in E.sse_frames(pieces).orderBy("frame_no").collect()] == [(0, "a"), (1, "b\nc")]
    turns = spark.createDataFrame([("s", 1, 0, 5), ("s", 2, 3, 9), ("s", 3, 10, None)], "session string, turn_id int, started int, ended int")
    assert {r["turn_id"]: r["interrupted"] for r in E.interrupted(turns).collect()} == {1: True, 2: False, 3: False}


def test_state_streams_equal_batch(spark, tmp_path):
    calls = spark.createDataFrame([(s, n, [], [f"p{(n * 7 + len(s)) % 5}"]) for s in ("a", "bb") for n in range(12)], "session string, call_no long, claimed array<string>, requested array<string>")
    tokens = {f"p{i}": i + 1 for i in range(5)}
    want = sorted(memory.session_fold(calls, tokens, 8).collect())
    live = E.run_available(E.session_stream(stream_of(spark, calls, tmp_path / "c"), tokens, 8), "memory_out", str(tmp_path / "ck"))
    assert sorted(live) == want
    requests = spark.createDataFrame([(h, k, float(k), 0.5, 429 if k % 3 == 0 else 200, 9.0) for h in ("x", "y") for k in range(8)], "host string, pos long, arrive_s double, took_s double, status int, retry_s double")
    want = sorted(crawl.paced(requests).collect())
    live = E.run_available(E.host_rates(stream_of(spark, requests, tmp_path / "r")), "rates_out", str(tmp_path / "ck"))
    assert sorted(live) == want


def test_windows_equal_batch(spark, data, tmp_path):
    raw = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    live = stream_of(spark, raw, tmp_path / "e")
    assert E.windowed(raw, "1 hour", "30 minutes").count() > E.windowed(raw, "1 hour").count()
    assert E.once(raw.unionByName(raw), ["event_id"]).count() == raw.count()
    deduped = E.run_available(E.once(live, ["event_id"]).select("event_id"), "once_out", str(tmp_path / "ck"))
    assert len(deduped) == raw.count()
    latency = E.turn_latency(raw.select((F.col("event_id") / 9).cast("long").alias("turn_id"), F.when(F.col("event_id") % 9 == 0, "start").when(F.col("event_id") % 9 == 8, "assistant.final").otherwise("assistant.delta").alias("kind"), "ts"))
    assert latency.where("first_token_ms > total_ms").count() == 0
