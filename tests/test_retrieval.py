"""Legs, fusion, merging and budget on small tables, against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.operators import chunking, index, retrieval
from loam.plans.pipelines import retrieve

HITS = "query_id string, kb_path string, chunk_index int, id string, text string, headings array<string>, token_estimate int, source_kind string, image_path string, vector_rank int, fts_rank int, fused_score double, rank int"


def hit(path, k, rank, tokens=5, query="q"):
    return (query, path, k, f"{path}{k}", f"t{k}", [f"h{k}"], tokens, f"k{rank}", None, rank, None, 1.0 / rank, rank)


def test_vectors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(900, None), (901, [1.0]), (902, [0.0] * 6)]
    rows += [(1000 + i, rows[3][1]) for i in range(4)]  # ties
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    queries = [(f"q{i}", rows[i][1]) for i in (3, 50)]
    for metric in ("l2", "cosine"):
        got = retrieval.vector_top_k(df, queries, 7, metric=metric).orderBy("query_id", "rank").collect()

        def far(a, b):
            if metric == "l2":
                return math.dist(a, b)
            na, nb = math.hypot(*a), math.hypot(*b)
            return 1 - sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else math.inf

        for name, q in queries:
            best = sorted((round(far(q, v), 9), i) for i, v in rows if v is not None and len(v) == 6 and far(q, v) < math.inf)[:7]
            assert [r["id"] for r in got if r["query_id"] == name] == [i for _, i in best]
    assert retrieval.vector_top_k(df, [], 3).count() == 0
    blocks = retrieval.vector_top_k_blocks(df, df.where("id < 5").select(F.col("id").alias("query_id"), "vector"), 2, block_bytes=96)
    assert blocks.count() == 10


def test_fusion(spark):
    v = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    t = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, id string, rank int")
    order = lambda how, x, y: [r["id"] for r in retrieval.fused(x, y, how).orderBy("rank").collect()]
    assert order("rrf", v, t) == ["b", "a", "c"] and order("none", v, t) == ["a", "b", "c"] and order("linear", v, t) == ["b", "a", "c"]
    # scores do not depend on which leg is which
    score = lambda x, y: {r["id"]: r["fused_score"] for r in retrieval.fused(x, y).collect()}
    assert score(v, t) == score(t, v)
    assert order("rrf", v.limit(0), t) == ["b", "c"]
    with pytest.raises(ValueError):
        retrieval.fused(v, t, "other")


@pytest.mark.parametrize("ok,v,t,want", [(True, 1, 2, None), (True, 0, 0, None), (False, 0, 2, "vector"), (False, 0, 0, "all")])
def test_degraded(spark, ok, v, t, want):
    assert spark.range(1).select(retrieval.degraded(F.lit(ok), F.lit(v), F.lit(t)).alias("d")).first()["d"] == want


def test_adjacent_runs(spark):
    rows = [hit("a", 4, 1), hit("a", 3, 3), hit("a", 6, 2), hit("b", 3, 4), hit("a", 6, 5)]
    got = retrieval.merged_adjacent(spark.createDataFrame(rows, HITS)).orderBy("rank").collect()
    assert [(r["kb_path"], r["chunk_index"], r["text"], r["token_estimate"]) for r in got] == [("a", 3, "t3\n\nt4", 10), ("a", 6, "t6", 5), ("b", 3, "t3", 5)]
    assert (got[0]["id"], got[0]["headings"], got[0]["source_kind"], got[0]["vector_rank"]) == ("a3", ["h3"], "k1", 1)


@pytest.mark.parametrize("tokens,kept", [([8, 5, 2], [True, False, True]), ([99, 1], [True, False]), ([4, 4, 4], [True, True, False])])
def test_budget(spark, tokens, kept):
    rows = [hit("p", 10 * i, i + 1, t) for i, t in enumerate(tokens)]
    got = retrieval.budget_cap(spark.createDataFrame(rows, HITS), 10).orderBy("rank").collect()
    assert [r["kept"] for r in got] == kept


def test_context(spark):
    rows = [hit("b", 1, 1), hit("a", 2, 2), hit("a", 9, 3)]
    got = retrieval.context(spark.createDataFrame(rows, HITS)).first()
    assert got["context"] == "CONTEXT\n\n[source: a § h2]\nt2\n\n[source: a § h9]\nt9\n\n[source: b § h1]\nt1" and got["cited"] == ["a", "b"]


PAGE = "# Title\n\nFirst paragraph here is long enough to matter.\n\n#\n\n## One\n\nSecond paragraph with some more words in it.\n\n## Two\n\nThird paragraph closes the page nicely."


def test_chunks():
    got = chunking.chunks(PAGE, target=20, overlap=0)
    assert len(got) > 1 and all(h for c in got for h in c["headings"]) and all(c["headings"][0] == "Title" for c in got[1:])
    text = PAGE.replace("\n", "\r\n")
    assert [c["text"] for c in chunking.chunks(text, target=20, overlap=0)] == [c["text"] for c in got]
    for c in got:
        assert PAGE[c["char_start"] : c["char_end"]].strip("\n") == c["text"]
    lapped = chunking.chunks(PAGE, target=20, overlap=5)
    assert all(b["text"].split("\n\n")[0] in a["text"] for a, b in zip(lapped, lapped[1:]))
    code = chunking.chunks("```\n" + "x = 1\n" * 40, target=10, overlap=0)
    assert len(code) == 1 and chunking.chunks("", target=5) == [] and chunking.chunks(" \n\n", target=5) == []
    assert len(chunking.chunks("# a\nb", markdown=False, target=50, overlap=0)) == 1


@pytest.mark.parametrize("seed", range(10))
def test_segments_cover(seed):
    rng = random.Random(seed)
    text = "\n".join(rng.choice(["", " ", "# h", "###", "para one", "```py", "```", "~~~~", "| a |", "x"]) for _ in range(60))
    for markdown in (True, False):
        found = chunking.segments(text, markdown)
        assert found[0].start == 0 and found[-1].end == len(text)
        assert all(a.end == b.start for a, b in zip(found, found[1:]))


def test_index_runs(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "markdown", "# A\n\nalpha beta", "h1", 10, 1.0), ("b.txt", "text", "gamma delta", "h2", 11, 1.0), ("c.png", "image", "a red cat", "h3", 12, 1.0), ("d.md", "markdown", "", "h4", 0, 1.0)], "kb_path string, source_kind string, text string, content_hash string, bytes long, mtime double")
    store = index.IndexStore(spark, f"file://{tmp_path}/kb")
    assert index.run_index(store, files, "m")["new"] == 4
    first = store.version()
    kb = store.read("kb")
    assert {r["kb_path"] for r in kb.collect()} == {"a.md", "b.txt", "c.png"} and kb.where("size(vector) <> 64").count() == 0
    assert index.run_index(store, files, "m") == {"new": 0, "changed": 0, "unchanged": 4, "removed": 0} and store.version() == first
    edited = files.withColumn("content_hash", F.when(F.col("kb_path") == "a.md", "h9").otherwise(F.col("content_hash")))
    assert index.run_index(store, edited, "m")["changed"] == 1
    after = {r["id"] for r in store.read("kb").collect()}
    assert len(after & {r["id"] for r in spark.read.parquet(f"{tmp_path}/kb/{first}/kb").collect()}) == 2
    assert index.run_index(store, edited.where("kb_path <> 'b.txt'"), "m")["removed"] == 0 and store.read("kb").where("kb_path = 'b.txt'").count() == 1
    assert index.run_index(store, edited.where("kb_path <> 'b.txt'"), "m", prune=True)["removed"] == 1 and store.read("kb").where("kb_path = 'b.txt'").count() == 0
    with pytest.raises(ValueError):
        index.run_index(store, files, "other")


def test_question_to_context(spark, tmp_path):
    texts = [(f"f{i}.md", "markdown", f"# Page {i}\n\nThe {w} is kept in room {i}.", f"h{i}", 1, 1.0) for i, w in enumerate(["lens", "probe", "comet", "antenna"])]
    files = spark.createDataFrame(texts, "kb_path string, source_kind string, text string, content_hash string, bytes long, mtime double")
    kb = index.index_rows(files, "m")
    asked = spark.createDataFrame([("q1", "where is the CM kept?")], "query_id string, query string")
    got = retrieve(kb, asked, [("q1", index.stub_vector("where is the comet kept?"))], k=2, budget=60, aliases={"cm": "comet"})
    row = got.context.first()
    assert row["cited"][0] in ("f2.md",) or "f2.md" in row["cited"]
    assert "[source: f2.md § Page 2]" in row["context"]


def test_described_images(spark):
    def broken(path):
        raise RuntimeError("no")

    df = spark.createDataFrame([("a/red-cat.png",)], "p string")
    assert df.select(index.described(F.col("p")).alias("d")).first()["d"]["text"] == "red cat"
    assert df.select(index.described(F.col("p"), broken).alias("d")).first()["d"]["error"] == "RuntimeError: no"


def test_chunker_in_sql(spark):
    chunking.register_chunker(spark)
    spark.createDataFrame([("# A\n\nb c", "markdown")], "t string, k string").createOrReplaceTempView("chunk_docs")
    assert spark.sql("SELECT c.text FROM chunk_docs, LATERAL chunk_document(t, k, 500, 60) c").first()["text"] == "# A\n\nb c"


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("stored", [False, True])
def test_pairs_of_query_and_text_are_not_shuffled(spark, tmp_path, stored):
    docs = spark.createDataFrame([(i, f"common w{i % 7} x{i}") for i in range(2000)], "id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q % 5}") for q in range(200)], "query_id long, query string")
    source = retrieval.TextIndex(spark, f"file://{tmp_path}/p").refresh(docs) if stored else docs
    before = shuffled_rows(spark)
    assert retrieval.bm25_top_k(source, asked, 3).count() == 600
    assert shuffled_rows(spark) - before < 30_000  # there are 400,000 pairs


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("block_texts,query_terms", [(8192, 250_000), (16, 40)])
def test_bm25_by_hand(spark, tmp_path, monkeypatch, stored, block_texts, query_terms):
    """Ties, copies, texts and queries under one id, a null id, few and many texts and queries at once."""
    monkeypatch.setattr(retrieval, "BLOCK_TEXTS", block_texts)
    rng = random.Random(3)
    rows = [(f"d{k:03d}", " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 9)))) for k in range(150)]
    rows += [(f"e{k:03d}", rows[k][1]) for k in range(40)] + [("d007", "a b zz"), ("d007", "zz"), (None, "a zz"), ("null", None)]
    asked = [(q, " ".join(rng.sample(["a", "bb", "ccc", "d", "zz", "none"], 3))) for q in range(30)] + [(5, "a a BB"), (31, None), (None, "a d")]
    cut = lambda text: re.findall(r"[a-z]+", (text or "").lower())
    counts, lens = {}, {}
    for i, text in rows:
        counts.setdefault(i, Counter()).update(cut(text))
        lens.setdefault(i, set()).add(len(cut(text)))
    n, avg = len(rows), sum(len(cut(t)) for _, t in rows) / len(rows)
    wanted = {}
    for q, text in asked:
        wanted.setdefault(q, set()).update(cut(text))
    df = Counter(t for c in counts.values() for t in c)

    def score(terms, i, length):
        return round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[i][t] * 2.2 / (counts[i][t] + 1.2 * (0.25 + 0.75 * length / avg)) for t in terms if counts[i][t]), 6)

    # an id of several texts has the length of any one of them: d007 is left out of what is compared by score
    source = spark.createDataFrame(rows, "id string, text string")
    source = retrieval.TextIndex(spark, f"file://{tmp_path}/p").refresh(source) if stored else source
    k = len(counts)
    got = retrieval.bm25_top_k(source, spark.createDataFrame(asked, "query_id long, query string"), k, query_terms=query_terms).collect()
    top = retrieval.bm25_top_k(source, spark.createDataFrame(asked, "query_id long, query string"), 4, query_terms=query_terms).collect()
    for q, terms in wanted.items():
        own = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert {i for _, i, _ in own} == {i for i, c in counts.items() if any(c[t] for t in terms)}
        assert all(s == pytest.approx(score(terms, i, next(iter(lens[i]))), abs=2e-6) for _, i, s in own if i != "d007")
        assert [(i, s) for _, i, s in own] == sorted(((i, s) for _, i, s in own), key=lambda x: (-x[1], x[0] is None, x[0] or ""))
        first = sorted((r["rank"], r["id"], r["score"]) for r in top if r["query_id"] == q)
        assert [(r, s) for r, _, s in first] == [(r, s) for r, _, s in own[:4]] and [i for _, i, _ in first] == [i for _, i, _ in own[:4]]
