"""Splitting, pair defects, tokenizing, packing: round trips, brute force and hand-made cases."""

import math
import os
import random

import pytest

from loam.llm import pack, pairs, split, tokens

VOCABULARY = tokens.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")


# --- splitting


def long_text(rng):
    parts = []
    for _ in range(rng.randrange(3, 14)):
        kind = rng.random()
        sentence = " ".join(rng.choice(["alpha", "beta", "gamma,", "dölta", "epsilon."]) for _ in range(rng.randrange(5, 260)))
        if kind < 0.2:
            parts.append("## " + sentence[:40])
        elif kind < 0.4:
            parts.append("```py\n" + "\n\n".join(sentence[i : i + 70] for i in range(0, len(sentence), 70)) + "\n```")
        elif kind < 0.5:
            parts.append("x" * rng.randrange(10, 5200))
        else:
            parts.append(sentence)
    return rng.choice(["\n\n", "\n\n\n"]).join(parts)


@pytest.mark.parametrize("seed", range(40))
def test_pieces_cover_and_fit(seed):
    text = long_text(random.Random(seed))
    blocks = split.natural_blocks(text)
    cut, spans = split.balanced_spans(text)
    assert cut == ("forced" if any(b - a > split.LIMIT for a, b, _ in blocks) else "boundary")
    covered = "".join(text[b:c] for _, b, c in spans)
    assert covered.replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    edges = {a for a, _, _ in blocks} | {b for _, b, _ in blocks}
    for k, (lead, body, stop) in enumerate(spans):
        assert stop - lead <= split.LIMIT and lead <= body < stop
        if k:
            assert body - lead <= split.OVERLAP + 4 and spans[k - 1][2] <= body
            assert not text[spans[k - 1][2] : body].strip()
        if cut == "boundary":
            assert body in edges and stop in edges


def test_blocks():
    text = "a\nb\n\n# h\nc\n````\nx\n\n```\ny\n````\nd\n~~~\nnever closed\n\nz"
    assert [text[a:b] for a, b, _ in split.natural_blocks(text)] == ["a\nb", "# h", "c", "````\nx\n\n```\ny\n````", "d", "~~~\nnever closed\n\nz"]


def test_split_rows(spark):
    rows = [("a", "x\r\n" * 700, 1), ("a", "x\r\n" * 700, 1), ("b", "y" * 2000, 2), ("c", "y" * 2001, 3), ("d", None, 4), ("e", "", 5), ("f", "w " * 40000, 6)]
    df = spark.createDataFrame(rows, "id string, text string, cut int")
    got = {r["id"]: r for r in split.split_oversized(df).collect()}
    assert set(got) == {"c", "f"}  # CRLF counts as LF: "a" has 1,400 characters
    assert got["c"]["cut"] == "forced" and len(got["f"]["pieces"]) >= 40
    pieces = split.pieces_of(split.split_oversized(df)).collect()
    assert max(len(r["piece"]) for r in pieces) <= 2000
    assert split.split_oversized(df.limit(0)).count() == 0


# --- pairs

Q = "How long does the visa applicant in Quibrail need to reissue the consular desk?"
PAIRS = [
    (Q, None, ["empty"]), (Q, " \n", ["empty"]), (Q, "…", ["empty"]), (Q, "{}", ["empty"]), (Q, "```\n```", ["empty"]), (Q, "N/A", ["empty"]), (Q, "Answer:", ["empty"]), (Q, "[no_result]", ["empty"]), (Q, "<p></p>", ["empty"]), (Q, "​", ["empty"]),
    (Q, "No", []), (Q, "12 days", []), (Q, "Only the consul", []), (Q, "Form 72-Dorova", []), (Q, "Yes, once a year", []),
    (Q, Q, ["copy"]), (Q, Q.upper(), ["copy"]), (Q, "**Q:** " + Q, ["copy"]), (Q, f"{Q}\n{Q}", ["copy"]), (Q, Q.replace("the visa", "the the visa"), ["copy"]), (Q, Q[:-1] + ".", ["copy"]),
    (Q, Q + " It takes 12 days to reissue the desk, and the consul keeps the form for the applicant.", []),
    (Q, "I'm sorry, but I am unable to answer this question. Is there anything else you would like to know?", ["refusal"]),
    (Q, "Hmm, my rules keep me from going into this; please rephrase or contact the help desk.", ["refusal"]), (Q, "No comment.", ["refusal"]),
    ("Wer ist zuständig und wo ist das Amt?", "Leider kann ich diese Frage nicht beantworten. Bitte wenden Sie sich an das Team.", ["refusal"]),
    ("¿Quién se ocupa de los abonos en la oficina?", "Perdone, pero prefiero no contestar.", ["refusal"]),
    ("Qui s'occupe des wagons dans la ville ?", "Désolé, mais il m'est impossible de vous aider sur ce point.", ["refusal"]),
    (Q, "I can't see your own file, but in general: the desk is reissued within 12 days.", []),
    (Q, "Unfortunately the desk can't be changed any more, but here is what to do. Ask the consul for the form.", []),
    (Q, "You cannot reissue the desk yourself.", []), (Q, "I'm sorry to hear that. The desk is reissued within 12 days.", []),
    (Q, "The desk is reissued when the", ["truncated"]), (Q, "The desk is reissued when the consul sig-", ["truncated"]), (Q, "The desk is reissued when the…", ["truncated"]), (Q, "Bring these papers, namely:", ["truncated"]),
    (Q, "The desk is reissued (for example the", ["truncated"]), (Q, "Run this.\n\n```bash\nkb --path ./x", ["truncated"]), (Q, "Bring these.\n1. the form\n2. a copy\n3. The", ["truncated"]),
    (Q, "The handbook explains how to reissue the desk in 24 pages ...", []), (Q, "Bring these.\n* copy of the form\n* exit stamp from Froil", []), (Q, "Run this.\n\n```bash\nkb check --all\n```", []), (Q, "The desk is open (see the table)", []),
    (Q, "Hay que revisar los sellos en un plazo de 30 días y guardar los controles.", ["language"]), (Q, "日志必须在55天内检查,否则补丁失效。没有日志就无法处理服务器。", ["language"]),
    (Q + " Respuesta en español, por favor.", "Hay que revisar los sellos en un plazo de 30 días y guardar los controles.", []),
    (Q, "The desk is open for the consul. The printed sign says “Bitte prüfen Sie die Nebenkosten und melden Sie die Grundrisse.”", []),
    (None, "The desk is open.", []), ("", "", ["empty"]),
]


@pytest.mark.parametrize("question,answer,want", PAIRS)
def test_pair(question, answer, want):
    assert pairs.defects_of(question, answer) == want


def test_pair_rows(spark):
    df = spark.createDataFrame([(1, Q, Q, 1, "x"), (2, Q, "", None, "x"), (3, Q, "The desk is open.", 2, "x"), (1, Q, Q, 1, "x")], "pos long, question string, actual_answer string, turns int, defects string")
    assert sorted(tuple(r) for r in pairs.broken_pairs(df).collect()) == [(1, ["copy"]), (1, ["copy"])]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_very_long_reply():
    assert pairs.defects_of(Q, "The desk is open. " * 20000) == []


# --- tokens


@needs_vocabulary
def test_ids_equal_the_public_tokenizer(spark, data):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    odd = ["", " ", "a<|endoftext|>b", "½ Ⅷ ²³x", "\x1c\x1d a​b  　  x", "日本語テキスト", "\r\n\r\n  x", "🤦🏽‍♂️👍", "it's I'LL we've", "ａｂｃ１２３ ٣٤٥", "x" * 3000, "ab" * 4000 + " " * 500]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").where("text is not null").collect()]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*texts, None])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    for k, text in enumerate(texts):
        assert got[k] == reference.encode(text, add_special_tokens=False).ids, text[:50]
    assert got[len(texts)] is None and got[0] == []


@needs_vocabulary
def test_merging_agrees_with_speculation():
    encoder = tokens.Encoder(open(VOCABULARY, "rb").read())
    rng = random.Random(1)
    words = list({"".join(rng.choice("aeinrst uöß-1'") for _ in range(rng.randrange(1, 18))) for _ in range(3000)})
    assert encoder.decided(words) == [encoder.merged(w.encode()) for w in words]
    assert all(encoder.merged(t) == [r] for t, r in encoder.ranks.items())


# --- packing


def filled(plan):
    fill, placed = {}, {}
    for size, first, last, container, per in plan.runs:
        for rank in range(first, last):
            at = container + (rank - first) // per
            fill[at] = fill.get(at, 0) + size
        placed[size] = placed.get(size, 0) + last - first
    assert placed == {s: c for s, c in plan.counts.items() if c}
    assert set(fill) == set(range(plan.containers)) and all(v <= plan.capacity for v in fill.values())
    return len(fill)


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_plans_are_near_the_optimum():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([10, 30, 100])
        counts = {}
        for _ in range(rng.randrange(1, 9)):
            s = rng.randint(1, capacity)
            counts[s] = counts.get(s, 0) + 1
        got = filled(pack.packing_plan(counts, capacity))
        best = optimum([s for s, c in counts.items() for _ in range(c)], capacity)
        assert best <= got <= best + (best > 3)


def test_large_plan():
    rng = random.Random(3)
    counts = {}
    for _ in range(50_000):
        s = min(2048, int(rng.lognormvariate(5.5, 1)) + 1)
        counts[s] = counts.get(s, 0) + 1
    plan = pack.packing_plan(counts, 2048)
    assert filled(plan) <= math.ceil(sum(s * c for s, c in counts.items()) / 2048) * 1.002 + 1 and plan.fixed


def test_packed_items(spark):
    sizes = [(1, 0), (2, 5000), (3, 2048), (4, 1000), (5, 1000), (6, 48), (6, 48), (7, 2049)] + [(k, 7) for k in range(100, 400)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    got = pack.packed(spark, pack.items_of(df, "doc_id", 2048), "doc_id").collect()
    assert len(got) == len(sizes) + 2 + 1
    fill = {}
    for r in got:
        if r["container_id"] is None:
            assert r["tokens"] == 0
        else:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(t for _, t in sizes)
    assert sorted((r["piece_no"], r["tokens"]) for r in got if r["doc_id"] == 2) == [(0, 2048), (1, 2048), (2, 904)]
    assert pack.packed(spark, pack.items_of(df.limit(0), "doc_id", 2048), "doc_id").count() == 0


def test_hot_size_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(pack, "ROWS_PER_BUCKET", 50)
    df = spark.range(2000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 512, 100 + id % 40) as long) as tokens")
    got = pack.packed(spark, pack.items_of(df, "doc_id", 2048), "doc_id").groupBy("container_id").sum("tokens").collect()
    assert max(r[1] for r in got) <= 2048 and len(got) <= 2000 * 250 / 2048 * 1.2


@pytest.mark.parametrize("times", [1, 2, 3, 4, 5, 9, 400])
def test_a_question_repeated_is_a_copy_however_often(times):
    question = "Which form do I need for a second parking permit?"
    assert pairs.is_copy(question, " ".join([question] * times))
    other = question.replace("second", "third")
    assert pairs.is_copy(question, " ".join([question, other] * times))
    assert not pairs.is_copy(question, " ".join([question] * times) + " You need form 12, which the counter on the second floor has" + " and keeps for you" * times)
    assert not pairs.is_copy(question, " ".join(["Form 12 is for that, and you get it from the counter."] * times))


def test_lines_with_a_role_are_no_sentences_whatever_their_wording_and_length():
    from loam.llm.subjects import sentences_of

    notices = ["Was this page useful?", "Gala Help is operated by Turent.", "We use coo[kies](/c) on this site.", "This website stores cookies" + " and more of them" * 30 + "."]
    for notice in notices:
        assert sentences_of(f"The probe is here.\n\n{notice}\n\nThe lens is there.")[0] == ["The probe is here.", "The lens is there."]
