"""Main bodies and subject areas: made-up sites and corpora with known answers."""

import random

import pytest

from loam.llm.boilerplate import furniture_lines, main_bodies
from loam.llm.subjects import document_subjects

WORDS = "orbit lens crater probe signal antenna module payload thruster sensor telescope comet".split()
MENU = ["Press", "Services", "Payments", "Our blooms", "Forms"]


def site(rng, pages):
    rows, truth = [], set()
    for k in range(pages):
        body = [" ".join(rng.choice(WORDS) for _ in range(14)).capitalize() + f" {rng.randrange(9999)}." for _ in range(4)]
        head = ["Skip to content", "", *[f"- [{m}](/{m})" for m in MENU], "", f"Home » Guides » {body[0][:20]}", ""]
        main = [f"# {body[0][:24]}", *body, "", f"* copy of the {rng.choice(WORDS)} {k}", f"* {rng.choice(WORDS)} ({k} pages)", "", "| a | b | c |", "|---|---|---|", "", "```", "Home » x » y", "```", ""]
        tail = ["Related pages", f"How to {body[1][:18]}", f"What {body[2][:18]}", "", "Back to top", "", "Imprint | Privacy | Terms of use", "", f"© {2000 + k % 20} Gala Help. All rights reserved."]
        lines = head + main + tail
        rows.append((f"p{k}", f"www.gala-help.test/guides/{k}.html", "\r\n".join(lines), ["Top"]))
        truth |= {(f"p{k}", n) for n, x in enumerate(lines) if x and not len(head) <= n < len(head) + len(main)}
    return rows, truth


SCHEMA = "id string, kb_path string, text string, headings array<string>, host string"


def test_site(spark):
    rows, truth = site(random.Random(4), 24)
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0]]], SCHEMA)
    got = {tuple(r) for r in furniture_lines(df).collect()}
    assert got == truth
    bodies = {r["id"]: r["body"] for r in main_bodies(df, furniture_lines(df)).collect()}
    assert bodies["p3"].startswith("# ") and "Imprint" not in bodies["p3"] and "* copy of the" in bodies["p3"]


def test_odd_pages(spark):
    long = "\n\n".join(f"The {k} probe sends a signal to the module." for k in range(20000))
    rows = [("a", None, "Cookie policy\n\nThe probe is here.", None, "x"), ("b", "h/x", None, None, "x"), ("c", "h/x", " \n ", ["", None], "x"), ("d", "h/y", long, [], "x"), ("e", "h/z", "Top > Sub\n\n# Sub\nText here.", ["Top", "Sub"], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in furniture_lines(df).collect()} == {("a", 0)}
    assert furniture_lines(df.limit(0)).count() == 0


TOPICS = {
    "astronomy": "comet crater telescope orbit galaxy eclipse meteor nebula",
    "cooking": "oven recipe flour butter whisk saucepan garlic dough",
    "sailing": "mast rudder anchor harbour keel jib mainsail tiller",
}
TEMPLATES = ["The {} was moved to room {} since the {} was late.", "Please keep the {} for {} days with the {}.", "Readers who ask about the {} get {} pages on the {}.", "Nobody at counter {1} knows the {0} or the {2}."]


def sentence(rng, topic):
    a, b = rng.sample(TOPICS[topic].split(), 2)
    return rng.choice(TEMPLATES).format(a, rng.randrange(2, 90), b)


def test_subjects_held_out(spark):
    rng = random.Random(6)
    examples = [(k, t, "en", " ".join(sentence(rng, t) for _ in range(3))) for k, t in enumerate(list(TOPICS) * 4)]
    docs, truth = [], set()
    for k in range(400):
        mix = rng.sample(list(TOPICS), rng.choice([1, 1, 2]))
        parts = [" ".join(sentence(rng, t) for _ in range(rng.randrange(5, 8))) for t in mix]
        other = rng.choice([t for t in TOPICS if t not in mix])
        parts.append(sentence(rng, other))  # a passing mention
        docs.append((k, "Skip to content\n\n" + "\n\n".join(parts) + "\n\n© 2020 Gala. All rights reserved.", "gala.test/x", None))
        truth |= {(k, t) for t in mix}
    docs += [(1000, None, "x", None), (1001, " ", "x", None), (1002, "Lunch is at noon. The lift is out of order today.", None, None)]
    got = {
        (r["doc_id"], r["subject"])
        for r in document_subjects(
            spark.createDataFrame(docs, "doc_id long, text string, source string, title string"),
            spark.createDataFrame(examples, "example_id long, subject string, lang string, text string"),
            spark.createDataFrame([(t, "") for t in TOPICS], "subject string, description string"),
        ).collect()
    }
    hit = len(got & truth)
    assert hit / len(truth) > 0.97 and hit / len(got) > 0.97
    assert not {d for d, _ in got} & {1000, 1001}


def test_no_examples(spark):
    docs = spark.createDataFrame([(1, "Some words here are on nothing.", "a", None)], "doc_id long, text string, source string, title string")
    none = spark.createDataFrame([], "example_id long, subject string, lang string, text string")
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string")
    assert document_subjects(docs, none, areas).count() == 0
    assert document_subjects(docs.limit(0), none, areas.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_bodies", "p2_found", "p2_pieces", "p5_found", "p5_defects", "p7_containers", "p8_found", "p8_composition"])
def test_queries_run(spark, data, name):
    from loam.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0


def test_varied_notices_are_furniture_at_any_size(spark):
    rng = random.Random(9)
    for pages in (20, 140):
        rows = []
        for k in range(pages):
            notice = f"We use cookies to make this site work {' '.join(rng.choice(WORDS) for _ in range(6))}. Read our cookie policy for details."
            body = " ".join(rng.choice(WORDS) for _ in range(16)).capitalize() + "."
            rows.append((f"p{k}", f"h{k % 7}.test/a/{k}.md", f"{notice}\n\n# Title\n\n{body}", [], "x"))
        got = {tuple(r) for r in furniture_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {(f"p{k}", 0) for k in range(pages)}


def test_repeated_sentences_in_any_language_are_furniture(spark):
    rng = random.Random(3)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(16)).capitalize() + "."
    notice = "Questo portale conserva piccoli file sul dispositivo {} per ricordare le scelte fatte."
    rows = [(f"p{k}", f"h{k % 2}.test/a/{k}.md", f"{body()}\n\n{notice.format(k) if k % 2 else body()}", [], "x") for k in range(40)]
    got = {tuple(r) for r in furniture_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"p{k}", 2) for k in range(1, 40, 2)}


def test_roles_are_judged_host_by_host(spark):
    rng = random.Random(5)
    rows = []
    for k in range(80):
        who = "We" if k % 2 else f"{rng.choice(WORDS)} {rng.choice(WORDS)} {WORDS[k % 12]}{'abcdefg'[k // 12]} and its partners".capitalize()
        text = f"{who} use cookies for {' '.join(rng.choice(WORDS) for _ in range(6))}.\n\n" + " ".join(rng.choice(WORDS) for _ in range(16)) + "."
        rows.append((f"p{k}", f"h{k % 2}.test/a/{k}.md", text, [], "x"))
    got = {tuple(r) for r in furniture_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"p{k}", 0) for k in range(1, 80, 2)}


def test_sentences_of_a_page_alone_are_content_whatever_their_wording(spark):
    only = "Your privacy matters when you choose a provider for the orbit archive.\n\nWe set up a small files experiment and store cookies in a glass jar."
    rows = [("u", "solo.test/a", only, [])] + [(f"n{k}", "shop.test/a", f"The {WORDS[k]} near the {WORDS[k + 5]} is clean and stays where it was.\n\nWe use cookies to measure the audience of this service.", []) for k in range(5)]
    got = {tuple(r) for r in furniture_lines(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {(f"n{k}", 2) for k in range(5)}


def test_an_address_names_the_subject():
    from loam.llm.subjects import address_words

    assert address_words("www.gala.example/law/courts", "See https://help.test/law/judges.html?x=1 or so.") == ["gala", "example", "law", "courts", "help", "test", "judges"]
    assert address_words(None, "") == []


def test_votes_by_chance_name_no_subject():
    import numpy as np

    from loam.llm.subjects import on_subjects

    base = 13
    votes = [[3, 3, 3], [1, 2, 3], [1, 2, 3, 4, 5], [1, 1, 2], [4], [], [1] * 6 + [2] * 6 + [3]]
    doc = np.array([k for k, v in enumerate(votes) for _ in v])
    codes = np.array([x * base**3 for v in votes for x in v])
    assert on_subjects(doc, codes, np.ones(len(doc), int), len(votes), 12).tolist() == [True, False, False, True, False, True, True]
    assert on_subjects(doc[:0], codes[:0], np.ones(0, int), 0, 12).tolist() == []


def test_parts_follow_the_length_of_texts():
    import pandas as pd

    from loam.llm.subjects import _parts

    frame = pd.DataFrame({"text": ["a" * 10, "b" * 95, "c", "", "d" * 250, "e"]})
    assert [list(p["text"].str.len()) for p in _parts(frame, 100)] == [[10], [95, 1, 0], [250, 1]]
    assert list(_parts(frame.iloc[:0])) == []
