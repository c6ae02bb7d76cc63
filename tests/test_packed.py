"""Packed fields: every writing style seen in exports, and the defined results for odd fields."""

import pytest

from loam.operators.packed import unpack

A, B, C = "https://a.test/x-1?ids=1,21", "http://b.example/y;v=9", "help/settle-notice.md"

CASES = [
    (f"{A} {B}", [A, B]),
    (f"{A}, {B} and {C}", [A, B, C]),
    (f"{A}, {B}, and {C}", [A, B, C]),
    (f"{A};{B};{C}", [A, B, C]),
    (f"{A}|{C}|{B}", [A, C, B]),
    (f"{A}\r\n{B}\n", [A, B]),
    (f"<{A}>,<{B}>", [A, B]),
    (f"<{A}><{B}>", [A, B]),
    (f"{A}{B}", [A, B]),
    (f"1) {A} 2) {B}", [A, B]),
    (f"[1] {A}; [2] {B}", [A, B]),
    (f"(1) {A}\n(2) {B}", [A, B]),
    (f"1. {A}\n10. {B}", [A, B]),
    (f"* {A}\n• {B}\n- {C}", [A, B, C]),
    (f"{A}<br/>{B}<br />{C}", [A, B, C]),
    (f"{A} -> {B}", [A, B]),
    (f"{A} / {B} + {C} & {A}", [A, B, C, A]),
    (f"{A} ‖ {B} · {C}", [A, B, C]),
    (f"{A}、{B}，{C}；{A}", [A, B, C, A]),
    (f"{A} {B}", [A, B]),
    (f", {A} | | {B},\n,\n{C};", [A, B, C]),
    (f'["{A}", "{C}"]', [A, C]),
    (f"['{A}', '{C}']", [A, C]),
    (f"'{A}'|'{B}'", [A, B]),
    (f'"{A}"\t"{B}"', [A, B]),
    ('["faq/a ""new"" b; draft 1.pdf"]', ['faq/a "new" b; draft 1.pdf']),
    (f'"faq/a ""new"" b, part 1.pdf";"c/d | copy 2.md";{A}', ['faq/a "new" b, part 1.pdf', "c/d | copy 2.md", A]),
    (f'["x/turbine \\"new\\" blade, part 4.png", "{B}"]', ['x/turbine "new" blade, part 4.png', B]),
    (f'{A}, "s/park bus; draft 2.md", "{C}"', [A, "s/park bus; draft 2.md", C]),
    (f"{A}?next=https://c.test/x {B}", [f"{A}?next=https://c.test/x", B]),
    (f"{A}\n{A}", [A, A]),
    (f'"{A}", "", "{B}"', [A, B]),
    (None, []),
    ("", []),
    (" \n", []),
    ("none", []),
    ("N/A", []),
    ("[]", []),
    ("-", []),
    (f'"{A}', [A]),
]


def test_every_style(spark):
    df = spark.createDataFrame([(k, s, "clash") for k, (s, _) in enumerate(CASES)], "pos long, f string, row_key string")
    got = {}
    for r in unpack(df, "pos", "f").collect():
        got.setdefault(r["row_key"], {})[r["val_pos"]] = r["val"]
    for k, (text, want) in enumerate(CASES):
        values = got.get(k, {})
        assert [values[i] for i in sorted(values)] == want, text
        assert sorted(values) == list(range(len(want)))


def test_least_and_long_fields(spark):
    many = ",".join(f"https://a.test/{i}" for i in range(5000))
    df = spark.createDataFrame([(1, A), (2, many)], "pos long, f string")
    assert unpack(df, "pos", "f", least=2).groupBy("row_key").count().collect() == [(2, 5000)]


def test_empty_table(spark):
    assert unpack(spark.createDataFrame([], "pos long, f string"), "pos", "f").count() == 0


@pytest.mark.parametrize("name", ["p3_found"])
def test_query_columns(spark, data, name):
    from loam.queries import QUERIES

    df = QUERIES[name](spark, data)
    assert df.columns == ["tab", "row_key", "val_pos", "val"]
    assert df.count() > 0


def test_private_code_points_are_kept(spark):
    field = 'a/x﷐y.md, "b ﷑ ""c"" ﷒﷒0.md"'
    got = spark.createDataFrame([(1, field)], "k long, f string")
    from loam.operators.packed import unpack

    assert [r["val"] for r in unpack(got, "k", "f").orderBy("val_pos").collect()] == ["a/x﷐y.md", 'b ﷑ "c" ﷒﷒0.md']
