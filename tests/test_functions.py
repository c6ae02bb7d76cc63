"""URL, text, Markdown and HTML functions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loam.functions import html as H
from loam.functions import markdown as M
from loam.functions import text as T
from loam.functions import url as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://User@Example.COM:443/A/b?q=1#f", "https://example.com/A/b?q=1"), ("http://x.test:80", "http://x.test/"), ("http://x.test:8080/?", "http://x.test:8080/"), (" https://x.test/a;p=1 ", "https://x.test/a;p=1"), ("mailto:x", "mailto:x"),
    ],
)
def test_normalize(spark, url, want):
    assert value(spark, U.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(
    "base,href,want",
    [
        ("https://a.test/x/y.html", "z.html", "https://a.test/x/z.html"), ("https://a.test/x/y.html", "../z", "https://a.test/z"), ("https://a.test/x/y", "/r?q", "https://a.test/r?q"), ("https://a.test/x/y", "//b.test/c", "https://b.test/c"),
        ("https://a.test/x/y?o=1", "?p=2", "https://a.test/x/y?p=2"), ("https://a.test/x/", "./", "https://a.test/x/"), ("https://a.test", "b", "https://a.test/b"), ("https://a.test/x", "http://c.test/", "http://c.test/"),
    ],
)
def test_absolute(spark, base, href, want):
    assert value(spark, U.absolute_url(F.lit(base), F.lit(href))) == want


@pytest.mark.parametrize("url,path,slug", [("https://A.test/b/c.html", "a.test/b/c/index.md", "c"), ("https://a.test/b/c.d/", "a.test/b/c.d/index.md", "c"), ("https://a.test/", "a.test/index.md", ""), ("https://a.test/.x", "a.test/_/index.md", "_")])
def test_paths(spark, url, path, slug):
    assert value(spark, U.output_path(F.lit(url))) == path
    assert value(spark, U.slug_of(F.lit(url))) == slug


@pytest.mark.parametrize("header,want", [("120", 120.0), ("-5", 0.0), ("Wed, 21 Oct 2015 07:28:00 GMT", 60.0), ("soon", None), ("", None)])
def test_retry_after(spark, header, want):
    got = value(spark, U.retry_after_seconds(F.lit(header), F.lit(dt.datetime(2015, 10, 21, 7, 27))))
    assert got == want


def test_hosts(spark):
    assert value(spark, U.host_of(F.lit("https://X.test:8080/a"))) == "x.test:8080"
    assert value(spark, U.asset_host_allowed(F.lit("https://b.test/x.pdf"), F.lit("https://a.test/"), ["B.test"]))
    assert value(spark, U.is_asset_url(F.lit("https://b.test/x.PDF?a"))) and not value(spark, U.is_asset_url(F.lit("https://b.test/x.pdf/")))
    assert value(spark, U.endpoint_url(F.lit("http://o.test/"))) == "http://o.test/v1/traces"
    assert value(spark, U.strip_host(F.lit("http://o.test/a?b=1#c"))) == "/a?b=1"


@pytest.mark.parametrize("text,headings,want", [("body", ["A", "B"], "A > B\n\nbody"), ("# B\nx", ["A", "B"], "A\n\n# B\nx"), ("# A\nx", ["A"], "# A\nx"), ("x", [" ", None], "x"), ("x", None, "x")])
def test_heading_prefix(spark, text, headings, want):
    df = spark.createDataFrame([(text, headings)], "t string, h array<string>")
    assert df.select(T.heading_prefix(F.col("t"), F.col("h")).alias("v")).first()["v"] == want


@pytest.mark.parametrize(
    "raw,want",
    [('["a.b","c"]', ["a.b", "c"]), ('["a.b"],', ["a.b"]), ("a.b, c.d", ["a.b", "c.d"]), ("a a b", ["a", "b"]), ('{"a":1}', []), ("", []), (None, []), ('"a.b"', ["a.b"])],
)
def test_id_lists(spark, raw, want):
    from loam.operators.memory import coerced_ids

    assert value(spark, T.id_list(F.lit(raw))) == want
    assert coerced_ids(raw) == want


@pytest.mark.parametrize("raw,ok", [(None, True), ('["a","b"]', True), ("[]", True), ("[1]", False), ("a", False)])
def test_well_formed(spark, raw, ok):
    assert value(spark, T.well_formed_ids(F.lit(raw).cast("string"))) is ok


@pytest.mark.parametrize("text,want", [('{"score": 2}', 2), ('```json\n{"score": 2}\n```', 2), ('Sure {"score": 3} ok', 3), ('{"score": true}', None), ("none", None)])
def test_salvage(spark, text, want):
    got = value(spark, T.salvaged_json(F.lit(text), "score int"))
    assert (got["score"] if got else None) == want


def test_small_text(spark):
    assert value(spark, T.question_id("q", F.lit(12345))) == "q-12345" and value(spark, T.question_id("q", F.lit(7))) == "q-0007"
    assert [value(spark, T.duration(F.lit(s))) for s in (42, 185, 3720, -1)] == ["42s", "3m05s", "1h02m", "0s"]
    assert value(spark, T.figures(F.lit("$5,600. and 5600, 65.40"))) == ["5600", "65.40"]
    assert value(spark, T.invented_figures(F.lit("pay 45, or 46"), F.lit("it is 45."))) == ["46"]
    assert value(spark, T.magic_ext(F.lit(bytearray(b"\x89PNG\r\n\x1a\nxx")))) == ".png" and value(spark, T.magic_ext(F.lit(bytearray(b"zz")))) == ".bin"
    assert value(spark, T.expanded(F.lit("about the EP, please"), {"ep": "Employment Pass"})) == "about the EP, please Employment Pass"
    assert value(spark, T.expanded(F.lit("the employment pass ep"), {"ep": "Employment Pass"})) == "the employment pass ep"
    assert value(spark, T.expanded(F.lit("step one"), {"ep": "Employment Pass"})) == "step one"
    assert value(spark, T.exam_tell(F.lit("Which of the following is it?"))) == "enumeration scaffolding"
    assert value(spark, T.folder_title(F.lit("over-view_x"))) == "Over View X"
    assert value(spark, T.has_marker(F.lit("<!-- M -->\nx"), "<!-- M")) is True


def test_grounding(spark):
    body = "The foreign worker levy applies to holders whose permits were issued before the deadline of 45 days."
    good = "Holders whose permits were issued before the deadline must settle the worker levy within 45 days."
    assert value(spark, T.is_grounded(F.lit(good), F.lit(body))) is True
    assert value(spark, T.is_grounded(F.lit(good.replace("45", "46")), F.lit(body))) is False
    assert value(spark, T.is_grounded(F.lit("Penguins happily migrate across frozen southern oceans during winter"), F.lit(body))) is False
    assert value(spark, T.is_grounded(F.lit(" "), F.lit(body))) is False


def test_markdown(spark):
    md = "x\n| a | b |\n| 1 | 2 |\n\n\n\ny ![i](img/p.png) ![j](https://h/q.png)"
    assert value(spark, M.tidied(F.lit(md))) == "x\n| a | b |\n|---|---|\n| 1 | 2 |\n\ny ![i](img/p.png) ![j](https://h/q.png)\n"
    assert value(spark, M.tidied(F.lit("| a |\n|---|\n| b |"))) == "| a |\n|---|\n| b |\n"
    assert value(spark, M.rewritten_images(F.lit(md))).endswith("y ![i](assets/p.png) ![j](https://h/q.png)")
    assert value(spark, M.without_image(F.lit('a ![x](n.png "t") b'), F.lit("n.png"))) == "a  b"
    assert value(spark, M.link_slugs(F.lit("[a](https://h/x/y.html) ![p](https://h/z.png) [b](https://h/x/y.md?q)"))) == ["y"]
    assert value(spark, M.escaped_cell(F.lit(" a\n| b "))) == "a \\| b" and value(spark, M.unescaped_cell(F.lit(" a \\| b "))) == "a | b"
    assert value(spark, M.section(F.lit("<b>\n## Content\n\nabc\n<e>\n## Other"), "Content", "<b>", "<e>")) == "abc"
    assert value(spark, M.section(F.lit("## Content\n\nabc\n\n## Other\nx"), "Content", "<b>", "<e>")) == "abc"
    assert value(spark, M.without_front_matter(F.lit("<!-- M -->\n---\na: 1\n---\n\nbody"), "<!-- M")) == "body"
    assert value(spark, M.paragraphs(F.lit("| " + "w " * 70 + "|\n\nshort\n\n" + "v " * 70), 120)) == [("w " * 70).strip(), ("v " * 70).strip()]
    assert value(spark, M.retained_pct(F.lit("abc"), F.lit("abcdef"))) == 50.0
    assert value(spark, M.hrefs(F.lit('<a href="/x">a</a><a class=q href="mailto:z">b</a><a href="/x">c</a>'))) == ["/x", "/x"]
    assert value(spark, M.image_source(F.lit("data:xx"), [F.lit("/lazy.png")], F.lit("/s.png 2x, /t.png"))) == "/lazy.png"


PAGE = """<html><head><title> My  Page </title></head><body><nav><a href="/n">N</a></nav><main><h1>Top</h1><p>{}</p>
<ul><li>one</li><li>two <a href="b.html">B</a></li></ul><table><tr><td>h</td><td>i</td></tr><tr><td>1</td><td>2</td></tr></table>
<pre>code  x</pre><img src="a/p.png"><img src="a/p.png"><img src="c/p.png"></main><footer>F</footer></body></html>"""


def test_html(spark):
    got = H.convert(PAGE.format("words " * 60), "https://h.test/d/index.html", "index")
    assert got["title"] == "My Page" and got["extracted"] and got["fallback_reason"] is None
    assert got["markdown"].startswith("# Top") and "- one" in got["markdown"] and "```\ncode  x\n```" in got["markdown"] and "| h | i |" in got["markdown"] and "N" not in got["markdown"].split()
    assert got["links"] == ["https://h.test/n", "https://h.test/d/b.html"]
    assert [i["local"] for i in got["images"]] == ["index-p.png", "index-p-2.png"]
    short = H.convert("<div><p>tiny</p></div>")
    assert not short["extracted"] and short["fallback_reason"] == "too_short"
    form = H.convert("<form><div>" + "<p>" + "body text " * 60 + "</p></div></form>")
    assert form["extracted"] and "body text" in form["markdown"]
    df = spark.createDataFrame([(PAGE.format("w " * 200), "https://h.test/"), (None, None)], "h string, b string")
    rows = df.select(H.converted(F.col("h"), F.col("b"), F.lit("index")).alias("p")).collect()
    assert rows[0]["p"]["markdown"].startswith("# Top") and rows[1]["p"]["markdown"] == ""
