"""HTML to Markdown with the parser of the standard library, as pandas functions.

The extractor is pluggable: anything from text to the struct of ``PAGE`` can stand in its place. The default keeps the
page's densest part (text against link text), falls back to the whole page, and says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "struct<markdown:string,title:string,links:array<string>,images:array<struct<remote:string,local:string>>,extracted:boolean,fallback_reason:string,text_chars:int>"
LEAST_CHARS = 200
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr"}
_DROP = {"script", "style", "noscript", "template", "svg", "head"}
_CHROME = {"nav", "footer", "aside", "header", "form", "button"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "body", "html", "figure", "dl", "dt", "dd"}


class _Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Element | str] = []

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, _Element):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in _DROP else c.text() for c in self.children)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("html", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd", "option") and self.at.tag == tag:
            self.at = self.at.parent or self.root
        child = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree_of(html: str) -> _Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _unwrapped_forms(root: _Element) -> None:
    """A form that holds half of a page's text is the page, not a form."""
    total = max(1, len(root.text()))
    for e in list(root.walk()):
        if e.tag == "form" and len(e.text()) * 2 >= total:
            e.tag = "div"


def _inline(e: _Element) -> str:
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in _DROP:
            continue
        elif c.tag == "a" and c.attrs.get("href"):
            out.append(f"[{_inline(c).strip()}]({c.attrs['href']})")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('data-local') or c.attrs.get('src', '')})")
        elif c.tag in ("strong", "b"):
            out.append(f"**{_inline(c).strip()}**")
        elif c.tag in ("em", "i"):
            out.append(f"*{_inline(c).strip()}*")
        elif c.tag == "code":
            out.append(f"`{c.text()}`")
        elif c.tag == "br":
            out.append("\n")
        else:
            out.append(_inline(c))
    return "".join(out)


def _blocks(e: _Element, depth: int = 0) -> list[str]:
    out: list[str] = []
    run: list[_Element | str] = []

    def flush() -> None:
        if run:
            holder = _Element("span", {}, None)
            holder.children = list(run)
            text = _inline(holder).strip()
            if text:
                out.append(text)
            run.clear()

    for c in e.children:
        if isinstance(c, str) or c.tag not in _BLOCK | {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "nav", "footer", "aside", "header", "form", *_DROP}:
            run.append(c)
            continue
        flush()
        if c.tag in _DROP:
            continue
        if re.fullmatch(r"h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + _inline(c).strip())
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, _Element) and x.tag == "li"]
            lines = []
            for n, item in enumerate(items, 1):
                parts = _blocks(item, depth + 1)
                lead = f"{n}. " if c.tag == "ol" else "- "
                lines.append("  " * depth + lead + ("\n" + "  " * (depth + 1)).join(parts))
            out.append("\n".join(lines))
        elif c.tag == "table":
            rows = [[_inline(x).strip().replace("|", "\\|") for x in r.children if isinstance(x, _Element) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            out.append("\n".join("| " + " | ".join(r) + " |" for r in rows if r))
        else:
            out.extend(_blocks(c, depth))
    flush()
    return [b for b in out if b.strip()]


#: How much link text costs a part, and the least share of its text a kept block's own text must have, by mode.
FAVOUR = {"precision": (3.0, 0.5), "balanced": (2.0, 0.0), "recall": (1.0, 0.0)}


def _main_part(root: _Element, favour: str) -> _Element | None:
    """The element that holds most text that is neither link nor page chrome."""
    if favour == "recall":
        return next((e for e in root.walk() if e.tag == "body"), root)
    for e in root.walk():
        if e.tag in ("main", "article") and len(e.text().strip()) >= LEAST_CHARS:
            return e
    best, score = None, 0.0
    for e in root.walk():
        if e.tag in _BLOCK and e.tag not in ("tr", "table", "ul", "ol"):
            own = sum(len(c.text()) for c in e.children if isinstance(c, _Element) and c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "h1", "h2", "h3"))
            links = sum(len(a.text()) for a in e.walk() if a.tag == "a")
            value = own - FAVOUR[favour][0] * links
            if value > score:
                best, score = e, value
    return best


def _without_chrome(e: _Element, favour: str) -> None:
    least = FAVOUR[favour][1]

    def kept(c: _Element) -> bool:
        if c.tag in _CHROME:
            return False
        if not least or c.tag not in ("p", "ul", "ol", "div", "section"):
            return True
        text = len(c.text().strip())  # blocks that are mostly links go where precision counts
        return not text or sum(len(a.text().strip()) for a in c.walk() if a.tag == "a") <= (1 - least) * text

    e.children = [c for c in e.children if isinstance(c, str) or kept(c)]
    for c in e.children:
        if isinstance(c, _Element):
            _without_chrome(c, favour)


def _image_names(root: _Element, base: str, doc: str) -> list[tuple[str, str]]:
    """Local names of images, one per remote address; names taken get -2, -3."""
    named: dict[str, str] = {}
    for e in root.walk():
        if e.tag == "img":
            usable = [v.strip() for v in (e.attrs.get(k, "") for k in ("src", "data-src", "data-original", "data-lazy-src")) if v.strip() and not v.strip().startswith("data:")]
            source = usable[0] if usable else (e.attrs.get("srcset", "").split(",")[0].split() or [""])[0]
            if not source:
                continue
            remote = urljoin(base, source)
            if remote not in named:
                file = re.sub(r"[?#].*$", "", remote).rsplit("/", 1)[-1] or "image"
                stem, dot, ext = file.rpartition(".")
                stem, ext = (stem, dot + ext) if dot else (file, "")
                taken, n = set(named.values()), 1
                name = f"{doc}-{stem}{ext}"
                while name in taken:
                    n += 1
                    name = f"{doc}-{stem}-{n}{ext}"
                named[remote] = name
            e.attrs["data-local"] = named[remote]
    return list(named.items())


def convert(html: str, base: str = "", doc: str = "index", extract: bool = True, favour: str = "balanced") -> dict:
    """A page as Markdown with its links and images; why the whole page was kept, where it was.

    ``favour``: *balanced*; *recall* keeps all but menus and forms; *precision* also drops blocks that are mostly links.
    """
    if favour not in FAVOUR:
        raise ValueError(f"no extraction mode named {favour!r}")
    root = tree_of(html or "")
    title_of = next((e for e in root.walk() if e.tag == "title"), None)
    title = re.sub(r"\s+", " ", title_of.text()).strip() if title_of else ""
    links = []
    for e in root.walk():
        href = e.attrs.get("href", "").strip() if e.tag == "a" else ""
        if href and not re.match(r"(?i)javascript:|mailto:|tel:|#", href):
            links.append(urljoin(base, href))
    images = _image_names(root, base, doc)
    text_chars = len(re.sub(r"\s+", " ", root.text()).strip())
    reason, part = None, None
    if extract:
        _unwrapped_forms(root)
        part = _main_part(root, favour)
        if part is not None:
            _without_chrome(part, favour)
            if len(part.text().strip()) < LEAST_CHARS:
                part, reason = None, "too_short"
        else:
            reason = "no_output"
    else:
        reason = "disabled"
    md = "\n\n".join(_blocks(part if part is not None else root))
    return {
        "markdown": md, "title": title or None, "links": links, "images": [{"remote": r, "local": n} for r, n in images if f"]({n}" in md],
        "extracted": part is not None, "fallback_reason": reason, "text_chars": text_chars,
    }


def converted(html: Column, base: Column, doc: Column, extractor: Callable[[str, str, str], dict] = convert) -> Column:
    """``PAGE`` of each HTML text."""

    def run(pages: pd.Series, bases: pd.Series, docs: pd.Series) -> pd.DataFrame:
        rows = [extractor(p or "", b or "", d or "index") for p, b, d in zip(pages, bases, docs)]
        return pd.DataFrame(rows, columns=["markdown", "title", "links", "images", "extracted", "fallback_reason", "text_chars"])

    return F.pandas_udf(run, PAGE)(html, base, doc)
