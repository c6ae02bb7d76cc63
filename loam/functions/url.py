"""URL column functions. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^@/?#]*@)?([^:/?#]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"


def normalize_url(url: Column) -> Column:
    """Identity form: trimmed, lower scheme and host, no user, default port or fragment; path and query as they are.

    A string that is no absolute URL is only trimmed and loses its fragment.
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, _URL, 1))
    host = F.lower(F.regexp_extract(u, _URL, 2))
    port = F.regexp_extract(u, _URL, 3)
    path = F.regexp_extract(u, _URL, 4)
    query = F.regexp_extract(u, _URL, 5)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    full = F.concat(
        scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query),
    )
    return F.when(u.rlike(_URL), full).otherwise(F.regexp_replace(u, "#.*$", ""))


def in_scope(url: Column, seeds: list[str] | Column) -> Column:
    """Whether the normalised URL begins with the normalised form of any seed."""
    seeds = F.array(*[normalize_url(F.lit(s)) for s in seeds]) if isinstance(seeds, list) else F.transform(seeds, normalize_url)
    return F.exists(seeds, lambda s: F.startswith(normalize_url(url), s))


def host_of(url: Column) -> Column:
    """Host with its port, lower-cased."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#]*)", 1))


def common_host(urls: Column) -> Column:
    """An aggregate: the one host of a group of URLs, null where there are several or none."""
    host = F.nullif(host_of(urls), F.lit(""))
    return F.when(F.min(host) == F.max(host), F.min(host))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _URL, 4)


def strip_host(url: Column) -> Column:
    """Path and query."""
    u = F.trim(url)
    path = path_of(url)
    return F.concat(F.when(path == "", "/").otherwise(path), F.regexp_extract(u, _URL, 5))


def sanitize_segment(segment: Column) -> Column:
    """A path segment as a file name: no separators, no leading dots, never empty."""
    s = F.regexp_replace(F.regexp_replace(segment, r"[/\\]", "_"), r"^\.+", "")
    return F.when(s == "", "_").otherwise(s)


def _segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda x: x != "")


def _stem(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.[^.]*$", "")


def output_path(url: Column) -> Column:
    """Where a page is written: host, every path segment a folder, ``index.md``; a last extension goes unless a slash ends the path."""
    segments = _segments(url)
    cut = F.transform(
        segments, lambda s, i: sanitize_segment(F.when((i == F.size(segments) - 1) & ~F.endswith(path_of(url), F.lit("/")), _stem(s)).otherwise(s))
    )
    host = F.lower(F.regexp_extract(F.trim(url), _URL, 2))
    named = F.when(host == "", "unknown").otherwise(host)
    return F.array_join(F.concat(F.array(sanitize_segment(named)), cut, F.array(F.lit("index.md"))), "/")


def slug_of(url: Column) -> Column:
    """Last path segment without extension, '' where there is none."""
    segments = _segments(url)
    return F.when(F.size(segments) == 0, "").otherwise(sanitize_segment(_stem(F.element_at(segments, -1))))


def is_asset_url(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.pdf$")


def asset_host_allowed(url: Column, referrer: Column, extra_hosts: list[str] | None = None) -> Column:
    allowed = host_of(url) == host_of(referrer)
    return allowed | host_of(url).isin([h.lower() for h in extra_hosts]) if extra_hosts else allowed


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds a ``Retry-After`` header asks for, in either form; null where it says nothing usable."""
    v = F.trim(value)
    seconds = v.try_cast("int").cast("double")
    # the weekday is left out: it adds nothing, and its pattern letter is not supported everywhere
    when = F.try_to_timestamp(F.regexp_extract(v, r"^\w+, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    asked = F.coalesce(seconds, F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double")
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), asked))


def endpoint_url(base: Column, suffix: str = "/v1/traces") -> Column:
    b = F.regexp_replace(base, "/+$", "")
    return F.when(F.endswith(b, F.lit(suffix)), b).otherwise(F.concat(b, F.lit(suffix)))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against a base URL: absolute, scheme-relative, rooted, query-only or relative with dot segments."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    raw = F.concat(folder, F.regexp_replace(href, r"[?#].*$", ""))
    parts = F.split(raw, "/")
    # dot segments fold away from left to right
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    closed = F.when(F.element_at(parts, -1).isin("..", "."), F.concat(F.array_join(folded, "/"), F.lit("/"))).otherwise(F.array_join(folded, "/"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path_of(base), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, closed, tail))
    )
