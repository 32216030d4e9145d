"""URL columns.

Parts are cut with one pattern (RFC 3986, appendix B) instead of
``parse_url``: page links are dirty, and that function raises on a bad URL
under ANSI mode and gives NULL for one with a space in it.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _url(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_url(c), _PARTS, 1))


def url_host(c: Column | str) -> Column:
    """Host with port and user, as written."""
    return F.regexp_extract(_url(c), _PARTS, 2)


def url_path(c: Column | str) -> Column:
    """Path without query, fragment or the last segment's ``;parameters``."""
    return F.regexp_replace(F.regexp_extract(_url(c), _PARTS, 3), ";[^/]*$", "")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.lit([""]).cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    # The seed holds one empty string so that slicing never runs dry.
    joined = F.array_join(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), "/")
    tail = F.when(path.rlike(r"/\.{1,2}$") & ~F.endswith(joined, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.when(F.startswith(joined, F.lit("/")), F.lit("")).otherwise(F.lit("/")), joined, tail)


def join_url(base: Column | str, link: Column | str) -> Column:
    """Absolute form of ``link`` seen on page ``base``."""
    base, link = _url(base), _url(link)
    scheme, host = url_scheme(base), url_host(base)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.regexp_extract(base, _PARTS, 3), "[^/]*$", "")
    path = F.regexp_extract(link, r"^([^?#]*)(.*)$", 1)
    rest = F.regexp_extract(link, r"^([^?#]*)(.*)$", 2)
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    )
    tidy = F.when(full.rlike(r"/\.{1,2}(/|$)"), _without_dots(full)).otherwise(full)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, F.regexp_extract(base, _PARTS, 3), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(root, tidy, rest))
    )


def resolve_link(link: Column | str, base_url: Column | str, list_url: Column | str) -> Column:
    """Listing link: ``/x`` joins the site, anything not ``http…`` the listing page."""
    link = _url(link)
    return (
        F.when(F.startswith(link, F.lit("/")), join_url(base_url, link))
        .when(~F.startswith(link, F.lit("http")), join_url(list_url, link))
        .otherwise(link)
    )


def resolve_image(src: Column | str, base_url: Column | str) -> Column:
    src = _url(src)
    return (
        F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src))
        .when(F.startswith(src, F.lit("/")), join_url(base_url, src))
        .otherwise(src)
    )
