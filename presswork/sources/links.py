"""Links on listing pages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text
from ..functions.urls import resolve_link
from ..operators.nodes import page_nodes
from ..operators.selectors import attr, inside, node_text, predicate, quoted, select
from .registry import SOURCES, Source

_ANCHOR = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>'


def anchor_links(pages: DataFrame) -> DataFrame:
    """Every plain ``<a href="…">text</a>`` of a page, in page order.

    Needs both a title and an address.  No parsing: two pattern passes over
    the page inside the JVM.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("label"),
    )
    links = pages.select(F.col("page_id"), F.col("url").alias("page_url"), F.posexplode(pairs).alias("pos", "link"))
    return (
        links.select(
            "page_id", "page_url", "pos",
            clean_text("link.label").alias("title"), F.col("link.href").alias("href"),
        )
        .filter((F.col("title") != "") & (F.col("href") != ""))
        .select("page_id", "pos", "title", resolve_link("href", "page_url", "page_url").alias("url"))
    )


def discover_links(listings: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Article links of listing pages, by each source's selectors.

    ``listings`` has ``source`` (display name) and ``html``.  The primary
    selectors are used; where they yield no link, the first fallback selector
    that does.
    """
    def within(box: str, selector: str) -> str:
        return f"get(filter(nodes, n -> {inside('n', box)} AND ({predicate('nodes', selector)})), 0)"

    def link(title: str, href: str) -> str:
        return f"named_struct('label', {title}, 'href', {href})"

    def primary(s: Source) -> str:
        title, target = s.primary.get("title"), s.primary.get("link")
        t = within("b", title) if title else "b"
        a = within("b", target) if target else t
        return (f"transform({select('nodes', s.primary['articles'])}, b -> "
                + link(node_text(t), attr(a, "href")) + ")")

    def spare(selector: str) -> str:
        a = f"get(filter(nodes, n -> {inside('n', 'b')} AND n.tag = 'a' AND {attr('n', 'href')} IS NOT NULL), 0)"
        return (f"transform({select('nodes', selector)}, b -> get(transform(array({a}), a -> "
                + link(f"coalesce(nullif({node_text('a')}, ''), {node_text('b')})", attr("a", "href")) + "), 0))")

    def per_source(build) -> str:
        return "CASE " + " ".join(f"WHEN source = {quoted(s.name)} THEN {build(s)}" for s in sources) + " END"

    def usable(links: str) -> str:
        """Links having both parts, as the search for a working selector counts them."""
        return (f"filter({links}, l -> coalesce(l.href, '') <> '' "
                "AND trim(regexp_replace(coalesce(l.label, ''), '(?U)[\\\\s]+|&nbsp;', ' ')) <> '')")

    nothing = "cast(array() AS array<struct<label:string,href:string>>)"

    def fallback(s: Source) -> str:
        tries = ", ".join(usable(spare(x)) for x in s.fallback.get("articles", []))
        return f"get(filter(array({tries}), x -> size(x) > 0), 0)" if tries else nothing

    home = {s.name: s for s in sources}

    def place(attribute: str) -> F.Column:
        cases = " ".join(f"WHEN source = {quoted(n)} THEN {quoted(getattr(s, attribute))}" for n, s in home.items())
        return F.expr(f"CASE {cases} END")

    nodes = page_nodes(listings).withColumn("first_links", F.expr(usable(per_source(primary))))
    chosen = nodes.withColumn(
        "links",
        F.expr(f"CASE WHEN size(first_links) > 0 THEN first_links ELSE coalesce({per_source(fallback)}, {nothing}) END"),
    )
    return (
        chosen.select(
            *[c for c in listings.columns if c not in ("html", "url")],
            F.posexplode("links").alias("pos", "link"),
        )
        .withColumn("title", clean_text("link.label"))
        .withColumn("url", resolve_link("link.href", place("base_url"), place("list_url")))
        .drop("link")
    )
