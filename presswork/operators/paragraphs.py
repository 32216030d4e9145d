"""Leaf paragraphs straight from the markup, without a parse.

A quick form for reports over whole page tables, with attributes and in either
case of the tags.  The main text takes paragraphs without inner tags, the
fallback text all paragraphs with the text of their inner tags; leaf ``div``
elements are read by :mod:`presswork.operators.extract` alone, whose rules
decide in collection runs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quality import quality_score
from ..functions.text import as_col, clean_text, is_boilerplate, once

# The tags read here.
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>([^<]*)</p\s*>"
ANY_PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"
INNER_TAG = r"<[^>]*>"
TITLE = r"(?i)<title(?:\s[^>]*)?>([^<]*)</title\s*>"
# The entities decoded here, `&` last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&#8211;", "–"), ("&#8212;", "—"), ("&#8216;", "‘"),
    ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”"), ("&#8230;", "…"), ("&#160;", "\u00a0"), ("&amp;", "&"),
]


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _leaves(html: Column | str) -> Column:
    raw = F.regexp_extract_all(as_col(html), F.lit(PARAGRAPH), F.lit(1))
    return F.transform(raw, lambda p: clean_text(decode_entities(p)))


def leaf_paragraphs(html: Column | str) -> Column:
    """Main text: paragraphs without inner markup, over 30 characters, not boilerplate."""
    return F.array_join(
        F.filter(_leaves(html), lambda p: (F.length(p) > 30) & ~is_boilerplate(p)), "\n\n"
    )


def first_paragraphs(html: Column | str, n: int = 10) -> Column:
    """Fallback text: the first ``n`` paragraphs over 50 characters, inner tags taken out."""
    raw = F.regexp_extract_all(as_col(html), F.lit(ANY_PARAGRAPH), F.lit(1))
    whole = F.transform(raw, lambda p: clean_text(decode_entities(F.regexp_replace(p, INNER_TAG, ""))))
    return F.array_join(F.slice(F.filter(whole, lambda p: F.length(p) > 50), 1, n), "\n\n")


def page_title(html: Column | str) -> Column:
    return clean_text(decode_entities(F.regexp_extract(as_col(html), TITLE, 1)))


def meta_content(html: Column | str, name: str) -> Column:
    """``content`` of the first ``<meta>`` whose property or name is ``name``, in either order of the two."""
    named = rf"""(?:property|name)\s*=\s*["']{name}["']"""
    content = r"""content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    tag = F.regexp_extract(as_col(html), rf"(?i)<meta\s(?:[^>]*\s)?{named}[^>]*>", 0)
    return decode_entities(F.coalesce(*[F.nullif(F.regexp_extract(tag, f"(?i){content}", k), F.lit("")) for k in (1, 2)], F.lit("")))


def quick_articles(pages: DataFrame) -> DataFrame:
    """Title, text and quality of pages with well-formed paragraphs, without leaving the JVM."""
    keep = [c for c in pages.columns if c != "html"]
    read = pages.select(
        *keep, once(F.struct(page_title("html").alias("title"), leaf_paragraphs("html").alias("content"))).alias("read"))
    return read.select(*keep, "read.title", "read.content").withColumn("quality_score", quality_score("title", "content"))
