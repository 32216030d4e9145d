"""Text columns: cleaning, normalising, hashing, dates.

Whitespace follows Unicode on purpose: Java's plain ``\\s`` misses the
no-break space, and Spark's ``trim`` only strips ``' '``.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed_values as fixed
from .urls import url_path

SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE}+"
WORD = r"[\p{L}\p{N}_]{2,}"
# What ``\S+@\S+`` matches, always a whole run of non-spaces; looked for at the beginning of one alone.
MAIL = r"(?U)(?<!\S)\S[^\s@]*+@\S+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def once(value: Column) -> Column:
    """``value`` as a column that later filters do not copy.

    A filter on a computed column is pushed below it by repeating the whole
    expression.  A generator of exactly one row stops that.  Use it alone in a
    ``select``, for values that cost more than carrying them.
    """
    return F.explode(F.array(value))


def contains_any(text: Column, pieces: list[str]) -> Column:
    """True when any piece is a substring, in one pass."""
    return text.rlike("|".join(re.escape(p) for p in pieces))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACES, " "))


def clean_text(c: Column | str) -> Column:
    return F.trim(F.replace(squeeze(c), F.lit("&nbsp;"), F.lit(" ")))


def _whole_words(words: list[str]) -> str:
    return r"(?U)\b(" + "|".join(words) + r")\b"


def normalize_text(c: Column | str) -> Column:
    """Lower-case text without site names, agency words, links or e-mails.

    Deleted pieces leave their surrounding spaces behind; only the ends are
    trimmed afterwards.
    """
    out = squeeze(F.lower(text_or_empty(c)))
    for pattern in (
        _whole_words(fixed.SITE_NAMES),
        _whole_words(fixed.AGENCY_WORDS),
        _whole_words(fixed.READ_MORE_PHRASES),
        r"(?U)https?://\S+",
        MAIL,
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def words(c: Column | str) -> Column:
    return F.filter(F.split(text_or_empty(c), SPACES), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def key_phrases(c: Column | str, n: int = 10) -> Column:
    """The first ``n`` adjacent pairs of words longer than three characters."""
    def pairs(ws):
        found = F.zip_with(
            ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))),
            lambda a, b: F.when((F.length(a) > 3) & (F.length(b) > 3), F.concat_ws(" ", a, b)),
        )
        return F.array_join(F.slice(F.filter(found, lambda p: p.isNotNull()), 1, n), " ")

    return bind(words(c), pairs)


def fingerprint(title: Column | str, content: Column | str, url: Column | str, length: int | None = 2000) -> Column:
    """Hash of title, opening and path; ``length`` None takes the whole content."""
    body = text_or_empty(content) if length is None else F.substring(text_or_empty(content), 1, length)
    return F.sha2(
        F.concat(
            F.lit("T:"), normalize_text(title),
            F.lit("|C:"), normalize_text(body),
            F.lit("|U:"), url_path(url),
        ),
        256,
    )


def title_hash(title: Column | str) -> Column:
    return F.md5(normalize_text(title))


def article_id(url: Column | str, run_ts: Column | str) -> Column:
    """``art_<epoch seconds>_<8 hex digits>``; the run time is an argument, not a clock."""
    return F.concat_ws(
        "_", F.lit("art"), F.unix_timestamp(as_col(run_ts)).cast("string"),
        F.substring(F.md5(as_col(url)), 1, 8),
    )


def looks_like_date(c: Column | str) -> Column:
    return text_or_empty(c).rlike("(?U)" + "|".join(f"(?:{p})" for p in fixed.DATE_PATTERNS))


def published_ts(c: Column | str) -> Column:
    """A timestamp for the page's own date text, NULL when no known shape fits."""
    raw = squeeze(c)
    return F.coalesce(
        F.try_to_timestamp(raw),
        F.try_to_timestamp(raw, F.lit("MM/dd/yyyy")),
        F.try_to_timestamp(raw, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(raw, F.lit("MMM d, yyyy")),
    )


def date_part(c: Column | str) -> Column:
    """Text before the first ``T``, as in ``2024-01-02T10:00``."""
    return F.substring_index(text_or_empty(c), "T", 1)


def is_boilerplate(c: Column | str) -> Column:
    return contains_any(F.lower(text_or_empty(c)), fixed.BOILERPLATE_PHRASES)


def similarity_text(title: Column | str, content: Column | str, length: int | None = 1000) -> Column:
    """Text that similarity compares; ``length`` None takes the whole content."""
    body = text_or_empty(content) if length is None else F.substring(text_or_empty(content), 1, length)
    return normalize_text(F.concat(text_or_empty(title), F.lit(" "), body))


def title_or_link(title: Column | str, link_title: Column | str) -> Column:
    return F.coalesce(F.nullif(as_col(title), F.lit("")), as_col(link_title))


def summary_prompt(title: Column | str, content: Column | str) -> Column:
    return F.format_string(
        fixed.SUMMARY_PROMPT, text_or_empty(title), F.substring(text_or_empty(content), 1, 3000)
    )


def length_in_range(summary: Column | str, low: int = 50, high: int = 65) -> Column:
    return word_count(summary).between(low, high)
