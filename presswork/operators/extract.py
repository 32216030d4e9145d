"""Article extraction: five strategies per page, the best one kept.

The strategies run in a fixed order on one page, and reading the main text
removes navigation and advertising from it.  Later strategies therefore see
less of the page than earlier ones.  That is kept here as ``tried``: the
containers read so far, from which ``_alive`` tells what is still there.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.images import best_image
from ..functions.quality import candidate_quality, confidence, passes_gate
from ..functions.text import bind, clean_text, date_part, is_boilerplate, looks_like_date, once, text_or_empty
from ..sources.registry import SOURCES, Source
from .nodes import page_nodes
from .selectors import attr, first, inside, node_text, quoted, select

FIELDS = ["title", "content", "description", "author", "date", "image_url"]
ENOUGH_TEXT = 200
EXCELLENT = 0.9


def _candidate(strategy: str, **fields: Column) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"),
        *[text_or_empty(fields.get(f, F.lit(""))).alias(f) for f in FIELDS],
    )


# ---------------------------------------------------------------- JSON-LD

def _json_text(item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", "string")


def _is_kind(item: Column, path: str, kind: str) -> Column:
    """The JSON value at ``path`` is a STRING, ARRAY, OBJECT ..."""
    found = F.try_variant_get(item, path, "variant")
    return F.coalesce(F.startswith(F.schema_of_variant(found), F.lit(kind)), F.lit(False))


def _one_or_first(item: Column, field: str, inner: str) -> Column:
    """A string, an object's ``inner`` field, or the same of a list's first element."""
    return F.coalesce(
        F.when(_is_kind(item, f"$.{field}", "OBJECT"), F.coalesce(_json_text(item, f"{field}.{inner}"), F.lit("")))
        .when(
            _is_kind(item, f"$.{field}", "ARRAY"),
            F.when(
                _is_kind(item, f"$.{field}[0]", "OBJECT"),
                F.coalesce(_json_text(item, f"{field}[0].{inner}"), F.lit("")),
            ).otherwise(_json_text(item, f"{field}[0]")),
        )
        .otherwise(_json_text(item, field)),
        F.lit(""),
    )


def json_ld_items(ld_json: Column) -> Column:
    """All top-level items of a page's JSON-LD scripts, in order; bad JSON gives none."""
    parsed = F.transform(ld_json, lambda s: F.try_parse_json(F.regexp_replace(s, r"[\n\r\t]", " ")))
    items = F.transform(
        parsed,
        lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
    )
    return F.flatten(F.filter(items, lambda a: a.isNotNull()))


def json_ld_article(ld_json: Column) -> Column:
    """The first item typed as an article; NULL when there is none."""
    wanted = F.filter(
        json_ld_items(ld_json),
        lambda v: _is_kind(v, "$['@type']", "STRING")
        & F.try_variant_get(v, "$['@type']", "string").isin(fixed.ARTICLE_TYPES),
    )
    return F.get(wanted, F.lit(0))


def _bad_json_ld(item: Column) -> Column:
    """A text field that is neither text nor null stops this strategy."""
    bad = F.lit(False)
    for name in ("headline", "articleBody", "description"):
        kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
        falsy = F.try_variant_get(item, f"$.{name}", "string").isin("0", "false", "[]", "{}")
        bad = bad | (~kind.isin("STRING", "VOID") & ~F.coalesce(falsy, F.lit(False)))
    kind = F.schema_of_variant(F.try_variant_get(item, "$.datePublished", "variant"))
    return F.coalesce(bad, F.lit(False)) | F.coalesce(kind != "STRING", F.lit(False))


def _json_ld(item: Column) -> Column:
    return _candidate(
        "json_ld",
        title=clean_text(_json_text(item, "headline")),
        content=clean_text(_json_text(item, "articleBody")),
        description=clean_text(_json_text(item, "description")),
        author=_one_or_first(item, "author", "name"),
        date=date_part(_json_text(item, "datePublished")),
        image_url=_one_or_first(item, "image", "url"),
    )


# -------------------------------------------------------------- microdata

def _text_of(node: Column) -> Column:
    return F.substring(F.col("text"), node["start"] + 1, node["stop"] - node["start"])


def _microdata() -> Column:
    """From ``props``, the elements with an itemprop inside the first article item."""
    def prop(name):
        found = F.expr(first(f"filter(props, n -> {attr('n', 'itemprop')} = {quoted(name)})"))
        return bind(found, lambda n: F.coalesce(
            F.nullif(F.try_element_at(n["attrs"], F.lit("content")), F.lit("")), _text_of(n)))

    return _candidate(
        "microdata",
        title=F.coalesce(F.nullif(prop("headline"), F.lit("")), prop("name")),
        content=prop("articleBody"), description=prop("description"),
        author=prop("author"), date=prop("datePublished"), image_url=prop("image"),
    )


# ------------------------------------------------------------- main text

_PARAGRAPHS = "array<struct<i:int,end:int,chrome:int,frame:int,words:string>>"
_BOXES = "array<struct<rank:int,i:int,end:int,chrome:int,frame:int,is_body:boolean>>"
_CANDIDATE = "struct<strategy:string," + ",".join(f"{f}:string" for f in FIELDS) + ">"


def _alive(n: str, tried: str) -> str:
    """``n`` was not removed while one of the ``tried`` containers was read."""
    return (f"NOT exists({tried}, e -> {inside(n, 'e')} AND "
            f"({n}.chrome > e.i OR (e.is_body AND {n}.frame > e.i)))")


def _paragraphs(start: str, stop: str) -> Column:
    """Text of every ``p`` and ``div`` holding exactly one string, if it reads like prose."""
    leaf = F.expr(f"filter(nodes, n -> n.tag IN ('p', 'div') AND n.{stop} > n.{start})")
    cleaned = F.transform(leaf, lambda n: F.struct(
        n["i"].alias("i"), n["end"].alias("end"), n["chrome"].alias("chrome"), n["frame"].alias("frame"),
        clean_text(F.substring(F.col("text"), n[start] + 1, n[stop] - n[start])).alias("words"),
    ))
    return F.filter(cleaned, lambda p: (F.length(p["words"]) > 30) & ~is_boilerplate(p["words"]))


def _text_in(box: str, paragraphs: str, frame_too: bool = False) -> str:
    more = f" AND p.frame <= {box}.i" if frame_too else ""
    return (f"array_join(transform(filter({paragraphs}, p -> {inside('p', box)} AND p.chrome <= {box}.i{more}), "
            f"p -> p.words), '\\n\\n')")


def _box(n: str, rank: int, is_body: bool = False) -> str:
    return (f"named_struct('rank', {rank}, 'i', {n}.i, 'end', {n}.end, 'chrome', {n}.chrome, "
            f"'frame', {n}.frame, 'is_body', {str(is_body).lower()})")


def _containers(nodes: str, selectors: Sequence[str]) -> str:
    """Every match of every selector, in selector order, then document order."""
    return "flatten(array(" + ", ".join(
        f"transform({select(nodes, s)}, n -> {_box('n', k)})" for k, s in enumerate(selectors)
    ) + "))"


def _read_containers(containers: str, paragraphs: str) -> Column:
    """Read the first living match of each selector until one holds enough text."""
    content = _text_in("b", paragraphs)
    return F.expr(f"""
        aggregate({containers},
          named_struct('rank', -1, 'tried', cast(array() AS {_BOXES}), 'content', '', 'done', false),
          (acc, b) -> CASE WHEN acc.done OR acc.rank = b.rank OR NOT ({_alive('b', 'acc.tried')}) THEN acc
            ELSE get(transform(array({content}), c -> named_struct(
              'rank', b.rank, 'tried', concat(acc.tried, array(b)),
              'content', c, 'done', length(c) > {ENOUGH_TEXT})), 0) END)""")


# ---------------------------------------------------------- field rules

def _meta(metas: str, key: str, name: str) -> str:
    """First ``meta`` element with this property or name."""
    return first(f"filter({metas}, n -> {attr('n', key)} = {quoted(name)})")


def _meta_content(names: Sequence[str]) -> Column:
    """Content of the first of ``names`` that has any; ``property`` goes before ``name``."""
    tries = []
    for name in names:
        meta = f"coalesce({_meta('metas', 'property', name)}, {_meta('metas', 'name', name)})"
        tries.append(f"nullif({attr(meta, 'content')}, '')")
    return F.expr(f"coalesce({', '.join(tries)}, '')")


def _description(more_names: Sequence[str] = ()) -> Column:
    tries = [_meta("left_metas", "name", "description")]
    for name in more_names:
        tries += [_meta("left_metas", "name", name), _meta("left_metas", "property", name)]
    return F.expr(f"coalesce({attr(f'coalesce({', '.join(tries)})', 'content')}, '')")


def _first_text(selectors: Sequence[str], accept) -> Column:
    """Text of the first match per selector, the first acceptable one; else an empty string."""
    nodes = F.expr("flatten(array(" + ", ".join(f"slice({select('places', s)}, 1, 1)" for s in selectors) + "))")
    texts = F.transform(nodes, lambda n: clean_text(_text_of(n)))
    return text_or_empty(F.get(F.filter(texts, accept), F.lit(0)))


def _image_sources() -> Column:
    """Candidate image addresses in selector order."""
    src = f"coalesce(nullif({attr('n', 'src')}, ''), nullif({attr('n', 'data-src')}, ''))"
    found = ", ".join(
        f"transform({select('images', s, 'places')}, n -> {src})" for s in fixed.IMAGE_SELECTORS
    )
    # Most pages have few images or none: look for them only when there are some.
    return F.expr(f"""CASE WHEN size(images) > 0 THEN filter(flatten(array({found})), s -> s IS NOT NULL)
                      ELSE cast(array() AS array<string>) END""")


def _by_source(sources: Sequence[Source], field: str, build) -> Column:
    """``build(selector)`` for the page's source; NULL where the source has none."""
    cases = " ".join(
        f"WHEN source = {quoted(s.name)} THEN {build(s.primary[field])}" for s in sources if field in s.primary
    )
    return F.expr(f"CASE {cases} END") if cases else F.lit(None).cast("string")


def _site_candidate(sources: Sequence[Source]) -> Column:
    """Fields read with the site's own selectors."""
    def one(selector):
        return node_text(first(select("left", selector)))

    def content(selector):
        return first(f"transform(slice({select('left', selector)}, 1, 1), b -> {_text_in('b', 'left_para')})")

    return _candidate(
        "html_heuristic",
        title=clean_text(_by_source(sources, "title", one)),
        content=_by_source(sources, "content", content),
        author=clean_text(_by_source(sources, "author", one)),
        date=clean_text(_by_source(sources, "date", one)),
        image_url=_by_source(sources, "image", lambda s: attr(first(select("left", s)), "src")),
    )


# ------------------------------------------------------------- the job

def _node_facts(nodes: DataFrame, sources: Sequence[Source], source: bool) -> DataFrame:
    """The arrays the strategies read.  Each step is its own projection so that
    no array is built twice."""
    named = " OR ".join(f"{attr('n', a)} IS NOT NULL" for a in ("role", "rel", "itemprop"))
    types = "|".join(fixed.ARTICLE_TYPES)
    author_link = f"array_contains(split({attr('n', 'rel')}, ' '), 'author')"
    # True where no container was good enough and the whole body is read.
    whole = "(NOT walk.done AND body IS NOT NULL)"
    steps = [
        {
            "places": F.expr(f"filter(nodes, n -> n.tag IN ('article', 'main', 'h1', 'title') OR n.id <> '' "
                             f"OR size(n.classes) > 0 OR {named})"),
            "metas": F.expr("filter(nodes, n -> n.tag = 'meta')"),
            "item": F.expr(first(f"filter(nodes, n -> rlike({attr('n', 'itemtype')}, 'schema[.]org/({types})'))")),
            "para": _paragraphs("s0", "s1"),
            "ld": json_ld_article(F.col("ld_json")),
            "body": F.expr(first(f"transform(filter(nodes, n -> n.tag = 'body'), n -> {_box('n', -1, True)})")),
        },
        {
            "walk": _read_containers(_containers("places", fixed.CONTENT_SELECTORS), "para"),
            "props": F.expr(f"CASE WHEN item IS NOT NULL THEN filter(nodes, n -> {inside('n', 'item')} "
                            f"AND {attr('n', 'itemprop')} IS NOT NULL) END"),
            "bad_ld": F.coalesce(_bad_json_ld(F.col("ld")), F.lit(False)),
        },
        {
            "body_para": F.when(F.expr(whole), _paragraphs("b0", "b1")).otherwise(F.array().cast(_PARAGRAPHS)),
            "tried": F.expr(f"CASE WHEN {whole} THEN concat(walk.tried, array(body)) ELSE walk.tried END"),
        },
        {
            "main_text": F.expr(f"CASE WHEN walk.done THEN walk.content WHEN body IS NOT NULL "
                                f"THEN {_text_in('body', 'body_para', True)} ELSE '' END"),
            "left": F.expr(f"filter(nodes, n -> {_alive('n', 'tried')})"),
            "places": F.expr(f"filter(places, n -> {_alive('n', 'tried')})"),
            "left_para": F.expr(f"CASE WHEN {whole} THEN filter(body_para, p -> {_alive('p', 'tried')}) "
                                "ELSE para END"),
        },
        {
            "semantic": _read_containers(_containers("places", fixed.SEMANTIC_CONTAINERS), "left_para"),
            "images": F.expr("filter(left, n -> n.tag = 'img')"),
            "left_metas": F.expr("filter(left, n -> n.tag = 'meta')"),
            "clock": F.expr(first("filter(left, n -> n.tag = 'time')")),
            "page_title": F.expr(first("filter(places, n -> n.tag = 'title')")),
            "heading": F.expr(first("filter(places, n -> n.tag = 'h1')")),
            "byline": F.expr(f"coalesce({first(f'filter(places, n -> {author_link})')}, "
                             f"{first(select('places', fixed.BYLINE_SELECTOR))})"),
        },
        {
            "image_sources": _image_sources(),
            "stamp": F.expr(f"coalesce(nullif({attr('clock', 'datetime')}, ''), {node_text('clock')})"),
            "own": F.when(F.col("source").isNotNull(), _site_candidate(sources)) if source
            else F.lit(None).cast(_CANDIDATE),
        },
        {"image": best_image("image_sources", "url")},
    ]
    for step in steps:
        nodes = nodes.withColumns(step)
    return nodes


def extract_candidates(nodes: DataFrame, sources: Sequence[Source] = SOURCES, source: bool = True) -> DataFrame:
    """Replace the node columns by ``candidates`` (one struct per strategy), ``fallback`` and ``errors``.

    ``nodes`` comes from :func:`page_nodes` and, with ``source``, carries a
    ``source`` column that picks the site's own selectors.
    """
    c = F.col
    semantic = _candidate(
        "html_semantic",
        title=clean_text(F.expr(node_text("coalesce(heading, page_title)"))), content=c("semantic.content"),
        description=_description(), author=clean_text(F.expr(node_text("byline"))),
        date=c("stamp"), image_url=c("image"),
    )
    opengraph = _candidate(
        "opengraph",
        title=_meta_content(["og:title", "twitter:title"]), content=c("main_text"),
        description=_meta_content(["og:description", "twitter:description"]),
        image_url=_meta_content(["og:image", "twitter:image"]),
    )
    guessed = _candidate(
        "html_heuristic",
        title=_first_text(fixed.TITLE_SELECTORS, lambda t: F.length(t) > 10),
        content=c("main_text"),
        description=_description(["twitter:description", "og:description"]),
        author=_first_text(fixed.AUTHOR_SELECTORS, lambda t: (t != "") & (F.length(t) < 100)),
        date=F.when(c("clock").isNotNull(), c("stamp")).otherwise(
            _first_text(fixed.DATE_SELECTORS, looks_like_date)),
        image_url=c("image"),
    )
    heuristic = F.when(candidate_quality(c("own")) > F.lit(0.5), c("own")).otherwise(guessed) if source else guessed
    long_paragraphs = F.filter(
        F.transform(F.expr("filter(left, n -> n.tag = 'p')"), lambda n: clean_text(_text_of(n))),
        lambda t: F.length(t) > 50,
    )
    fallback = _candidate(
        fixed.FALLBACK,
        title=F.expr("CASE WHEN page_title.s0 >= 0 THEN "
                     "substring(text, page_title.s0 + 1, page_title.s1 - page_title.s0) END"),
        content=F.array_join(F.slice(long_paragraphs, 1, 10), "\n\n"),
        description=_description(),
    )
    return (
        _node_facts(nodes, sources, source)
        .withColumn("candidates", F.array(
            F.when(c("ld").isNull() | c("bad_ld"), _candidate("json_ld")).otherwise(_json_ld(c("ld"))),
            F.when(c("item").isNull(), _candidate("microdata")).otherwise(_microdata()),
            opengraph, semantic, heuristic,
        ))
        .withColumn("chosen", best_candidate(c("candidates")))
        .select(
            *[x for x in nodes.columns if x not in ("nodes", "text", "ld_json")],
            "candidates", "chosen",
            # Read only where the strategies failed.
            F.when(_too_poor(c("chosen")), fallback).alias("fallback"),
            F.expr("CASE WHEN bad_ld THEN array('json_ld: a text field is not text') "
                   "ELSE cast(array() AS array<string>) END").alias("errors"),
        )
    )


def best_candidate(candidates: Column) -> Column:
    """The first candidate of strictly highest quality, stopping above 0.9, with its score."""
    scored = F.transform(candidates, lambda x: F.struct(candidate_quality(x).alias("q"), x.alias("found")))
    start = F.struct(F.lit(0.0).alias("q"), F.get(candidates, F.lit(-1)).alias("found"), F.lit(False).alias("done"))
    return F.aggregate(
        scored, start,
        lambda acc, x: F.when(acc["done"], acc)
        .when(x["q"] > acc["q"], F.struct(x["q"].alias("q"), x["found"].alias("found"),
                                          (x["q"] > EXCELLENT).alias("done")))
        .otherwise(F.struct(acc["q"].alias("q"), acc["found"].alias("found"), (x["q"] > EXCELLENT).alias("done"))),
        lambda acc: F.struct(acc["q"].alias("quality_score"), acc["found"].alias("found")),
    )


def _too_poor(best: Column) -> Column:
    return best["found"].isNull() | (best["quality_score"] < F.lit(fixed.MIN_QUALITY))


def choose_strategy(candidates: Column, fallback: Column) -> Column:
    """:func:`best_candidate`, but below 0.3 the fallback, even when it scores worse."""
    return _or_fallback(best_candidate(candidates), fallback)


def _or_fallback(best: Column, fallback: Column) -> Column:
    return bind(best, lambda b: F.when(
        _too_poor(b), F.struct(candidate_quality(fallback).alias("quality_score"), fallback.alias("found")),
    ).otherwise(b))


def extract_articles(pages: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Pages (``url``, ``html`` and any other columns) to article rows.

    Without a ``source`` column every page is read by the general rules.
    """
    has_source = "source" in pages.columns
    df = extract_candidates(page_nodes(pages), sources, source=has_source)
    best = F.col("best")
    return (
        df.select(
            *[x for x in df.columns if x not in ("candidates", "chosen", "fallback")],
            once(_or_fallback(F.col("chosen"), F.col("fallback"))).alias("best"),
        )
        .select(
            *[x for x in df.columns if x not in ("candidates", "chosen", "fallback", "errors")],
            best["found"]["title"].alias("title"),
            best["found"]["content"].alias("content"),
            best["found"]["description"].alias("description"),
            best["found"]["author"].alias("author"),
            best["found"]["date"].alias("published_date"),
            best["found"]["image_url"].alias("image_url"),
            best["quality_score"].alias("quality_score"),
            confidence(best["quality_score"]).alias("confidence_score"),
            best["found"]["strategy"].alias("extraction_strategy"),
            F.length(best["found"]["content"]).alias("content_length"),
            F.when(best["found"]["strategy"] == fixed.FALLBACK, 1).otherwise(0).alias("fallback_count"),
            F.col("errors"),
        )
    )


def extraction_metrics(articles: DataFrame) -> DataFrame:
    """Per-page extraction record (no clock readings: those differ per run)."""
    return articles.select(
        *[x for x in ("source", "url") if x in articles.columns],
        F.col("extraction_strategy").alias("strategy"),
        "quality_score", "confidence_score", "content_length", "fallback_count", "errors",
    )


def gate(articles: DataFrame, floor: float = fixed.MIN_QUALITY) -> DataFrame:
    return articles.filter(passes_gate("quality_score", floor))
