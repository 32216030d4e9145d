"""Golden pages for the extraction strategies."""
import json

import pytest
from pyspark.sql import functions as F

from presswork.operators.extract import choose_strategy, extract_articles, extract_candidates, extraction_metrics, gate
from presswork.operators.nodes import flatten_page, page_nodes
from presswork.operators.paragraphs import first_paragraphs, leaf_paragraphs, meta_content, page_title
from presswork.operators.selectors import predicate
from presswork.sources.links import discover_links
from presswork.sources.pages import cap_per_source
from presswork.sources.registry import Source, registry_frame, with_source

LONG = "This paragraph is long enough to count as prose for the reader. "


@pytest.fixture
def extract(spark):
    def run(*pages, source=None):
        df = spark.createDataFrame(
            [(i, f"https://x.org/{i}", html, source) for i, html in enumerate(pages)],
            "page_id long, url string, html string, source string")
        return [r.asDict() for r in extract_articles(df).orderBy("page_id").collect()]

    return run


def ld(item):
    return f'<script type="application/ld+json">{item if isinstance(item, str) else json.dumps(item)}</script>'


ITEM = {"@type": "NewsArticle", "headline": "A headline of some length", "articleBody": "b" * 1200,
        "description": "d", "author": "Ann", "datePublished": "2024-01-02T03:04", "image": "https://x.org/i.jpg"}


def test_json_ld_shapes(extract):
    listed = {**ITEM, "@type": ["NewsArticle"]}
    rows = extract(ld(ITEM), ld([{"@type": "Person"}, ITEM]), ld("{bad") + ld(ITEM), ld(listed), ld({"@graph": [ITEM]}),
                   ld(json.dumps(ITEM).replace("b" * 1200, "b\n" * 600)))
    assert [r["extraction_strategy"] == "json_ld" for r in rows] == [True, True, True, False, False, True]
    assert rows[0]["published_date"] == "2024-01-02" and rows[0]["quality_score"] == 1.0
    assert rows[0]["author"] == "Ann" and rows[0]["image_url"] == "https://x.org/i.jpg"


def test_json_ld_author_variants(extract):
    variants = ["Ann", {"name": "Bob"}, [{"name": "Cy"}, {"name": "Di"}], ["Ed", "Flo"]]
    pages = [ld({**ITEM, "author": a}) for a in variants]
    pages.append(ld({k: v for k, v in ITEM.items() if k != "author"}))
    assert [r["author"] for r in extract(*pages)] == ["Ann", "Bob", "Cy", "Ed", ""]


def test_json_ld_error_is_recorded(extract):
    row = extract(ld({**ITEM, "headline": {"x": 1}}))[0]
    assert row["extraction_strategy"] != "json_ld" and row["errors"]


def test_microdata_attribute_goes_before_text(extract):
    html = ('<div itemtype="https://schema.org/Article"><h1 itemprop="name">A name of some length</h1>'
            '<span itemprop="author" content="Ann">someone else</span><time itemprop="datePublished">2024</time>'
            f'<div itemprop="articleBody">{"b " * 600}</div><img itemprop="image" content="i.jpg"></div>')
    row = extract(html)[0]
    assert row["extraction_strategy"] == "microdata" and row["author"] == "Ann"
    assert row["title"] == "A name of some length" and row["published_date"] == "2024" and row["image_url"] == "i.jpg"


def test_opengraph_falls_back_to_twitter(extract):
    head = ('<head><meta property="og:title" content=""><meta name="twitter:title" content="A tweeted title here">'
            '<meta property="og:description" content="d"><meta name="twitter:image" content="i.jpg"></head>')
    row = extract(f"<html>{head}<body><article><p>{LONG * 20}</p></article></body></html>")[0]
    assert row["extraction_strategy"] == "opengraph"
    assert row["title"] == "A tweeted title here" and row["image_url"] == "i.jpg" and row["description"] == "d"


def test_semantic_fields(extract):
    html = (f'<html><head><title>Site</title></head><body><h1>The heading of the page</h1><span class="byline"> By Ann </span>'
            f'<time datetime="2024-01-02">yesterday</time><article><img src="/story/a.jpg"><p>{LONG * 20}</p></article></body></html>')
    row = extract(html)[0]
    assert row["extraction_strategy"] == "html_semantic"
    assert (row["title"], row["author"], row["published_date"], row["image_url"]) == (
        "The heading of the page", "By Ann", "2024-01-02", "/story/a.jpg")


def test_paragraph_rules(extract):
    inner = (f"<div><p>{LONG}</p></div>" f"<p>{LONG}<b>bold</b></p>" f"<p>{'x' * 30}</p>" f"<p>{'y' * 31}</p>"
             "<p>Please subscribe to our newsletter to read on</p>" f"<nav><p>{LONG} nav</p></nav>")
    row = extract(f"<html><body><h1>The heading of it</h1><article>{inner}</article></body></html>")[0]
    assert row["content"].split("\n\n") == [LONG.strip(), LONG.strip(), "y" * 31]


def test_body_is_read_without_its_frame(extract):
    html = (f'<html><body><h1>The heading of the page</h1><div class="menu"><p>{LONG} menu</p></div>'
            f"<p>{LONG * 5}</p><footer><p>{LONG} foot</p></footer></body></html>")
    row = extract(html)[0]
    assert row["content"] == (LONG * 5).strip()


def test_removed_elements_are_gone_for_later_strategies(extract):
    html = (f'<html><body><article><nav><time datetime="2020">old</time></nav><h1>The heading of the page</h1>'
            f"<p>{LONG * 20}</p></article></body></html>")
    assert extract(html)[0]["published_date"] == ""


def test_fallback_when_nothing_scores(extract):
    row = extract(f"<title>T</title><p>{LONG}<i>x</i></p><p>short</p>")[0]
    assert row["extraction_strategy"] == "fallback" and row["fallback_count"] == 1
    assert row["title"] == "T" and row["content"] == LONG + "x"
    assert extract("")[0]["quality_score"] == 0.0


def test_source_selectors_are_used(spark):
    src = Source("s", "Site", "https://x.org", "https://x.org/", {"title": "h2.top a", "content": "#story", "author": ".who"})
    html = (f'<html><body><h2 class="top"><a>Title by selector</a></h2><div class="who">Ann</div>'
            f'<section id="story"><p>{LONG * 20}</p></section></body></html>')
    pages = spark.createDataFrame([("https://x.org/1", html), ("https://y.org/1", html)], "url string, html string")
    placed = with_source(pages, registry_frame(spark, [src]))
    rows = {r["url"]: r for r in extract_candidates(page_nodes(placed), [src]).collect()}
    assert rows["https://y.org/1"]["source"] is None
    found = rows["https://x.org/1"]["candidates"][4]
    assert (found["title"], found["author"], found["content"]) == ("Title by selector", "Ann", (LONG * 20).strip())


def test_strategy_choice(spark):
    def cand(name, title):
        return F.struct(F.lit(name).alias("strategy"), F.lit(title).alias("title"), F.lit("c" * 200).alias("content"),
                        *[F.lit("").alias(x) for x in ("description", "author", "date", "image_url")])

    row = spark.range(1).select(
        choose_strategy(F.array(cand("a", "same title ok"), cand("b", "same title ok")), cand("f", "")).alias("tie"),
    ).first()
    assert row["tie"]["found"]["strategy"] == "a"


def test_metrics_and_gate(spark):
    df = spark.createDataFrame([("https://x.org/1", f"<h1>The heading here</h1><p>{LONG}</p>"), ("https://x.org/2", "")],
                               "url string, html string")
    rows = extract_articles(df)
    assert gate(rows).count() == 1
    assert extraction_metrics(rows).filter("strategy = 'fallback'").count() == 1


def test_unclosed_paragraphs_nest():
    nodes, text, _ = flatten_page("<p><b>T<br><p>one</p><p>two</p>")
    assert [(n[2], text[n[6]:n[7]]) for n in nodes] == [("p", "Tonetwo"), ("b", "Tonetwo"), ("br", ""), ("p", "one"), ("p", "two")]
    assert nodes[3][8:10] == (1, 4)


def test_selector_contract(spark):
    html = "<html><body><h2 class='entry-title'><a href='/a'>Title</a></h2><a>other</a></body></html>"
    nodes = page_nodes(spark.createDataFrame([(html,)], "html string"))
    hits = nodes.selectExpr(f"filter(nodes, n -> {predicate('nodes', 'h2.entry-title a')}) AS hits", "text").first()
    assert len(hits["hits"]) == 1
    assert hits["text"][hits["hits"][0]["start"]:hits["hits"][0]["stop"]] == "Title"
    with pytest.raises(ValueError):
        predicate("nodes", "a:hover")


def test_listing_links(spark):
    first = "".join(f"<div class='card-wrapper'><h2 class='entry-title'><a href='{h}'>T{i}</a></h2></div>"
                    for i, h in enumerate(["/a", "b", "http://o.p/c", ""]))
    spare = "<div class='story'><a href='/x'>X</a></div><div class='article'><a href='/y'>Y</a></div>"
    df = spark.createDataFrame([("Inc42", first), ("Moneycontrol", spare)], "source string, html string")
    got = {(r["source"], r["title"]): r["url"] for r in discover_links(df).collect()}
    assert got == {
        ("Inc42", "T0"): "https://inc42.com/a", ("Inc42", "T1"): "https://inc42.com/buzz/b",
        ("Inc42", "T2"): "http://o.p/c", ("Moneycontrol", "X"): "https://www.moneycontrol.com/x",
    }
    assert cap_per_source(discover_links(df), 2).filter("source = 'Inc42'").count() == 2


def test_leaf_paragraphs_decode(spark):
    df = spark.createDataFrame([(f"<p>{'a&amp;b' * 11}</p><p>x <b>y</b></p>",)], "html string")
    assert df.select(leaf_paragraphs("html")).first()[0] == "a&b" * 11


def test_quick_forms_read_attributes_case_and_either_order(spark):
    html = (f'<TITLE lang="en">It&rsquo;s a title</TITLE><meta content="One &#8212; two" property="og:title">'
            f"<meta name='og:description' content='d'><P class=\"x\">{LONG}</P><p\nid=a>{LONG} again</p >")
    got = spark.createDataFrame([(html,)], "html string").select(
        page_title("html").alias("title"), leaf_paragraphs("html").alias("text"), first_paragraphs("html").alias("first"),
        meta_content("html", "og:title").alias("og"), meta_content("html", "og:description").alias("d"), meta_content("html", "none").alias("n"),
    ).first()
    assert got["title"] == "It’s a title" and got["og"] == "One — two" and got["d"] == "d" and got["n"] == ""
    assert got["text"] == got["first"] == f"{LONG.strip()}\n\n{LONG.strip()} again"
