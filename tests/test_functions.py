"""Golden values of the column functions."""
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from presswork import functions as fn
from presswork.functions.urls import join_url

SENTENCES = (
    "The quick brown fox jumps over the lazy dog. Artificial intelligence is transforming industries worldwide. "
    "Python is a popular programming language for data science. OpenAI develops advanced AI models. "
    "Machine learning enables computers to learn from data. Natural language processing helps computers understand text. "
    "Cloud computing provides scalable resources. APIs allow different software systems to communicate. "
    "Docker containers simplify deployment. Continuous integration improves code quality. "
    "Unit tests catch bugs early. Version control is essential for collaboration. "
)


def test_summary_of_short_sentences_has_the_wanted_length(one):
    summary = one(lambda: fn.extractive_summary("t"), t=SENTENCES)
    assert 50 <= len(summary.split()) <= 65
    assert len(summary.split()) == 56
    assert summary == " ".join(SENTENCES.split(". ")[:8])
    assert one(lambda: fn.length_in_range("t"), t=summary)


def test_summary_guards(one):
    long = ". ".join(" ".join(["word"] * 66) for _ in range(10))
    assert one(lambda: fn.extractive_summary("t"), t=long) == ""
    assert one(lambda: fn.extractive_summary("t"), t="") == ""
    assert one(lambda: fn.extractive_summary("t"), t=None) == ""
    assert one(lambda: fn.leading_text("t"), t="x" * 301) == "x" * 300 + "..."
    assert one(lambda: fn.leading_text("t"), t="x" * 300) == "x" * 300
    assert one(lambda: fn.trim_words("t"), t="w " * 66) == " ".join(["w"] * 60) + "..."


def test_summary_prefers_keywords(one):
    text = "one two three. startup raises ten million funding today. four five six"
    assert one(lambda: fn.extractive_summary("t"), t=text).startswith("startup raises")


@pytest.mark.parametrize("src,score", [
    ("https://x.com/wp-content/uploads/a-1024.jpg", 0.39999999999999997),
    ("https://x.com/story/p.png", 0.6000000000000001),
    ("/logo.png", 0.0),
    ("//x.com/large.webp", 0.5),
])
def test_image_score(one, src, score):
    assert one(lambda: fn.image_score("s", F.lit("https://x.com/p")), s=src) == score


def test_best_image_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(["/logo.png", "/a.jpg", "/b.jpg"],), ([],), (["/icon"],)], "s array<string>")
    got = [r[0] for r in df.select(fn.best_image("s", F.lit("https://x.com/"))).collect()]
    assert got == ["/a.jpg", "", ""]


@pytest.mark.parametrize("text,found", [
    ("2023-12-25", True), ("12/25/2023", True), ("December 25, 2023", True), ("yesterday", False), ("", False),
])
def test_looks_like_date(one, text, found):
    assert one(lambda: fn.looks_like_date("t"), t=text) is found


def test_published_ts(one):
    for text in ("2023-12-25", "12/25/2023", "December 25, 2023"):
        assert str(one(lambda: fn.published_ts("t").cast("string"), t=text)).startswith("2023-12-25")
    assert one(lambda: fn.published_ts("t"), t="yesterday") is None


def test_normalize(one):
    text = "A\u00a0Inc42 story: été et  Source http://x.y/z me@x.org Read More b"
    got = one(lambda: fn.normalize_text("t"), t=text)
    assert got == "a  story: été      b"
    assert one(lambda: fn.normalize_text("t"), t="") == ""


def test_clean(one):
    assert one(lambda: fn.clean_text("t"), t=" a \n\t b\u00a0c&nbsp;d ") == "a b c d"
    assert one(lambda: fn.clean_text("t"), t=None) == ""


def test_key_phrases(one):
    assert one(lambda: fn.key_phrases("t"), t="alpha beta of gamma delta") == "alpha beta gamma delta"
    assert one(lambda: fn.key_phrases("t"), t="one") == ""
    assert len(one(lambda: fn.key_phrases("t"), t="word " * 30).split()) == 20


def test_hashes(one):
    want = hashlib.sha256("T:title|C:body|U:/a/b".encode()).hexdigest()
    assert one(lambda: fn.fingerprint("t", "c", "u"), t="Title", c="Body", u="https://x.org/a/b?q=1") == want
    assert one(lambda: fn.title_hash("t"), t="") == hashlib.md5(b"").hexdigest()
    url = "https://x.org/a"
    assert one(lambda: fn.article_id("u", F.expr("timestamp'2024-01-01 00:00:00'")), u=url) == (
        "art_1704067200_" + hashlib.md5(url.encode()).hexdigest()[:8])


def test_fingerprint_cuts_before_normalising(one):
    body = "x " * 1500
    assert one(lambda: fn.fingerprint("t", "c", "u"), t="T", c=body, u="/") == (
        one(lambda: fn.fingerprint("t", "c", "u"), t="T", c=body[:2000] + "more", u="/"))


@pytest.mark.parametrize("url,host,path", [
    ("https://a.b:80/c/d?x#y", "a.b:80", "/c/d"), ("http://a b/c", "a b", "/c"), ("nonsense", "", "nonsense"),
    ("https://a.b", "a.b", ""), ("/c;p=1", "", "/c"), (None, "", ""),
])
def test_url_parts(one, url, host, path):
    assert one(lambda: fn.url_host("u"), u=url) == host
    assert one(lambda: fn.url_path("u"), u=url) == path


@pytest.mark.parametrize("link,full", [
    ("/x", "https://a.b/x"), ("y?q=1", "https://a.b/c/y?q=1"), ("../z", "https://a.b/z"), ("//o.p/q", "https://o.p/q"),
    ("http://o.p/", "http://o.p/"), ("./k/../m", "https://a.b/c/m"), ("", "https://a.b/c/d"), ("#f", "https://a.b/c/d#f"),
])
def test_join_url(one, link, full):
    assert one(lambda: join_url(F.lit("https://a.b/c/d"), F.col("l")), l=link) == full


def test_quality_rules_in_order(spark):
    def score(title="", content="", description="", author="", date="", image=""):
        row = spark.createDataFrame([(title, content, description, author, date, image)], "t string, c string, d string, a string, x string, i string")
        return row.select(fn.quality_score("t", "c", "d", "a", "x", "i")).first()[0]

    assert score() == 0.0
    assert score(title="x" * 10) == 0.2
    assert score(title="x" * 11) == 0.2 + 0.1
    assert score(content="x" * 100) == 0.0
    assert score(content="x" * 101) == 0.3
    assert score(title="x" * 11, content="x" * 1001) == 0.2 + 0.1 + 0.3 + 0.2 + 0.1
    assert score("x" * 11, "x" * 1001, "d", "a", "x", "i") == 1.0
    assert score(author="a", date="d") == 0.05 + 0.05


def test_tiers_and_null_policies(spark):
    df = spark.createDataFrame([(0.8,), (0.7999999999999999,), (0.6,), (0.4,), (0.1,), (None,)], "q double")
    rows = df.select(fn.quality_tier("q"), fn.quality_tier("q", "poor")).collect()
    assert [r[0] for r in rows] == ["excellent", "good", "good", "fair", "poor", None]
    assert rows[-1][1] == "poor"
    assert df.filter(fn.export_threshold("q", 0.0)).count() == 6
    with pytest.raises(ValueError):
        fn.quality_tier("q", "skip")


def test_small_functions(one):
    assert one(lambda: fn.date_part("t"), t="2024-01-02T10:00") == "2024-01-02"
    assert one(lambda: fn.title_or_link("a", "b"), a="", b="link") == "link"
    assert one(lambda: fn.title_or_link("a", "b"), a="title", b="link") == "title"
    assert one(lambda: fn.is_boilerplate("t"), t="Please SUBSCRIBE now") is True
    assert one(lambda: fn.is_boilerplate("t"), t="plain prose") is False
    assert one(lambda: fn.confidence(F.lit(0.9)), t="") == 1.0
    prompt = one(lambda: fn.summary_prompt("t", "c"), t="100% T", c="c" * 4000)
    assert "Title: 100% T\n" in prompt and "Content: " + "c" * 3000 + "\n" in prompt


def test_mail_pattern_takes_what_the_plain_one_takes(spark):
    """The pattern that looks at beginnings of runs alone, against ``\\S+@\\S+``, over all short strings of a few characters."""
    from presswork.functions.text import MAIL

    texts = ["".join(t) for n in range(7) for t in itertools.product("a@  ", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.regexp_replace("t", r"(?U)\S+@\S+", "#").alias("plain"), F.regexp_replace("t", MAIL, "#").alias("now"))
    assert df.filter("plain <> now").isEmpty() and not df.filter("contains(now, '#')").isEmpty()
