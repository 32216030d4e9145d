"""Operators 11, 12 and 13 against brute force, and odd tables."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from presswork.llm import collocations, spelling, spot_signatures


def odd_frame(spark, rows):
    """Documents with null ids, repeated rows and columns whose names the operators use inside."""
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "lang AS word", "source AS key", "n_chars AS n", "text AS gram", "doc_id AS p", "lang AS id", "n_chars AS score", "text AS phrase")


# ------------------------------------------------------------- 11: spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, damaged):
    counts = Counter()
    for doc_id, text in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("block", [2000, 2])
def test_variants_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rnd = random.Random(5)
    letters = "abé"
    some = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 8))) for _ in range(150)]
    some += ["thorough", "thoroughs", "thorrough", "borough", "aaaaa", "aaaaaa", "aaaaaaa", "Àÿ×÷Àÿ", "Ünïcode", "ünïcode", "unïcode"]
    rows = []
    for i in range(60):
        words = [w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(some, k=40)] + rnd.choices(some[:20], k=30)
        rows.append((i, rnd.choice([" ", "-", "\n", "1"]).join(words), None, None, None))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "x" * 20_000 + " " + "ab" * 5_000, None, None, None)] * 3
    docs = odd_frame(spark, rows)
    got = spelling.variants(docs, damaged=5)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_variants([(r[0], r[1]) for r in [*rows, rows[0], (None, None)]], 5)


def test_pivots_are_disjoint_and_cheapest(spark):
    rnd = random.Random(6)
    words = list({"".join(rnd.choice("abcde") for _ in range(rnd.randint(5, 12))) for _ in range(300)})
    order = spelling.gram_order(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    for w in words:
        grams = spelling.prefix(w, order)
        a, b = spelling.pivots(grams)
        cost = {at: k for _, at, k in grams}
        assert len(grams) >= 3 and b - a >= 2
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in cost for y in cost if y - x >= 2)


def test_variants_of_odd_tables(spark, corpus):
    assert spelling.variants(corpus.frame(spark, [])).count() == 0
    assert spelling.variants(corpus.frame(spark, [(1, "one two", None, None, None)])).count() == 0
    rows = [r for r in corpus.rows]
    assert {tuple(r) for r in spelling.variants(corpus.frame(spark, rows)).collect()} == brute_variants([r[:2] for r in rows], 97)


def test_chains_are_followed(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {r["root"] for r in spelling.followed(links).collect()} == {"w100"}


# ------------------------------------------------------------- 12: document fingerprints

def brute_signatures(text, common):
    words = re.findall(r"[^\W_]+", text.lower())
    content = [w for w in words if w not in common]
    found, seen = set(), 0
    for w in words:
        if w in common:
            if content[seen:]:
                found.add(" ".join([w, *content[seen:seen + 3]]))
        else:
            seen += 1
    for k, w in enumerate(content):
        if hashlib.md5(w.encode()).hexdigest()[0] < "2":
            found.add(" ".join(content[k:k + 4]))
    return found or {"= " + " ".join(words)}


def brute_fingerprints(rows, common):
    def digest(s):
        return hashlib.md5("\n".join(sorted(s)).encode()).hexdigest()

    placed = sorted([(i, t or "") for i, t in rows if i is not None])
    out = []
    for at, (i, text) in enumerate(placed):
        following = placed[(at + 1) % len(placed)][1]
        out.append((i, text, following))
    out += [(None, t or "", "") for i, t in rows if i is None]
    result = []
    for i, text, following in out:
        m = len(text) // 4
        edited = text[:len(text) - m] + following[:m]
        a, b, c = (brute_signatures(t, common) for t in (text, edited, following))
        result.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b), len(a & b) / len(a | b), len(a & c) / len(a | c)))
    return sorted(result, key=repr)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_fingerprints_equal_brute_force(spark, corpus, bucket, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BUCKET_ROWS", bucket)
    rows = [*corpus.rows, (3_000_000_000, "The end of the table and the start of it. " * 30, "en", None, 1), (-5, "ab" * 3000, "fr", None, 1)]
    docs = odd_frame(spark, rows)
    common = spot_signatures.common_words(docs)
    got = sorted(map(tuple, spot_signatures.fingerprint_query(docs).collect()), key=repr)
    assert got == brute_fingerprints([(r[0], r[1]) for r in [*rows, rows[0], (None, None)]], set(common))
    by_text = defaultdict(set)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        by_text[texts[r[0]]].add(r[3])
    assert all(len(prints) == 1 for prints in by_text.values())


def test_common_words_are_those_of_each_language(spark):
    rows = [(i, "the cat and the dog " + f"w{i} x{i} y{i} z{i}", "en") for i in range(300)] + [(i, f"der hund v{i}", "de") for i in range(300, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert spot_signatures.common_words(docs) == ["and", "cat", "der", "dog", "hund", "the", *sorted(f"v{i}" for i in range(300, 310))]
    assert spot_signatures.common_words(docs, None) == ["and", "cat", "dog", "the"]


def test_fingerprints_of_odd_tables(spark, corpus):
    assert spot_signatures.fingerprint_query(corpus.frame(spark, [])).count() == 0
    one = spot_signatures.fingerprint_query(corpus.frame(spark, [(7, "the only text of all here", "en", None, 1)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    with pytest.raises(ValueError):
        spot_signatures.fingerprint_query(spark.createDataFrame([("a", "t", "en")], "doc_id string, text string, lang string"))


@pytest.mark.parametrize("block", [2000, 3])
def test_near_documents_equal_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BLOCK", block)
    rnd = random.Random(12)
    rows = [r[:3] for r in corpus.rows]
    words = [f"word{i}" for i in range(400)] + ["the", "of", "and"] * 60
    for group in range(6):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 160))]
        for k in range(7):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((5000 + 10 * group + k, " ".join(text[rnd.randint(0, 6):]), "en"))
    docs = spark.createDataFrame([*rows, rows[-1], (None, "the word1 word2 word3", "en")], "doc_id long, text string, lang string")
    common = set(spot_signatures.common_words(docs))
    sets = {i: frozenset(brute_signatures(t or "", common)) for i, t, _ in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    members, pairs = spot_signatures.near_documents(docs, 0.6)
    assert {(r["id"], r["class"]) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    want = {(a, b): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) >= 0.6 * len(x | y)}
    assert {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()} == want and len(want) > 20


def test_likeness_prunes_by_length(spark):
    rows = spark.createDataFrame([(["a"], ["a", "b", "c", "d", "e"]), (["a", "b"], ["b", "a"]), (["a", "b", "c"], ["a", "b", "d"])], "a array<string>, b array<string>")
    exact = [r[0] for r in rows.select(spot_signatures.likeness(F.col("a"), F.col("b"))).collect()]
    pruned = [r[0] for r in rows.select(spot_signatures.likeness(F.col("a"), F.col("b"), 0.5)).collect()]
    assert exact == [0.2, 1.0, 0.5] and pruned == [0.0, 1.0, 0.5]


# ------------------------------------------------------------- 13: collocations

def brute_collocations(rows, top, least):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(k for g, k in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(100 * f[h] >= 50 * a for h in f if len(h) == 3 and f[h] >= least and g in (h[:2], h[1:])):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase, -a, left, right, n, -score))
    return out


def phrase_rows(n=150):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(14)] + ["É", "new", "york", "city", "a b"]
    rows = []
    for i in range(n):
        parts = [rnd.choice(words) for _ in range(rnd.randint(1, 30))] + rnd.choice([["New", "York", "City"], ["new", "york"], ["w1", "w2", "w3"]])
        rows.append((i, "".join(w + rnd.choice([" ", " ", "\t", "  ", ". ", "\r\n"]) for w in parts), rnd.choice(["en", "en", "fr", None]), None, None))
    return [*rows, (900, None, "en", None, None), (901, "", None, None, None), (902, "Same " * 3000, "xx", None, None)]


@pytest.mark.parametrize("top, wave, held", [(2000, 400_000, 300_000), (6, 7, 20), (25, 11, 300_000)])
def test_collocations_equal_brute_force(spark, top, wave, held, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", held)
    rows = phrase_rows(150 if wave > 100 else 60)
    docs = odd_frame(spark, rows)
    got = collocations.collocations(docs, top=top, least=3, wave=wave)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations([(r[1], r[2]) for r in [*rows, rows[0], (None, None, None)]], top, 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    short = spark.createDataFrame([("x", "a", 4_000_000_000_000), ("x", "b", 3_999_999_999_999), ("x", "a b", 3_999_999_999_990)], "lang string, gram string, k long")
    got = collocations.scored_pairs(short).first()
    assert got["score"] == 1_000_000 * got["a"] ** 2 // (got["l"] * got["r"])


def test_collocations_of_odd_tables(spark, corpus):
    assert collocations.collocations(corpus.frame(spark, [])).count() == 0
    assert collocations.collocations(corpus.frame(spark, [(1, None, None, None, None), (2, "few words", "en", None, None)])).count() == 0
