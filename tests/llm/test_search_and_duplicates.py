"""Operators 1, 2, 5 and 10 against brute force."""
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from presswork.llm import kd_search, line_dedup, simhash, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------- 1: exact top-k

def odd_vectors():
    rnd = random.Random(3)
    rows = []
    for i in range(240):
        v = [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
        if i % 3 == 0:
            v = [0.5, 0.5, 0.0, -1.0]  # a third of all rows
        if i % 97 == 1:
            v = None
        elif i % 89 == 2:
            v[0] = None
        elif i % 83 == 3:
            v[1] = float("nan")
        elif i % 79 == 4:
            v[2] = float("inf")
        rows.append((i, v))
    return [*rows, rows[150], (9999, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0]), (9998, [])]


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in kd_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    sound = {i: np.floor(256 * np.array(v, float)) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in sound if i % 50 == 0):
        want = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:5]
        assert sorted(got[q]) == [(k + 1, *w) for k, w in enumerate(want)]


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kd_search.top_k(none, none).count() == 0


def test_tree_visits_ties():
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (500, 6)).astype(float)
    tree = kd_search.KdTree(rng.permutation(500), v)
    for q in rng.integers(-3, 4, (20, 6)).astype(float):
        want = sorted(((-s, int(i)) for s, i in zip(tree.v @ q, tree.ids)))[:4]
        assert sorted((-s, i) for s, i in tree.search(q, 4, float("-inf"))) == want


def test_an_overfull_leaf_is_divided(spark, monkeypatch):
    """Near-equal vectors that tie on every split dimension make one leaf and several shards."""
    sizes = []
    search = kd_search._search_shards

    def seen(rows, k):
        sizes.append(rows.filter("kind = 0").groupBy("shard").count().agg(F.max("count")).first()[0])
        return search(rows, k)

    monkeypatch.setattr(kd_search, "_search_shards", seen)
    rnd = random.Random(7)
    rows = [(i, [0.5, 0.5, 0.5, i / 4096]) for i in range(1500)] + [(2000 + i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kd_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=60).collect()}
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    for q in np.flatnonzero(ids % 50 == 0):
        order = sorted((-int(s), int(i)) for s, i in zip(whole @ whole[q], ids) if i != ids[q])[:5]
        assert [got[int(ids[q]), r + 1] for r in range(5)] == [(i, -s) for s, i in order]
    assert max(filter(None, sizes)) < 200


# ------------------------------------------------------------- 2: SimHash

def slow_fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [sum(xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(links, n):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while root[x] != x:
            x = root[x]
        out.append(x)
    return out


def test_simhash_equals_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in simhash.simhash_query(corpus.frame(spark)).collect()}
    rows = sorted(corpus.rows)
    prints = [slow_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = slow_components(links, len(rows))
    for k, r in enumerate(rows):
        assert got[r[0]]["fingerprint"] == f"{prints[k]:016x}"
        assert got[r[0]]["component_id"] == rows[want[k]][0]


@pytest.mark.parametrize("rows, asking", [(32_768, 1_000_000), (16, 1_000_000), (16, 7)])
def test_links_connect_what_is_near(spark, monkeypatch, rows, asking):
    """Clusters, chains and common quarters; one range, many ranges, and copies of ranges."""
    monkeypatch.setattr(simhash, "RANGE_ROWS", rows)
    monkeypatch.setattr(simhash, "ASKING", asking)
    rnd = random.Random(5)
    words = {rnd.getrandbits(64) for _ in range(60)}
    centre = rnd.getrandbits(64)
    words |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(150)}
    for _ in range(40):  # a chain
        words.add(centre := centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    words |= {rnd.getrandbits(48) for _ in range(80)}  # one common quarter
    words = sorted(words)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    at = {s: k for k, s in enumerate(signed)}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.links(fps)).collect()}
    near = [(a, b) for a in range(len(words)) for b in range(a) if (words[a] ^ words[b]).bit_count() <= 3]
    want = slow_components(near, len(words))
    got = [at[roots.get(s, s)] for s in signed]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_the_index_drops_groups_and_loses_nothing(monkeypatch):
    """Differences are added up on the way down; whole nodes go, and what is near stays."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    near = words[:50] ^ np.uint64(0b1011 << 20)
    words = np.unique(np.concatenate([words, near]))
    words = words[np.argsort(simhash.gray_rank(words))]
    asked = np.concatenate([near, rng.integers(0, 1 << 63, 150, dtype=np.uint64)])
    want = {(q, int(w)) for q in range(len(asked)) for w in np.flatnonzero(np.bitwise_count(words ^ asked[q]) <= 3)}
    for frontier in (1_000_000, 64):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        index = simhash.GrayIndex(words)
        found = [(int(q), int(w)) for a, b in index.near(asked) for q, w in zip(a, b)]
        assert len(found) == len(set(found)) and set(found) == want and len(want) >= 100
        # Far fewer nodes are met than there are fingerprints, let alone nodes of all levels.
        assert index.visited < 0.6 * len(asked) * len(words) and index.dropped > 0.8 * index.visited
    assert not list(simhash.GrayIndex(words[:0]).near(asked)) and list(simhash.GrayIndex(words[:1]).near(words[:1]))


def test_simhash_of_odd_rows(spark, corpus):
    rows = [*corpus.rows[:5], corpus.rows[0], (None, corpus.rows[0][1], None, None, None), (None, None, None, None, None)]
    kept = [(r["doc_id"], r["text"] is None) for r in simhash.one_of_each(corpus.frame(spark, rows)).collect()]
    assert (None, True) in kept and (None, False) not in kept and kept.count((0, False)) == 2
    assert simhash.simhash_query(corpus.frame(spark, [])).count() == 0


def test_long_texts_are_hashed_in_slices():
    text = " ".join(str(i % 1000) for i in range(150_000))
    w = text.split()
    ones = np.zeros(64, np.int64)
    for k in range(len(w) - 2):
        h = np.uint64(xxh64_intdigest(" ".join(w[k:k + 3]), 42))
        ones += (h >> np.arange(64, dtype=np.uint64)).astype(np.int64) & 1
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(w) - 2)


# ------------------------------------------------------------- 5: repeated strings

def slow_removal(rows, size=50):
    first = {}
    data = [(NO if i is None else i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        for k in range(len(d) - size + 1):
            w = d[k:k + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - size + 1):
            if first[d[k:k + size]] < i:
                gone[k:k + size] = True
        out.append((d, gone))
    return out


NO = (1 << 63) - 1


def check_removal(spark, corpus, digest, rows):
    got = sorted((tuple(r) for r in suffix_dedup.suffix_query(corpus.frame(spark, rows)).collect()), key=repr)
    want = []
    for r, (d, gone) in zip(rows, slow_removal([r[:2] for r in rows])):
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((r[0], len(d), int(gone.sum()), spans, digest(np.frombuffer(d, np.uint8)[~gone].tobytes())))
    assert got == sorted(want, key=repr)


def test_repeats_equal_brute_force(spark, corpus, digest):
    check_removal(spark, corpus, digest, corpus.rows)


def test_repeats_in_many_groups_and_segments(spark, corpus, digest, monkeypatch):
    """Small groups, buckets and segments, repeated ids, null ids; the results stay."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "BUCKET_KEYS", 200)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    extra = [(3, corpus.rows[8][1], None, None, None), (None, corpus.rows[3][1], None, None, None), corpus.rows[3],
             (2, corpus.rows[10][1] + corpus.rows[15][1] * 3, None, None, None)]
    check_removal(spark, corpus, digest, [*corpus.rows, *extra])


def test_repeats_keep_columns(spark, corpus):
    docs = corpus.frame(spark).selectExpr("doc_id", "text", "lang AS part", "struct(source) AS g", "n_chars AS id")
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def moved(df):
    """Bytes that the shuffles of a query write."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName() != "ReusedExchange":
            if node.metrics().contains("shuffleBytesWritten"):
                total += node.metrics().apply("shuffleBytesWritten").value()
            todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return total


def test_repeats_move_little(spark, corpus, monkeypatch):
    """Suffixes with possible partners move as runs of bytes, not as a hash for each."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 100_000)
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(400)) for _ in range(400)]
    rows = [(k, "".join(rnd.sample(pool, 8)), None, None, None) for k in range(300)]
    size = sum(len(r[1]) for r in rows)
    assert size < moved(suffix_dedup.suffix_query(corpus.frame(spark, rows))) < 6 * size


def run_steps(rows, n_groups, n_buckets):
    """(id, n_removed) of rows (id, bytes), by the three steps in this process."""
    def dealt(tables):
        table = pa.concat_tables(tables)
        return {d: table.filter(pa.compute.equal(table["dest"], d)) for d in set(table["dest"].to_pylist())}

    def step(fn, messages):
        return [fn(d, messages.get(g, suffix_dedup._messages([]))) for g, d in docs.items()]

    docs = {}
    for g in range(n_groups):
        own = [(g, i, k, 0, len(t), suffix_dedup._codec().compress(t, asbytes=True), len(t)) for k, (i, t) in enumerate(rows) if k % n_groups == g]
        docs[g] = pa.table(dict(zip(("g", "id", "tk", "seg", "n", "part", "size"), map(list, zip(*own)))))
    told = dealt([suffix_dedup.shared_samples(m) for m in dealt(step(suffix_dedup.sample_step(3), {})).values()])
    late = dealt([suffix_dedup.earliest_suffixes(m) for m in dealt(step(suffix_dedup.suffix_step(3, n_buckets), told)).values()])
    kept = step(suffix_dedup.cut_step(n_buckets, pa.schema([("id", pa.int64())]), False), late)
    return sorted((i, n) for t in kept for i, n in zip(t["id"].to_pylist(), t["_n_removed"].to_pylist()))


@pytest.mark.parametrize("lot", [1 << 21, 500])
def test_repeats_do_not_rest_on_hashes(corpus, monkeypatch, lot):
    """With hashes of seven values only the bytes tell strings apart; many lots; ids below zero and repeated ones."""
    at = suffix_dedup.Hasher.at
    monkeypatch.setattr(suffix_dedup.Hasher, "at", lambda self, places, length: at(self, places, length) % np.uint64(7) * np.uint64(0x2492492492492492))
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    rows = [(r[0] // 2 - 9, r[1]) for r in corpus.rows if r[1]]
    want = sorted((r[0], int(gone.sum())) for r, (_, gone) in zip(rows, slow_removal(rows)))
    assert run_steps([(i, t.encode()) for i, t in rows], 4, 3) == want


# ------------------------------------------------------------- 10: lines

def near(a, b):
    """At most one word put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def slow_lines(rows):
    seen, gone = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, s in enumerate((t or "").split("\n")):
            w = WORDS.findall(s)
            if not w:
                continue
            if any(w == x or len(w) >= 5 and len(x) >= 5 and near(w, x) for x in seen):
                gone.setdefault(i, []).append(k)
            seen.append(w)
    return gone


def test_lines_equal_brute_force(spark, corpus):
    want = slow_lines([r[:2] for r in corpus.rows])
    got = {r["doc_id"]: r for r in line_dedup.line_verdicts(corpus.frame(spark)).collect()}
    assert len(got) == len(corpus.rows)
    for i, t in (r[:2] for r in corpus.rows):
        assert got[i]["removed_lines"] == ",".join(map(str, want.get(i, [])))
        assert got[i]["n_lines"] == sum(bool(WORDS.search(s)) for s in (t or "").split("\n"))


def test_lines_left_and_columns(spark, corpus):
    docs = corpus.frame(spark).selectExpr("doc_id", "text", "lang AS _tk", "source AS removed", "n_chars AS h1")
    gone = slow_lines([r[:2] for r in corpus.rows])
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        text = dict(x[:2] for x in corpus.rows)[r["doc_id"]]
        lines = (text or "").split("\n")
        want = "\n".join(s for k, s in enumerate(lines) if k not in gone.get(r["doc_id"], []))
        assert r["text"] == (None if text is None else want)


def test_lines_of_repeated_and_null_ids(spark, corpus):
    rows = [(None, "a b c d e f", None, None, None), (7, "a b c d e g", None, None, None), (7, "a b c d e g", None, None, None)]
    got = [(r["doc_id"], r["n_removed"]) for r in line_dedup.line_verdicts(corpus.frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == [(7, 1), (7, 1), (None, 0)]
    assert line_dedup.line_verdicts(corpus.frame(spark, [])).count() == 0


def test_hashes_leave_little_in_a_worker():
    """Tables of powers stay in the worker, beside the stages that follow; equal strings hash alike wherever they lie."""
    buffer = np.tile(np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz ", np.uint8), 60_000)
    tracemalloc.start()
    for salt in range(3):
        hasher = suffix_dedup.Hasher(buffer, salt)
        places = np.arange(5, len(buffer) - 50, 37)
        assert len(set(hasher.at(places, 50).tolist())) == 1
        assert len(set(hasher.at(np.arange(37), 50).tolist())) == 37
    del hasher, places
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 10_000_000
