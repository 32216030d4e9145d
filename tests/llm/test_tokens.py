"""Operators 6 and 7 against the tokenizers library."""
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from presswork.llm import bpe, packing
from presswork.llm.queries import tokenizer_path

ODD = ["", " ", "<|endoftext|>a <|endoftext|> ", "x<|startoftext|>y", "I'LL don't we've.", "ΑΣ ΟΔΟΣ ǅ", "a\x1cb\x1f c\x85d\xa0e　f",
       "a" * 3000, "ab" * 500 + " " * 300 + "x", "=-" * 400, "é é É İ", "😀👩‍👧 ٠١٢ 12345 ½", "\n\n\t \n", "a\r\nb"]


def library(name):
    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    return found


def fuzz(seed=1, n=1500):
    rnd = random.Random(seed)
    some = "abcdefghij  \n\t'éß中İΣσ٠😀\x1c\x1f\x85\xa0 ​　,.;!?0123ABCDll'll'ré-ÉÀ"
    out = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    points = [lambda: rnd.randint(0, 255), lambda: rnd.randint(0, 0xD7FF), lambda: rnd.randint(0x10000, 0x1FFFF)]
    return [*ODD, *out, *["".join(chr(rnd.choice(points)()) for _ in range(30)) for _ in range(n)]]


# ------------------------------------------------------------- 7: BPE

@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(tokenizer_path("byte_bpe_50k.json"))


def test_ids_and_texts_equal_the_library(coder, corpus):
    whole, texts = library("byte_bpe_50k.json"), [*fuzz(), *[r[1] or "" for r in corpus.rows]]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(text) == want.ids
        assert coder.decode(want.ids) == whole.decode(want.ids, skip_special_tokens=False)


def test_proposals_are_verified(coder):
    """Verification is right about every proposal, and the exact ways agree."""
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("etaoinsrhl ") for _ in range(rnd.randint(2, 40))).encode() for _ in range(800)]
    v = coder.vocabulary
    exact = [v.merged(p) for p in pieces]
    assert v.merged_lot(pieces) == exact and v.encode_pieces(pieces) == exact
    for piece, want in zip(pieces, exact):
        ids = np.array(v.proposed(piece))
        passes = v.sound[ids].all() and v.compatible(ids[:-1], ids[1:]).all()
        assert passes == (ids.tolist() == want)


@pytest.mark.parametrize("text", ["a" * 40 + "1", "ab,cd" * 8 + "é5", "a" * 1_000_000, ".," * 20_000 + "@", "ßx" * 10_000 + "中"])
def test_glued_chunks_take_linear_time(text):
    """A run of plain characters before another sign is settled at once."""
    path = tokenizer_path("word_bpe_49k.json")
    own = packing.ChunkEncoder(path)
    whole = library("word_bpe_49k.json")
    start = time.time()
    found = list(own.encode_all([text, text[:20]]))
    assert time.time() - start < 5
    if len(text) < 100_000:
        assert found[1] == next(own.encode_all([text[:20]]))
        assert list(own.encode_all([text])) == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    monkeypatch.setattr(bpe, "LOT_CHARS", 100)
    own, whole, texts = bpe.Coder(tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json"), fuzz(n=100)
    got = [[i for p in pieces for i in p.ids] for pieces in own.pieces(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_query(spark, corpus, digest):
    path, whole = tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    rows = [*corpus.rows, corpus.rows[0], (None, None, None, None, None)]
    got = sorted((tuple(r) for r in bpe.round_trip(corpus.frame(spark, rows), path).collect()), key=repr)
    want = []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), digest(",".join(map(str, ids)).encode()), digest(whole.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=repr)
    docs = corpus.frame(spark)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(bpe.encode_column(docs, path), path).collect()}
    assert back == {r[0]: r[1] or "" for r in corpus.rows}
    assert bpe.round_trip(docs.limit(0), path).count() == 0


# ------------------------------------------------------------- 6: packing

def test_chunk_ids_equal_the_library(corpus):
    own, whole = packing.ChunkEncoder(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    texts = [*fuzz(), *[r[1] or "" for r in corpus.rows]]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_document_once(seed):
    rnd, length = random.Random(seed), 64
    histogram = {n: rnd.randint(1, 1000 if seed % 2 else 3) for n in rnd.sample(range(1, length), rnd.randint(1, 50))}
    packs = packing.fill_gaps(packing.shortest_pack_first(histogram, length), length)
    tokens = {n: np.zeros((k, n), int) for n, k in histogram.items()}
    for p in packs:
        at = 0
        for n, rank, start, size, offset in p.entries:
            assert offset == at
            at += size
            tokens[n][rank:rank + p.count, start:start + size] += 1
        assert at == p.used and (p.used == length or p.used.bit_count() == 1)
    assert all((t == 1).all() for t in tokens.values())


def check_packs(rows, got, length):
    whole = library("word_bpe_49k.json")
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    used, total = {}, 0
    for p in got:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        total += p["length"]
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
                   for ids in texts[p["doc_id"]])
    assert total == sum(len(ids) for same in texts.values() for ids in same)
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == length or at <= length and at.bit_count() == 1
    for i, same in texts.items():
        if len(same) == 1:
            cuts = sorted((p["start"], p["length"]) for p in got if p["doc_id"] == i)
            assert [s for s, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]]


@pytest.mark.parametrize("length", [4096, 16])
def test_packs(spark, corpus, length):
    rows = [*corpus.rows, corpus.rows[0], (3, "other text of one id", None, None, None), (None, None, None, None, None), (None, "a b", None, None, None)]
    docs = corpus.frame(spark, rows).withColumnRenamed("n_chars", "n").withColumnRenamed("lang", "rest")
    check_packs(rows, packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=length).collect(), length)


def test_packs_of_nothing(spark, corpus):
    assert packing.pack(corpus.frame(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_odd_texts_are_found_by_plain_searches():
    """What goes to the tokenizer uncut, told without a pattern over each character of each text."""
    pattern = re.compile("[\x1c-\x1fΣİ]|<\\|")
    signs = [chr(c) for c in range(0x500)] + ["<|", "<", "|", "|<", "a<|pad|>", ""]
    assert [packing._odd(f"x{s}y") for s in signs] == [bool(pattern.search(f"x{s}y")) for s in signs]
    assert all(isinstance(sign, str) for sign in packing._ODD)


def test_what_is_remembered_of_many_words_is_small():
    """Workers of two tasks keep it beside an executor's heap: no objects for each word."""
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("abdeginorst", k=9)) + rnd.choice(["", ",", ".##"]) for _ in range(4000)) for _ in range(30)]
    own = packing.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    tracemalloc.start()
    for _ in own.encode_all(texts):
        pass
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 120 * 4000 * 30


def test_forgetting_pieces_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 20)
    monkeypatch.setattr(packing, "LOT_CHARS", 100)
    own, whole = packing.ChunkEncoder(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    blanks = [f"a{c}b, Été{c} ÷x÷ ß{c}" for c in packing._BLANKS + "\x00\x07​﻿"]
    texts = [*fuzz(n=100), *blanks, None, "", " ", "the the", "Ã", "x÷"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_a_lot_is_looked_up_once(monkeypatch):
    """Each look-up hashes all that is remembered, and nearly every lot has a new piece."""
    import pyarrow.compute as pc

    calls, plain = [], pc.index_in
    monkeypatch.setattr(pc, "index_in", lambda *a, **k: calls.append(1) or plain(*a, **k))
    monkeypatch.setattr(packing, "LEARN_ROWS", 7)
    own, whole = packing.ChunkEncoder(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    for lot in range(3):
        texts = [f"new{lot} a##b{k} word{chr(97 + k)}{chr(97 + lot)} old ## x{k}y" for k in range(20)]
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
        assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert len(calls) == 3
