"""Grouping of spelling variants: words one edit apart, found through pivotal grams.

Words are counted over whole texts.  Two words are near if one inserted, deleted
or replaced code point makes them equal.  A word's form is its most frequent
near word, if that is frequent enough; its root is the end of the chain of forms.

Search: the two-letter grams of all words are ordered from rare to frequent.  A
word's prefix is its three rarest grams and all that tie with the last of them;
its pivots are two disjoint grams of the prefix with the least total frequency,
chosen by dynamic programming over their places.  One edit leaves one of two
disjoint grams whole, so of two near words the one whose prefix ends earlier in
the order has a pivot in the other's prefix.  Prefixes are indexed and pivots
look them up.  Places limit the look-up: behind an edit a gram keeps its distance
from the word's end, before one that from its beginning, and all there is on
that side is equal.  So an entry's key is its gram with the word's whole
beginning, or whole ending, and the other word's length.  What meets is verified.

Scale: counts are combined in tasks before the shuffle.  The order of the grams
is sent to the tasks: there are at most 90 * 90.  A key that very many words
share is dealt out in blocks of ``BLOCK`` by ``BLOCK`` entries, joined in several
tasks, so nothing is gathered and no pair is lost.  Chains of forms are followed
by pointer doubling; counts double from form to form, so there are few rounds.

Edge cases: a null text has no words; a null id counts as an empty one; repeated
rows count again; equal counts are settled by code points; an empty table gives
no rows; further columns are ignored.  Task memory follows the longest text and
``HELD`` distinct words.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import landed, worker_slot

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A run whose checksum this divides loses a code point.
DAMAGED = 97
#: A form is at least so many times as frequent.
FORM_RATIO = 2
#: Distinct words a task holds before it passes their counts on, entries of a key in one block, and pairs met by one task, about.
HELD, BLOCK, TASK_PAIRS = 500_000, 2000, 40_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs(doc_id: str, text: bytes, damaged: int = DAMAGED) -> Iterator[tuple[str, int]]:
    """The distinct runs of a text after damage, with how often each occurs."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, k in Counter(RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if damaged and h % damaged == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, k


def word_counts(docs: DataFrame, id_col: str = "doc_id", damaged: int = DAMAGED) -> DataFrame:
    """(word, n): frequent words of enough code points."""
    def passed_on(held: Counter):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "k"])

    def run(batches: Iterator) -> Iterator:
        worker_slot("spelling")
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at, doc_id in enumerate(ids):
                for word, k in runs(doc_id, batch.column("text")[at].as_py(), damaged):
                    if len(word) >= LEAST_CHARS:
                        held[word] += k
                if len(held) > HELD:
                    yield passed_on(held)
                    held.clear()
        yield passed_on(held)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(run, "word string, k bigint").groupBy("word").agg(F.sum("k").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order from rare to frequent, and number of occurrences, of each two-letter gram."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = Counter(w[i:i + 2] for w in batch.column("word").to_pylist() for i in range(len(w) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "k"])

    total = words.select("word").mapInArrow(run, "gram string, k bigint").groupBy("gram").agg(F.sum("k").alias("k"))
    ordered = sorted((r["k"], r["gram"]) for r in total.collect())
    return {gram: (place, k) for place, (k, gram) in enumerate(ordered)}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(place in the order, place in the word, frequency) of the three rarest grams and those that tie with the third."""
    grams = [(*order[word[i:i + 2]], i) for i in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    return [(place, at, k) for place, k, at in grams if place <= last]


def pivots(grams: list[tuple[int, int, int]]) -> list[int]:
    """Places in the word of two disjoint grams of the least total frequency."""
    best, least, lag = None, None, 0
    for _, at, k in grams:
        # The cheapest gram that ends before this one begins.
        while grams[lag][1] <= at - 2:
            if least is None or grams[lag][2] < least[0]:
                least = (grams[lag][2], grams[lag][1])
            lag += 1
        if least and (best is None or least[0] + k < best[0]):
            best = (least[0] + k, [least[1], at])
    return best[1]


def _letters(word: str) -> int:
    """A signed 64-bit set of the word's letters."""
    found = 0
    for c in set(word):
        p = ord(c)
        found |= 1 << (p - 97 if p < 128 else 26 + (p - 192) % 38)
    return found - (1 << 64) if found >> 63 else found


def entries(words: DataFrame, order: dict[str, tuple[int, int]], looks_up: bool) -> DataFrame:
    """(key, word, n, last, letters): index rows of prefixes, or the look-ups of pivots."""
    sent = words.sparkSession.sparkContext.broadcast(order)

    def keys(word: str) -> tuple[list[int], int]:
        grams = prefix(word, sent.value)
        size, data = len(word), word.encode("utf-16-le")
        # Checksums of each beginning and of each ending; a collision costs a comparison only.
        begin, end = [0], [0]
        for i in range(size):
            begin.append(zlib.crc32(data[2 * i:2 * i + 2], begin[-1]))
            end.append(zlib.crc32(data[2 * (size - i - 1):2 * (size - i)], end[-1]))
        sizes = (size - 1, size, size + 1) if looks_up else (size,)
        places = pivots(grams) if looks_up else [at for _, at, _ in grams]
        sides = [side for at in places for side in ((begin[at + 2] << 1), (end[size - at] << 1) + 1)]
        return [(side << 24) + n for side in sides for n in sizes], max(g[0] for g in grams)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        worker_slot("spelling")
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = [(*keys(w), _letters(w)) for w in part.column("word").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                columns = [pa.array([k for f in found for k in f[0]], pa.int64()), part.column("word").take(rows), part.column("n").take(rows),
                           pa.array([f[1] for f in found], pa.int32()).take(rows), pa.array([f[2] for f in found], pa.int64()).take(rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n", "last", "letters"])

    return words.mapInArrow(run, "key bigint, word string, n bigint, last int, letters bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of each pair of near words, once each."""
    order = gram_order(words)
    indexed = landed(entries(words, order, False), "spelling-index")
    asked = landed(entries(words, order, True), "spelling-pivots")
    sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n_asked")).join(
        indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n_indexed")), "key")
    sizes = landed(sizes, "spelling-keys")
    total = sizes.agg(F.sum(F.col("n_asked") * F.col("n_indexed"))).first()[0] or 0
    blocks = sizes.select("key", F.ceil(F.col("n_asked") / BLOCK).alias("across"), F.ceil(F.col("n_indexed") / BLOCK).alias("down")).filter("across > 1 OR down > 1")
    parts = max(words.sparkSession.sparkContext.defaultParallelism, total // TASK_PAIRS)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """One copy of a row per block of the other side; its own block follows from its word."""
        met = rows.join(blocks, "key", "left").na.fill(1, ["across", "down"])
        mine = F.pmod(F.xxhash64("word"), F.col(own)).alias(f"_{own}")
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"_{other}")
        return met.select("key", "word", "n", "last", "letters", mine, theirs).repartition(parts, "key", "_across", "_down")

    left = dealt(asked, "across", "down")
    right = dealt(indexed, "down", "across").withColumnsRenamed({"word": "near", "n": "near_n", "last": "near_last", "letters": "near_letters"})
    met = left.join(right, ["key", "_across", "_down"]).filter(
        (F.col("near_last") >= F.col("last")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2)
        & (F.levenshtein("word", "near", 1) == 1))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"),
                             F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(both.alias("x")).select("x.*").distinct()


def followed(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of ``links`` (word, form) from each word ends."""
    links = landed(links.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("root").alias("_next"), F.col("word").alias("root"))
        step = landed(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", damaged: int = DAMAGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    words = landed(word_counts(docs, id_col, damaged), "spelling-words")
    found = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    most = -F.col("best.minus")
    fits = most >= FORM_RATIO * F.col("n")
    formed = landed(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, most).alias("form_n")), "spelling-forms")
    roots = followed(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
