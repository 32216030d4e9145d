"""Phrase collocations by best-first branch-and-bound growth.

Phrases are runs of two or three words inside a piece of text.  The score of a
phrase of count a is that of its worst cut into a first part of count l and a
rest of count r, floor(1,000,000 a a / (l r)).

Words and two-word phrases are counted exactly.  Growing a two-word phrase of
count b by a word gives a count of at most b, so a prefix "x y" bounds the
scores of all phrases it grows into by b / count(x): an admissible bound.  The
frontier holds each prefix with this bound, and each two-word phrase that may
be reported with its own score, because a longer phrase on its left, too, can
make it go.  The best entries are expanded first: one reading of the texts
counts the three-word phrases of up to ``WAVE`` entries.  A language's threshold
starts at its ``top``-th best two-word score.  Once all entries with a bound at
the threshold or above are expanded, each phrase at or above it is settled; a
language with fewer than ``top`` survivors there lowers its threshold, and the
growth ends when none has to.  Ties with the last place are settled too, as
entries with an equal bound are expanded.

Scale: counts are combined in tasks before the shuffle, and no key is ever
gathered, so a phrase or language that a third of all words belong to is summed
like any other.  A wave sends at most ``WAVE`` phrases to the tasks whatever the
size of the corpus; more entries mean more waves.  Scores use decimals of 38
digits.

Edge cases: a null text is empty and a null language is ``und``; repeated rows
count again; a table without phrases that are frequent enough gives no rows;
ids are not needed; further columns are ignored.  Task memory follows the longest
text and ``HELD`` distinct phrases.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from presswork.sources.pages import top_rows

from .common import landed, worker_slot

LEAST, TOP = 10, 2000
#: A longer phrase with this share of a phrase's count makes it go.
COVERED = 50
#: Frontier entries expanded by one reading of the texts.
WAVE = 400_000
#: Distinct phrases that a task holds before it passes their counts on.
HELD = 300_000
#: A-Z in lower case; white space and marks that end a piece.
_BYTES = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text with any."""
    for piece in text.translate(_BYTES).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def _counts(docs: DataFrame, add: Callable[[Counter, str, list[bytes]], None]) -> DataFrame:
    """(lang, gram, k): what ``add`` counts in the pieces of (lang, text), summed."""
    def passed_on(held: dict[str, Counter]) -> Iterator:
        import pyarrow as pa

        for lang, counts in held.items():
            if counts:
                grams = pa.array(list(counts), pa.binary()).view(pa.string())
                langs = pa.DictionaryArray.from_arrays(pa.array([0] * len(counts), pa.int32()), pa.array([lang])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, grams, pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "k"])
        held.clear()

    def run(batches: Iterator) -> Iterator:
        worker_slot("collocations")
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, lang in enumerate(langs):
                counts = held.setdefault(lang, Counter())
                before = len(counts)
                for words in pieces(batch.column("text")[at].as_py()):
                    add(counts, lang, words)
                size += len(counts) - before
                if size > HELD:
                    yield from passed_on(held)
                    size = 0
        yield from passed_on(held)

    part = docs.mapInArrow(run, "lang string, gram string, k bigint")
    return part.groupBy("lang", "gram").agg(F.sum("k").alias("k"))


def _short(counts: Counter, lang: str, words: list[bytes]) -> None:
    counts.update(words)
    counts.update(map(b" ".join, zip(words, words[1:])))


def grown(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, gram, k): three-word phrases that begin with an entry of side 0 or end with one of side 1."""
    chosen: dict[str, tuple[set, set]] = {}
    for r in entries.select("lang", F.col("gram").cast("binary").alias("gram"), "side").toLocalIterator():
        chosen.setdefault(r["lang"], (set(), set()))[r["side"]].add(bytes(r["gram"]))
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def add(counts: Counter, lang: str, words: list[bytes]) -> None:
        if len(words) > 2 and lang in sent.value:
            begins, ends = sent.value[lang]
            pairs = list(map(b" ".join, zip(words, words[1:])))
            counts.update(first + b" " + last for first, second, last in zip(pairs, pairs[1:], words[2:]) if first in begins or second in ends)

    return _counts(docs, add)


def _score(a: str, left: str, right: str) -> Column:
    whole = "CAST({} AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {whole.format(a)} * {whole.format(a)}) DIV ({whole.format(left)} * {whole.format(right)})")


def _looked_up(rows: DataFrame, table: DataFrame, phrase: Column, name: str) -> DataFrame:
    """``rows`` with the count of a part of the phrase, which is in ``table``."""
    return rows.withColumn("_part", phrase).join(table.select("lang", F.col("gram").alias("_part"), F.col("k").alias(name)), ["lang", "_part"]).drop("_part")


def _words(gram: str = "gram") -> Column:
    return F.split(gram, " ")


def _joined(first: int, n: int) -> Column:
    return F.concat_ws(" ", F.slice(_words(), first, n))


def scored_pairs(short: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the two-word phrases in ``short`` (lang, gram, k)."""
    single, double = short.filter("NOT contains(gram, ' ')"), short.filter("contains(gram, ' ')")
    rows = _looked_up(_looked_up(double, single, _joined(1, 1), "l"), single, _joined(2, 1), "r")
    return rows.select("lang", F.col("gram").alias("phrase"), F.col("k").alias("a"), "l", "r", _score("k", "l", "r").alias("score"))


def scored_triples(long: DataFrame, short: DataFrame) -> DataFrame:
    """The same of three-word phrases: the lower of two cuts, the first if both score alike."""
    single, double = short.filter("NOT contains(gram, ' ')"), short.filter("contains(gram, ' ')")
    rows = _looked_up(_looked_up(long, single, _joined(1, 1), "x"), double, _joined(2, 2), "yz")
    rows = _looked_up(_looked_up(rows, double, _joined(1, 2), "xy"), single, _joined(3, 1), "z")
    rows = rows.withColumns({"first": _score("k", "x", "yz"), "second": _score("k", "xy", "z")})
    early = F.col("first") <= F.col("second")
    return rows.select(
        "lang", F.col("gram").alias("phrase"), F.col("k").alias("a"), F.when(early, F.col("x")).otherwise(F.col("xy")).alias("l"),
        F.when(early, F.col("yz")).otherwise(F.col("z")).alias("r"), F.least("first", "second").alias("score"))


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each language, with their place; found in salted parts first, so a hot language fills no task."""
    return top_rows(rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], n, "place")


def _thresholds(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, want, least): the score at place ``want`` of a language's pairs, 0 if there are fewer."""
    most = wanted.agg(F.max("want")).first()[0] or 0
    ranked = _best(pairs.select("lang", "phrase", "a", "score"), most).join(wanted, "lang").filter("place <= want")
    return ranked.groupBy("lang").agg(F.max("want").alias("want"), F.when(F.count(F.lit(1)) < F.max("want"), 0).otherwise(F.min("score")).alias("least"))


def _survivors(pairs: DataFrame, triples: DataFrame, limits: DataFrame) -> DataFrame:
    """Settled phrases at or above their language's threshold that no longer phrase covers."""
    held = triples.select("lang", F.explode(F.array(*[
        F.struct(F.concat_ws(" ", F.slice(_words("phrase"), k, 2)).alias("phrase"), F.col("a").alias("most")) for k in (1, 2)])).alias("x"))
    cover = held.groupBy("lang", "x.phrase").agg(F.max("x.most").alias("most"))
    rows = pairs.join(limits, "lang").filter("score >= least").join(cover, ["lang", "phrase"], "left")
    short = rows.filter(F.coalesce(100 * F.col("most") < COVERED * F.col("a"), F.lit(True)))
    return short.select("lang", "phrase", "a", "l", "r", "score").union(
        triples.join(limits, "lang").filter("score >= least").select("lang", "phrase", "a", "l", "r", "score"))


def collocations(docs: DataFrame, lang_col: str = "lang", top: int = TOP, least: int = LEAST, wave: int = WAVE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    frequent = F.col("k") >= least
    sums = landed(_counts(texts, _short).withColumn("n", F.when(~F.contains("gram", F.lit(" ")), F.col("k"))).filter(
        frequent | F.col("n").isNotNull()), "phrase-short")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("n"))
    short = sums.filter(frequent).drop("n")
    pairs = landed(scored_pairs(short), "phrase-pairs")
    # The bound of all phrases that a pair grows into, and its own score for those that end with it.
    frontier = landed(pairs.select("lang", F.col("phrase").alias("gram"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.expr("1000000 * a DIV l").alias("bound")), F.struct(F.lit(1).alias("side"), F.col("score").alias("bound")))).alias("x"))
        .select("lang", "gram", "x.side", "x.bound"), "phrase-frontier")
    none = short.limit(0)
    triples, done = scored_triples(none, short), frontier.limit(0).select("lang", "gram", "side")
    wanted = pairs.select("lang").distinct().withColumn("want", F.lit(top))
    while True:
        limits = landed(_thresholds(pairs, wanted), "phrase-limits")
        while True:
            open_ = frontier.join(limits, "lang").filter("bound >= least").join(done, ["lang", "gram", "side"], "left_anti")
            batch = landed(open_.orderBy(F.desc("bound"), "lang", "gram", "side").limit(wave).select("lang", "gram", "side"), "phrase-wave")
            if batch.isEmpty():
                break
            found = scored_triples(grown(texts, batch).filter(frequent), short)
            # A phrase met from both sides, in two waves, has the same row twice.
            triples = landed(triples.union(found).distinct(), "phrase-triples")
            done = done.union(batch)
        settled = landed(_survivors(pairs, triples, limits), "phrase-settled")
        lacking = limits.join(settled.groupBy("lang").agg(F.count(F.lit(1)).alias("got")), "lang", "left").fillna(0, ["got"])
        short_of = F.when((F.col("got") < top) & (F.col("least") > 0), F.col("want") + 2 * (top - F.col("got"))).otherwise(F.col("want"))
        after = landed(lacking.select("lang", "want", short_of.cast("int").alias("next")), "phrase-wanted")
        if after.filter("next > want").isEmpty():
            break
        wanted = after.select("lang", F.col("next").alias("want"))
    return _best(settled, top).join(totals, "lang").select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
