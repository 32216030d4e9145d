"""Line deduplication by deletion neighbourhoods (DataFrame functions only).

Two lines are the same when their word sequences differ by at most one word
put in, left out or replaced (lines of ``MIN_NEAR`` words and more) or not at
all (shorter ones).  A line goes when an earlier line, in order of document id
and line number, is the same; this is judged on the input, not on what is left.

Every line in question emits a hashed key for itself and for each variant with
one word deleted.  Equal variants with the same place deleted are replacements
of one another; a variant equal to a whole line is an insertion.  So the
earliest member of a group decides for all others and no pairs are formed.
Decisions are verified on the words.

Scale: lines without a partner never emit variants.  If two lines differ by
one word, one half of them is equal, so first only the hashes of halves are
counted (combined before the shuffle), and just lines whose half occurs in
another line go on.  A common line or template costs one row per task.

Edge cases: null texts have no lines; lines without words stay and count as no
line; rows repeating a document id count as one document if their texts are
equal and are ordered by a hash of the text if not; a null id comes first; an
empty table gives no rows; further columns are kept by ``dedup_lines``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.functions.text import bind

from .common import landed, words

#: Lines with fewer words are compared exactly only.
MIN_NEAR = 5


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64("text").alias("_tk"), "text")


def _join_docs(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on the document key; a null id meets a null id."""
    right = other.withColumnsRenamed({"_id": "_id2", "_tk": "_tk2"})
    met = docs.join(right, (F.col("_tk") == F.col("_tk2")) & F.col("_id").eqNullSafe(F.col("_id2")), how)
    return met.drop("_id2", "_tk2")


def _half_keys(w: Column, n: Column) -> Column:
    """Hashes of the halves one of which survives any single edit.

    A line of n words meets lines of n - 1, n and n + 1 words; the shorter of
    two has its first or last ``n // 2`` words in common with the longer.
    """
    def at(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit("head"), m, F.slice(w, F.lit(1), m)), F.xxhash64(F.lit("tail"), m, F.slice(w, n - m + 1, m))]

    full, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n < MIN_NEAR, F.array().cast("array<bigint>")).when(full == less, F.array(*at(full))).otherwise(
        F.array(*at(full), *at(less)))


def line_table(docs: DataFrame) -> DataFrame:
    """A narrow row for each line with a word: place, two hashes and the keys of its halves."""
    lines = docs.select("_id", "_tk", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    split = lines.select("_id", "_tk", "line_no", words(F.col("line")).alias("w")).filter(F.size("w") > 0)
    sized = split.select("*", F.size("w").alias("n"))
    return sized.select("_id", "_tk", "line_no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), F.col("w")).alias("h2"),
                        _half_keys(F.col("w"), F.col("n")).alias("halves"))


def _place() -> Column:
    return F.struct("_id", "_tk", "line_no")


def _candidates(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Distinct lines, at their first place, that share a half with another line."""
    halves = lines.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("half")
    asked = lines.select("h1", "h2", F.explode("halves").alias("half")).join(shared, "half", "left_semi")
    hashes = asked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).select("h1", "h2")
    return first.join(hashes, ["h1", "h2"], "left_semi").select("place.*")


def _with_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The words of the lines at ``places``; each document is split once."""
    by_doc = places.groupBy("_id", "_tk").agg(F.collect_set("line_no").alias("line_nos"))
    met = _join_docs(docs, by_doc, "inner")
    split = met.select("_id", "_tk", "line_nos", F.split("text", "\n").alias("lines"))
    picked = split.select("_id", "_tk", F.explode(F.transform("line_nos", lambda i: F.struct(
        i.alias("line_no"), F.get("lines", i).alias("line")))).alias("x"))
    # Rows that repeat a document meet here.
    once = picked.select("_id", "_tk", "x.line_no", "x.line").dropDuplicates(["_id", "_tk", "line_no"])
    return once.select("_id", "_tk", "line_no", words(F.col("line")).alias("w"))


def deletion_variants(lines: DataFrame) -> DataFrame:
    """Each line's key (``cut`` = -1) and the keys of its variants with word ``cut`` deleted.

    A key is a sum of hashes of (word, place), so a running sum gives the key
    of every variant: words behind the deleted one move up by one place.
    """
    def parts(word: Column, at: Column) -> list[Column]:
        return [F.shiftrightunsigned(F.xxhash64(F.lit(salt), word, at), 24) for salt in (0, 1)]

    rows = lines.select("_id", "_tk", "line_no", F.size("w").alias("n"), F.posexplode("w").alias("cut", "word"))
    stay, move = parts(F.col("word"), F.col("cut")), parts(F.col("word"), F.col("cut") - 1)
    rows = rows.select("_id", "_tk", "line_no", "n", "cut", *[s.alias(f"s{k}") for k, s in enumerate(stay)],
                       *[m.alias(f"m{k}") for k, m in enumerate(move)])
    line = Window.partitionBy("_id", "_tk", "line_no")
    upto = line.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = [F.sum(f"s{k}").over(upto) for k in (0, 1)]
    cut = [F.sum(f"m{k}").over(line) + F.sum(F.col(f"s{k}") - F.col(f"m{k}")).over(upto) - F.col(f"s{k}") for k in (0, 1)]
    keyed = rows.select("_id", "_tk", "line_no", "n", "cut", F.xxhash64(F.col("n") - 1, *cut).alias("key"),
                        F.xxhash64(F.col("n"), *whole).alias("whole"))
    # The last word's running sum is the whole line's.
    entries = F.when(F.col("cut") == F.col("n") - 1, F.array(
        F.struct(F.col("key"), F.col("cut")), F.struct(F.col("whole").alias("key"), F.lit(-1).alias("cut"))
    )).otherwise(F.array(F.struct(F.col("key"), F.col("cut"))))
    return keyed.select("_id", "_tk", "line_no", F.explode(entries).alias("e")).select("_id", "_tk", "line_no", "e.key", "e.cut")


def _rest(w: Column, cut: Column) -> Column:
    return F.when(cut < 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(cut, F.lit(0))),
                                                 F.slice(w, F.greatest(cut, F.lit(0)) + 2, F.size(w))))


def near_duplicates(lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Places of lines that an earlier line differs from by one word."""
    # Nearly all variants are alone with their key: only the others go on.
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    variants = landed(variants.join(shared, "key", "left_semi"), "line-shared")
    place = F.struct("_id", "_tk", "line_no", "cut")
    by_cut = variants.groupBy("key", "cut").agg(F.min(place).alias("twin"), F.count(F.lit(1)).alias("k"))
    by_key = by_cut.groupBy("key").agg(
        F.min(F.when(F.col("cut") < 0, F.col("twin"))).alias("line"), F.min(F.when(F.col("cut") >= 0, F.col("twin"))).alias("variant"),
        F.sum("k").alias("k")).filter("k > 1").drop("k")
    met = variants.join(by_key, "key").join(by_cut.filter("k > 1 and cut >= 0").select("key", "cut", "twin"), ["key", "cut"], "left")
    here = F.struct("_id", "_tk", "line_no")

    def earlier(c: str) -> Column:
        there = F.struct(F.col(f"{c}._id").alias("_id"), F.col(f"{c}._tk").alias("_tk"), F.col(f"{c}.line_no").alias("line_no"))
        return F.when(F.col(c).isNotNull() & (there < here), F.col(c))

    found = met.select("_id", "_tk", "line_no", "cut", F.array_compact(F.array(
        F.when(F.col("cut") >= 0, earlier("twin")), F.when(F.col("cut") >= 0, earlier("line")),
        F.when(F.col("cut") < 0, earlier("variant")))).alias("partners"))
    pairs = found.select("_id", "_tk", "line_no", "cut", F.explode("partners").alias("p"))
    mine = lines.select("_id", "_tk", "line_no", "w")
    theirs = lines.select(F.col("_id").alias("_id2"), F.col("_tk").alias("_tk2"), F.col("line_no").alias("line_no2"), F.col("w").alias("w2"))
    same = lambda a, b: (F.col(f"_tk{a}") == F.col(f"_tk{b}")) & (F.col(f"line_no{a}") == F.col(f"line_no{b}")) & F.col(f"_id{a}").eqNullSafe(F.col(f"_id{b}"))
    asked = pairs.select(*[F.col(c).alias(f"{c}1") for c in ("_id", "_tk", "line_no")], "cut", F.col("p._id").alias("_id3"),
                         F.col("p._tk").alias("_tk3"), F.col("p.line_no").alias("line_no3"), F.col("p.cut").alias("cut3"))
    verified = (asked.join(mine, same("1", "")).join(theirs, same("3", "2"))
                .filter(_rest(F.col("w"), F.col("cut")) == _rest(F.col("w2"), F.col("cut3"))))
    return verified.select("_id", "_tk", "line_no").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of the lines that go, a row per document (``_id``, ``_tk``) with any."""
    docs = _keyed(docs, id_col)
    lines = landed(line_table(docs), "line-table")
    # Written, so that the joins meet it as it is and can split a line that is very common.
    first = landed(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("place")), "line-firsts")
    copies = lines.join(first, ["h1", "h2"]).filter(_place() > F.col("place")).select("_id", "_tk", "line_no")
    worded = landed(_with_words(docs, _candidates(lines, first)), "line-words")
    near = near_duplicates(worded, landed(deletion_variants(worded), "line-variants"))
    return copies.union(near).groupBy("_id", "_tk").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: lines with a word, and the numbers (from 0) of those that go."""
    # A match runs from a line's first word to its end.
    counts = _keyed(docs, id_col).select("_id", "_tk", F.regexp_count(
        F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines"))
    met = _join_docs(counts, removed_lines(docs, id_col), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return met.select(F.col("_id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"),
                      F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay; null texts stay null."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64("text").alias("_tk"))
    met = _join_docs(keyed, removed_lines(docs, id_col), "left")
    lines = F.split(F.col("_row")["text"], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("_row")["text"]).otherwise(
        bind(lines, lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")))
    return met.select(F.col("_row"), text.alias("_text")).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
