"""Document fingerprints by spot signatures: chains of content words behind common words.

Common words are anchors: those that make up ``ANCHOR_SHARE`` of the words of a
language, counted over all documents, and the union over the languages is used
for every text.  Behind each anchor the next ``CHAIN`` content words form a
signature, "anchor word word word".  One content word in eight, chosen by its
MD5, is an anchor too, so that texts in a language without common words, lists
and code have signatures.  A text's fingerprint is the set of its distinct
signatures; a set's digest names it in one string.  A text without any
signature has one of all its words, so the set is never empty.

Comparing: ``likeness`` is the Jaccard similarity of two sets; where lengths
alone rule out ``least`` it is 0 and nothing is intersected.  ``near_documents``
finds all pairs within ``least``: equal sets are one; sets are partitioned by
length so that near ones lie in the same or in neighbouring partitions; inside
them they are joined on the rarest part of each, and lengths and places prune
what meets before sets are intersected.  A signature that very many sets hold is
dealt out in blocks.

Scale: DataFrame functions only.  Word counts are combined before the shuffle;
anchors are at most 1 / ``ANCHOR_SHARE`` words for each of at most 1 /
``LANG_SHARE`` languages, whatever the input.  For the next document, whole
texts move once, into buckets of about ``BUCKET_ROWS`` neighbouring ids; the
first row of a bucket also goes to the bucket before, so no window spans more.

Edge cases: a null text is empty.  Rows of one id follow each other in the order
of their texts.  A row without an id has no place in the order: its next text is
empty, and it is nobody's next.  The next of a single document is itself.  Empty
texts have equal fingerprints; repeated rows give repeated rows; an empty table
gives no rows; further columns are ignored.  Memory follows the longest text.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import landed

#: Share of a language's words that makes a word an anchor, and share of the documents that makes a language count.
ANCHOR_SHARE, LANG_SHARE = 0.004, 0.001
#: Content words in a signature.
CHAIN = 3
#: Documents in a bucket of neighbouring ids, about.
BUCKET_ROWS = 4096
#: Sets that hold one signature in one block.
BLOCK = 2000
WORD = r"[\p{L}\p{N}\p{M}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def common_words(docs: DataFrame, lang_col: str | None = "lang") -> list[str]:
    """The anchors: frequent words of each language, or of all texts without ``lang_col``."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(lang.alias("lang"), "text")
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    total = per_lang.agg(F.sum("k")).first()[0] or 0
    langs = [r["lang"] for r in per_lang.filter(F.col("k") >= LANG_SHARE * total).collect()]
    if not langs:
        return []
    # Rare languages add to no count of their own; their texts use the anchors of the others.
    counted = landed(rows.filter(F.col("lang").isin(langs)).select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy(
        "lang", "word").agg(F.count(F.lit(1)).alias("k")), "spot-words")
    sums = counted.groupBy("lang").agg(F.sum("k").alias("n"))
    kept = counted.join(F.broadcast(sums), "lang").filter(F.col("k") >= ANCHOR_SHARE * F.col("n"))
    return sorted(r["word"] for r in kept.select("word").distinct().collect())


def with_signatures(rows: DataFrame, text: str, out: str, common: list[str]) -> DataFrame:
    """``rows`` with the sorted distinct signatures of ``text`` in ``out``."""
    def anchor(w: Column) -> Column:
        return w.isin(common) if common else F.lit(False)

    rows = rows.withColumn("_w", _words(F.col(text)))
    rows = rows.withColumn("_c", F.filter("_w", lambda w: ~anchor(w)))
    rows = rows.withColumn("_p", F.array_compact(F.transform("_w", lambda w, i: F.when(anchor(w), i))))
    # The anchor with j anchors before it, at place p, has p - j content words before it.
    behind = F.transform("_p", lambda p, j: F.when(p - j < F.size("_c"), F.concat_ws(
        " ", F.get("_w", p), F.slice("_c", p - j + 1, F.lit(CHAIN)))))
    chosen = F.transform("_c", lambda w, k: F.when(F.substring(F.md5(w.cast("binary")), 1, 1) < "2", F.concat_ws(
        " ", F.slice("_c", k + 1, F.lit(CHAIN + 1)))))
    rows = rows.withColumn("_s", F.array_distinct(F.array_compact(F.concat(behind, chosen))))
    whole = F.array(F.concat(F.lit("= "), F.concat_ws(" ", "_w")))
    return rows.withColumn(out, F.when(F.size("_s") > 0, F.sort_array("_s")).otherwise(whole)).drop("_w", "_c", "_p", "_s")


def fingerprint(signatures: Column | str) -> Column:
    """One string for a set of signatures."""
    return F.md5(F.concat_ws("\n", signatures).cast("binary"))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where lengths rule ``least`` out."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    found = shared / (n + m - shared)
    return F.when(F.least(n, m) < least * F.greatest(n, m), F.lit(0.0)).otherwise(found) if least else found


def near_documents(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", lang_col: str | None = "lang") -> tuple[DataFrame, DataFrame]:
    """Members (id, class) of equal sets, and pairs (a, b, likeness) of classes, a < b, at ``least`` or above.

    A class is named by its smallest id; rows without an id take no part.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = landed(with_signatures(rows, "text", "sigs", common_words(docs, lang_col)).select(
        "id", "sigs", fingerprint("sigs").alias("print")), "spot-sets")
    firsts = sets.groupBy("print").agg(F.min("id").alias("class"))
    members = sets.select("id", "print").join(firsts, "print").select("id", "class").distinct()
    classes = landed(sets.join(firsts, "print").filter(F.col("id") == F.col("class")).dropDuplicates(["class"]).select(
        "class", "sigs", F.size("sigs").alias("n")), "spot-classes")
    # A step of the partitions is a little wider than the bound, so that rounding never puts near sets two apart.
    part = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - math.log(least))).cast("int")
    held = classes.select("class", "n", part.alias("part"), F.explode("sigs").alias("sig")).withColumn("sig", F.xxhash64("sig"))
    counts = held.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    own = Window.partitionBy("class")
    shared = held.join(counts, "sig").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
    # Places run from rare to common; signatures that no other set holds come first and need no row.
    placed = shared.withColumn("at", F.col("alone") + F.row_number().over(own.orderBy("k", "sig")))
    rare = landed(placed.filter(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("class", "n", "part", "sig", "at"), "spot-rare")
    asking = rare.select("class", "n", "sig", "at", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    keys = ["sig", "part"]
    blocks = lambda rows_, name: rows_.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = landed(blocks(rare, "down").join(blocks(asking, "across"), keys), "spot-sizes")

    def dealt(rows_: DataFrame, mine: str, theirs: str) -> DataFrame:
        return rows_.join(sizes, keys).select("class", "n", "at", *keys, F.pmod(F.xxhash64("class"), F.col(mine)).alias(f"_{mine}"),
                                              F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)).alias(f"_{theirs}"))

    left = dealt(asking, "across", "down").withColumnsRenamed({"class": "b", "n": "m", "at": "place"})
    right = dealt(rare, "down", "across").withColumnRenamed("class", "a")
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) + 1
    met = left.join(right, [*keys, "_down", "_across"]).filter(
        (F.col("a") != F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)
        & (most >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9))
    pairs = landed(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "spot-pairs")
    both = pairs.join(classes.select(F.col("class").alias("a"), F.col("sigs").alias("x")), "a").join(
        classes.select(F.col("class").alias("b"), F.col("sigs").alias("y")), "b")
    return members, both.select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).filter(F.col("likeness") >= least)


def _buckets(ids: DataFrame) -> tuple[list[int], list[int]]:
    """Borders of buckets of neighbouring ids, and the smallest id in each bucket that holds any."""
    n = ids.count()
    if not n:
        return [], []
    parts = max(1, n // BUCKET_ROWS)
    steps = [k / parts for k in range(1, parts)]
    borders = sorted(set(ids.agg(F.percentile_approx("id", steps, max(10_000, 20 * parts))).first()[0])) if steps else []
    firsts = ids.groupBy(_bucket(F.col("id"), borders).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
    # Buckets without rows go, so that a bucket's number is that of its first id.
    return [r["id"] for r in firsts[1:]], [r["id"] for r in firsts]


def _bucket(value: Column, borders: list[int]) -> Column:
    """How many of the sorted ``borders`` are not above ``value``, by halving."""
    if not borders:
        return F.lit(0)
    table = F.array(*map(F.lit, borders)) if len(borders) < 64 else F.expr(f"array({', '.join(f'{b}L' for b in borders)})")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step <= len(borders)) & (F.get(table, low + step - 1) <= value), low + step).otherwise(low))


def beside_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, p, guest, at): every row, sorted by id inside its bucket ``p``, and behind each bucket the first row of the next.

    ``guest`` marks these further rows; the first row of all follows the last.
    Rows without an id are dealt out over buckets below zero.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is to be an integer")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    borders, firsts = _buckets(rows.select("id").filter("id IS NOT NULL"))
    last = max(0, len(firsts) - 1)
    own = _bucket(F.col("id"), borders)
    placed = rows.withColumn("own", F.when(F.col("id").isNull(), -1 - F.pmod(F.monotonically_increasing_id(), F.lit(last + 1)).cast("int")).otherwise(own))
    first = F.get(F.expr(f"array({', '.join(f'{i}L' for i in firsts)})"), F.col("own")) if firsts else F.lit(None).cast("long")
    before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
    # A place in one bucket, and one more for the first id of a bucket.
    places = F.array_compact(F.array(
        F.struct(F.col("own").alias("p"), F.lit(False).alias("guest")),
        F.when((F.col("own") >= 0) & (first == F.col("id")), F.struct(before.alias("p"), F.lit(True).alias("guest")))))
    spread = placed.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.p", "at.guest")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return spread.repartition(max(cores, last + 1), "p").sortWithinPartitions("p", "guest", "id", "text")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last quarter is replaced by as much of the beginning of ``following``."""
    n = F.length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - m), F.substr(following, F.lit(1), m))


def compared(docs: DataFrame, id_col: str = "doc_id", lang_col: str | None = "lang") -> DataFrame:
    """(id, text, sigs, edited, edited_sigs, next_sigs): each document beside its edited text and its next."""
    common = common_words(docs, lang_col)
    sets = with_signatures(beside_next(docs, id_col), "text", "sigs", common)
    order = Window.partitionBy("p").orderBy("guest", "id", "text")
    met = sets.withColumns({"following": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)}).filter("NOT guest")
    met = met.withColumns({
        "following": F.when(F.col("id").isNull(), F.lit("")).otherwise(F.col("following")),
        "next_sigs": F.when(F.col("id").isNull(), F.array(F.lit("= "))).otherwise(F.col("next_sigs"))})
    met = met.withColumn("edited", edited(F.col("text"), F.col("following"))).drop("following", "p", "guest")
    return with_signatures(met, "edited", "edited_sigs", common)


def fingerprint_query(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    found = compared(docs, id_col)
    return found.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
