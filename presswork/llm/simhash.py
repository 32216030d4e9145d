"""SimHash near-duplicates over a hierarchical index in Gray order.

A fingerprint has a bit for each of 64 hash bits that more than half of a
text's word shingles have.  Texts whose fingerprints differ in at most three
bits are linked, and linked groups are found as connected components.

Index: all distinct fingerprints are sorted by the rank of their bits in the
Gray sequence, so that neighbours share long masked bit patterns.  The order is
cut into ranges.  A run of eight fingerprints is a node that keeps the bits all
have in common (mask and pattern), eight nodes an upper node that takes over the
bits they share, and so on to the top; ranges are nodes of this tree as well, and
those above them are the upper part of the index.  There are four such orders,
each with another quarter of the bits in front.

Search: every fingerprint goes down from the top.  Each node adds the differences
in the bits that it knows and its parent did not; a node whose sum exceeds three
is dropped with all below it.  Two fingerprints within three bits agree in a
quarter, so in each order a node that differs in the front quarter is dropped at
once.  The upper part decides which ranges a fingerprint is sent to, never one
before its own, and each range goes on down to fingerprints.

Scale: only distinct fingerprints are searched, with their smallest id formed
before the shuffle.  The upper part is sent to all tasks: at most four times
``NODES`` ranges, however many fingerprints, as ranges then grow.  A fingerprint
is sent to its own range of each order, and beyond only while its front quarter
goes on.  A range that very many are sent to is copied for each ``ASKING`` of
them.  A group of fingerprints within three bits of one has at most 43,745
members.  Of the links in a task only a spanning forest leaves it.  Components
are contracted in rounds whose number grows with the logarithm of their size;
every round is written to the shared folder.

Edge cases: null and blank texts have fingerprint zero and are linked as any
other; repeated rows have one fingerprint; null ids are passed over when a
component's smallest id is chosen; an empty table gives no rows; very long
texts are hashed in slices, so memory does not follow their length.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import landed, strings, worker_slot

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 3
NEAR = 3
FANOUT = 8
#: Fingerprints in a range, about, unless that makes more than so many ranges.
RANGE_ROWS, NODES = 32_768, 200_000
#: Fingerprints sent to one copy of a range.
ASKING = 1_000_000
#: Query and node pairs looked at together.
FRONTIER = 200_000
#: The quarter of the bits in front.
FRONT = 0xFFFF << 48

_UPPER = re.compile("[A-Z]+")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    text = text or ""
    text = text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)
    words = WORDS.findall(text)
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones, join, part = np.zeros(64, np.int64), " ".join, 65_536
    for at in range(0, n, part):
        end = min(n, at + part)
        shingles = map(join, zip(*[words[at + k:end + k] for k in range(size)])) if len(words) >= size else [join(words)]
        hashes = np.fromiter([xxh64_intdigest(s, 42) for s in shingles], np.uint64, end - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tk, fp) of every document: fp as a signed long, and a hash of the text to tell rows of one id apart."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_slot("simhash")
        for batch in batches:
            values = np.fromiter((fingerprint(t) for t in strings(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("tk"), pa.array(values.view(np.int64))], names=[id_col, "tk", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64("text").alias("tk"), "text").mapInArrow(run, f"{id_col} {kind}, tk bigint, fp bigint")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A tree of (mask, pattern) nodes over leaves in Gray order; a leaf has a mask, too.

    ``visited`` and ``dropped`` count the nodes met and those dropped with all below them.
    """

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        full = np.full(len(patterns), np.iinfo(np.uint64).max, np.uint64) if masks is None else masks
        #: From the leaves up: masks, patterns, and where a node's children begin in the level below.
        self.levels = [(full, patterns & full, None)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern, _ = self.levels[-1]
            first = np.arange(0, len(mask), FANOUT)
            # Bits stay in the mask where all children know them and agree.
            all_and, all_or = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(all_and ^ all_or)
            self.levels.append((shared, all_and & shared, first))
        self.visited = self.dropped = 0

    def near(self, words: np.ndarray, equal: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs that differ in at most ``NEAR`` known bits and in none of ``equal``, in bounded lots."""
        equal = np.uint64(equal)
        if not len(self.levels[0][0]):
            return
        top = len(self.levels) - 1
        mask, pattern, _ = self.levels[top]
        step = max(1, FRONTIER // FANOUT)
        for at in range(0, len(words), step):
            query = np.arange(at, min(at + step, len(words)))
            self.visited += len(query)
            apart = (words[query] ^ pattern[0]) & mask[0]
            seen = np.bitwise_count(apart)
            close = (seen <= NEAR) & (apart & equal == 0)
            self.dropped += int((~close).sum())
            yield from self._down(words, equal, top, query[close], np.zeros(int(close.sum()), np.int64), seen[close])

    def _down(self, words, equal, depth, query, node, seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not depth:
            yield query, node
            return
        above, _, first = self.levels[depth]
        mask, pattern, _ = self.levels[depth - 1]
        step = max(1, FRONTIER // FANOUT)
        for at in range(0, len(query), step):
            q, n, s = query[at:at + step], node[at:at + step], seen[at:at + step]
            width = np.minimum(first[n] + FANOUT, len(mask)) - first[n]
            child = np.repeat(first[n], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            q, parent = np.repeat(q, width), np.repeat(n, width)
            # Only the bits that the parent did not know are new.
            apart = (words[q] ^ pattern[child]) & (mask[child] & ~above[parent])
            sum_ = np.repeat(s, width) + np.bitwise_count(apart)
            close = (sum_ <= NEAR) & (apart & equal == 0)
            self.visited += len(child)
            self.dropped += int((~close).sum())
            yield from self._down(words, equal, depth - 1, q[close], child[close], sum_[close])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in ``label`` (smallest member as root)."""
    while len(a):
        for _ in range(64):
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)


def gray_order(fp: Column) -> Column:
    """A long that sorts fingerprints (longs) by Gray rank."""
    out = fp
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, shift))
    return out.bitwiseXOR(F.lit(-1 << 63))


def turned(fp: Column, quarters: Column) -> Column:
    """``fp`` with a later quarter of its bits in front."""
    bits = quarters * 16
    return F.when(quarters == 0, fp).otherwise(
        F.call_function("shiftleft", fp, bits).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - bits)))


def _sent(ranged: DataFrame, nodes: list[tuple[int, int, int]]) -> DataFrame:
    """(place, word): the ranges, by the upper part of the index, that each (place, word) is to look into."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_slot("simhash")
        upper = []
        for quarter in range(4):
            own = [n for n in nodes if n[0] % 4 == quarter]
            masks, patterns = (np.array([n[k] for n in own], np.int64).view(np.uint64) for k in (1, 2))
            upper.append((np.array([n[0] for n in own], np.int64), GrayIndex(patterns, masks)))
        for batch in batches:
            place, word = batch.column("place").to_numpy(), batch.column("word").to_numpy()
            for quarter, (places, index) in enumerate(upper):
                mine = place % 4 == quarter
                at, words = place[mine], word[mine].view(np.uint64)
                for query, leaf in index.near(words, FRONT):
                    ahead = places[leaf] >= at[query]
                    yield pa.RecordBatch.from_arrays([pa.array(places[leaf[ahead]]), pa.array(words[query[ahead]].view(np.int64))], names=["place", "word"])

    return ranged.mapInArrow(run, "place bigint, word bigint")


def _forest(left, right):
    """A spanning forest (a, b) of the links between a range and the fingerprints sent to it."""
    import pyarrow as pa

    worker_slot("simhash")
    held, asked = (t.column("word").combine_chunks().to_numpy().view(np.uint64) for t in (left, right))
    if not len(held) or not len(asked):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    held = held[np.argsort(gray_rank(held))]
    # One number for equal fingerprints, whichever side they are on.
    words, number = np.unique(np.concatenate([held, asked]), return_inverse=True)
    label = np.arange(len(words))
    for query, leaf in GrayIndex(held).near(asked, FRONT):
        a, b = number[len(held) + query], number[leaf]
        apart = a != b
        _merge(label, a[apart], b[apart])
    while not np.array_equal(label[label], label):
        label = label[label]
    joined = np.flatnonzero(label != np.arange(len(label)))
    back = np.uint64(16 * (left.column("place")[0].as_py() % 4))
    if back:
        words = (words >> back) | (words << (np.uint64(64) - back))
    signed = words.view(np.int64)
    return pa.table({"a": pa.array(signed[joined]), "b": pa.array(signed[label[joined]])})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what lies within ``NEAR`` bits among the distinct ``fp``."""
    n = 4 * fps.count()
    ranges = max(1, n // max(RANGE_ROWS, n // NODES))
    quarters = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("quarter")
    words = fps.select("fp", quarters).select("quarter", turned(F.col("fp"), F.col("quarter")).alias("word"))
    ordered = words.withColumn("rank", gray_order(F.col("word"))).repartitionByRange(ranges, "quarter", "rank")
    # Numbered in the order of (quarter, rank); a range that holds the end of one order and the beginning of the next is two.
    place = F.spark_partition_id().cast("long") * 4 + F.col("quarter")
    ranged = landed(ordered.select(place.alias("place"), "word"), "simhash-ranges")
    shared = F.bitwise_not(F.bit_and("word").bitwiseXOR(F.bit_or("word")))
    nodes = ranged.groupBy("place").agg(shared.alias("mask"), F.bit_and("word").alias("pattern")).orderBy("place").collect()
    sent = landed(_sent(ranged, [tuple(r) for r in nodes]), "simhash-sent")
    copies = sent.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("copies"))
    asked = sent.join(copies, "place").select("place", F.pmod(F.xxhash64("word"), F.col("copies")).alias("copy"), "word")
    held = ranged.join(copies, "place").select(
        F.col("place").alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("word").alias("word"))
    return held.groupBy("place", "copy").cogroup(asked.groupBy("place", "copy")).applyInArrow(_forest, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); equal roots are connected.

    Rounds of contraction: every vertex goes to the neighbour (or itself) that
    has the smallest hash in this round, which on any graph leaves a constant
    share of the vertices on average.
    """
    edges = landed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    chain: list[DataFrame] = []
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("r"), F.col(c).alias("v"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = landed(best.select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("to")), f"contract-{step}")
        chain.append(to)
        left = edges.join(to.withColumnsRenamed({"v": "a", "to": "ta"}), "a").join(to.withColumnsRenamed({"v": "b", "to": "tb"}), "b")
        edges = landed(left.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"edges-{step}")
        step += 1
    if not chain:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = chain[-1].withColumnRenamed("to", "root")
    for to in reversed(chain[:-1]):
        up = out.withColumnsRenamed({"v": "to"})
        out = landed(to.join(up, "to", "left").select("v", F.coalesce("root", "to").alias("root")), "roots")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tk, fp, component_id): the smallest id that links lead to, its own included."""
    each = landed(fingerprints(docs, id_col), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").select("fp", "component_id")
    return each.join(known, "fp").select(id_col, "tk", "fp", "component_id")


def simhash_query(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints in hexadecimal, with components."""
    found = near_duplicates(docs, id_col)
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows repeating an id and its text are one document and stay or go together,
    and so are rows without an id in a component where none has one.
    """
    found = near_duplicates(docs.select(F.col(id_col).alias("_id"), "text"), "_id")
    kept = found.filter(F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("kept id"), F.col("tk").alias("kept text")).distinct()
    return docs.join(kept, (F.xxhash64("text") == F.col("kept text")) & F.col(id_col).eqNullSafe(F.col("kept id")), "left_semi")
