"""Packing documents into sequences by shortest-pack-first over the length histogram.

A document's token ids and an end token are cut into whole sequences of
``length`` tokens and a rest.  Rests are packed on their histogram: lengths go
longest first, each into the open pack pattern with the most room, and patterns
are counted, not single packs.  The emptiest packs are then taken apart to fill
the gaps of all others, the only place where a rest is cut; what is left at the
end is cut at powers of two, which need no padding.  Patterns are joined back
to documents by their rank among the documents of the same rest.

Scale: the driver sees the histogram only (one number per length below
``length``) and packs it in bundles, so that its patterns stay about as many as
``UNIT_RESTS`` documents have, times the few rounds.  Patterns become a row for
each pack and entry in tasks and meet documents by (rest, rank); nothing that
grows is sent to all.  Ranks come from counts per (length, shard) and a short
window in each shard, so a length that a third of all documents share is ranked
in many tasks.  Texts are encoded once where they lie; checksums and lengths
move, and the texts of documents cut inside their rest, to be encoded again.

Edge cases: a null or empty text is the end token alone; rows with equal ids
(null ids too) are packed each for itself; an empty table gives no rows.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, landed, strings, worker_slot

LENGTH = 4096
END = 2
#: Pieces of text that a worker remembers from lot to lot, about.
MEMORY = 700_000
#: Characters of text whose pieces are looked up together, and pieces that the tokenizer sees at once.
LOT_CHARS, LEARN_ROWS = 1 << 21, 5_000
#: Documents in a shard of the ranking, about, and ranks that one task turns into rows.
SHARD_ROWS, SPAN_ROWS = 50_000, 50_000
#: Rests packed one by one at a time; more of them are packed in equal bundles first.
UNIT_RESTS = 100_000
#: Documents cut inside their rest whose keys are sent to the tasks that read the texts.
CUT_KEYS = 1_000_000
#: Separators and letters on which Python's splitting or lower-casing and the tokenizer's may differ, and special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130", "<|")
#: What else separates words, as ``str.split`` has it.
_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Composed Latin letters, and marks that never take part in a contraction.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[.,;:!?()*#$%&|-]+")
#: Kinds of bytes; letters beyond ASCII have two.
_BLANK, _LETTER, _MARK, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b" \t\n\x0b\x0c\r")] = _BLANK
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KINDS[list(b".,;:!?()*#$%&|-")] = _MARK


def _odd(text: str) -> bool:
    """Whether a text holds any of ``_ODD``; plain searches, as a pattern would look at one character after the other."""
    return any(sign in text for sign in _ODD)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of a lower-cased text in UTF-8."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    follow = data[lead + 1]
    lead = lead[(follow >= 0x9F) & (follow != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    return kinds


def _piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Where the pieces begin: runs of one kind, but a chunk between blanks that holds other signs is one piece."""
    starts = np.flatnonzero(np.diff(kinds, prepend=np.uint8(_BLANK)))
    kind = kinds[starts]
    if (kind == _OTHER).any():
        chunk = np.cumsum(kind == _BLANK)
        whole = np.zeros(int(chunk[-1]) + 1, bool)
        whole[chunk[kind == _OTHER]] = True
        inside = whole[chunk] & (np.r_[_BLANK, kind[:-1]] != _BLANK)
        starts, kind = starts[~inside | (kind == _BLANK)], kind[~inside | (kind == _BLANK)]
    return starts[kind != _BLANK]


class ChunkEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary ignores case and no token spans white space or the border
    of letters and other signs, so a text's ids are those of its pieces in
    turn.  Texts are taken in lots: their pieces are found and numbered as
    arrays, only distinct pieces are looked up, and the tokenizer sees each new
    one.  What is remembered are arrays too; pieces met in one lot only since
    the last time are forgotten when there are too many.
    """

    def __init__(self, path: str):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        #: Whether a token ends a word.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        #: The pieces, how many ids each has, all their ids, and the lots that had the piece.
        self.known = pa.array([], pa.binary())
        self.sizes, self.ids, self.lots = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _encoded_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pieces that are one word to the tokenizer: encoded in one go and parted at the tokens that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(pieces):
            raise ValueError("a piece is not one word of this vocabulary")
        return sizes, ids

    def _learn(self, fresh) -> np.ndarray:
        """Remember distinct pieces that are not known; where each of them is now."""
        import pyarrow as pa

        known, all_sizes, all_ids, order = [self.known], [self.sizes], [self.ids], []
        for at in range(0, len(fresh), LEARN_ROWS):
            texts = [x.decode() for x in fresh.slice(at, LEARN_ROWS).to_pylist()]
            plain = [k for k, x in enumerate(texts) if _PLAIN.fullmatch(x)]
            alone = sorted({*range(len(texts))}.difference(plain))
            if plain:
                sizes, ids = self._encoded_words([texts[k] for k in plain])
                all_sizes.append(sizes)
                all_ids.append(ids)
            other = self._encoded([texts[k] for k in alone])
            all_sizes.append(np.array([len(x) for x in other], np.int64))
            all_ids += other
            known.append(fresh.slice(at, LEARN_ROWS).take(pa.array([*plain, *alone])))
            order += [at + k for k in (*plain, *alone)]
        places = np.empty(len(fresh), np.int64)
        places[order] = len(self.sizes) + np.arange(len(fresh))
        self.known, self.sizes, self.ids = pa.concat_arrays(known), np.concatenate(all_sizes), np.concatenate(all_ids)
        self.lots = np.concatenate([self.lots, np.zeros(len(fresh), np.int32)])
        return places

    def _forget(self) -> None:
        import pyarrow as pa

        kept = self.lots > 1
        if kept.sum() > MEMORY // 2:
            kept[:] = False
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.known, self.sizes = self.known.filter(pa.array(kept)), self.sizes[kept]
        self.lots = np.zeros(len(self.sizes), np.int32)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; texts are taken in lots, so that many pieces are looked up at once."""
        lot: list[str] = []
        size = 0
        for text in texts:
            lot.append(text or "")
            size += len(lot[-1])
            if size >= LOT_CHARS:
                yield from self._looked_up(lot)
                lot, size = [], 0
        yield from self._looked_up(lot)

    def _looked_up(self, lot: list[str]) -> Iterator[bytes]:
        odd = {k: text for k, text in enumerate(lot) if _odd(text)}
        ids, ends = self._ids([b"" if k in odd else self._lowered(text) for k, text in enumerate(lot)])
        for k, (begin, end) in enumerate(zip([0, *ends], ends)):
            yield (self._encoded([odd[k]])[0] if k in odd else ids[begin:end]).tobytes()

    @staticmethod
    def _lowered(text: str) -> bytes:
        text = text.lower()
        if not text.isascii():
            for sign in _BLANKS:
                if sign in text:
                    text = text.replace(sign, " ")
        return text.encode()

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of lower-cased texts one after the other, and where each text's end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        kinds = _kinds(data)
        starts = _piece_starts(kinds)
        filled = np.r_[0, np.cumsum(kinds != _BLANK, dtype=np.int32)]
        places = np.append(filled[starts], filled[-1:])
        pieces = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data[kinds != _BLANK])]).dictionary_encode()
        upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
        del kinds, filled, starts, places
        distinct = pieces.dictionary
        if len(self.known) > MEMORY:
            self._forget()
        # Looking up hashes all that is known, so it is done once a lot.
        found = np.array(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1), np.int64)
        fresh = found < 0
        if fresh.any():
            found[fresh] = self._learn(distinct.filter(pa.array(fresh)))
        self.lots[found] += 1
        sizes = self.sizes[found]
        begins = (np.cumsum(self.sizes) - self.sizes)[found]
        # The ids of the distinct pieces of the lot lie close together.
        near = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(begins - near, sizes) + np.arange(sizes.sum())]
        each = pieces.indices.to_numpy()
        n = sizes[each]
        ends = np.cumsum(n)
        out = ids[np.repeat(near[each] - (ends - n), n) + np.arange(n.sum())]
        return out, np.r_[0, ends][upto].tolist()


def encoder(path: str) -> ChunkEncoder:
    kept = worker_slot("packing")
    if path not in kept:
        kept[path] = ChunkEncoder(path)
    return kept[path]


def measured(docs: DataFrame, path: str, id_col: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, tk, n, crcs): tokens with the end token, and the checksum of each piece cut at ``length``."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, step = encoder(path), 4 * length
        for batch in batches:
            sizes, crcs = [], []
            for data in own.encode_all(strings(batch.column("text"))):
                ids = memoryview(data + last)
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[at:at + step]) for at in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("tk"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=[id_col, "tk", "n", "crcs"])
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.xxhash64("text").alias("tk"), "text")
    return keyed.mapInArrow(run, f"{id_col} {kind}, tk bigint, n bigint, crcs array<bigint>")


def cut_checksums(docs: DataFrame, cuts: DataFrame, path: str, id_col: str = "doc_id", end: int = END) -> DataFrame:
    """``cuts`` (id, tk, start, length, ...) with the checksum of each piece; their documents are encoded again."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(path)
        for batch in batches:
            out = []
            for data, pieces in zip(own.encode_all(strings(batch.column("text"))), batch.column("pieces").to_pylist()):
                ids = memoryview(data + last)
                out.append([p | {"crc": zlib.crc32(ids[4 * p["start"]:4 * (p["start"] + p["length"])])} for p in pieces])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, result)], names=["id", "pieces"])
            give_back()

    import pyarrow as pa

    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    result = pa.list_(pa.struct([pa.field(c, pa.int64()) for c in (*names, "crc")]))
    # Rows that repeat a document share its text: they come together here, a row per cut.
    per_doc = landed(cuts.groupBy(id_col, "tk").agg(F.collect_list(F.struct(*names)).alias("pieces")), "packing-cuts")
    right = per_doc.withColumnsRenamed({id_col: "_id2", "tk": "_tk2"})
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("tk"), "text")
    if per_doc.count() <= CUT_KEYS:
        # Only texts that were cut move; beyond this number of them, all do.
        keyed = keyed.join(F.broadcast(per_doc.select("tk").distinct()), "tk", "left_semi")
    met = keyed.join(right, (F.col("tk") == F.col("_tk2")) & F.col("id").eqNullSafe(F.col("_id2")))
    once = met.groupBy("id", "tk").agg(F.first("text").alias("text"), F.first("pieces").alias("pieces")).select("id", "text", "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c}: bigint" for c in (*names, "crc"))
    made = once.mapInArrow(run, f"id {kind}, pieces array<struct<{fields}>>")
    return made.select(F.col("id").alias(id_col), F.inline("pieces"))


class Packs:
    """``count`` packs alike: pack i holds, of each entry, the document of rank ``rank + i``."""

    def __init__(self, count: int, used: int, entries: list[tuple[int, int, int, int, int]]):
        #: Entries: (rest's length, rank of the first pack's document, start in the rest, tokens, offset in the pack).
        self.count, self.used, self.entries = count, used, entries

    def split(self, m: int) -> Packs:
        """Take the first ``m`` packs off."""
        head = Packs(m, self.used, self.entries)
        self.entries = [(n, rank + m, start, size, at) for n, rank, start, size, at in self.entries]
        self.count -= m
        return head

    def with_piece(self, n: int, rank: int, start: int, size: int) -> Packs:
        return Packs(self.count, self.used + size, [*self.entries, (n, rank, start, size, self.used)])


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[Packs]:
    """Packs for a histogram of lengths: longest first, each into the pack with the most room."""
    by_used: dict[int, list[Packs]] = {}
    for n in sorted(histogram, reverse=True):
        rank, left = 0, histogram[n]
        while left:
            used = min(by_used, default=length)
            if used + n > length:
                by_used.setdefault(n, []).append(Packs(left, n, [(n, rank, 0, n, 0)]))
                break
            packs = by_used[used].pop()
            m = min(packs.count, left)
            taken = packs.split(m) if m < packs.count else packs
            if taken is not packs:
                by_used[used].append(packs)
            if not by_used[used]:
                del by_used[used]
            by_used.setdefault(used + n, []).append(taken.with_piece(n, rank, 0, n))
            rank, left = rank + m, left - m
    return [p for same in by_used.values() for p in same]


def packed_in_bundles(histogram: dict[int, int], length: int = LENGTH, units: int = UNIT_RESTS) -> list[Packs]:
    """``shortest_pack_first`` with a bounded number of patterns, whatever the number of rests.

    More than ``units`` rests are packed as bundles of equally many rests of one
    length, so a pattern counts bundles; what is left over of each length, less
    than a bundle, is packed in smaller bundles, and at last one by one.  Each
    round has about ``units`` bundles or fewer, or one for each length.
    """
    out: list[Packs] = []
    done = dict.fromkeys(histogram, 0)
    left = dict(histogram)
    while left:
        bundle = max(1, sum(left.values()) // units)
        for p in shortest_pack_first({n: k // bundle for n, k in left.items() if k >= bundle}, length):
            p.count *= bundle
            p.entries = [(n, done[n] + rank * bundle, start, size, at) for n, rank, start, size, at in p.entries]
            out.append(p)
        done = {n: done[n] + left.get(n, 0) // bundle * bundle for n in done}
        left = {n: k % bundle for n, k in left.items() if k % bundle}
    return out


def fill_gaps(packs: list[Packs], length: int = LENGTH) -> list[Packs]:
    """Take packs of the commonest patterns apart until no other pack has room; cut the end at powers of two.

    Pieces of many packs alike go into many packs alike: the commonest first on
    both sides, so that a step settles whole patterns and entries stay few.
    """
    packs = sorted(packs, key=lambda p: p.count)
    gap = sum((length - p.used) * p.count for p in packs)
    dissolve, apart = -(-gap // length), []
    while dissolve:
        p = packs.pop()
        m = min(p.count, dissolve)
        taken = p.split(m) if m < p.count else p
        if taken is not p:
            packs.append(p)
        apart += [(-m, k, [n, rank, start, size]) for k, (n, rank, start, size, _) in enumerate(taken.entries, len(apart))]
        dissolve -= m
    out = [p for p in packs if p.used == length]
    order = count(len(apart))
    todo = [(-p.count, next(order), p) for p in packs if p.used < length]
    heapify(apart)
    heapify(todo)
    while todo and apart:
        _, _, p = heappop(todo)
        have, _, (n, rank, start, size) = heappop(apart)
        m = min(p.count, -have)
        if m < -have:
            heappush(apart, (have + m, next(order), [n, rank + m, start, size]))
        taken = p.split(m) if m < p.count else p
        if taken is not p:
            heappush(todo, (-p.count, next(order), p))
        room = length - taken.used
        if size > room:
            heappush(apart, (-m, next(order), [n, rank, start + room, size - room]))
        full = taken.with_piece(n, rank, start, min(size, room))
        if full.used == length:
            out.append(full)
        else:
            heappush(todo, (-full.count, next(order), full))
    loose = [[*piece, -have] for have, _, piece in apart]
    todo = [p for _, _, p in todo]
    # The rest is less than one pack: sequences of powers of two, largest first.
    singles = [(n, rank + i, start, size) for n, rank, start, size, k in loose for i in range(k)]
    left = sum(s[3] for s in singles)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        last = Packs(1, 0, [])
        while room:
            n, rank, start, size = singles.pop()
            if size > room:
                singles.append((n, rank, start + room, size - room))
                size = room
            last = last.with_piece(n, rank, start, size)
            room -= size
        out.append(last)
    return out + todo


def _ranked(rests: DataFrame, shards: int, id_col: str) -> DataFrame:
    """``rests`` with ``rank`` from 0 among the rows of equal ``rest``."""
    shard = F.pmod(F.xxhash64(id_col, "tk"), F.lit(shards))
    rows = rests.withColumn("shard", shard)
    counts = rows.groupBy("rest", "shard").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("rest").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("rest", "shard", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("rest", "shard").orderBy(id_col, "tk")
    return rows.withColumn("at", F.row_number().over(own)).join(before, ["rest", "shard"]).withColumn(
        "rank", F.col("before") + F.col("at") - 1).drop("shard", "at", "before")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """A row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    import pyarrow as pa

    spark = docs.sparkSession
    sized = landed(measured(docs, path, id_col, length, end), "packing-sizes")
    rested = sized.withColumns({"rest": F.col("n") % length, "whole": F.floor(F.col("n") / length)})
    n_docs = sized.count()
    shards = max(1, n_docs // SHARD_ROWS)
    histogram = {r["rest"]: r["k"] for r in rested.filter("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("k")).collect()}
    packs = fill_gaps(packed_in_bundles(histogram, length), length)
    rows, base = [], 0
    for p in packs:
        rows += [(n, rank, rank + p.count, base, start, size, at) for n, rank, start, size, at in p.entries]
        base += p.count
    # As an Arrow table it is read by the driver alone; a list of rows would start further Python workers to unpack it.
    columns = ["rest", "first", "last", "sequence", "start", "size", "offset"]
    patterns = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 7], names=columns))
    # A row for each pack and entry, which meets the document of its rank; long runs are dealt out first.
    runs = patterns.withColumn("from", F.explode(F.sequence("first", F.col("last") - 1, F.lit(SPAN_ROWS).cast("long")))).repartition(
        max(spark.sparkContext.defaultParallelism, n_docs // SHARD_ROWS))
    spans = runs.select("rest", F.explode(F.sequence("from", F.least("last", F.col("from") + SPAN_ROWS) - 1)).alias("rank"),
                        "first", "sequence", "start", "size", "offset")
    ranked = landed(_ranked(rested.filter("rest > 0"), shards, id_col), "packing-ranks")
    met = ranked.withColumnsRenamed({"rest": "_rest", "rank": "_rank"}).join(spans, (F.col("_rest") == F.col("rest")) & (F.col("_rank") == F.col("rank")))
    parts = met.select(id_col, "tk", "n", "rest", "rank", "crcs", F.struct("first", "sequence", "start", "size", "offset").alias("s"))
    parts = parts.select(
        id_col, "tk", F.col("n").alias("doc_tokens"), (F.col("n") - F.col("rest") + F.col("s.start")).alias("start"),
        F.col("s.size").alias("length"), (F.col("s.sequence") + F.col("rank") - F.col("s.first")).alias("sequence_id"),
        F.col("s.offset").alias("offset"), (F.col("s.size") == F.col("rest")).alias("uncut"), F.element_at("crcs", -1).alias("ids_crc32"))
    order = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = cut_checksums(docs, parts.filter(~F.col("uncut")), path, id_col, end).withColumnRenamed("crc", "ids_crc32")
    # Whole sequences are numbered after the packs: by shard, and within it by running count.
    full = rested.filter("whole > 0").withColumn("shard", F.pmod(F.xxhash64(id_col, "tk"), F.lit(shards)))
    per_shard = full.groupBy("shard").agg(F.sum("whole").alias("k"))
    before = per_shard.select("shard", F.coalesce(F.sum("k").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum("whole").over(Window.partitionBy("shard").orderBy(id_col, "tk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = full.withColumn("upto", running).join(before, "shard")
    chunks = numbered.select(
        id_col, F.col("n").alias("doc_tokens"), (F.col("before") + F.col("upto") - F.col("whole") + base).alias("at"),
        F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("k", "ids_crc32"))
    chunks = chunks.select(
        id_col, (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return parts.filter("uncut").select(*order).union(cut.select(*order)).union(chunks.select(*order))
