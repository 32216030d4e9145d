"""BPE encoding and decoding by speculation and verification.

A text is cut into pieces by the vocabulary's splitting pattern, as its own
library does.  For the distinct pieces not met before, greedy longest match
proposes tokens.  Merging is local: a proposal is what merging would give if
and only if merging gives every token from its own bytes and no adjacent pair
of tokens would have merged across its border.  Both are tested with numpy for
all proposals at once; only pieces that fail are merged exactly.

Scale: a map over Arrow batches without a shuffle.  The vocabulary is loaded
once per Python worker and pieces are remembered up to ``MEMORY`` entries.
Texts are encoded whole; the memory needed follows the longest text.

Edge cases: a null text counts as empty and gives no tokens; special tokens in
a text are taken as such, as the library does by default; repeated rows are
encoded alike; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import strings, worker_slot

#: How byte-level vocabularies cut a text (fixed value of the format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers.
MEMORY = 600_000
#: Pieces merged together, and the longest that are.
BLOCK_ROWS, BLOCK_BYTES = 4096, 48
#: Characters of text whose pieces are looked up together.
LOT_CHARS = 1 << 20
#: Larger than any rank.
NEVER = 1 << 40


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + k)
    return letters


class Vocabulary:
    """Tokens as bytes, and the merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_letter = {c: b for b, c in byte_letters().items()}
        model = spec["model"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            if all(c in of_letter for c in token):
                self.bytes_of[i] = bytes(of_letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        special_ids = set(self.special.values())
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in special_ids}
        size = max(self.bytes_of) + 1
        self.rank = np.full(size, -1, np.int64)  # -1: a single byte
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            self.merges[a, b] = (rank, whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        pairs = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pair_keys = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        #: What the merge of a rank makes.
        self.whole_of = np.array([w for _, w in sorted(self.merges.values())], np.int64)
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        #: The longest token by its first two bytes.
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self.sound = np.zeros(size, bool)
        for b, i in self.id_of.items():
            self.sound[i] = len(b) == 1 or self.merged(b) == [i]

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, leftmost among equals."""
        ids = [self.id_of[piece[k:k + 1]] for k in range(len(piece))]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(self.merges[p][0], k, self.merges[p][1], p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, k, whole, pair = heapq.heappop(heap)
            j = after[k]
            if ids[k] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[k], ids[j], after[k] = whole, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.merges:
                    rank, w = self.merges[p]
                    heapq.heappush(heap, (rank, a, w, p))
        return [i for i in ids if i >= 0]

    def merged_lot(self, pieces: list[bytes]) -> list[list[int]]:
        """``merged`` of many pieces: one merge in each of a block of pieces of like length at a time."""
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        out: list[list[int]] = [[]] * len(pieces)
        while order and len(pieces[order[-1]]) > BLOCK_BYTES:
            k = order.pop()
            out[k] = self.merged(pieces[k])
        for at in range(0, len(order), BLOCK_ROWS):
            rows = order[at:at + BLOCK_ROWS]
            sizes = np.array([len(pieces[k]) for k in rows])
            width = int(sizes.max())
            flat = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in rows]), np.uint8).reshape(-1, width)
            ids = self.byte_ids[flat]
            columns = np.arange(width)
            ids[columns >= sizes[:, None]] = -1
            live = np.arange(len(rows))
            own, ranks = ids, self.pair_rank(ids[:, :-1], ids[:, 1:])
            while len(live) and own.shape[1] > 1:
                best = ranks.argmin(axis=1)
                line = np.arange(len(live))
                busy = ranks[line, best] < NEVER
                for k, x in zip(live[~busy].tolist(), own[~busy].tolist()):
                    out[rows[k]] = [i for i in x if i >= 0]
                live, own, ranks, best, line = live[busy], own[busy], ranks[busy], best[busy], line[:int(busy.sum())]
                whole = self.whole_of[ranks[line, best]]
                # The pair becomes one token and what lies behind moves up.
                moved = columns[:own.shape[1] - 1] + (columns[:own.shape[1] - 1] > best[:, None])
                own = np.take_along_axis(own, moved, axis=1)
                own[line, best] = whole
                if own.shape[1] > 1:
                    ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NEVER), moved, axis=1)[:, :-1]
                    left, right = best > 0, best < own.shape[1] - 1
                    ranks[line[left], best[left] - 1] = self.pair_rank(own[line[left], best[left] - 1], own[line[left], best[left]])
                    ranks[line[right], best[right]] = self.pair_rank(own[line[right], best[right]], own[line[right], best[right] + 1])
            for k, x in zip(live.tolist(), own.tolist()):
                out[rows[k]] = [i for i in x if i >= 0]
        return out

    def proposed(self, piece: bytes) -> list[int]:
        """Greedy longest match."""
        ids, k, n, find = [], 0, len(piece), self.id_of.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        while k < n:
            end = min(n, k + self.reach.get(piece[k:k + 2], 1))
            while (i := find(piece[k:end])) is None:
                end -= 1
            ids.append(i)
            k = end
        return ids

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b  # a missing neighbour is -1 and gives a key below all
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together leaves the border between them.

        Going back in time, the later-made of the two tokens is taken apart.
        At each moment the parts touching the border could have merged; they
        would have if that merge comes before the one just taken back.  Of
        equal ranks the left one comes first.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 2 * NEVER)
        while len(live):
            # Doubled ranks: the border's merge is even, a limit from the left
            # token equals it on a tie (the left one came first), one from the right lies above.
            cross = 2 * self.pair_rank(a, b)
            bad = cross < limit
            out[live[bad]] = False
            ranks_a, ranks_b = self.rank[a], self.rank[b]
            done = bad | ((ranks_a < 0) & (ranks_b < 0))
            on_left = ranks_a > ranks_b
            new_a = np.where(on_left, self.right[a], a)
            new_b = np.where(on_left, b, self.left[b])
            limit = np.where(on_left, 2 * ranks_a, 2 * ranks_b + 1)
            a, b, limit, live = new_a[~done], new_b[~done], limit[~done], live[~done]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Proposals for all pieces, verified together; failures merged exactly."""
        ids = [self.proposed(p) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        wrong = np.zeros(len(ids), bool)
        wrong[owner[~self.sound[flat]]] = True
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong[owner[:-1][inner][fails]] = True
        failed = np.flatnonzero(wrong).tolist()
        for k, exact in zip(failed, self.merged_lot([pieces[k] for k in failed])):
            ids[k] = exact
        return ids


class Piece(NamedTuple):
    """What is remembered of a piece: its ids, these as text, and the bytes they stand for."""
    ids: tuple[int, ...]
    text: str
    data: bytes


class Coder:
    """Encodes and decodes texts, remembering pieces."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PIECES)
        self.known: dict[str, Piece] = {}

    def _piece(self, ids: Iterable[int]) -> Piece:
        get = self.vocabulary.bytes_of
        return Piece(tuple(ids), ",".join(map(str, ids)), b"".join([get[i] for i in ids]))

    def _learn(self, fresh: set[str], lot: list[list[str]]) -> None:
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = set().union(*lot)
        found = self.vocabulary.encode_pieces([p.encode() for p in fresh])
        self.known.update(zip(fresh, map(self._piece, found)))
        self.known.update((s, self._piece([i])) for s, i in self.vocabulary.special.items())

    def split(self, text: str) -> list[str]:
        """Pieces of a text; special tokens are pieces of their own."""
        special = self.vocabulary.special_pattern
        if special is None or not special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += self.pattern.findall(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def pieces(self, texts: Iterable[str | None]) -> Iterator[list[Piece]]:
        """The encoded pieces of each text in turn; texts are taken in lots, so that many pieces are learnt at once."""
        lot, size = [], 0
        for text in texts:
            lot.append(self.split(text or ""))
            size += len(text or "")
            if size >= LOT_CHARS:
                yield from self._looked_up(lot)
                lot, size = [], 0
        yield from self._looked_up(lot)

    def _looked_up(self, lot: list[list[str]]) -> Iterator[list[Piece]]:
        fresh = set().union(*lot).difference(self.known)
        if fresh:
            self._learn(fresh, lot)
        find = self.known.__getitem__
        for cut in lot:
            yield list(map(find, cut))

    def encode(self, text: str) -> list[int]:
        return [i for pieces in self.pieces([text]) for p in pieces for i in p.ids]

    def decode(self, ids: Iterable[int]) -> str:
        get = self.vocabulary.bytes_of
        return b"".join([get[i] for i in ids]).decode("utf-8", errors="replace")


def coder(path: str) -> Coder:
    kept = worker_slot("bpe")
    if path not in kept:
        kept[path] = Coder(path)
    return kept[path]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Token ids of each text: (id, ids array<int>)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "ids": [[i for p in pieces for i in p.ids] for pieces in own.pieces(batch["text"])]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Text of each list of token ids: (id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "text": [own.decode(x) for x in batch["ids"]]})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.mapInPandas(run, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Digest of encoding and decoding: token count, hashes of the ids and of the decoded text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = coder(path)
        text_of, data_of = attrgetter("text"), attrgetter("data")
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for pieces in own.pieces(strings(batch.column("text"))):
                ids = ",".join(map(text_of, pieces))
                counts.append(ids.count(",") + 1 if ids else 0)
                encoded.append(hashlib.sha256(ids.encode()).hexdigest())
                # The ids' bytes, piece by piece, then read as UTF-8 as a whole.
                back = b"".join(map(data_of, pieces)).decode("utf-8", errors="replace")
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text")).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
