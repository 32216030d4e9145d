"""Removal of byte strings that repeat from earlier documents, by blockwise suffix sorting.

A byte goes when a ``WINDOW``-byte string covering it also starts in a document
with a smaller id.  Suffixes need sorting by their first ``WINDOW`` bytes only,
and few of them have a partner, so the cover samples are ranked first:

1. Positions in a difference cover modulo ``PERIOD`` are samples.  Any two equal
   windows hold samples at the same distance from their starts, ``KEY`` bytes
   of which lie in both.  Sample keys are sorted bucket by bucket, and each
   document group learns which of its keys another group has too.
2. Suffixes within reach of such a sample are the only ones that can tie.  The
   least hash among the ``ANCHOR``-byte strings of a suffix's window names its
   bucket, so neighbours mostly go to the same one, as one run of bytes.  They
   are sorted bucket by bucket by their window; a bucket knows the smallest
   document of each.
3. Each group marks the bytes and cuts.

Scale: texts move once, into groups of about ``GROUP_BYTES``, and all three
steps read that exchange.  What moves between is packed: less than three bytes
for a sample, and the bytes of each run of suffixes with possible partners, two
or three for a suffix.  Groups are bounded, whatever the number of documents; a
passage shared by all is one run per group, and a bucket is sorted ``LOT``
suffixes at a time.  Copies of a whole text are found by digest first and leave
one representative.  Texts over ``SEGMENT`` bytes are cut into segments that
overlap by a window less a byte, so memory does not follow their length.

Windows are sorted by a hash, and those with the same hash compared byte by
byte.  Whole copies alone rest on hashes (SHA-256; XXH64 among rows of one id).

Edge cases: a null text is empty; rows of one id do not remove from each other;
a null id counts as larger than all others; texts shorter than a window lose
nothing; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import give_back, worker_slot

WINDOW = 50
#: A difference cover: every distance modulo PERIOD lies between two of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
KEY = WINDOW - PERIOD + 1
GROUP_BYTES = 1 << 21
SEGMENT = 1 << 20
#: Sample keys in a bucket, about.
BUCKET_KEYS = 2_000_000
#: Bytes of the strings that name a suffix's bucket.
ANCHOR = 20
#: Groups for each bucket of suffixes, and suffixes sorted at a time.
BUCKET_GROUPS = 4
LOT = 3 << 19
NO_ID = (1 << 63) - 1
#: Powers in a table of the hashes, which workers keep.
BLOCK = 1 << 16

MESSAGE = "dest long, src long, kind int, head binary, body binary"
_MESSAGE = pa.schema([("dest", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
SAMPLES, COPIES, SUFFIXES, MARKS = 0, 1, 2, 3


# ------------------------------------------------------------- packed numbers

@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def packed(sorted_values: np.ndarray) -> bytes:
    """Differences of sorted unsigned numbers, byte plane by byte plane: high planes are mostly zero and compress away."""
    steps = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    return _planes(steps)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(_from_planes(data, dtype), dtype=dtype)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _key_message(dest: int, source: int, keys: np.ndarray) -> tuple:
    """Sorted 32-bit keys for a bucket or a group."""
    return (dest, source, SAMPLES, np.int64(len(keys)).tobytes(), _codec().compress(packed(keys), asbytes=True))


def _message_keys(head: bytes, body: bytes) -> np.ndarray:
    return unpacked(_codec().decompress(body, 4 * int(np.frombuffer(head, np.int64)[0]), asbytes=True), np.uint32)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


# ------------------------------------------------------------- hashes

@lru_cache(maxsize=4)
def _hash_parameters(salt: int) -> tuple[np.ndarray, int, int]:
    """A random number for each byte, an odd base and its inverse modulo 2**64."""
    rng = np.random.default_rng(20_000 + salt)
    table = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    return table, base, pow(base, -1, 1 << 64)


@lru_cache(maxsize=16)
def _powers(base: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base in two small tables: of 0 to BLOCK - 1, and of the multiples of BLOCK."""
    def upto(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return upto(base, BLOCK), upto(pow(base, BLOCK, 1 << 64), blocks)


class Hasher:
    """Hashes of strings of a buffer from running sums."""

    def __init__(self, buffer: np.ndarray, salt: int):
        table, base, self.inverse = _hash_parameters(salt)
        self.blocks = 1 << max(6, (len(buffer) // BLOCK).bit_length())
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        low, high = _powers(base, self.blocks)
        for k in range(0, len(buffer), BLOCK):
            part = self.sums[k + 1:k + 1 + BLOCK]
            np.multiply(table[buffer[k:k + BLOCK]], low[:len(part)], out=part)
            part *= high[k // BLOCK]
        np.cumsum(self.sums, out=self.sums)

    def at(self, places: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        x = self.sums[places + length] - self.sums[places]
        low, high = _powers(self.inverse, self.blocks)
        x *= low[places % BLOCK]
        x *= high[places // BLOCK]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


# ------------------------------------------------------------- document groups

class Group:
    """The segments of a group in one buffer, in an order that does not depend on how rows arrive."""

    def __init__(self, table: pa.Table, copies: set[tuple[int, int]]):
        ids = [NO_ID if i is None else i for i in table.column("id").to_pylist()]
        tks, segs = table.column("tk").to_pylist(), table.column("seg").to_pylist()
        parts = table.column("part")
        rows = sorted(range(len(ids)), key=lambda r: (ids[r], tks[r], segs[r]))
        self.rows = [r for r in rows if (ids[r], tks[r]) not in copies]
        self.copied = [r for r in rows if (ids[r], tks[r]) in copies]
        lengths = table.column("size").to_pylist()
        data = [_codec().decompress(parts[r].as_buffer(), lengths[r], asbytes=True) if lengths[r] else b"" for r in self.rows]
        self.buffer = np.frombuffer(b"".join(data), np.uint8)
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.array([ids[r] for r in self.rows], np.int64)

    @cached_property
    def room(self) -> np.ndarray:
        """Bytes from each place to its segment's end."""
        return np.repeat(self.ends.astype(np.int32), self.sizes) - np.arange(len(self.buffer), dtype=np.int32)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Document ids at places."""
        return self.ids[np.searchsorted(self.ends, places, side="right")]

    def samples(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover samples, and bucket << 32 | 32 bits of the key."""
        size = len(self.buffer)
        grid = (np.arange(0, size, PERIOD)[:, None] + np.array(COVER)).ravel()
        grid = grid[grid < size]
        grid = grid[self.room[grid] >= KEY]
        keys = Hasher(self.buffer, 0).at(grid, KEY)
        return grid, _bucket(keys, n_buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)

    def candidates(self, places: np.ndarray) -> np.ndarray:
        """Window starts within reach of the samples at ``places``."""
        size = len(self.buffer)
        turns = np.zeros(size + 1, np.int32)
        np.add.at(turns, np.maximum(places - PERIOD + 1, 0), 1)
        np.add.at(turns, places + 1, -1)
        return np.flatnonzero((np.cumsum(turns[:-1], dtype=np.int32) > 0) & (self.room >= WINDOW))


def _least_ahead(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each value and the n - 1 behind it."""
    step = 1
    while 2 * step <= n:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:len(values) - (n - step)], values[n - step:])


class Runs:
    """Window starts (ascending) in runs of neighbours that go to one bucket, sorted by bucket; equal runs have one head, of the smallest document."""

    def __init__(self, group: Group, starts: np.ndarray, n_buckets: int):
        # Only the bytes of the windows are hashed.
        first = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
        size = np.diff(np.r_[first, len(starts)])
        spans = size + WINDOW - 1
        buffer = group.buffer[_ranges(starts[first], spans)]
        places = _ranges(np.cumsum(spans) - spans, size)
        hasher = Hasher(buffer, 1)
        names = (hasher.at(np.arange(len(buffer) - ANCHOR + 1), ANCHOR) >> np.uint64(32)).astype(np.uint32)
        least = _least_ahead(names, WINDOW - ANCHOR + 1)[places]
        turn = np.ones(len(starts), bool)
        turn[1:] = least[1:] != least[:-1]
        turn[first] = True
        first = np.flatnonzero(turn)
        size, at = np.diff(np.r_[first, len(starts)]), places[first]
        # Least hashes are small ones: they are spread anew.
        bucket = _bucket(least[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), n_buckets).astype(np.int64)
        owner, key = group.owner(starts[first]), hasher.at(at, size + WINDOW - 1)
        order = np.lexsort((owner, size, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (size[order][1:] != size[order][:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.flatnonzero(~new)
        if len(again):
            spans = size[order[again]] + WINDOW - 1
            other = buffer[_ranges(at[order[again]], spans)] != buffer[_ranges(at[order[head[again]]], spans)]
            other = again[np.logical_or.reduceat(other, np.cumsum(spans) - spans)]
            head[other] = other
        heads = order[head == np.arange(len(order))]
        heads = heads[np.lexsort((at[heads], owner[heads], bucket[heads]))]
        number = np.empty(len(order), np.int64)
        number[heads] = np.arange(len(heads))
        self.starts, self.size, self.owner = starts[first], size, owner
        self.heads, self.bucket, self.head = heads, bucket[heads], np.empty(len(order), np.int64)
        self.head[order] = number[order[head]]
        self.at, self.buffer = at[heads], buffer

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets met, and where each begins among the heads (with the end)."""
        first = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        return self.bucket[first], np.r_[first, len(self.bucket)]

    def messages(self, source: int) -> list[tuple]:
        size, ids = self.size[self.heads], self.owner[self.heads]
        text, ends = self.buffer.tobytes(), (self.at + size + WINDOW - 1).tolist()
        pieces = [text[i:j] for i, j in zip(self.at.tolist(), ends)]
        buckets, cut = self.bounds()
        rows = []
        for b, i, j in zip(buckets.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            body = packed(ids[i:j].view(np.uint64)) + _planes(size[i:j].astype(np.uint32)) + b"".join(pieces[i:j])
            rows.append((b, source, SUFFIXES, np.array([j - i, len(body)], np.int64).tobytes(), _codec().compress(body, asbytes=True)))
        return rows


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE)], schema=_MESSAGE)


def _copies(messages: pa.Table) -> set[tuple[int, int]]:
    kinds, heads = messages.column("kind").to_pylist(), messages.column("head")
    found: set[tuple[int, int]] = set()
    for k, kind in enumerate(kinds):
        if kind == COPIES:
            found.update(map(tuple, np.frombuffer(heads[k].as_py(), np.int64).reshape(-1, 2).tolist()))
    return found


def _copy_message(g: int, copies: set[tuple[int, int]]) -> tuple:
    return (g, g, COPIES, np.array(sorted(copies), np.int64).reshape(-1, 2).tobytes(), b"")


def _g(docs: pa.Table, messages: pa.Table) -> int:
    return (docs.column("g") if docs.num_rows else messages.column("dest"))[0].as_py()


# ------------------------------------------------------------- the three steps

def sample_step(n_buckets: int):
    def run(docs: pa.Table, messages: pa.Table) -> pa.Table:
        worker_slot("suffixes")
        copies, g = _copies(messages), _g(docs, messages)
        _, keys = Group(docs, copies).samples(n_buckets)
        keys = _distinct(keys)
        cut = np.searchsorted(keys >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [_key_message(b, g, low[cut[b]:cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
        # The groups' own notes pass through the bucket step unchanged.
        return _messages([*rows, (-1 - g, *_copy_message(g, copies)[1:])] if copies else rows)

    return run


def shared_samples(messages: pa.Table) -> pa.Table:
    """A bucket's keys that two groups or more have, told to each that has them."""
    sources, kinds = messages.column("src").to_pylist(), messages.column("kind").to_pylist()
    dest, heads, bodies = messages.column("dest")[0].as_py(), messages.column("head").to_pylist(), messages.column("body").to_pylist()
    out = [(-1 - dest, s, k, h, b) for s, k, h, b in zip(sources, kinds, heads, bodies) if k != SAMPLES]
    sets = [(s, _message_keys(h, b)) for s, k, h, b in zip(sources, kinds, heads, bodies) if k == SAMPLES]
    if len(sets) > 1:
        merged = np.sort(np.concatenate([x for _, x in sets]))
        shared = _distinct(merged[1:][merged[1:] == merged[:-1]])
        for source, own in sets:
            if len(hit := own[_among(own, shared)]):
                out.append(_key_message(source, dest, hit))
    return _messages(out)


def suffix_step(n_sample_buckets: int, n_buckets: int):
    def run(docs: pa.Table, messages: pa.Table) -> pa.Table:
        worker_slot("suffixes")
        copies, g = _copies(messages), _g(docs, messages)
        group = Group(docs, copies)
        places, keys = group.samples(n_sample_buckets)
        # Keys that two documents of this group have.
        ordered = np.sort(keys)
        twice = np.flatnonzero(_among(keys, _distinct(ordered[1:][ordered[1:] == ordered[:-1]])))
        twice = twice[np.argsort(keys[twice])]
        own, owner = keys[twice], group.owner(places[twice])
        mixed = own[1:][(own[1:] == own[:-1]) & (owner[1:] != owner[:-1])]
        told = [_message_keys(h, b).astype(np.uint64) | np.uint64(s << 32) for s, k, h, b in zip(
            *(messages.column(c).to_pylist() for c in ("src", "kind", "head", "body"))) if k == SAMPLES]
        hot = _among(keys, _distinct(np.concatenate([mixed, *told])))
        starts = group.candidates(places[hot])
        rows = []
        if len(starts):
            rows = Runs(group, starts, n_buckets).messages(g)
            first = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
            runs = np.stack([starts[first], np.diff(np.r_[first, len(starts)])])
            rows.append((-1 - g, g, MARKS, b"", runs.astype(np.int64).tobytes()))
        if copies:
            rows.append((-1 - g, *_copy_message(g, copies)[1:]))
        return _messages(rows)

    return run


def _sorted_windows(text: np.ndarray, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at ``places`` that puts equal ones together, and where in it another begins."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    keys = keys[order]
    new[1:] = keys[1:] != keys[:-1]
    again = np.flatnonzero(~new)
    p, q = places[order[again]], places[order[np.flatnonzero(new)[np.cumsum(new)[again] - 1]]]
    strings = np.ndarray(len(text) - WINDOW + 1, f"V{WINDOW}", text, strides=(1,))
    if any(strings[p[k:k + BLOCK]].tobytes() != strings[q[k:k + BLOCK]].tobytes() for k in range(0, len(p), BLOCK)):
        words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
        columns = [words[places + k] for k in (*range(0, WINDOW - 8, 8), WINDOW - 8)]
        order = np.lexsort(columns)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, new


def _late(text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of runs of ``size`` windows each, one after another in ``text``: which windows a document before their own has too."""
    begin = np.r_[0, np.cumsum(size)]
    late = np.zeros(begin[-1], bool)
    lots = 1 + len(late) // LOT
    # About LOT windows are hashed at a time, and those of one lot kept.
    cuts = np.unique(np.r_[np.searchsorted(begin, np.arange(0, len(late), LOT)), len(size)])
    for lot in range(lots):
        found = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            run = np.repeat(np.arange(i, j), size[i:j])
            windows = np.arange(begin[i], begin[j])
            places, origin = windows + (WINDOW - 1) * run, begin[i] + (WINDOW - 1) * i
            keys = Hasher(text[origin:begin[j] + (WINDOW - 1) * j], 1).at(places - origin, WINDOW)
            mine = keys % np.uint64(lots) == lot if lots > 1 else slice(None)
            found.append((windows[mine], places[mine], ids[run[mine]], keys[mine]))
        windows, places, owner, keys = (np.concatenate(x) for x in zip(*found))
        del found
        if not len(windows):
            continue
        order, new = _sorted_windows(text, places, keys)
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        late[windows[order]] = owner[order] > least[np.cumsum(new) - 1]
    return late


def earliest_suffixes(messages: pa.Table) -> pa.Table:
    """Sort one bucket of suffixes; tell each group which of its windows a document before its own first has."""
    worker_slot("suffixes")
    sources, kinds = messages.column("src").to_pylist(), messages.column("kind").to_pylist()
    dest, heads, bodies = messages.column("dest")[0].as_py(), messages.column("head").to_pylist(), messages.column("body")
    out = [(-1 - dest, s, k, h, bodies[r].as_py()) for r, (s, k, h) in enumerate(zip(sources, kinds, heads)) if k != SUFFIXES]
    runs, texts = [], []
    for r, (s, k, head) in enumerate(zip(sources, kinds, heads)):
        if k == SUFFIXES:
            n, length = np.frombuffer(head, np.int64).tolist()
            body = _codec().decompress(bodies[r].as_buffer(), length, asbytes=True)
            runs.append((s, unpacked(body[:8 * n], np.uint64).view(np.int64), _from_planes(body[8 * n:12 * n], np.uint32).astype(np.int64)))
            texts.append(body[12 * n:])
    if runs:
        text = np.frombuffer(b"".join(texts), np.uint8)
        texts.clear()
        late = _late(text, np.concatenate([x[2] for x in runs]), np.concatenate([x[1] for x in runs]))
        at = 0
        for s, _, size in runs:
            mine = late[at:at + size.sum()]
            at += len(mine)
            if mine.any():
                out.append((s, dest, SUFFIXES, b"", np.packbits(mine).tobytes()))
    return _messages(out)


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def cut_step(n_buckets: int, keep: pa.Schema, with_text: bool):
    """Rows (columns of ``keep``, n_bytes, n_removed, n_spans, kept_sha256, text, tk, spans) of whole texts; segments give spans."""
    def run(docs: pa.Table, messages: pa.Table) -> pa.Table:
        worker_slot("suffixes")
        copies = _copies(messages)
        group = Group(docs, copies)
        kinds, sources, bodies = (messages.column(c).to_pylist() for c in ("kind", "src", "body"))
        covered = np.zeros(len(group.buffer) + 1, np.int32)
        for kind, body in zip(kinds, bodies):
            if kind != MARKS:
                continue
            first, size = np.frombuffer(body, np.int64).reshape(2, -1)
            found = Runs(group, _ranges(first, size), n_buckets)
            end = np.r_[0, np.cumsum(found.size[found.heads])]
            late = np.zeros(end[-1], bool)
            buckets, cut = found.bounds()
            place = {b: (i, j) for b, i, j in zip(buckets.tolist(), end[cut[:-1]].tolist(), end[cut[1:]].tolist())}
            for k, s, bits in zip(kinds, sources, bodies):
                if k == SUFFIXES:
                    i, j = place[s]
                    late[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
            gone = late[_ranges(end[found.head], found.size)] | np.repeat(found.owner > found.owner[found.heads][found.head], found.size)
            gone = _ranges(found.starts, found.size)[gone]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + WINDOW, -1)
        covered = np.cumsum(covered[:-1], dtype=np.int32) > 0
        sizes = docs.column("n").to_pylist()
        empty = hashlib.sha256(b"").hexdigest()
        rows, out = [], {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "part_of", "span_from", "span_to")}

        def add(r: int, n: int, removed: int, spans: int, digest: str | None, text: str | None, seg: int | None, a: list, b: list) -> None:
            rows.append(r)
            for c, v in zip(out, (n, removed, spans, digest, text, seg, a, b)):
                out[c].append(v)

        for r in group.copied:
            n = sizes[r]
            # A copy's windows all start in its original; below a window's size it has none.
            whole = n >= WINDOW
            data = b"" if whole or not n else _codec().decompress(docs.column("part")[r].as_buffer(), n, asbytes=True)
            if docs.column("seg")[r].as_py() == 0:
                add(r, n, n if whole else 0, int(whole), hashlib.sha256(data).hexdigest(),
                    data.decode("utf-8", "ignore") if with_text else None, None, [], [])
        end = 0
        for r, size in zip(group.rows, group.sizes.tolist()):
            begin, end = end, end + size
            own = covered[begin:end]
            a, b = _runs(own)
            n = sizes[r]
            if n > SEGMENT + WINDOW - 1:
                at = docs.column("seg")[r].as_py() * SEGMENT
                add(r, n, 0, 0, None, None, docs.column("seg")[r].as_py(), (a + at).tolist(), (b + at).tolist())
                continue
            left = group.buffer[begin:end][~own].tobytes()
            add(r, n, int(own.sum()), len(a), hashlib.sha256(left).hexdigest() if left else empty,
                left.decode("utf-8", "ignore") if with_text else None, None, [], [])
        kept = docs.take(pa.array(rows, pa.int64())).select(keep.names)
        fields = [pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
                  pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["part_of"], pa.int64()),
                  pa.array(out["span_from"], pa.list_(pa.int64())), pa.array(out["span_to"], pa.list_(pa.int64()))]
        return pa.table([*kept.columns, *fields], names=[*keep.names, *["_" + c for c in out]])

    return run


_RESULT = ("_n_bytes bigint, _n_removed bigint, _n_spans bigint, _kept_sha256 string, _text string, _part_of bigint, "
           "_span_from array<bigint>, _span_to array<bigint>")


def _finish_long(pieces: DataFrame, docs: DataFrame, with_text: bool) -> DataFrame:
    """Assemble texts that were searched in segments."""
    spans = pieces.groupBy("id", "tk").agg(F.flatten(F.collect_list(F.arrays_zip("_span_from", "_span_to"))).alias("spans"))
    right = spans.withColumnsRenamed({"id": "_id2", "tk": "_tk2"})
    met = docs.join(right, (F.col("tk") == F.col("_tk2")) & F.col("id").eqNullSafe(F.col("_id2"))).drop("_id2", "_tk2")

    def run(batches):
        for batch in batches:
            results = []
            for data, cuts in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                covered = np.zeros(len(data), bool)
                for c in cuts:
                    covered[c["_span_from"]:c["_span_to"]] = True
                left = np.frombuffer(data, np.uint8)[~covered].tobytes()
                results.append((len(data), int(covered.sum()), len(_runs(covered)[0]), hashlib.sha256(left).hexdigest(),
                                left.decode("utf-8", "ignore") if with_text else None))
            n, gone, runs, digest, text = zip(*results) if results else [[]] * 5
            names = [c for c in batch.schema.names if c not in ("data", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(text, pa.string())],
                names=[*names, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name not in ("data", "spans"))
    return met.mapInArrow(run, f"{fields}, _n_bytes bigint, _n_removed bigint, _n_spans bigint, _kept_sha256 string, _text string")


def _squeeze(batches):
    """Compress the texts before they move; their sizes go along."""
    for batch in batches:
        at = batch.schema.get_field_index("part")
        parts = batch.column(at)
        sizes = pa.array([len(x) for x in parts.to_pylist()], pa.int64())
        small = pa.array([_codec().compress(x.as_buffer(), asbytes=True) if n else b"" for x, n in zip(parts, sizes.to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*[small if k == at else c for k, c in enumerate(batch.columns)], sizes],
                                         names=[*batch.schema.names, "size"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: id, tk, ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the text that is left."""
    from pyspark.sql.pandas.types import to_arrow_schema

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("tk"),
                        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
                        *[F.col(c).alias(f"c_{c}") for c in carry])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = int(max(1, -(-total // GROUP_BYTES)))
    n_sample_buckets = int(max(1, total * len(COVER) // PERIOD // BUCKET_KEYS))
    # Whole copies of an earlier text: all their windows start there too.
    digests = named.select("id", "tk", F.sha2("data", 256).alias("digest"), F.octet_length("data").alias("n"))
    order = F.coalesce("id", F.lit(NO_ID))
    least = digests.groupBy("digest").agg(F.min(order).alias("least"))
    segments = F.greatest(F.lit(1), F.ceil((F.col("n") - WINDOW + 1) / SEGMENT)).cast("int")
    group = F.pmod(F.xxhash64("id", "tk", "seg"), F.lit(n_groups))
    copied = digests.join(least, "digest").filter(order > F.col("least")).select(
        order.alias("id0"), "id", "tk", F.explode(F.sequence(F.lit(0), segments - 1)).alias("seg"))
    pair = F.struct(F.col("id0"), F.col("tk"))
    pairs = copied.select(group.alias("dest"), pair.alias("p")).groupBy("dest").agg(F.collect_set("p").alias("ps"))

    def note(batches):
        for batch in batches:
            heads = [np.array([(p["id0"], p["tk"]) for p in ps], np.int64).tobytes() for ps in batch.column("ps").to_pylist()]
            dest = batch.column("dest")
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([dest, dest, pa.array([COPIES] * n, pa.int32()), pa.array(heads, pa.binary()),
                                              pa.array([b""] * n, pa.binary())], schema=_MESSAGE)

    copies = pairs.mapInArrow(note, MESSAGE)
    cut = named.select("*", F.octet_length("data").cast("long").alias("n"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), segments - 1)).alias("seg"))
    plain = cut.select(group.alias("g"), "id", "tk", "seg", "n", *[f"c_{c}" for c in carry],
                       F.substring("data", F.col("seg") * SEGMENT + 1, F.lit(SEGMENT + WINDOW - 1)).alias("part"))
    parts = plain.mapInArrow(_squeeze, StructType([*plain.schema.fields, StructField("size", LongType())]))
    n_buckets = -(-n_groups // BUCKET_GROUPS)

    def step(messages: DataFrame, fn, schema: str) -> DataFrame:
        def run(docs: pa.Table, messages: pa.Table) -> pa.Table:
            out = fn(docs, messages)
            give_back()
            return out

        return parts.groupBy("g").cogroup(messages.groupBy("dest")).applyInArrow(run, schema)

    def bucket_step(messages: DataFrame, fn) -> DataFrame:
        def run(messages: pa.Table) -> pa.Table:
            out = fn(messages)
            give_back()
            return out

        return messages.groupBy("dest").applyInArrow(run, MESSAGE)

    sampled = bucket_step(step(copies, sample_step(n_sample_buckets), MESSAGE), shared_samples)
    suffixes = bucket_step(step(sampled, suffix_step(n_sample_buckets, n_buckets), MESSAGE), earliest_suffixes)
    kept = parts.select("id", "tk", *[f"c_{c}" for c in carry])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    made = step(suffixes, cut_step(n_buckets, to_arrow_schema(kept.schema), with_text), f"{schema}, {_RESULT}")
    columns = ["id", "tk", *[f"c_{c}" for c in carry], "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_text"]
    whole = made.filter(F.col("_part_of").isNull()).select(*columns)
    longer = named.filter(F.octet_length("data") > SEGMENT + WINDOW - 1)
    if longer.isEmpty():
        return whole
    return whole.union(_finish_long(made.filter(F.col("_part_of").isNotNull()), longer, with_text).select(*columns))


def suffix_query(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    found = suffix_dedup(docs, id_col)
    return found.select(F.col("id").alias(id_col), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                        F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character cut in half goes, a null text becomes empty."""
    carry = tuple(c for c in docs.columns if c != "text")
    found = suffix_dedup(docs, id_col, carry, with_text=True)
    return found.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"c_{c}").alias(c) for c in docs.columns])
