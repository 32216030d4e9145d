"""Exact top-k inner-product search with KD-trees per shard.

Vectors become integers (floor(256 x)).  A shard holds about ``shard_rows``
vectors, or a ``SHARDS``-th of all if that is more: shards are the leaves of a
tree of median splits fitted on a bounded sample, and each leaf that gets more
rows is divided by hash, by its own count.  Each shard builds a KD-tree with
median splits on the widest side and tight bounding boxes.  A query visits boxes
best first, by the highest inner product a box allows, and stops at the first
box that cannot reach its kth score.

A query starts in the shard it belongs to.  The kth score found there drops all
shards whose root box cannot reach it before anything moves.  Of the others the
most promising are asked first (``FIRST``), and only what their kth score leaves
over is asked then.

Ties go to smaller ids, so a box that can only equal the kth score is visited.

Scale: shards and queries stream through the tasks: a task holds one shard and
one batch of queries.  All tasks get the root boxes, two vectors for each of at
most about ``2 * SHARDS`` shards.  Of equal vectors only the ``k + 1`` smallest ids are
kept, formed before the shuffle, and equal queries are asked once; so a vector
that a third of all rows share stays a handful of rows.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part, neither do rows with a null id; vectors of another length than
the first query's are compared on shards of their own length only; fewer than k
other vectors give fewer rows; repeated rows (same id and vector) are one.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import landed

K = 5
#: Rows of a shard, about, unless that makes more than so many shards.
SHARD_ROWS, SHARDS = 4096, 10_000
#: Shards that a query asks before all others, besides its own.
FIRST = 8
#: Rows that the split planes of the shards are fitted on, at most.
SAMPLE_ROWS = 8192
LEAF_ROWS = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.filter(sound).select(
        F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.floor(256 * e.cast("double")).cast("long")).alias("v"))


def fit_splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, median) of each inner node of a complete tree, in heap order."""
    splits: list[tuple[int, float]] = [(0, 0.0)] * (2 ** depth - 1)
    stack = [(0, np.arange(len(sample)))]
    while stack:
        node, rows = stack.pop()
        if node >= len(splits):
            continue
        if len(rows):
            spread = np.ptp(sample[rows], axis=0)
            dim = int(spread.argmax())
            cut = float(np.median(sample[rows, dim]))
            splits[node] = (dim, cut)
            below = sample[rows, dim] <= cut
            stack += [(2 * node + 1, rows[below]), (2 * node + 2, rows[~below])]
    return splits


def _leaf_of(v: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """Leaf of each row of ``v``."""
    node = np.zeros(len(v), np.int64)
    if not splits:
        return node
    dims, cuts = np.array([d for d, _ in splits]), np.array([c for _, c in splits])
    for _ in range(int(np.log2(len(splits) + 1))):
        dim = np.minimum(dims[node], v.shape[1] - 1)
        node = 2 * node + 1 + (v[np.arange(len(v)), dim] > cuts[node])
    return node - len(splits)


class KdTree:
    """A KD-tree over rows sorted so that every node is a run of them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.arange(len(v))
        self.first, self.last, self.kids = [0], [len(v)], [None]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= LEAF_ROWS:
                continue
            part = v[order[a:b]]
            dim = int(np.ptp(part, axis=0).argmax())
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, dim], half)]
            self.kids[node] = (len(self.first), len(self.first) + 1)
            self.first += [a, a + half]
            self.last += [a + half, b]
            self.kids += [None, None]
            todo += self.kids[node]
        self.ids, self.v = ids[order], v[order]
        self.low = np.array([self.v[a:b].min(axis=0) for a, b in zip(self.first, self.last)])
        self.high = np.array([self.v[a:b].max(axis=0) for a, b in zip(self.first, self.last)])

    def search(self, q: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id) that reach ``floor``: highest score, then smallest id."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[tuple[float, int]] = []  # heap of (score, -id), worst first
        bound = float(self.high[0] @ up + self.low[0] @ down)
        heap = [(-bound, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    reach = float(self.high[kid] @ up + self.low[kid] @ down)
                    if reach >= floor:
                        heapq.heappush(heap, (-reach, kid))
                continue
            a, b = self.first[node], self.last[node]
            scores = self.v[a:b] @ q
            for at in np.flatnonzero(scores >= floor):
                entry = (float(scores[at]), -int(self.ids[a + at]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in best]


_FOUND = "qkey bigint, score double, vec_id bigint"


def _search_shards(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (shard, kind, id, v, floor): vectors (kind 0) come before the shard's queries (kind 1)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            found = []
            columns = zip(batch["shard"], batch["kind"], batch["id"], batch["v"], batch["floor"])
            for own, kind, i, v, floor in columns:
                if own != shard:
                    shard, ids, vectors, tree = own, [], [], None
                if kind == 0:
                    ids.append(i)
                    vectors.append(v)
                    continue
                if tree is None:
                    if not ids:
                        continue
                    tree = KdTree(np.array(ids, np.int64), np.stack(vectors).astype(np.float64))
                    ids, vectors = [None], []
                found += [(i, s, j) for s, j in tree.search(np.asarray(v, np.float64), k, floor)]
            if found:
                yield pd.DataFrame(found, columns=["qkey", "score", "vec_id"])

    placed = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    return placed.mapInPandas(run, _FOUND)


def _root_boxes(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each vector length: shards, and the lowest and highest components in each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for (shard, d), part in batch.groupby(["shard", "d"], sort=False):
                v = np.stack(part["v"].to_list())
                found.append((shard, d, v.min(axis=0), v.max(axis=0)))
            yield pd.DataFrame(found, columns=["shard", "d", "low", "high"])

    # A shard lies in one task and in few batches, so there is about one row for each.
    together = shards.select("shard", "d", "v").repartition("shard").sortWithinPartitions("shard")
    boxes: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for r in together.mapInPandas(run, "shard bigint, d int, low array<bigint>, high array<bigint>").toLocalIterator():
        low, high = np.array(r["low"], float), np.array(r["high"], float)
        of_length = boxes.setdefault(r["d"], {})
        if r["shard"] in of_length:
            low, high = np.minimum(low, of_length[r["shard"]][0]), np.maximum(high, of_length[r["shard"]][1])
        of_length[r["shard"]] = (low, high)
    return {d: (np.array(list(b), np.int64), np.stack([x for x, _ in b.values()]), np.stack([y for _, y in b.values()])) for d, b in boxes.items()}


def _sent(queries: DataFrame, boxes: dict, first: int, last: int | None) -> DataFrame:
    """(shard, qkey, v, floor): ``queries`` (qkey, v, d, home, floor) for their shards from place ``first`` to ``last``, best box
    first, of those whose box reaches the floor; the home shard is none of them."""
    sent = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                found = []
                for key, v, d, home, floor in batch.iloc[at:at + 64][["qkey", "v", "d", "home", "floor"]].itertuples(index=False):
                    if d not in sent.value:
                        continue
                    shards, low, high = sent.value[d]
                    q = np.asarray(v, np.float64)
                    reach = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                    order = np.argsort(-reach, kind="stable")
                    order = order[shards[order] != home][first:last]
                    found += [(s, key, v, floor) for s in shards[order[reach[order] >= floor]]]
                if found:
                    yield pd.DataFrame(found, columns=["shard", "qkey", "v", "floor"])

    return queries.select("qkey", "v", "d", "home", "floor").mapInPandas(run, "shard bigint, qkey bigint, v array<bigint>, floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors."""
    base = quantised(vectors, id_col, vector_col)
    # Of equal vectors the k + 1 smallest ids can be among the k best besides the query's own.
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = base.withColumn("at", F.dense_rank().over(same)).filter(F.col("at") <= k + 1).dropDuplicates(["v", "vec_id"])
    rows = landed(distinct.select("vec_id", "v", F.size("v").alias("d")), "vectors")
    asked = quantised(queries, id_col, vector_col)
    n = rows.count()
    shard_rows = max(shard_rows, n // SHARDS)
    depth = int(np.ceil(np.log2(max(1, min(n / shard_rows, SAMPLE_ROWS / 8)))))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v").collect()]
    width = max(map(len, sample), default=1)
    splits = fit_splits(np.array([v for v in sample if len(v) == width], np.float64).reshape(-1, width), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf = np.zeros(len(batch), np.int64)
            for d in batch["d"].unique():
                own = (batch["d"] == d).to_numpy()
                leaf[own] = _leaf_of(np.stack(batch["v"][own].to_list()), splits)
            yield batch.assign(leaf=leaf)

    def placed(df: DataFrame) -> DataFrame:
        return df.mapInPandas(place, "vec_id bigint, v array<bigint>, d int, leaf bigint")

    leaved = landed(placed(rows), "leaves")
    parts = leaved.groupBy("d", "leaf").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))

    def sharded(df: DataFrame) -> DataFrame:
        """With the shard: the leaf, and a part of it that the id decides."""
        part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1).cast("long")))
        return df.join(parts, ["d", "leaf"], "left").select("vec_id", "v", "d", F.xxhash64("d", "leaf", part).alias("shard"))

    shards = landed(sharded(leaved), "shards")
    boxes = _root_boxes(shards)
    # Equal queries are asked once, under the hash of their vector and the vector itself.
    distinct_q = asked.select("v").distinct().select(F.xxhash64("v").alias("vec_id"), "v", F.size("v").alias("d"))
    tree_rows = shards.select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(float("-inf")).alias("floor"))
    homed = landed(sharded(placed(distinct_q)).select(F.col("vec_id").alias("qkey"), "v", "d", F.col("shard").alias("home")), "homed")

    def hits(queries: DataFrame, label: str) -> DataFrame:
        rows_ = queries.select("shard", F.lit(1).alias("kind"), F.col("qkey").alias("id"), "v", "floor")
        return landed(_search_shards(tree_rows.join(queries.select("shard").distinct(), "shard", "left_semi").union(rows_), k + 1), label)

    def with_floor(found: DataFrame) -> DataFrame:
        """The queries with their kth best score so far."""
        kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k))
        floors = found.groupBy("qkey").agg(kth.alias("kth"))
        return homed.join(floors, "qkey", "left").select("qkey", "v", "d", "home", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))

    near = hits(homed.select("qkey", "v", F.col("home").alias("shard"), F.lit(float("-inf")).alias("floor")), "home-hits")
    ahead = hits(landed(_sent(with_floor(near), boxes, 0, FIRST), "first-asked"), "first-hits")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    so_far = near.union(ahead).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).drop("at")
    far = hits(landed(_sent(with_floor(so_far), boxes, FIRST, None), "then-asked"), "then-hits")
    found = so_far.union(far)
    top = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    lists = top.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("hits"))
    per_query = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qkey")).distinct().join(lists, "qkey")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return per_query.select("query_id", F.posexplode(own).alias("pos", "h")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "h.vec_id", F.col("h.score").cast("long").alias("score"))
