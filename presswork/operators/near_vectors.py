"""Pairs of embeddings above a cosine threshold, over all earlier rows, exactly.

Unit vectors with a cosine above t are closer than ``r = sqrt(2 - 2t)``.  Each
vector lives in the cell of its nearest pivot.  A vector looks into another cell
only if its distance to the plane between the two pivots is at most r: beyond
it, all of that cell is too far.  Inside a cell, vectors lie in rings by their
distance to the pivot, and rings further apart than r do not meet either (a
projection on one line can only shorten a distance).  What meets is compared by
matrix products, so the result is exact whatever the pivots are; they decide the
work only.  Vectors in groups (topics, near copies) meet few cells; vectors
spread evenly in many dimensions meet most, and no exact bound can help there.

Neighbouring rings and cells share a bin of about ``BLOCK`` rows, and a vector
is sent once to each bin it looks into, however many cells of it: what is moved
grows with the number of bins, not of cells.  A group (``group``) that fits one
block is one bin.

The pivots are at most ``PIVOTS`` vectors and are sent to all tasks, as are the
bins of the rings.  A hot bin is dealt out in blocks; a task holds two blocks.
Rows without a vector, with a NULL or non-finite component, of length zero or of
another dimension than most match nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from ..functions.fixed_values import SIMILARITY_THRESHOLD
from ..session import durable
from .vectors import _dot, unit

#: Rows of a block at most; of one whose pairs leave the task; numbers of a block at most; rows of a matrix product.
PIVOTS, BLOCK, PAIR_BLOCK, NUMBERS, TILE = 128, 65_536, 8_192, 4_194_304, 2_048
#: Small tables are still cut, so that several tasks have work.
LEAST, PARTS = 4_096, 4
#: Rings of a cell at most; wider ones than the reach are right, too.
RINGS = 64
#: Rows that ``keep_order`` should pair first, and pairs that it may hold: what is kept then removes most others unpaired.
BATCH_ROWS, PAIR_BUDGET = 20_000, 5_000_000
#: Room for rounding in the bounds; candidates are compared exactly.
SLACK = 1e-6


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _units(data):
    """The unit vectors of an Arrow table or batch with ``v`` and ``norm``, as doubles."""
    import numpy as np

    v, norm = data.column("v"), data.column("norm").to_numpy()[:, None]
    v = v.combine_chunks() if hasattr(v, "combine_chunks") else v
    u = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(data.num_rows, -1)
    return np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)


class _Cells:
    """Cell and ring of unit vectors, and the rings of other cells that may hold a match."""

    def __init__(self, pivots: list[list[float]], reach: float):
        import numpy as np

        self.p, self.reach, self.width = np.array(pivots, float), reach, max(reach, 2 / (RINGS - 1))
        self.apart = np.sqrt(np.maximum(2 - 2 * self.p @ self.p.T, 0))
        np.fill_diagonal(self.apart, 1)

    def home(self, u):
        """(products with the pivots, distances to them, own cell, own ring)"""
        import numpy as np

        dots = u @ self.p.T
        far, cell = np.sqrt(np.maximum(2 - 2 * dots, 0)), dots.argmax(axis=1)
        return dots, far, cell, self._ring(far[np.arange(len(u)), cell])

    def _ring(self, far):
        import numpy as np

        return np.clip(np.floor(far / self.width), 0, RINGS - 1).astype(int)

    def bins(self, u, bin_of):
        """Own bin, and for every bin whether it may hold a match; ``bin_of[cell, ring]`` grows with the ring."""
        import numpy as np

        dots, far, cell, ring = self.home(u)
        lead = dots[np.arange(len(u)), cell][:, None] - dots
        near = lead <= (self.reach + 1e-9) * self.apart[cell] + 1e-9
        # A vector of another cell within reach is as far from that cell's pivot, give or take the reach.
        first, last = self._ring(far - self.reach), self._ring(far + self.reach)
        steps = np.zeros((len(u), bin_of.max() + 2), int)
        for c in range(len(self.p)):
            i = np.flatnonzero(near[:, c])
            steps[i, bin_of[c, first[i, c]]] += 1
            steps[i, bin_of[c, last[i, c]] + 1] -= 1
        return bin_of[cell, ring], steps.cumsum(axis=1)[:, :-1] > 0


def _tiles(left, right, threshold: float) -> Iterator:
    """(ord, early_ord, similarity) arrays of the pairs above the threshold, in pieces by rising ``ord``.

    Products of single precision find what may be above; those pairs are multiplied out anew in double precision.
    """
    import numpy as np

    if not left.num_rows or not right.num_rows:
        return
    left, right = left.sort_by("ord"), right.sort_by("ord")
    a, b = left.column("ord").to_numpy(), right.column("ord").to_numpy()
    u, v = _units(left), _units(right)
    u32, v32 = u.astype("float32"), v.astype("float32")
    low = threshold - 4e-7 * (u.shape[1] + 4)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            # Sorted sides: from here on there are later rows only.
            if b[j] >= a[min(i + TILE, len(a)) - 1]:
                break
            at, to = np.nonzero(u32[i:i + TILE] @ v32[j:j + TILE].T > low)
            for k in range(0, len(at), 65_536):
                x, y = at[k:k + 65_536] + i, to[k:k + 65_536] + j
                x, y = x[a[x] > b[y]], y[a[x] > b[y]]
                found = np.einsum("ij,ij->i", u[x], v[y])
                hit = found > threshold
                yield a[x[hit]], b[y[hit]], found[hit]


class CosineSimilar:
    """A ``similar`` for :func:`presswork.operators.dedupe.dedupe`: built once over all rows, called with two sides."""

    def __init__(self, df: DataFrame, order: str, vector: str, group: str | None = None,
                 threshold: float = SIMILARITY_THRESHOLD, pivots: int = PIVOTS, block: int = BLOCK):
        self.threshold = threshold
        self.reach = max(0.0, 2 - 2 * threshold) ** 0.5 + SLACK
        grp = F.col(group).cast("string") if group else F.lit("")
        rows = df.filter(usable(vector)).select(F.col(order).alias("ord"), grp.alias("grp"), F.col(vector).alias("v"))
        sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(1).collect()
        self.size, n = (sizes[0]["n"], sizes[0]["k"]) if sizes else (0, 0)
        self.block = max(1, min(block, max(LEAST, -(-n // PARTS)), NUMBERS // max(self.size, 1)))
        if not isinstance(rows.schema["v"].dataType.elementType, FloatType):
            rows = rows.withColumn("v", F.col("v").cast("array<double>"))
        # A row without an order or a group meets nobody.
        rows = rows.filter((F.size("v") == self.size) & F.col("ord").isNotNull() & F.col("grp").isNotNull()).withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v"))))
        # A group of more rows than a block holds is cut into bins; there are few of them.
        large = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > min(self.block, PAIR_BLOCK)).select("grp", F.lit(True).alias("cut"))
        rows = rows.join(F.broadcast(large), "grp", "left")
        self.rows = durable(self._placed(rows, pivots))

    def _placed(self, rows: DataFrame, pivots: int) -> DataFrame:
        """Rows with their bin, and the bins that may hold a match (-1: the only one of a small group)."""
        import numpy as np

        chosen = (rows.filter("cut").select(unit("v").alias("u")).select("u", F.xxhash64("u").alias("h"))
                  .dropDuplicates(["h"]).orderBy("h").limit(pivots).collect())
        cells = _Cells([r["u"] for r in chosen], self.reach) if chosen else None
        bin_of = np.zeros((max(len(chosen), 1), RINGS), int)

        def count(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            held = np.zeros(bin_of.size, int)
            for batch in batches:
                if batch.num_rows:
                    _, _, cell, ring = cells.home(_units(batch))
                    held += np.bincount(cell * RINGS + ring, minlength=held.size)
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["place", "n"])

        if cells:
            held = np.zeros(bin_of.size, int)
            for r in rows.filter("cut").select("v", "norm").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
                held[r["place"]] = r["n"]
            bin_of = ((held.cumsum() - held) // self.block).reshape(bin_of.shape)

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                own, asks = np.full(batch.num_rows, -1), [[-1]] * batch.num_rows
                cut = np.flatnonzero(batch.column("cut").fill_null(False).to_numpy(zero_copy_only=False))
                if len(cut):
                    own[cut], met = cells.bins(_units(batch)[cut], bin_of)
                    for i, row in zip(cut, met):
                        asks[i] = np.flatnonzero(row).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("ord", "grp", "v", "norm")), pa.array(own, pa.int32()), pa.array(asks, pa.list_(pa.int32()))],
                    names=["ord", "grp", "v", "norm", "bin", "asks"])

        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("ord", "v")}
        return rows.select("ord", "grp", "v", "norm", "cut").mapInArrow(
            run, f"ord {kinds['ord']}, grp string, v {kinds['v']}, norm double, bin int, asks array<int>")

    def _met(self, late: DataFrame | None, early: DataFrame | None, block: int):
        """Both sides dealt out: (grp, bin, held, asking) is one block of each.  Without a side, all rows are that side."""
        def side(rows, *columns):
            own = self.rows if rows is None else self.rows.join(rows.select("ord"), "ord", "left_semi")
            return own.select("ord", "grp", "v", "norm", *columns)

        asking, held = side(late, F.explode("asks").alias("bin")), side(early, "bin")
        cut = lambda rows, n: rows.filter("bin >= 0").groupBy("grp", "bin").agg(F.ceil(F.count("*") / block).alias(n))
        # One row per bin of the large groups: few.
        sizes = durable(cut(held, "n_held").join(cut(asking, "n_asking"), ["grp", "bin"]))

        def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
            few = F.broadcast(sizes.select(F.col("grp").alias("g"), F.col("bin").alias("b"), "n_held", "n_asking"))
            # A bin that only one side knows has no partner; the rows of small groups are one block.
            rows = rows.join(few, (F.col("grp") == F.col("g")) & (F.col("bin") == F.col("b")), "left").filter("bin < 0 OR b IS NOT NULL")
            mine = F.pmod(F.xxhash64("ord"), F.coalesce(F.col(f"n_{own}"), F.lit(1))).alias(own)
            theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"n_{other}"), F.lit(1)) - 1)).alias(other)
            # New names for new columns: both sides come from one table.
            return rows.select(*[F.col(c).alias(c) for c in ("ord", "grp", "bin", "v", "norm")], mine, theirs)

        keys = ["grp", "bin", "held", "asking"]
        return dealt(asking, "asking", "held").groupBy(*keys).cogroup(dealt(held, "held", "asking").groupBy(*keys))

    def __call__(self, late: DataFrame, early: DataFrame) -> DataFrame:
        """(ord, early_ord, similarity) of all pairs above the threshold, the earlier row from ``early``."""
        threshold = self.threshold

        def pairs(left, right):
            import numpy as np
            import pyarrow as pa

            parts = list(_tiles(left, right, threshold)) or [([], [], [])]
            return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), (pa.int64(), pa.int64(), pa.float64()))],
                            names=["ord", "early_ord", "similarity"])

        return self._met(late, early, min(self.block, PAIR_BLOCK)).applyInArrow(pairs, "ord bigint, early_ord bigint, similarity double")

    def pair_bound(self, rows: DataFrame) -> int:
        """Number of pairs among ``rows``, counted without making them."""
        threshold = self.threshold

        def count(left, right):
            import pyarrow as pa

            return pa.table({"n": pa.array([sum(len(t[0]) for t in _tiles(left, right, threshold))], pa.int64())})

        return self._met(rows, rows, self.block).applyInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def best(self) -> DataFrame:
        """Per row with one: its most similar earlier row (the earlier on a tie), the similarity and the number of all above."""
        threshold = self.threshold

        def best_of(left, right):
            import numpy as np
            import pyarrow as pa

            at = np.sort(left.column("ord").to_numpy())
            top, matched, n = np.full(len(at), -np.inf), np.zeros(len(at), "int64"), np.zeros(len(at), "int64")
            for late, early, found in _tiles(left, right, threshold):
                if not len(late):
                    continue
                # The best of each row first, the earlier one on a tie.
                i = np.searchsorted(at, late)
                n += np.bincount(i, minlength=len(at))
                by = np.lexsort((early, -found, i))
                first = by[np.unique(i[by], return_index=True)[1]]
                i, early, found = i[first], early[first], found[first]
                more = (found > top[i]) | ((found == top[i]) & (early < matched[i]))
                top[i[more]], matched[i[more]] = found[more], early[more]
            some = n > 0
            return pa.table({"ord": pa.array(at[some], pa.int64()), "matched": pa.array(matched[some]), "similarity": pa.array(top[some]),
                             "n": pa.array(n[some])})

        found = self._met(None, None, self.block).applyInArrow(best_of, "ord bigint, matched bigint, similarity double, n bigint")
        return found.groupBy("ord").agg(
            F.max_by("matched", F.struct(F.col("similarity"), -F.col("matched"))).alias("matched"),
            F.max("similarity").alias("similarity"), F.sum("n").alias("n_matches"))


def earlier_matches(df: DataFrame, order: str, vector: str, group: str | None = None, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """For every row with one, its most similar earlier row (the earlier one on a tie) and how many there are."""
    return CosineSimilar(df, order, vector, group, threshold).best().withColumnRenamed("ord", order)
