"""Approximate nearest neighbours by largest inner product: stable random projections, kd-trees, a chi-square stop.

Inner products become distances by one more coordinate (the root of what a vector lacks to the longest one). Vectors
are projected on DIMS Gaussian directions; the squared projected distance of two points, over their squared distance,
follows a chi-square law of DIMS degrees. A kd-tree over the projected points, its upper part fitted to a bounded
sample, deals the vectors to cells; each cell's blocks have trees of their own. A query takes leaves in the order of
their projected distance and verifies what they hold on the original vectors. It stops once a nearer vector would lie
beyond the next leaf with a probability of 1 - CONFIDENCE at most. First each query searches its own cell; the distance
found there then tells, by the same test, which other cells it must still see.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, be
it as query or as candidate; copies of a vector are indexed once with their ids, so ties go to the smaller id and a
vector that fills a third of the table costs no more than others; rows with a null id take no part; rows that repeat an
id, with another vector or with the same, are rows like others: each is a candidate of all the rest and each asks (equal
rows are counted first, searched for once, and their answer is given as often as they stand there); fewer candidates
than k give fewer rows; an empty table gives an empty table; other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, factorial, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save

DIMS, CONFIDENCE, LEAF = 8, 0.9, 32
#: Vectors that the upper tree is fitted on at most; vectors a cell should hold; vectors of a block; queries of a group.
SAMPLE_ROWS, CELL_ROWS, BLOCK_ROWS, QUERY_ROWS = 100_000, 8192, 16_384, 4096
#: Leaves that a query takes at a time, and queries that go together.
LEAVES, TOGETHER = 4, 128
#: Times that one step of an expansion repeats a row.
REPEATS = 10_000


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """Of DIMS (an even number of) degrees."""
    half = np.minimum(x / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(DIMS // 2))


class Projection:
    def __init__(self, size: int, longest: float):
        self.longest = longest  # squared
        self.directions = np.random.default_rng(20240603).standard_normal((size + 1, DIMS))

    def base(self, x: np.ndarray) -> np.ndarray:
        lacks = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.c_[x, lacks] @ self.directions

    def query(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[:-1]

    def distance(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distances of queries from vectors of these scores."""
        return np.maximum((x * x).sum(axis=1) + self.longest - 2 * score, 0)


class Cells:
    """The upper tree: boxes of the projected space."""

    def __init__(self, points: np.ndarray, depth: int):
        self.low, self.high = [], []
        self.cuts: list = []
        self._split(points, depth, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> None:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(DIMS)
        axis = int(spread.argmax())
        if not depth or spread[axis] == 0:
            self.low.append(low)
            self.high.append(high)
            return
        cut = float(np.median(points[:, axis]))
        if cut == points[:, axis].max():  # many equal points: the cut must leave some on either side
            cut = float(points[points[:, axis] < cut, axis].max())
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = cut
        inside = points[:, axis] <= cut
        self._split(points[inside], depth - 1, low, left)
        self._split(points[~inside], depth - 1, right, high)

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points from all boxes."""
        out = np.empty((len(points), len(self.low)))
        for k, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            out[:, k] = (np.maximum(np.maximum(low - points, points - high), 0) ** 2).sum(axis=1)
        return out

    def of(self, points: np.ndarray) -> np.ndarray:
        """A box is open at its lower faces."""
        out = np.zeros(len(points), dtype=np.int32)
        for k, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            out[((points > low) & (points <= high)).all(axis=1)] = k
        return out


class Tree:
    """A kd-tree over a block's projected distinct vectors: leaves with bounding boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, projection: Projection, k: int):
        order = np.argsort(ids, kind="stable")
        vectors, ids, copies = np.ascontiguousarray(vectors[order]), ids[order], np.minimum(copies[order], k + 1)
        _, first, same = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(same, kind="stable")  # ids of each distinct vector, in order
        ids, same = np.repeat(ids[by], copies[by]), np.repeat(same[by], copies[by])
        begin = np.searchsorted(same, np.arange(len(first)))
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(begin, np.r_[begin[1:], len(ids)], strict=True)]
        self.x, self.projection, self.k = vectors[first], projection, k
        points = projection.base(self.x)
        leaves = [np.arange(len(points))]
        while max(map(len, leaves)) > LEAF:
            halves = []
            for own in leaves:
                if len(own) <= LEAF:
                    halves.append(own)
                    continue
                axis = int(np.ptp(points[own], axis=0).argmax())
                cut = np.argpartition(points[own, axis], len(own) // 2)
                halves += [own[cut[: len(own) // 2]], own[cut[len(own) // 2 :]]]
            leaves = halves
        self.leaves = np.full((len(leaves), LEAF), -1)
        for n, own in enumerate(leaves):
            self.leaves[n, : len(own)] = own
        self.low = np.array([points[own].min(axis=0) for own in leaves])
        self.high = np.array([points[own].max(axis=0) for own in leaves])

    def search(self, q: np.ndarray, own_ids: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """q: queries; kth: scores that a neighbour must reach (-inf: any). Gives (place of the query, ids, scores)."""
        for a in range(0, len(q), TOGETHER):
            x, floor = q[a : a + TOGETHER], kth[a : a + TOGETHER]
            points = self.projection.query(x)
            outside = np.maximum(np.maximum(self.low - points[:, None], points[:, None] - self.high), 0)
            bound = (outside**2).sum(axis=2)
            order = np.argsort(bound, axis=1)
            keep = self.k + 1
            scores, found = np.full((len(x), keep), -np.inf), np.full((len(x), keep), np.iinfo(np.int64).max)
            active = np.arange(len(x))
            for t in range(0, order.shape[1], LEAVES):
                # the test is made on what is known to be the k-th neighbour, copies counted
                worst = np.maximum(self._kth(scores[active], found[active]), floor[active])
                beyond = bound[active, order[active, t]] / np.maximum(self.projection.distance(x[active], np.where(np.isfinite(worst), worst, 0)), 1e-300)
                active = active[~(np.isfinite(worst) & (chi_square_cdf(beyond) >= CONFIDENCE))]
                if not len(active):
                    break
                rows = self.leaves[order[active, t : t + LEAVES]].reshape(len(active), -1)
                total = np.einsum("qld,qd->ql", self.x[rows], x[active])
                total[rows < 0] = -np.inf
                better = total.max(axis=1) >= scores[active, -1]  # few after the first steps
                own, total, rows = active[better], total[better], rows[better]
                both, names = np.c_[scores[own], total], np.c_[found[own], np.where(rows < 0, np.iinfo(np.int64).max, rows)]
                best = np.lexsort((names, -both), axis=1)[:, :keep]
                scores[own], found[own] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            held = np.isfinite(scores)
            seen = self.x[np.where(held, found, 0)]
            exact = np.zeros(scores.shape)
            for d in range(x.shape[1]):  # summed up in order, so that equal vectors have equal scores everywhere
                exact += seen[:, :, d] * x[:, None, d]
            scores = np.where(held, exact, -np.inf)
            for k in range(len(x)):
                ids, values = [], []
                for row, s in zip(found[k][np.isfinite(scores[k])], scores[k][np.isfinite(scores[k])], strict=True):
                    more = self.ids[row]
                    own = np.flatnonzero(more == own_ids[a + k])[:1]
                    if len(own) and np.array_equal(self.x[row], x[k]):  # the row that asks
                        more = np.delete(more, own)
                    ids.append(more)
                    values.append(np.full(len(more), s))
                ids, values = np.concatenate(ids or [np.empty(0, np.int64)]), np.concatenate(values or [np.empty(0)])
                best = np.lexsort((ids, -values))[: self.k]
                best = best[values[best] >= floor[k] - 1e-9]
                yield a + k, ids[best], values[best]

    def _kth(self, scores: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The score of the k-th neighbour so far (distinct vectors count once, which only makes the search longer); one place is left for the query's own vector."""
        return scores[:, self.k]


PAIRS = "query_id long, twin long, copies long, vec_id long, score double"
#: A query: its id, a digest that tells it from other vectors of that id, how many rows it stands for.
QUERY = ["query_id", "twin", "copies"]


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(good)


def repeated(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as `copies` says, in two steps, so that no array holds more than REPEATS items (or their number)."""
    steps = df.withColumn("_step", F.explode(F.expr(f"sequence(0, ({copies} - 1) div {REPEATS})")))
    return steps.withColumn("_one", F.explode(F.expr(f"sequence(1, least({REPEATS}, {copies} - _step * {REPEATS}))"))).drop("_step", "_one")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by `every`. The k nearest of each: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == most["size"])
    projection = Projection(most["size"], most["longest"])
    ids = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield pd.DataFrame({"point": list(projection.base(np.vstack(df["x"].to_numpy())))})

    sample = rows.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("x").alias("x"))
    points = np.unique(np.vstack(sample.mapInPandas(projected, "point array<double>").toPandas()["point"].to_numpy()), axis=0)  # DIMS numbers a row
    depth = max(0, min(ceil(log2(max(1, most["n"] / CELL_ROWS))), int(log2(max(1, len(points) / 16)))))
    cells = Cells(points, depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = np.vstack(df["x"].to_numpy())
                yield df.assign(cell=cells.of(projection.base(x)), home=cells.bounds(projection.query(x)).argmin(axis=1).astype(np.int32))

    counted = rows.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"))
    placed = save(counted.mapInPandas(place, "vec_id long, x array<double>, copies long, cell int, home int"), "nearest-placed")
    many = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    blocks = F.create_map(*(F.lit(v) for c, n in sorted(many.items()) for v in (c, ceil(n / BLOCK_ROWS))))
    base = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.element_at(blocks, F.col("cell"))).cast("int")).select("vec_id", "x", "copies", "cell", "block")
    queries = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("twin"), "copies", F.col("x").alias("q"), "home")

    def search(wanted: DataFrame) -> DataFrame:
        """wanted: QUERY, q, cell, kth. Neighbours found in the blocks of the cell."""
        groups = wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell
        if not groups:
            return spark.createDataFrame([], PAIRS)
        parts = F.create_map(*(F.lit(v) for r in groups for v in (r["cell"], ceil(r["n"] / QUERY_ROWS))))
        asked = wanted.withColumn("part", F.pmod(F.xxhash64("query_id", "twin"), F.element_at(parts, F.col("cell"))).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell")) - 1)))
        held = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("cell")) - 1))).where("part is not null")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({c: [] for c in (*QUERY, "vec_id", "score")})
            tree = Tree(np.vstack(left["x"].to_numpy()), left["vec_id"].to_numpy(), left["copies"].to_numpy(), projection, k)
            found = list(tree.search(np.vstack(right["q"].to_numpy()), right["query_id"].to_numpy(), right["kth"].to_numpy()))
            asked = right[QUERY].iloc[np.repeat([n for n, _, _ in found], [len(i) for _, i, _ in found])]
            return asked.assign(vec_id=np.concatenate([i for _, i, _ in found]), score=np.concatenate([s for _, _, s in found]))

        key = ["cell", "block", "part"]
        return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, PAIRS)

    by = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    best = lambda pairs: pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = save(best(search(queries.select(*QUERY, "q", F.col("home").alias("cell"), F.lit(float("-inf")).alias("kth")))), "nearest-first")
    known = first.groupBy("query_id", "twin").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    full = F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf"))
    held = queries.join(known.hint("merge"), ["query_id", "twin"], "left").select(*QUERY, "q", "home", F.coalesce(full, F.lit(float("-inf"))).alias("kth"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                q, kth = np.vstack(df["q"].to_numpy()), df["kth"].to_numpy()
                sure = np.isfinite(kth)
                ratio = cells.bounds(projection.query(q)) / np.maximum(projection.distance(q, np.where(sure, kth, 0)), 1e-300)[:, None]
                needed = ~sure[:, None] | (chi_square_cdf(ratio) < CONFIDENCE)
                needed[np.arange(len(df)), df["home"].to_numpy()] = False
                needed[:, [c for c in range(len(cells.low)) if c not in many]] = False
                row, cell = np.nonzero(needed)
                yield df[[*QUERY, "q"]].iloc[row].assign(cell=cell.astype(np.int32), kth=kth[row])

    second = search(save(held.mapInPandas(others, "query_id long, twin long, copies long, q array<double>, cell int, kth double"), "nearest-wanted"))
    both = best(first.drop("rank").unionByName(second))
    return repeated(both, "copies").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
