"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Shards are cells about pivots, the vectors nearest to each, and know how near and how far from their pivot
they reach. A query first searches one shard of its own cell; with the radius found there it visits, of the
other shards, those alone that the same inequality does not rule out, and takes the radius along.

A node of a tree holds a vantage point and, for the half of its points that is nearer and the half that is
farther, the smallest and largest distance to it. By the triangle inequality a half can hold nothing
nearer than the k-th best so far if the query's distance to the vantage point is off its interval by more
than that. The pruning radius is multiplied by ``factor``: one is exact, less visits fewer nodes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LEAF = 64
#: Share of the distances in a bound that keeps rounding from pruning an equal distance.
SLACK = 1e-12


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, dimensions summed in order."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        gap = queries[:, j, None] - points[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and nodes as rows of integers and of interval bounds.

    Integers: start, middle, end, near child, far child; a leaf has no children (-1). An inner node's
    vantage point stands at its start. Halves are cut by rank, so equal points split as well.
    """
    order = np.arange(len(points))
    shape: list[list[int]] = []
    bounds: list[list[float]] = []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        number = len(shape)
        if parent >= 0:
            shape[parent][3 + side] = number
        shape.append([start, end, end, -1, -1])
        bounds.append([0.0] * 4)
        if end - start <= LEAF:
            continue
        # The point farthest from an arbitrary one sees the others at well-spread distances.
        seed = distances(points[order[start : start + 1]], points[order[start:end]])[0]
        far = start + int(seed.argmax())
        order[[start, far]] = order[[far, start]]
        rest = order[start + 1 : end]
        d = distances(points[order[start : start + 1]], points[rest])[0]
        rank = np.argsort(d, kind="stable")
        order[start + 1 : end], d = rest[rank], d[rank]
        half = len(d) // 2
        shape[number][1] = start + 1 + half
        bounds[number] = [d[0], d[half - 1], d[half], d[-1]]
        todo += [(start + 1 + half, end, number, 1), (start + 1, start + 1 + half, number, 0)]
    return order, np.array(shape, np.int64).reshape(-1, 5), np.array(bounds).reshape(-1, 4)


class Search:
    """A batch of queries against one tree; every node is visited once, by the queries it may serve."""

    def __init__(self, queries, query_ids, points, ids, shape, bounds, k, factor, radius=None):
        self.radius = np.full(len(queries), np.inf) if radius is None else radius
        self.q, self.own, self.p, self.ids = queries, query_ids, points, ids
        self.shape, self.bounds, self.k, self.factor = shape, bounds, k, factor
        self.d = np.full((len(queries), k), np.inf)
        self.i = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, active: np.ndarray, start: int, end: int) -> np.ndarray:
        d = distances(self.q[active], self.p[start:end])
        ids = np.broadcast_to(self.ids[start:end], d.shape)
        seen = np.where(ids == self.own[active, None], np.inf, d)
        better = (seen <= self.d[active, -1:]).any(axis=1) & np.isfinite(seen).any(axis=1)
        rows = active[better]
        if len(rows):
            all_d = np.hstack([self.d[rows], seen[better]])
            all_i = np.hstack([self.i[rows], np.where(np.isinf(seen[better]), np.iinfo(np.int64).max, ids[better])])
            best = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
            self.d[rows] = np.take_along_axis(all_d, best, 1)
            self.i[rows] = np.take_along_axis(all_i, best, 1)
        return d

    def descend(self) -> None:
        """Gives every query a first radius from the leaf on its side of each vantage point."""
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            node, active = todo.pop()
            start, middle, end, near, far = self.shape[node]
            if near < 0:
                self.first[active] = node
                self.offer(active, start, end)
                continue
            d = distances(self.q[active], self.p[start : start + 1])[:, 0]
            inner = d <= (self.bounds[node, 1] + self.bounds[node, 2]) / 2
            todo += [(c, a) for c, a in ((near, active[inner]), (far, active[~inner])) if len(a)]

    def run(self) -> None:
        self.first = np.full(len(self.q), -1)
        self.descend()
        todo = [(0, np.arange(len(self.q)), np.zeros(len(self.q)))]
        while todo:
            node, active, gap = todo.pop()
            # The radius may have shrunk since the node was noted.
            keep = gap <= self.factor * np.minimum(self.d[active, -1], self.radius[active])
            active = active[keep]
            if not len(active):
                continue
            start, middle, end, near, far = self.shape[node]
            if near < 0:
                self.offer(active[self.first[active] != node], start, end)
                continue
            d = self.offer(active, start, start + 1)[:, 0]
            low, high, low2, high2 = self.bounds[node]
            todo.append((far, active, np.maximum(low2 - d, d - high2) - SLACK * (d + high2)))
            todo.append((near, active, np.maximum(low - d, d - high) - SLACK * (d + high)))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def good(vectors: DataFrame, name: str = "vec_id") -> DataFrame:
    """The vectors that take part: ``name``, dims, vector in double precision."""
    return vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias(name), F.size("embedding").alias("dims"), F.col("embedding").cast("array<double>").alias("vector")
    )


def drawn_pivots(rows: DataFrame, shard_rows: int, most: int) -> dict[int, np.ndarray]:
    """Pivots for each number of dimensions: as many as it has shards, ``most`` at most, drawn by a hash of the id."""
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / shard_rows))
    unit = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 30))
    # Four times as many as needed on the average, and the first of them by their hash.
    some = rows.join(F.broadcast(sizes), "dims").withColumn("unit", unit).where(F.col("unit") / float(1 << 30) <= 4 * wanted / F.col("n"))
    place = F.row_number().over(Window.partitionBy("dims").orderBy("unit", "vec_id"))
    chosen = some.withColumn("place", place).where(F.col("place") <= wanted).select("dims", "vector").toPandas()
    return {int(d): np.stack(x["vector"].to_list()).astype(np.float64) for d, x in chosen.groupby("dims")}


def build_index(vectors: DataFrame, shard_rows: int = 4096, pivots: int = 256) -> DataFrame:
    """The trees as a table, one row for each shard: dims, cell, part, low, high, pivot, tree; vectors included.

    ``vectors`` has vec_id and embedding. Vectors that ``usable`` refuses and null ids take no part. A vector
    belongs to the cell of its nearest pivot; ``low`` and ``high`` are a shard's distances to it. A cell of
    more than ``shard_rows`` vectors, however alike, is dealt to several shards by a hash of their ids.
    Vectors of different lengths never share one. At most ``pivots`` vectors of each length reach the driver.
    """
    rows = good(vectors)
    held = rows.sparkSession.sparkContext.broadcast(drawn_pivots(rows, shard_rows, pivots))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(cell=np.int32(0), far=0.0)
            for dims, part in pdf.groupby("dims"):
                centres = held.value.get(int(dims), np.zeros((1, int(dims))))
                d = distances(np.stack(part["vector"].to_list()), centres)
                pdf.loc[part.index, "cell"], pdf.loc[part.index, "far"] = d.argmin(axis=1).astype(np.int32), d.min(axis=1)
            yield pdf

    placed = rows.mapInPandas(cells, "vec_id bigint, dims int, vector array<double>, cell int, far double")
    sizes = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        points = np.stack(pdf["vector"].to_list()).astype(np.float64)
        order, shape, bounds = build_tree(points)
        blob = io.BytesIO()
        np.savez(blob, points=points[order], ids=pdf["vec_id"].to_numpy()[order], shape=shape, bounds=bounds)
        dims, cell = int(pdf["dims"].iloc[0]), int(pdf["cell"].iloc[0])
        centres = held.value.get(dims, np.zeros((1, dims)))
        return pd.DataFrame({
            "dims": [dims], "cell": [cell], "part": [int(pdf["part"].iloc[0])], "low": [pdf["far"].min()], "high": [pdf["far"].max()],
            "pivot": [centres[cell]], "tree": [blob.getvalue()],
        })

    return dealt.groupBy("dims", "cell", "part").applyInPandas(tree, "dims int, cell int, part int, low double, high double, pivot array<double>, tree binary")


def visits(asked: DataFrame, shards: pd.DataFrame, factor: float, first: bool) -> DataFrame:
    """``asked`` (query_id, dims, vector, radius) with the shards (cell, part) that each query visits.

    First that is one shard of the nearest cell; later all others whose distance to the query, by the
    triangle inequality about their pivot, is within the radius.
    """
    table = {}
    for dims, x in shards.groupby("dims"):
        x = x.sort_values(["cell", "part"])
        table[int(dims)] = (np.stack(x["pivot"].to_list()), x["cell"].to_numpy(), x["part"].to_numpy(), x["low"].to_numpy(), x["high"].to_numpy())
    held = asked.sparkSession.sparkContext.broadcast(table)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                if int(dims) not in held.value:
                    continue
                pivots, cell, number, low, high = held.value[int(dims)]
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    d = distances(np.stack(some["vector"].to_list()), pivots)
                    near = cell[d.argmin(axis=1)]
                    ids = some["query_id"].to_numpy(np.int64)
                    many = np.bincount(cell)
                    home = (cell[None, :] == near[:, None]) & (number[None, :] == (ids % many[near])[:, None])
                    bound = np.maximum(low - d, d - high) - SLACK * (d + high)
                    row, col = np.nonzero(home if first else ~home & (bound <= factor * some["radius"].to_numpy()[:, None]))
                    yield some.iloc[row].assign(cell=cell[col].astype(np.int32), part=number[col].astype(np.int32))

    return asked.select("query_id", "dims", "vector", "radius").mapInPandas(each, "query_id bigint, dims int, vector array<double>, radius double, cell int, part int")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, block_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors of each query but its own row.

    Score is the Euclidean distance; ties go to the smaller vec_id. ``index`` is stored. A task holds one
    tree and a block of about ``block_rows`` of the queries that visit it, and a tree is copied once for
    each block. ``queries`` has vec_id and embedding under the rules of ``build_index``; a query whose
    dimension no vector has finds nothing, and an empty table gives no rows. What every task knows of the
    shards are their pivots and distances, never their vectors.
    """
    shards = index.select("dims", "cell", "part", "low", "high", "pivot").toPandas()
    asked = good(queries, "query_id").withColumn("radius", F.lit(float("inf")))
    key = ["dims", "cell", "part", "block"]

    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        tree = np.load(io.BytesIO(trees["tree"].iloc[0]))
        own = asked["query_id"].to_numpy(np.int64)
        vectors = np.stack(asked["vector"].to_list()).astype(np.float64)
        found = Search(vectors, own, tree["points"], tree["ids"], tree["shape"], tree["bounds"], k, factor, asked["radius"].to_numpy(np.float64))
        found.run()
        keep = np.isfinite(found.d)
        q, _ = np.nonzero(keep)
        return pd.DataFrame({"query_id": own[q], "vec_id": found.i[keep], "score": found.d[keep]})

    def searched(rows: DataFrame) -> DataFrame:
        rows = stored(rows)
        sizes = rows.groupBy("dims", "cell", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        left = index.join(F.broadcast(sizes), ["dims", "cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = rows.join(F.broadcast(sizes), ["dims", "cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        found = left.select(*key, "tree").groupBy(*key).cogroup(right.select(*key, "query_id", "vector", "radius").groupBy(*key))
        return found.applyInPandas(search, "query_id bigint, vec_id bigint, score double")

    near = stored(searched(visits(asked, shards, factor, first=True)))
    full = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("reach"))
    narrowed = asked.join(full, "query_id", "left").withColumn("radius", F.coalesce("reach", "radius"))
    found = near.unionByName(searched(visits(narrowed, shards, factor, first=False)))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def search_table(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """``nearest`` for the rows whose vec_id is divisible by ``every``, against all rows."""
    index = stored(build_index(vectors))
    return nearest(index, vectors.where(F.col("vec_id") % every == 0), k, factor)


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda x, y: x + y)) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
