"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

A node has a few split points; each of its rows goes to the nearest one, and every split point stores the
smallest and largest distance from itself to the rows of each sibling subtree. A search asks for rows whose
inner product with an anchor lies in a window. As |a - x|^2 = |a|^2 + |x|^2 - 2 a.x, a window of products
and the range of norms in a subtree make an annulus of distances about the anchor. A subtree is left out if,
by the triangle inequality about any one split point, its range of distances does not meet the annulus.
Leaves are exact, in integers. The best rows found so far narrow the annulus from its far side.

The root has its split points on the driver, a bounded number of them; its subtrees are cells of a table,
large ones dealt to several shards, each of which is a tree of its own. Labels are hashed to a few groups,
and cells belong to a group, so that rows of one label are looked for among its own cells only.
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
WAYS = 8
#: Share of a distance that keeps rounding from leaving out a row on the rim of an annulus.
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of integer points held as doubles; products and squares below 2^53 are exact."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; refuses components whose inner products might not be exact."""
    out = np.floor(scale * x.astype(np.float64))
    if out.size and (np.abs(out).max() ** 2) * max(1, out.shape[1]) * 4 >= 2.0**53:
        raise ValueError(f"a component of {np.abs(out).max() / scale:g} is too large for exact inner products")
    return out


def split_points(points: np.ndarray) -> np.ndarray:
    """Rows that lie far apart: each next one is the farthest from those before, among a spread of rows."""
    some = points[np.linspace(0, len(points) - 1, min(len(points), 32 * WAYS)).astype(np.int64)]
    chosen = [0]
    nearest = distances(some, some[:1])[:, 0]
    while len(chosen) < WAYS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


class Tree:
    """One shard: its rows in the order of the leaves, and nodes as arrays.

    ``start``, ``end``: a node's rows; ``norms``: the range of |x|^2 in it; ``kids``: its subtrees, -1 for
    none; ``splits``, ``low``, ``high``: where an inner node's split points and ranges begin.
    """

    FIELDS = ("points", "ids", "labels", "start", "end", "norms", "kids", "splits", "low", "high")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
        square = (points * points).sum(axis=1)
        order = np.arange(len(points))
        start, end, norms, kids, splits, low, high = [], [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            start.append(a)
            end.append(b)
            norms.append((square[order[a:b]].min(), square[order[a:b]].max()))
            kids.append([-1] * WAYS)
            splits.append(np.zeros((WAYS, points.shape[1])))
            low.append(np.full((WAYS, WAYS), np.inf))
            high.append(np.full((WAYS, WAYS), -np.inf))
            return len(start) - 1

        todo = [node(0, len(points))]
        while todo:
            at = todo.pop()
            a, b = start[at], end[at]
            if b - a <= LEAF:
                continue
            own = split_points(points[order[a:b]])
            if len(own) < 2:  # nothing but copies of one point
                continue
            d = distances(points[order[a:b]], own)
            side = d.argmin(axis=1)
            place = np.argsort(side, kind="stable")
            order[a:b], d, side = order[a:b][place], d[place], side[place]
            splits[at][: len(own)] = own
            ends = np.searchsorted(side, np.arange(len(own)), side="right")
            for j, (left, right) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if right > left:
                    low[at][: len(own), j], high[at][: len(own), j] = d[left:right].min(axis=0), d[left:right].max(axis=0)
                    kids[at][j] = node(a + left, a + right)
                    todo.append(kids[at][j])
        arrays = (points[order], ids[order], labels[order], start, end, norms, kids, splits, low, high)
        return cls(**dict(zip(cls.FIELDS, map(np.asarray, arrays), strict=True)))

    def pack(self) -> bytes:
        blob = io.BytesIO()
        np.savez(blob, **{f: getattr(self, f) for f in self.FIELDS})
        return blob.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        return cls(**np.load(io.BytesIO(blob)))


def reaches(to_splits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest that a subtree can be, from distances to split points (last axis) and its ranges."""
    slack = SLACK * (to_splits + np.where(np.isfinite(high), np.abs(high), 0) + 1)
    near = np.maximum(low - to_splits, to_splits - high) - slack
    return np.maximum(near.max(axis=-1), 0), (to_splits + high + slack).min(axis=-1)


def meets(near, far, square, norms, floor, roof) -> np.ndarray:
    """Whether distances from ``near`` to ``far`` meet the annulus of products from ``floor`` to ``roof``."""
    outer, inner = square + norms[1] - 2 * floor, square + norms[0] - 2 * roof
    return (near * near <= outer * (1 + SLACK) + SLACK) & (far * far >= inner * (1 - SLACK) - SLACK) & (floor <= roof)


class Search:
    """Windows of anchors against one tree: the ``k`` largest products in each, ties to the smaller id."""

    def __init__(self, tree: Tree, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, owner, floor, roof, same: bool, k: int):
        self.t, self.a, self.ids, self.labels, self.owner = tree, anchors, ids, labels, owner
        self.square = (anchors * anchors).sum(axis=1)
        self.floor, self.roof, self.same, self.k = floor.astype(np.float64), roof, same, k
        self.score = np.full((len(owner), k), -np.inf)
        self.found = np.full((len(owner), k), NO_ID)

    def leaf(self, node: int, active: np.ndarray) -> None:
        t, rows = self.t, slice(self.t.start[node], self.t.end[node])
        who, back = np.unique(self.owner[active], return_inverse=True)
        s = self.a[who] @ t.points[rows].T
        alike = t.labels[rows][None, :] == self.labels[who][:, None]
        itself = (t.ids[rows][None, :] == self.ids[who][:, None]) & alike
        if itself.any():  # of rows that share an id, the anchor is the one at distance zero
            itself &= distances(self.a[who], t.points[rows]) == 0
        s = np.where((alike if self.same else ~alike) & ~itself, s, -np.inf)[back]
        s = np.where((s >= self.floor[active, None]) & (s <= self.roof[active, None]), s, -np.inf)
        some = np.isfinite(s).any(axis=1)
        mine = active[some]
        if len(mine):
            s, ids = s[some], np.broadcast_to(t.ids[rows], (len(mine), s.shape[1]))
            all_s = np.hstack([self.score[mine], s])
            all_i = np.hstack([self.found[mine], np.where(np.isfinite(s), ids, NO_ID)])
            best = np.lexsort((all_i, -all_s), axis=1)[:, : self.k]
            self.score[mine], self.found[mine] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
            self.floor[mine] = np.maximum(self.floor[mine], self.score[mine, -1])

    def run(self) -> None:
        t, n = self.t, len(self.owner)
        todo = [(0, np.arange(n), np.zeros(n), np.full(n, np.inf))]
        while todo:
            node, active, near, far = todo.pop()
            # The floor may have risen since the subtree was noted.
            active = active[meets(near, far, self.square[self.owner[active]], t.norms[node], self.floor[active], self.roof[active])]
            if not len(active):
                continue
            kids = np.nonzero(t.kids[node] >= 0)[0]
            if not len(kids):
                self.leaf(node, active)
                continue
            who, back = np.unique(self.owner[active], return_inverse=True)
            ways = int(np.isfinite(t.low[node]).any(axis=1).sum())
            d = distances(self.a[who], t.splits[node][:ways])
            # The subtree nearest to most anchors is popped first.
            for j in kids[np.argsort(-d.mean(axis=0)[kids], kind="stable")]:
                near, far = reaches(d, t.low[node][:ways, j], t.high[node][:ways, j])
                todo.append((int(t.kids[node][j]), active, near[back], far[back]))


def good(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, x: rows with an id, a label and a vector of finite components."""
    x: Column = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size(x).alias("dims"), x.cast("array<double>").alias("x")
    )


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64).reshape(len(column), dims)


def drawn_pivots(rows: DataFrame, shard_rows: int, most: int, scale: int) -> dict[int, np.ndarray]:
    """Split points of the root for each number of dimensions: one for each shard, ``most`` at most, drawn by a hash of the id."""
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / shard_rows))
    unit = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 30))
    some = rows.join(F.broadcast(sizes), "dims").withColumn("unit", unit).where(F.col("unit") / float(1 << 30) <= 4 * wanted / F.col("n"))
    place = F.row_number().over(Window.partitionBy("dims").orderBy("unit", "vec_id"))
    chosen = some.withColumn("place", place).where(F.col("place") <= wanted).select("dims", "x").toPandas()
    return {int(d): np.unique(whole_numbers(matrix(part["x"], int(d)), scale), axis=0) for d, part in chosen.groupby("dims")}


KEY = ["dims", "team", "cell", "part"]


def build_index(rows: DataFrame, pivots: dict[int, np.ndarray], shard_rows: int, teams: int, scale: int) -> DataFrame:
    """One row for each shard: KEY, low and high (its distances to the root's split points), norms, tree.

    A row that repeats whole counts once: copies meet in one shard. A cell of more than ``shard_rows`` rows is
    dealt to several shards by a hash of the ids.
    """
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                points = whole_numbers(matrix(part["x"], int(dims)), scale)
                centres = held.value.get(int(dims), np.zeros((1, int(dims))))
                yield part.assign(cell=distances(points, centres).argmin(axis=1).astype(np.int32), x=list(points))

    team = F.pmod(F.xxhash64("label"), F.lit(teams)).cast("int").alias("team")
    placed = rows.select("vec_id", "label", team, "dims", "x").mapInPandas(
        cells, "vec_id long, label long, team int, dims int, x array<double>, cell int"
    )
    sizes = placed.groupBy("dims", "team", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), ["dims", "team", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dims, group, cell, part = (int(x) for x in key)
        points = matrix(pdf["x"], dims)
        table = np.column_stack([pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), points.astype(np.int64)])
        first = np.unique(table, axis=0, return_index=True)[1]
        points, pdf = points[first], pdf.iloc[first]
        tree = Tree.build(points, pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64))
        d = distances(points, held.value.get(dims, np.zeros((1, dims))))
        return pd.DataFrame({
            "dims": [dims], "team": [group], "cell": [cell], "part": [part], "low": [d.min(axis=0)], "high": [d.max(axis=0)],
            "norms": [tree.norms[0].astype(np.float64)], "tree": [tree.pack()],
        })

    return dealt.groupBy(*KEY).applyInPandas(
        shard, "dims int, team int, cell int, part int, low array<double>, high array<double>, norms array<double>, tree binary"
    )


def root_of(index: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """What the root knows of its cells, for each number of dimensions: their ranges, norms and shards.

    At most ``teams`` times ``pivots`` cells of ``pivots`` ranges each, however many rows there are.
    """
    by = ["dims", "team", "cell"]
    cells = index.groupBy(*by).agg(F.count("*").alias("parts"), F.min(F.col("norms")[0]).alias("n0"), F.max(F.col("norms")[1]).alias("n1"))
    each = index.select(*by, F.posexplode(F.arrays_zip("low", "high")).alias("at", "d"))
    ranges = each.groupBy(*by, "at").agg(F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    listed = ranges.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("d"))
    table = cells.join(listed, by).select(*by, "parts", "n0", "n1", F.col("d.low").alias("low"), F.col("d.high").alias("high")).toPandas()
    root = {}
    for dims, x in table.groupby("dims"):
        x = x.sort_values(["team", "cell"])
        root[int(dims)] = {c: x[c].to_numpy() for c in ("team", "cell", "parts", "n0", "n1")} | {c: np.stack(x[c].to_list()) for c in ("low", "high")}
    return root


ASKED = "vec_id long, anchor long, label long, team int, dims int, x array<double>, window array<long>, floor array<double>, roof array<double>"


def visits(asked: DataFrame, root: dict, pivots: dict[int, np.ndarray], same: bool, first: bool) -> DataFrame:
    """``asked`` with the shards (cell_team, cell, part) that each anchor visits: first one shard near it, later
    all others of the cells whose ranges meet the annulus of one of its windows."""
    held = asked.sparkSession.sparkContext.broadcast((root, pivots))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, pivots = held.value
        for pdf in batches:
            for dims, whole in pdf.groupby("dims"):
                if int(dims) not in root:
                    continue
                cells, centres = root[int(dims)], pivots.get(int(dims), np.zeros((1, int(dims))))
                for at in range(0, len(whole), 128):
                    some = whole.iloc[at : at + 128]
                    points, own = matrix(some["x"], int(dims)), some["team"].to_numpy()[:, None]
                    d = distances(points, centres)
                    open_ = cells["team"][None, :] == own if same else np.ones((len(some), len(cells["team"])), bool)
                    # Negatives start outside the anchor's own team, where one is there.
                    start = open_ if same else np.where((cells["team"][None, :] != own).any(axis=1)[:, None], cells["team"][None, :] != own, open_)
                    home = np.where(start, d[:, np.minimum(cells["cell"], d.shape[1] - 1)], np.inf)
                    nearest = home.argmin(axis=1)
                    ids = some["vec_id"].to_numpy(np.int64)
                    chosen = ids % cells["parts"][nearest]
                    if first:
                        there = np.isfinite(home.min(axis=1))
                        rows, cols, parts = np.nonzero(there)[0], nearest[there], chosen[there]
                    else:
                        near, far = reaches(d[:, None, :], cells["low"][None], cells["high"][None])
                        square = (points * points).sum(axis=1)[:, None]
                        wide = np.zeros_like(open_)
                        for w in range(int(some["window"].map(len).max() or 0)):
                            has = (some["window"].map(len) > w).to_numpy()
                            floor = np.array([f[w] if h else np.inf for f, h in zip(some["floor"], has, strict=True)])[:, None]
                            roof = np.array([f[w] if h else -np.inf for f, h in zip(some["roof"], has, strict=True)])[:, None]
                            wide |= meets(near, far, square, (cells["n0"][None], cells["n1"][None]), floor, roof) & has[:, None]
                        r, c = np.nonzero(open_ & wide)
                        many = cells["parts"][c]
                        rows, cols = np.repeat(r, many), np.repeat(c, many)
                        parts = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                        other = ~((cols == nearest[rows]) & (parts == chosen[rows]))
                        rows, cols, parts = rows[other], cols[other], parts[other]
                    yield some.iloc[rows].assign(
                        cell_team=cells["team"][cols].astype(np.int32), cell=cells["cell"][cols].astype(np.int32), part=parts.astype(np.int32)
                    )

    return asked.mapInPandas(each, ASKED + ", cell_team int, cell int, part int").withColumn("team", F.col("cell_team")).drop("cell_team")


def searched(index: DataFrame, rows: DataFrame, same: bool, k: int, block_rows: int) -> DataFrame:
    """vec_id, anchor, window, found, score: the ``k`` best of each window in each shard visited.

    A task holds one tree and about ``block_rows`` of the anchors that visit it.
    """
    rows = stored(rows)
    sizes = rows.groupBy(*KEY).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    key = [*KEY, "block"]
    left = index.join(sizes, KEY).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "tree")
    right = rows.join(sizes, KEY).withColumn("block", F.pmod(F.xxhash64("vec_id", "anchor"), F.col("blocks")).cast("int")).drop("blocks")

    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(asked):
            return pd.DataFrame({"vec_id": [], "anchor": [], "window": [], "found": [], "score": []}).astype(np.int64)
        owner = np.repeat(np.arange(len(asked)), asked["window"].map(len))
        flat = {c: np.concatenate(asked[c].to_list()) for c in ("window", "floor", "roof")}
        anchors = matrix(asked["x"], int(asked["dims"].iloc[0]))
        ids = asked["vec_id"].to_numpy(np.int64)
        found = Search(Tree.unpack(trees["tree"].iloc[0]), anchors, ids, asked["label"].to_numpy(np.int64), owner, flat["floor"], flat["roof"], same, k)
        found.run()
        at, place = np.nonzero(np.isfinite(found.score))
        return pd.DataFrame({
            "vec_id": ids[owner[at]], "anchor": asked["anchor"].to_numpy(np.int64)[owner[at]], "window": flat["window"][at].astype(np.int64),
            "found": found.found[at, place], "score": found.score[at, place].astype(np.int64),
        })

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "vec_id long, anchor long, window long, found long, score long")


def best_of(index: DataFrame, asked: DataFrame, root: dict, pivots: dict, same: bool, k: int, block_rows: int) -> DataFrame:
    """vec_id, anchor, window, found, score, rank: the ``k`` largest products in each window of each anchor.

    One shard near the anchor first raises the floors, then all others that still can hold a row are visited.
    """
    near = stored(searched(index, visits(asked, root, pivots, same, first=True), same, k, block_rows))
    risen = near.groupBy("vec_id", "anchor", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).where("least IS NOT NULL")
    known = risen.groupBy("vec_id", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("least"))
    raised = F.transform("window", lambda w, i: F.greatest(F.col("floor")[i], F.coalesce(F.col("least")[w].cast("double"), F.lit(float("-inf")))))
    narrowed = asked.join(known, ["vec_id", "anchor"], "left").withColumn("floor", F.when(F.col("least").isNull(), F.col("floor")).otherwise(raised)).drop("least")
    found = near.unionByName(searched(index, visits(narrowed, root, pivots, same, first=False), same, k, block_rows))
    order = Window.partitionBy("vec_id", "anchor", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    shard_rows: int = 4096, most_pivots: int = 64, teams: int = 8, block_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. A score is the inner product with the anchor of
    components floor(scale * x); higher ones come first, ties by the smaller vec_id. An anchor's positives are
    the first ``positives`` other rows of its label; the negatives of a pair are the first ``negatives`` rows of
    another label whose score is from ``low`` to ``high`` hundredths of the positive's. Exact, by the tree.

    Rows with a null id, label, vector or component, or one that is not finite, take no part; other columns are
    ignored. Vectors of another length are no candidates of an anchor; empty vectors score zero. A row that
    repeats whole counts once; rows that share an id but differ are rows of their own. A positive below zero has
    no negatives. An empty table gives no rows. Components too large for exact products raise an error.
    """
    rows = good(vectors)
    pivots = drawn_pivots(rows, shard_rows, most_pivots, scale)
    index = stored(build_index(rows, pivots, shard_rows, teams, scale))
    root = root_of(index)
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        "vec_id", F.xxhash64("label", "x").alias("anchor"), "label", F.pmod(F.xxhash64("label"), F.lit(teams)).cast("int").alias("team"), "dims",
        F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"),
    ).dropDuplicates(["vec_id", "anchor"])
    anchors = stored(anchors)
    open_ = anchors.withColumns({"window": F.array(F.lit(0).cast("long")), "floor": F.array(F.lit(float("-inf"))), "roof": F.array(F.lit(float("inf")))})
    liked = stored(best_of(index, open_, root, pivots, True, positives, block_rows).select(
        "vec_id", "anchor", F.col("rank").cast("long").alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # A floor of low/high hundredths in whole numbers: the score times 100 is at least low times the positive's.
    floor, roof = F.ceil(F.col("positive_score") * low / F.lit(100)), F.floor(F.col("positive_score") * high / F.lit(100))
    asked = liked.withColumns({"floor": floor.cast("double"), "roof": roof.cast("double")}).where("floor <= roof")
    listed = asked.groupBy("vec_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("window", "floor", "roof"))).alias("w"))
    wanted = anchors.join(listed, ["vec_id", "anchor"]).select(
        "vec_id", "anchor", "label", "team", "dims", "x", F.col("w.window").alias("window"), F.col("w.floor").alias("floor"), F.col("w.roof").alias("roof")
    )
    hard = best_of(index, wanted, root, pivots, False, negatives, block_rows)
    return hard.join(liked, ["vec_id", "anchor", "window"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def planted(vectors: DataFrame) -> DataFrame:
    """Labels as the query has them: the next of ten where vec_id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS alike,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM good a JOIN good c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
