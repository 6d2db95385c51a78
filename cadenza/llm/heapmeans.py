"""Centroid clustering with heap-ordered bounds: Lloyd's rounds in which few vectors are measured again.

Vectors lie in blocks. For every cluster a block keeps a heap of its vectors by their gap, the distance to
the second nearest centroid less that to the own one, with the drift added up until the gap was taken. A
round adds to the drift of a cluster how far its own centroid moved and the farthest that any other did. As
long as a gap is above its cluster's drift, the triangle inequality keeps the vector where it is; only
those popped from the top of the heap are measured against all centroids, exactly, in integers.

A round passes over the blocks where they lie. Of a block, only what its moved vectors change in the sums
of clusters is shuffled; the driver sees sums of clusters and centroids, never vectors.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored

#: Largest component for which sums of squares of 64 differences stay exact in 64 bits.
LARGEST = 1 << 27
#: Share of a bound that keeps rounding from hiding an expired gap.
SLACK = 1e-12


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer points (rows) to integer centroids, exact."""
    total = np.zeros((len(points), len(centroids)), np.int64)
    for j, centre in enumerate(centroids):
        gap = points.astype(np.int64) - centre
        total[:, j] = np.einsum("ij,ij->i", gap, gap)
    return total


def gaps(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its nearest centroid (ties: the smaller number), the squared distance and its gap."""
    d = squared(points, centroids)
    own = d.argmin(axis=1)
    rows = np.arange(len(d))
    best = d[rows, own]
    d[rows, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1, initial=np.iinfo(np.int64).max)) if d.shape[1] > 1 else np.full(len(d), np.inf)
    return own, best, second * (1 - SLACK) - np.sqrt(best) * (1 + SLACK)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a move of the centroids takes from the gaps of each cluster at most."""
    moved = np.array([np.sqrt(float(sum(int(x) ** 2 for x in row))) for row in after.astype(object) - before.astype(object)])
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
    return (moved + others) * (1 + SLACK)


class Block:
    """Ids, vectors, clusters and one heap of (gap, row) for each cluster; travels as bytes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, own: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.points, self.own, self.heaps = ids, points, own, heaps

    @classmethod
    def first(cls, ids: np.ndarray, points: np.ndarray, centroids: np.ndarray) -> Block:
        own, _, gap = gaps(points, centroids)
        block = cls(ids, points, own.astype(np.int32), [[] for _ in centroids])
        for row, (cluster, key) in enumerate(zip(own.tolist(), gap.tolist(), strict=True)):
            block.heaps[cluster].append((key, row))
        for heap in block.heaps:
            heapq.heapify(heap)
        return block

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Pops the vectors whose gap the drift has used up, measures those anew, and returns what changes in
        the clusters' sums: for each its components, then its count."""
        expired = []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[cluster]:
                expired.append(heapq.heappop(heap)[1])
        rows = np.array(expired, np.int64)
        change = np.zeros((len(centroids), self.points.shape[1] + 1), np.int64)
        if len(rows):
            own, _, gap = gaps(self.points[rows], centroids)
            for row, cluster, key in zip(expired, own.tolist(), (gap + drift[own]).tolist(), strict=True):
                heapq.heappush(self.heaps[cluster], (key, row))
            moved = own != self.own[rows]
            add_to(change, self.points[rows[moved]], own[moved], 1)
            add_to(change, self.points[rows[moved]], self.own[rows[moved]], -1)
            self.own[rows] = own
        self.measured = len(rows)
        return change

    def pack(self) -> bytes:
        keys = np.array([k for heap in self.heaps for k, _ in heap], np.float64)
        rows = np.array([r for heap in self.heaps for _, r in heap], np.int32)
        blob = io.BytesIO()
        np.savez(blob, ids=self.ids, points=self.points, own=self.own, keys=keys, rows=rows, ends=np.cumsum([len(h) for h in self.heaps]))
        return blob.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        kept = np.load(io.BytesIO(blob))
        pairs = list(zip(kept["keys"].tolist(), kept["rows"].tolist(), strict=True))
        starts = [0, *kept["ends"].tolist()]
        return cls(kept["ids"], kept["points"], kept["own"], [pairs[a:b] for a, b in zip(starts, starts[1:], strict=False)])


def add_to(sums: np.ndarray, points: np.ndarray, clusters: np.ndarray, sign: int) -> None:
    """Adds points (or takes them off) to the sums of their clusters, and their number to the last column."""
    for cluster in np.unique(clusters):
        some = points[clusters == cluster]
        sums[cluster, :-1] += sign * some.sum(axis=0, dtype=np.int64)
        sums[cluster, -1] += sign * len(some)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as the smallest integer type that holds all of them."""
    scaled = np.floor(scale * x.astype(np.float64))
    top = np.abs(scaled).max(initial=0)
    if top > LARGEST:
        raise ValueError(f"a component of {top / scale:g} is too large for exact squared distances in 64 bits")
    return scaled.astype(np.int8 if top <= 127 else np.int16 if top <= 32767 else np.int32)


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and x of the vectors that take part: ``dims`` components, none null or not finite, an id."""
    x: Column = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(x) == dims) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x")
    )


def summed(state: DataFrame) -> np.ndarray:
    """Sums of the blocks' changes, added up by Spark: one number for each cluster and component."""
    total = state.select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(len(total), object)
    out[total["at"].to_numpy()] = [int(v) for v in total["x"]]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part.

    Components become floor(scale * x). Centroids start as the ``k`` vectors with the smallest
    sha256 of ``seed:vec_id`` (all, if fewer; ids that repeat by their components) and are replaced ``rounds``
    times by the floored means of their vectors, an empty cluster keeping its own; then vectors are assigned
    once more. Distances are squared; ties go to the smaller number.

    Vectors that are null, of another length, or hold a null or a component that is not finite take no part,
    nor do rows without an id; rows that repeat count as often as they occur; other columns are ignored. An
    empty table gives no rows. Components past ``LARGEST`` raise an error. A block is one Arrow batch, some
    ten thousand vectors, so no task holds more, however the vectors are spread over clusters.
    """
    spark, rows = vectors.sparkSession, kept(vectors, dims)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(order, "x").limit(k).toPandas()
    if not len(starts):
        return spark.createDataFrame([], SCHEMA)
    centroids = whole_numbers(np.stack(starts["x"].to_list()), scale).astype(np.int64)
    width = len(centroids) * (dims + 1)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                points = whole_numbers(np.stack(pdf["x"].to_list()), scale)
                block = Block.first(pdf["vec_id"].to_numpy(np.int64), points, centroids)
                change = np.zeros((len(centroids), dims + 1), np.int64)
                add_to(change, points, block.own, 1)
                yield pd.DataFrame({"block": [block.pack()], "change": [change.ravel()], "measured": [len(pdf)]})

    state = stored(rows.mapInPandas(first, "block binary, change array<long>, measured long"))
    sums, drift = np.zeros(width, object), np.zeros(len(centroids))
    for turn in range(rounds):
        sums = sums + summed(state)
        table = sums.reshape(len(centroids), dims + 1)
        after = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else list(old) for row, old in zip(table, centroids, strict=True)], np.int64)
        drift, centroids = drift + drifts(centroids, after), after
        if turn < rounds - 1:
            following = stored(state.mapInPandas(advancing(centroids, drift), "block binary, change array<long>, measured long"))
            forget(state)
            state = following
    said = stored(state.mapInPandas(assigning(centroids, drift), "vec_id long, cluster int, distance long"))
    forget(state)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    # One row for each cluster, ``k`` at most.
    inertia = said.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).toPandas()
    whole = int(inertia["cluster_inertia"].sum())
    named = spark.createDataFrame(
        [(int(c), int(i), whole, digests[int(c)]) for c, i in zip(inertia["cluster"], inertia["cluster_inertia"], strict=True)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return said.join(F.broadcast(named), "cluster").select(*[f.split(" ")[0] for f in SCHEMA.split(", ")])


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def advancing(centroids: np.ndarray, drift: np.ndarray):
    """One round over blocks: pop, measure, push."""

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["block"]:
                block = Block.unpack(blob)
                change = block.advance(centroids, drift)
                yield pd.DataFrame({"block": [block.pack()], "change": [change.ravel()], "measured": [block.measured]})

    return advance


def assigning(centroids: np.ndarray, drift: np.ndarray):
    """The last assignment: vectors with their cluster and the exact squared distance to its centroid."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["block"]:
                block = Block.unpack(blob)
                block.advance(centroids, drift)
                gap = block.points.astype(np.int64) - centroids[block.own]
                yield pd.DataFrame({"vec_id": block.ids, "cluster": block.own, "distance": np.einsum("ij,ij->i", gap, gap)})

    return assign


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """SQL with one pair of steps for each round: assign, then floored means."""
    steps = [f"""WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM good ORDER BY h, v LIMIT {k})
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, cluster := cluster)) AS best
  FROM good, c{r} GROUP BY vec_id, v
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT cluster, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT best.cluster AS cluster, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL
  ) GROUP BY cluster
), c{r + 1} AS (SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN m{r} m USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, cluster::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, best, best.cluster AS cluster FROM a{rounds}) JOIN c{rounds} USING (cluster)"""


ORACLE = _oracle()
