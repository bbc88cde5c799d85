"""Centroid clustering: integer k-means whose nearest centroids come from a vantage-point tree.

Every round builds a vantage-point tree over the centroids on the driver and
broadcasts it (k vectors, whatever the size of the input).  Each vector walks it
best first: of its open nodes the one with the smallest possible distance is
next, and the walk ends when that distance exceeds the best found.  The radius is
inclusive, so a centroid that ties with the best is still seen and the smaller
number wins.  Distances are exact integers; the floating bounds are widened by
more than their rounding error.  All vectors of a block take their steps together
in numpy, each along its own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import materialize, tidy

LARGEST = 1 << 27              # with 64 components of this size a squared distance still fits a long
LEAF = 3                       # centroids of a leaf
BLOCK = 4096                   # vectors that walk the tree together
SLACK = 2.0 ** -48

Tree = list[tuple[np.ndarray, list[tuple[float, float, int]]]]


def build_tree(points: np.ndarray) -> Tree:
    """Nodes (centroids met there, [(least, largest distance of the first centroid to the child's, child)])."""
    nodes: Tree = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append((members, []))
        if len(members) > LEAF:
            far = np.argmax(squared(points[members[:1]], points[members])[0])
            vantage, rest = members[far], np.delete(members, far)
            away = np.sqrt(squared(points[[vantage]], points[rest])[0].astype(float))
            order = np.argsort(away, kind="stable")
            halves = [order[:len(order) // 2], order[len(order) // 2:]]
            nodes[at] = (np.array([vantage]), [(away[h].min(), away[h].max(), grow(np.sort(rest[h]))) for h in halves])
        return at

    grow(np.arange(len(points)))
    return nodes


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.stack([((a - point) ** 2).sum(1) for point in b], 1)


def nearest(vectors: np.ndarray, points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every vector; of equally near ones the smallest number."""
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    who = np.full(len(vectors), len(points))
    bound = np.full((len(vectors), len(tree)), np.inf)          # least possible distance below a node, inf when it is not open
    bound[:, 0] = 0
    walking = np.arange(len(vectors))
    while len(walking):
        pick = bound[walking].argmin(1)
        low = bound[walking, pick]
        on = low <= np.sqrt(best[walking].astype(float)) * (1 + SLACK)
        walking, pick, low = walking[on], pick[on], low[on]
        bound[walking, pick] = np.inf
        for node in np.unique(pick):
            here = pick == node
            rows, least = walking[here], low[here]
            members, children = tree[node]
            away = squared(vectors[rows], points[members])
            column = away.argmin(1)
            d, c = away[np.arange(len(rows)), column], members[column]
            better = (d < best[rows]) | (d == best[rows]) & (c < who[rows])
            best[rows[better]], who[rows[better]] = d[better], c[better]
            root = np.sqrt(away[:, 0].astype(float))
            for near, far, child in children:
                bound[rows, child] = np.maximum(least, np.maximum(near - root, root - far) - SLACK * (root + far))
    return who, best


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v): components as integers floor(scale * x), of the vectors with ``dim`` components, all finite."""
    def finite(x):
        return F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))

    v = F.col(vector_col)
    kept = df.where(F.coalesce((F.size(v) == dim) & F.forall(v, finite), F.lit(False)))
    scaled = kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    too_large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return scaled.select("id", F.when(too_large, F.raise_error(F.lit(f"components beyond {LARGEST}: distances do not fit a long")))
                         .otherwise(F.col("v")).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed`` and their id, in that order; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def moved(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each cluster's vectors, an empty cluster's centroid as it is.

    A task sends one sum per (cluster, component) and a count; the driver gets k * (dim + 1) totals.
    """
    k, dim = points.shape
    shared = vectors.sparkSession.sparkContext.broadcast((points, build_tree(points)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = shared.value
        total = np.zeros((k, dim + 1), np.int64)
        for _, block in _blocks(batches, dim):
            cluster, _ = nearest(block, own, tree)
            for c in np.unique(cluster):
                members = block[cluster == c]
                total[c, :dim] += members.sum(0)
                total[c, dim] += len(members)
        used = np.repeat(total[:, dim] > 0, dim + 1)
        cells = np.arange(k * (dim + 1))[used]
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(cells // (dim + 1)), pa.array(cells % (dim + 1)), pa.array(total.ravel()[used])],
                                         names=["cluster", "place", "total"])

    rows = (vectors.select("v").mapInArrow(sums, "cluster long, place long, total long")
            .groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect())
    shared.unpersist()
    total = {(r.cluster, r.place): r.total for r in rows}
    return np.array([[total[c, i] // total[c, dim] for i in range(dim)] if (c, dim) in total else points[c] for c in range(k)], np.int64)


def cluster(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256,
            seed: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Kept are vectors with exactly ``dim`` components, none null or non-finite;
    other rows have no row in the result, and an empty table gives an empty one.
    Rows that repeat an id or a vector are vectors of their own; first centroids
    with one digest are ordered by their components.  With fewer than ``k`` vectors
    there are as many centroids as vectors.  Further columns are not read.  A
    component beyond 2^27 after scaling is an error, since its distances fit no long.

    The integer vectors are written once; each round reads them and returns sums
    only.  What is broadcast or reaches the driver is bounded by k * (dim + 1)
    numbers a round.
    """
    spark = df.sparkSession
    vectors = materialize(whole_vectors(df, id_col, vector_col, dim, scale), "vectors")
    points = first_centroids(vectors, k, seed)
    kind = df.schema[id_col].dataType.simpleString()
    if not len(points):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        points = moved(vectors, points)
    shared = spark.sparkContext.broadcast((points, build_tree(points)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = shared.value
        for part, block in _blocks(batches, dim):
            number, distance = nearest(block, own, tree)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number, pa.int32()), pa.array(distance)],
                                             names=["id", "cluster", "distance"])
        tidy()

    assigned = materialize(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c in inertia]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(of_cluster), "cluster")       # k rows
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
