"""Near-duplicate embeddings with randomised-rotation binary codes.

A unit vector o is turned by a random rotation; its code is the signs of the
result, and <code, o> is stored as its correction factor.  For a vector q,
<code, q> / <code, o> is an unbiased estimate of <o, q> whose error is bounded
with confidence by sqrt(1 - <code, o>^2) / <code, o> / sqrt(d - 1).  Only pairs
whose upper bound reaches the threshold are recomputed in double precision.

Pairs are sought in tables of sign bits of further rotations.  The number of
bits follows the number of vectors, so that chance collisions stay rare; the
number of tables follows from the recall wanted for pairs exactly at the
threshold.  A full bucket is dealt into blocks, and each pair of blocks is
compared by a task of its own: nothing is capped.  A pair counts in the first
table where it meets, so links are counted without writing pairs down.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import materialize, run_starts, runs
from textlabels.llm.components import connected_components

THRESHOLD = 0.95
MISSED = 0.005         # share of the pairs exactly at the threshold that no table may bring together
SPARE_BITS = 4         # bits of a table beyond log2 of the number of vectors
CONFIDENCE = 4.0       # standard deviations of the estimate's error that are allowed for
BLOCK = 256            # vectors of a bucket that one block holds
SEED = 20240


@functools.lru_cache(maxsize=8)
def rotation(dim: int, no: int) -> np.ndarray:
    """The ``no``-th random rotation of ``dim`` dimensions; the first one makes the codes."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, no)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(n: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int]:
    """(bits of a table, number of tables) for ``n`` vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + SPARE_BITS))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - meet))


@functools.lru_cache(maxsize=8)
def _planes(dim: int, count: int) -> np.ndarray:
    """(dim, count) directions: columns of rotations, so those of one rotation are orthogonal."""
    need = -(-count // dim)
    return np.concatenate([rotation(dim, 1 + i) for i in range(need)], axis=1)[:, :count]


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it links with nothing."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def keys_of(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket keys."""
    n, dim = units.shape
    positive = (units @ _planes(dim, bits * tables) > 0).reshape(n, tables, bits)
    return positive @ (1 << np.arange(bits, dtype=np.int64))


def code_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (+1, -1) of the rotated vectors, and the correction factors <code, o>."""
    turned = units @ rotation(units.shape[1], 0)
    signs = np.where(turned > 0, 1.0, -1.0)
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def candidate_pairs(units: np.ndarray, codes: np.ndarray, factor: np.ndarray, rows: slice, threshold: float) -> np.ndarray:
    """Which of ``rows`` x all vectors may reach the threshold: the bound of the estimate does."""
    dim = units.shape[1]
    estimate = (codes[rows] @ (units @ rotation(dim, 0)).T) / math.sqrt(dim) / factor[rows, None]
    error = np.sqrt(np.maximum(0, 1 - factor[rows] ** 2)) / factor[rows] / math.sqrt(max(dim - 1, 1))
    return estimate + CONFIDENCE * error[:, None] >= threshold


def _encode(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, v in zip(ids, vectors):
                u = unit(v)
                if i is not None and u is not None:
                    by_dim.setdefault(len(u), []).append((i, u))
            for dim, rows in by_dim.items():
                units = np.stack([u for _, u in rows])
                codes, factor = code_of(units)
                packed = np.packbits(codes > 0, axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in rows], pa.int64()), pa.array([dim] * len(rows), pa.int32()),
                    pa.array(units.tolist(), pa.list_(pa.float64())), pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.array(factor), pa.array(keys_of(units, bits, tables).tolist(), pa.list_(pa.int64()))],
                    names=["id", "dim", "unit", "code", "factor", "keys"])
    return run


def _compare(threshold: float):
    """Blocks of a bucket -> (id, links, other): numbers of new links, and edges that connect the linked vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["tab", "key", "dim", "i", "j"]):
            n = t.num_rows
            starts = run_starts([t.column(c).to_numpy() for c in ("tab", "key", "dim", "i", "j")])
            ends = np.append(starts[1:], n)
            many = np.flatnonzero(ends - starts > 1)
            if not len(many):
                continue
            ids, tab = t.column("id").to_numpy(), t.column("tab").to_numpy()
            side, bi, bj = (t.column(c).to_numpy() for c in ("block", "i", "j"))
            dims = t.column("dim").to_numpy()
            a_out, n_out, b_out = [], [], []
            for k in many:
                s, e = int(starts[k]), int(ends[k])
                part, dim = t.slice(s, e - s), int(dims[s])
                flat = lambda c: part.column(c).combine_chunks().flatten().to_numpy()
                units = flat("unit").reshape(-1, dim)
                keys = flat("keys").reshape(e - s, -1)
                codes = np.stack([np.unpackbits(np.frombuffer(x, np.uint8))[:dim] for x in part.column("code").to_pylist()]) * 2.0 - 1
                factor, who, first = part.column("factor").to_numpy(), ids[s:e], int(tab[s])
                own = side[s:e]
                count, edges = np.zeros(e - s, np.int64), []
                for at in range(0, e - s, 512):
                    rows = slice(at, min(at + 512, e - s))
                    may = candidate_pairs(units, codes, factor, rows, threshold)
                    x, y = np.nonzero(may)
                    x += at
                    # within one block each pair once; between two blocks across only
                    keep = (x < y) & (who[x] != who[y]) & ((bi[s] == bj[s]) | (own[x] != own[y]))
                    # both directions of the estimate are one decision: the other is covered by its own bound
                    x, y = x[keep], y[keep]
                    for p in range(0, len(x), 1 << 16):
                        xs, ys = x[p:p + (1 << 16)], y[p:p + (1 << 16)]
                        close = np.einsum("ij,ij->i", units[xs], units[ys]) >= threshold
                        xs, ys = xs[close], ys[close]
                        edges.append(np.stack([xs, ys]))
                        new = ~(keys[xs, :first] == keys[ys, :first]).any(axis=1)
                        np.add.at(count, xs[new], 1)
                        np.add.at(count, ys[new], 1)
                linked = np.flatnonzero(count)
                a_out.append(who[linked])
                n_out.append(count[linked])
                b_out.append(np.full(len(linked), -1))
                pairs = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
                tree = _forest(pairs, e - s)
                a_out.append(who[tree[:, 0]])
                n_out.append(np.zeros(len(tree), np.int64))
                b_out.append(who[tree[:, 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a_out).astype(np.int64)), pa.array(np.concatenate(n_out).astype(np.int64)),
                 pa.array(np.concatenate(b_out).astype(np.int64))], names=["id", "links", "other"])
    return run


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """(edges, 2): a spanning forest, by repeatedly taking the smallest label of a neighbour."""
    label = np.arange(n)
    while pairs.shape[1]:
        x, y = label[pairs[0]], label[pairs[1]]
        low = label.copy()
        np.minimum.at(low, x, y)
        np.minimum.at(low, y, x)
        new = low[label]
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(n))
    return np.stack([away, label[away]], axis=1)


def near_vectors(df: DataFrame, id_col: str, vector_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: which vectors have a cosine of at least ``threshold``.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do rows with a null id (their component_id is null,
    kept false) or vectors of different length.  Rows of one id do not link with
    each other; each row that repeats an id and its vector counts as one, rows of
    one id with different vectors add up.  No pair below the threshold is linked.
    Further columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bits, tables = table_plan(df.count(), threshold)
    coded = materialize(rows.distinct().mapInArrow(
        _encode(bits, tables), "id long, dim int, unit array<double>, code binary, factor double, keys array<long>"), "codes")
    places = coded.select("id", "dim", F.xxhash64("unit").alias("version"), F.posexplode("keys").alias("tab", "key"))
    bucket = ["tab", "key", "dim"]
    full = (places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
            .select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id", "version"), F.col("blocks")).cast("int")
    met = places.join(full, bucket).withColumn("block", own)
    # block b meets every block: as the left of (b, j) for j >= b, as the right of (i, b) for i < b
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("*", other.alias("with")).select(
        "id", "version", *bucket, "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    payload = coded.select("id", F.xxhash64("unit").alias("version"), "unit", "code", "factor", "keys")
    group = ["tab", "key", "dim", "i", "j"]
    compared = materialize(
        met.join(payload, ["id", "version"]).repartition(*group).sortWithinPartitions(*group, "id")
        .mapInArrow(_compare(threshold), "id long, links long, other long"), "links")
    counts = compared.where("links > 0").groupBy("id").agg(F.sum("links").alias("n_links"))
    component = connected_components(compared.where("links = 0"), "id", "other").withColumnRenamed("node", "id")
    known = df.select(F.col(id_col), F.col(id_col).cast("long").alias("id"))
    return (known.join(counts, "id", "left").join(component, "id", "left")
            .select(id_col, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
