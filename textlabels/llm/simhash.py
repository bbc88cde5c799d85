"""SimHash near-duplicates, found with covering locality-sensitive hashing.

Two fingerprints within ``RADIUS`` bits of each other must share a bucket: the
64 bits are mapped to non-zero vectors m(i) of GF(2)^4, and the table of a
non-zero vector v keeps the bits with <m(i), v> = 1.  Three differing bits span
at most three dimensions, so some v is orthogonal to all of them, and its table
does not see the difference.  That makes 15 tables of 32 to 36 bits.

A bucket with more than ``BUCKET`` different fingerprints is not compared as a
whole: the same construction is applied to the bits its mask leaves free, again
without losing a pair.  After two refinements at most 8 bits are free, so a
bucket holds at most 256 fingerprints; that bound does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.llm.common import free_names, materialize, run_starts, tidy
from textlabels.llm.components import connected_components

RADIUS = 3
TABLES = 2 ** (RADIUS + 1) - 1
BUCKET = 512
LEVELS = 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15          # shingles whose bits are counted at a time


def covering_masks(bits: list[int]) -> list[int]:
    """The ``TABLES`` masks over the given bit positions; any ``RADIUS`` of the bits are all outside one of them."""
    vector = {bit: 1 + i % TABLES for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in vector.items() if bin(m & v).count("1") % 2) for v in range(1, TABLES + 1)]


def level_masks(level: int) -> np.ndarray:
    """Masks of a level: those of the level above, each with the masks over its free bits."""
    masks = [0]
    for _ in range(level):
        masks = [m | s for m in masks for s in covering_masks([b for b in range(64) if not m >> b & 1])]
    return np.array(masks, np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 if it has no words."""
    if not text:
        return 0
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > shingle:
        starts, ends = starts[:1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + _BLOCK].tolist(), ends[at:at + _BLOCK].tolist())],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        tidy()


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the different fingerprints of one bucket under "within the radius"."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
    waiting, edges = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & waiting)
            waiting[new] = False
            edges += [(at, int(x)) for x in new]
            front += new.tolist()
    return edges


def _sweep(level: int):
    """Sorted (tab, key, fp) batches -> edges (level 0), or rows of a full bucket for the next level."""
    names = ["level", "tab", "key", "fp", "other"]

    def out(lv, tab, key, fp, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(fp), lv), pa.int32()), pa.array(tab.astype(np.int32)), pa.array(key.view(np.int64)),
            pa.array(fp.view(np.int64)), pa.array(other.view(np.int64))], names=names)

    def refined(tab: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        masks = level_masks(level + 1)
        t = (tab.astype(np.int64)[:, None] * TABLES + np.arange(TABLES)).ravel()
        f = np.repeat(fp, TABLES)
        return out(level + 1, t, f & masks[t], f, f)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = None, None                  # rows of the unfinished bucket; its key once it is full
        for batch in batches:
            tab, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                tab, key, fp = (np.concatenate(x) for x in zip(held, (tab, key, fp)))
            starts = run_starts([tab, key])
            ends = np.append(starts[1:], len(tab))
            yield from groups(tab, key, fp, starts[:-1], ends[:-1], full)
            at = int(starts[-1])
            held, mine = (tab[at:], key[at:], fp[at:]), (int(tab[at]), int(key[at]))
            if len(starts) > 1 or full != mine:
                full = None
            if len(held[0]) > BUCKET or full == mine:
                yield refined(held[0], held[2].view(np.uint64))
                held, full = None, mine
        if held is not None:
            n = np.array([len(held[0])])
            yield from groups(*held, np.array([0]), n, full)

    def groups(tab, key, fp, starts, ends, full) -> Iterator[pa.RecordBatch]:
        sizes, fp = ends - starts, fp.view(np.uint64)
        rest = sizes > 1
        if len(starts) and full == (int(tab[0]), int(key[0])):
            yield refined(tab[:ends[0]], fp[:ends[0]])
            rest[0] = False
        two = starts[rest & (sizes == 2)]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS] if len(two) else two
        a, b = [fp[two]], [fp[two + 1]] if len(two) else [fp[:0]]
        for s, e in zip(starts[rest & (sizes > 2)], ends[rest & (sizes > 2)]):
            if e - s > BUCKET:
                yield refined(tab[s:e], fp[s:e])
            elif found := forest(fp[s:e]):
                pairs = np.array(found) + s
                a.append(fp[pairs[:, 0]])
                b.append(fp[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            z = np.zeros(len(a), np.int64)
            yield out(0, z, z, a, b)

    return sweep


def links(fps: DataFrame, col: str = "fp") -> DataFrame:
    """(fp, other): edges that connect all fingerprints within the radius of each other.

    ``fps`` holds each fingerprint once.  Every linked pair is compared in some
    bucket; of a bucket's links a spanning forest is kept.
    """
    spark = fps.sparkSession
    schema = "level int, tab int, key long, fp long, other long"
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col(col).bitwiseAND(F.lit(int(m))).alias("key"))
                       for i, m in enumerate(level_masks(1).view(np.int64))])
    rows = fps.select(F.col(col).alias("fp"), F.explode(tables).alias("t")).select("t.tab", "t.key", "fp")
    edges = None
    for level in range(1, LEVELS + 1):
        swept = materialize(rows.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
                            .mapInArrow(_sweep(level), schema), f"sweep{level}")
        found = swept.where("level = 0").select("fp", "other")
        edges = found if edges is None else edges.unionByName(found)
        rows = swept.where(f"level = {level + 1}").select("tab", "key", "fp")
        if level == LEVELS or rows.isEmpty():
            break
    return edges


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, component_id) for every row: which texts are near-copies of each other.

    Identical fingerprints are one node, however many rows have them.  A null or
    blank text has fingerprint zero and is linked like any other.  Rows that
    repeat an id are all returned.  A null id is never the smallest of its
    component; a component of null ids only has a null component_id.  Further
    columns are not read.
    """
    docs = materialize(df.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")), "simhash")
    nodes = materialize(docs.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    root = connected_components(links(nodes.select("fp")), "fp", "other")
    rooted = (nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` without those whose near-duplicate group has a smaller id; rows without an id stay."""
    name, = free_names(df.columns, "_gone")
    gone = (near_duplicates(df, id_col, text_col).where(F.col(id_col) != F.col("component_id"))
            .select(F.col(id_col).alias(name)).distinct())
    return df.join(gone, df[id_col] == F.col(name), "left_anti")
