"""Seeded splits and samples.

Rows are ordered by ``(md5(key:seed), key)``.  A split never sorts or shuffles
the rows: it finds the *cut value* that separates the parts and compares every
row with it, so the data pass is a scan plus a scalar comparison.

Finding the cut reads only the key column, twice:
  1. a histogram of the hash's upper 16 bits (<= 65,536 groups, combined
     map-side) tells which bucket holds the wanted rank;
  2. only the rows of that bucket (about 1/65,536 of the data) are ranked, and
     they are counted per key first, so repeated keys stay cheap.
Copies of one key always land in the same part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlabels.functions.columns import hash32

RANK_SEED = 42


def _position(key: str, seed: int) -> Column:
    return F.struct(hash32(key, F.lit(str(seed))).alias("h"), F.col(key).alias("key"))


def _cuts(df: DataFrame, key: str, seed: int, targets: Mapping[str, Column]) -> DataFrame:
    """One row with one struct ``(h, key)`` per target: the last row inside the first <target> rows.

    ``targets`` are expressions over ``n``, the row count.  A target of 0 gives null.
    """
    keyed = df.select(_position(key, seed).alias("pos")).withColumn("bucket", F.shiftright("pos.h", 16))

    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    histogram = (keyed.groupBy("bucket").agg(F.count("*").alias("rows"))
                      .withColumn("cum", F.sum("rows").over(upto))
                      .withColumn("n", F.sum("rows").over(whole)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                       for name, rank in targets.items()])
    start = F.col("cum") - F.col("rows")
    bounds = (histogram.withColumn("target", F.explode(wanted))
                       .where((F.col("target.rank") > start) & (F.col("target.rank") <= F.col("cum")))
                       .select("bucket", "target.name", (F.col("target.rank") - start).alias("need")))

    # bounds has at most one row per target
    inside = (keyed.join(F.broadcast(bounds), "bucket")
                   .groupBy("name", "need", "pos").agg(F.count("*").alias("copies")))
    running = (Window.partitionBy("name").orderBy("pos")
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("cum", F.sum("copies").over(running)).where(F.col("cum") >= F.col("need"))
    return found.agg(F.struct(*[
        F.min(F.when(F.col("name") == name, F.col("pos"))).alias(name) for name in targets]).alias("cuts"))


def _within(key: str, seed: int, cut: Column) -> Column:
    return F.coalesce(_position(key, seed) <= cut, F.lit(False))


def split_two(df: DataFrame, key: str, test: float = 0.2, seed: int = RANK_SEED, out: str = "split") -> DataFrame:
    """Exact two-way split: ``test`` gets ceil(n * test) rows, ``train`` the rest (unique keys)."""
    cuts = _cuts(df, key, seed, {"test": F.ceil(F.col("n") * F.lit(test))}).scalar()
    return df.withColumn(out, F.when(_within(key, seed, cuts["test"]), "test").otherwise("train"))


def split_three(df: DataFrame, key: str, test: float = 0.1, val: float = 0.1, seed: int = RANK_SEED,
                out: str = "split") -> DataFrame:
    """Exact three-way split: test off first, then validation = val / (1 - test) of the rest."""
    n_test = F.ceil(F.col("n") * F.lit(test))
    n_val = F.ceil((F.col("n") - n_test) * F.lit(val / (1 - test)))
    cuts = _cuts(df, key, seed, {"test": n_test, "validation": n_test + n_val}).scalar()
    return (df.withColumn("_cuts", cuts)
              .withColumn(out, F.when(_within(key, seed, F.col("_cuts.test")), "test")
                                .when(_within(key, seed, F.col("_cuts.validation")), "validation")
                                .otherwise("train"))
              .drop("_cuts"))


def split_hash(df: DataFrame, key: str, fractions: Mapping[str, float], rest: str = "train",
               seed: int = RANK_SEED, out: str = "split") -> DataFrame:
    """Approximate split, a pure projection: each part takes a range of the 32-bit hash."""
    h, upper, label = hash32(key, F.lit(str(seed))), 0.0, None
    for name, fraction in fractions.items():
        upper += fraction
        inside = h < F.lit(math.floor(upper * 2 ** 32))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return df.withColumn(out, F.lit(rest) if label is None else label.otherwise(rest))


def sample_n(df: DataFrame, key: str, n: int = 500, seed: int = RANK_SEED) -> DataFrame:
    """min(n, rows) rows, the same ones for the same seed; a top-k, not a sort."""
    return df.orderBy(hash32(key, F.lit(str(seed))), key).limit(n)
