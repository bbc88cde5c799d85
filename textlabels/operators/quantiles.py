"""Exact quantiles with linear interpolation by narrowing, and summaries that are stored and added to.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here a wanted rank is closed in round by round:

  1. an interval holds the ranks that are still open, at first the whole group;
  2. a KLL sketch of the interval's values names cut points around each open rank;
  3. the rows below, at and between the cuts are counted exactly (one small row a
     task and block).  A rank that falls on a cut is settled, the others go on with
     the open interval between two cuts.
Intervals of at most ``LIMIT`` rows are ordered, so what is ordered or dealt by
value does not grow with the input.  The sketch's error influences how many rounds
there are, never the result: a cut is a value of the data and leaves the interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlabels.functions.columns import join_null_safe, without_nan
from textlabels.sources.workspace import materialize

LIMIT = 100_000         # rows of an interval that are ordered
SKETCH = 4_000          # size of a sketch: ranks are off by less than a thousandth
GRID = 1_024            # ranks that a sketch is asked for


def _values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return without_nan(df, value).where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))


def quantile_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys`` + ``summary`` (binary): a sketch of a group's values; null and NaN values are ignored, null keys are a group.

    Summaries of several parts of a table are united (``unionByName``) and read
    together, so the summary of new rows is all that is computed when rows are added.
    """
    return _values(df, keys, value).groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("summary"))


def merge_summaries(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary a group out of those of its parts."""
    return summaries.groupBy(*keys).agg(F.kll_merge_agg_double("summary", F.lit(SKETCH)).alias("summary")).where("summary is not null")


def summary_quantiles(summaries: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys`` + ``n`` (exact) and ``q0, q1, ...``: values of the data whose ranks are off by less than n / 1000."""
    found = F.kll_sketch_get_quantile_double("summary", F.array(*[F.lit(float(p)) for p in probs]))
    return (merge_summaries(summaries, keys).select(*keys, F.kll_sketch_get_n_double("summary").alias("n"), found.alias("_q"))
            .select(*keys, "n", *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))]))


def _grid(summary: str) -> Column:
    """Values of a sketch at ``GRID + 1`` evenly spaced ranks."""
    return F.kll_sketch_get_quantile_double(summary, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))


def _cuts(places: DataFrame, grids: DataFrame, on: Sequence[str]) -> DataFrame:
    """``places`` with ``_cuts``: for each open rank four neighbouring values of the grid, in order."""
    at = lambda w: F.floor((w["rank"] - F.col("_offset")) / F.col("_size") * GRID).cast("int")
    near = lambda w: F.array(*[F.greatest(F.lit(0), F.least(F.lit(GRID), at(w) + d)) for d in (-1, 0, 1, 2)])
    index = F.array_distinct(F.flatten(F.transform("_wanted", near)))
    return (join_null_safe(places, grids, on)
            .withColumn("_cuts", F.array_sort(F.array_distinct(F.transform(index, lambda i: F.get("_grid", i))))).drop("_grid"))


def _inside(rows: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that lie in an open interval of their group, with its columns; the intervals of a group are disjoint."""
    return join_null_safe(rows, places, keys).where(
        (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high"))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    summaries: DataFrame | None = None) -> DataFrame:
    """``keys`` + ``q0, q1, ...`` (double), one per entry of ``probs``; null and NaN values are ignored, null keys are a group.

    ``summaries`` (see ``quantile_summary``) of these rows, or of most of them, save
    the first sketch; the result does not depend on them.
    """
    names, keys = list(keys), [f"_k{i}" for i in range(max(1, len(keys)))]
    renamed = [F.col(n).alias(k) for n, k in zip(names, keys)] or [F.lit(0).alias("_k0")]      # without keys all rows are one group
    rows = _values(df, names, value).select(*renamed, "_v")
    ranks = F.array(*[F.struct(F.lit(s).alias("slot"), r.cast("bigint").alias("rank")) for i, p in enumerate(probs) for s, r in (
        (2 * i, F.floor(F.lit(p) * (F.col("_n") - 1))), (2 * i + 1, F.ceil(F.lit(p) * (F.col("_n") - 1))))])
    nothing = F.lit(None).cast("double")
    sizes = [F.count("*").alias("_n")]
    if summaries is None:                       # the first sketch comes with the count
        sizes.append(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("summary"))
    groups = materialize(rows.groupBy(*keys).agg(*sizes), "groups")
    first = groups if summaries is None else merge_summaries(summaries, names).select(*renamed, "summary")
    # _offset rows of the group lie below the interval, _size in it; which of several it is: _id
    places = groups.select(*keys, "_n", F.lit(0).alias("_id"), nothing.alias("_low"), nothing.alias("_high"),
                           F.lit(0).cast("bigint").alias("_offset"), F.col("_n").alias("_size"), ranks.alias("_wanted"))
    settled = []
    small = places.where(F.col("_size") <= LIMIT)
    while True:
        wide = places.where(F.col("_size") > LIMIT)
        if wide.isEmpty():
            break
        if first is None:
            grids = (_inside(rows, wide, keys).groupBy(*keys, "_id").agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"))
                     .select(*keys, "_id", _grid("_s").alias("_grid")))
            cut = _cuts(wide, grids, [*keys, "_id"])
        else:
            cut, first = _cuts(wide, first.select(*keys, _grid("summary").alias("_grid")), keys), None
        cut = materialize(cut, "cuts")
        # groups that the summaries do not know stay as they are for the next round
        later = wide.join(cut.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("_id").alias("_r")),
                          _all_equal(keys) & (F.col("_id") == F.col("_r")), "left_anti")
        at = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        blocks = _inside(rows, cut, keys).select(*keys, "_id", at.alias("_at")).groupBy(*keys, "_id", "_at").agg(F.count("*").alias("_held"))
        before = Window.partitionBy(*keys, "_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)      # at most 8 * probs + 1 rows
        i = F.floor(F.col("_at") / 2).cast("int")
        found = (join_null_safe(cut, blocks, [*keys, "_id"])
                 .withColumn("_offset", F.col("_offset") + F.coalesce(F.sum("_held").over(before), F.lit(0)))
                 .withColumn("_wanted", F.filter("_wanted", lambda w: (w["rank"] >= F.col("_offset"))
                                                 & (w["rank"] < F.col("_offset") + F.col("_held"))))
                 .where(F.size("_wanted") > 0)
                 .withColumn("_hit", F.when(F.col("_at") % 2 == 1, F.get("_cuts", i)))
                 .withColumn("_low", F.when(i > 0, F.get("_cuts", i - 1)).otherwise(F.col("_low")))
                 .withColumn("_high", F.coalesce(F.get("_cuts", i), F.col("_high"))))
        found = materialize(found, "found")
        settled.append(found.where("_hit is not null").select(*keys, "_n", F.explode("_wanted.slot").alias("_slot"), F.col("_hit").alias("_v")))
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("_offset")).cast("int")                   # at most 2 * probs rows
        next_ = found.where("_hit is null").select(*keys, "_n", "_low", "_high", "_offset", F.col("_held").alias("_size"), "_wanted")
        later = later.select(*next_.columns)
        places = materialize(next_.unionByName(later).withColumn("_id", number), "places")
        small = small.unionByName(places.where(F.col("_size") <= LIMIT).select(*small.columns))

    counts = _inside(rows, small, keys).groupBy(*keys, "_n", "_offset", "_wanted", "_v").agg(F.count("*").alias("_copies"))
    running = Window.partitionBy(*keys, "_offset").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_offset") + F.sum("_copies").over(running)
    ordered = counts.withColumn("_upto", upto).select(*keys, "_n", F.explode(F.transform(F.filter(
        "_wanted", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_copies"))),
        lambda w: w["slot"])).alias("_slot"), "_v")
    for part in settled:
        ordered = ordered.unionByName(part)
    picked = ordered.groupBy(*keys, "_n").agg(*[F.max(F.when(F.col("_slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(probs))])

    def interpolated(i: int, p: float) -> Column:
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        return (low + (high - low) * (position - F.floor(position))).alias(f"q{i}")

    return picked.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], *[interpolated(i, p) for i, p in enumerate(probs)])


def _all_equal(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return same
