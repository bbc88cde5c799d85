"""Descriptive aggregations.  Group-bys combine map-side, so few or hot keys do not skew them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.functions.constants import LABELS28
from textlabels.functions.columns import join_null_safe, label_array, without_nan
from textlabels.operators.metrics import label_table
from textlabels.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def value_counts(df: DataFrame, cols: Sequence[str], sort: str = "count", n: int | None = None) -> DataFrame:
    """Counts per value (or per combination), by count descending or by key; optionally the first n."""
    if sort not in ("count", "key"):
        raise ValueError("sort must be 'count' or 'key'")
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    keys = [F.asc(c) for c in cols]
    counts = counts.orderBy(*keys) if sort == "key" else counts.orderBy(F.desc("n"), *keys)
    return counts if n is None else counts.limit(n)


def label_distribution(df: DataFrame, col: str, labels: Sequence[str] = LABELS28,
                       min_count: int | None = None) -> DataFrame:
    """Positives and percent of rows per label, from an id list; ``min_count=1`` hides labels that never occur.
    """
    rows = df.agg(F.count("*")).scalar()
    counts = df.select(F.explode(col).alias("label_id")).groupBy("label_id").agg(F.count("*").alias("found"))
    names = label_table(df, labels)
    out = names.join(counts, "label_id", "left").select(
        "label_id", "label", F.coalesce("found", F.lit(0)).alias("positives")).withColumn(
        "pct", F.col("positives") * 100.0 / F.nullif(rows, F.lit(0)))
    return out if min_count is None else out.where(F.col("positives") >= min_count)


def mean_probs(df: DataFrame, probs: str, labels: Sequence[str] = LABELS28, minimum: float = 0.01) -> DataFrame:
    """Mean probability per label, labels at or below ``minimum`` dropped.

    Probabilities are added as decimals of 15 digits, so the mean does not depend on the order of the rows.
    """
    return (df.select(F.posexplode(probs).alias("label_id", "p"))
              .groupBy("label_id").agg((F.sum(F.col("p").cast("decimal(38,15)")).cast("double") / F.count("p")).alias("mean_prob")).where(F.col("mean_prob") > minimum)
              .select("label_id", F.get(label_array(labels), F.col("label_id")).alias("label"), "mean_prob"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """One row: count, mean, sample std, min, quartiles (linear interpolation), max; NaN counts as missing.

    The column is read several times; if it is derived from long texts, write it to a table first.
    """
    df = without_nan(df, col)
    moments = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                     F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    quart = exact_quantiles(df, [], col, QUARTILES).agg(
        F.struct(F.max("q0").alias("q0"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))).scalar()
    return moments.withColumn("q", quart).select(
        "count", "mean", "std", "min", F.col("q.q0").alias("q25"), F.col("q.q1").alias("q50"),
        F.col("q.q2").alias("q75"), "max")


def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean value per key, ascending; NaN counts as missing."""
    df = without_nan(df, value)
    return df.groupBy(key).agg(F.avg(value).alias("mean_value")).orderBy("mean_value", key)


def top_n_values(df: DataFrame, col: str, n: int = 15) -> DataFrame | None:
    """The n most frequent values; None when the table has no such column."""
    return value_counts(df, [col], n=n) if col in df.columns else None


def split_stats(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per split and per (split, label)."""
    per_label = df.groupBy(split, label).agg(F.count("*").alias("n"))
    totals = per_label.groupBy(split).agg(F.sum("n").alias("split_rows"))
    return join_null_safe(per_label, totals, [split])


def grouped_accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Correct predictions, rows and their ratio per gold label."""
    ok = F.col(gold).eqNullSafe(F.col(pred))
    return df.groupBy(gold).agg(F.count_if(ok).alias("correct"), F.count("*").alias("n"),
                                F.avg(ok.cast("double")).alias("accuracy"))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins from min to max; the last bin is closed, empty bins are listed with 0."""
    df = without_nan(df, col)
    value = F.col(col).cast("double")
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(
        F.struct("lo", ((F.col("hi") - F.col("lo")) / bins).alias("w")).alias("e"))
    rows = df.where(F.col(col).isNotNull()).select(value.alias("v")).withColumn("e", edges.scalar())
    raw = F.when(F.col("e.w") > 0, F.floor((F.col("v") - F.col("e.lo")) / F.nullif(F.col("e.w"), F.lit(0.0)))).otherwise(F.lit(0))
    counts = rows.groupBy(F.least(raw, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").withColumn("e", edges.scalar()).select(
        "bin", (F.col("e.lo") + F.col("bin") * F.col("e.w")).alias("left_edge"),
        (F.col("e.lo") + (F.col("bin") + 1) * F.col("e.w")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group; a null key is a group, a group without values has nulls."""
    df = without_nan(df, value)
    quart = exact_quantiles(df, [key], value, QUARTILES)
    ends = df.groupBy(key).agg(
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
        F.count(value).alias("n"))
    return join_null_safe(ends, quart, [key], "left").select(
        key, "n", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def profile(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
                 F.col(f"c{i}").alias("non_null")) for i, (name, kind) in enumerate(df.dtypes)])).alias("r")).select("r.*")
