"""Majority-class baseline: fit and predict are separate, so fit on train and apply to test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_fit(df: DataFrame, col: str) -> DataFrame:
    """One row (label, n): the most frequent label, ties by name.  Counts combine map-side."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "label").limit(1))


def majority_predict(df: DataFrame, model: DataFrame, out: str = "pred") -> DataFrame:
    """Constant prediction column; the one-row model is read as a scalar subquery, so ``df`` is only scanned."""
    return df.withColumn(out, model.select("label").scalar())
