"""Projections, filters and previews.  Narrow operators: nothing here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import is_blank
from textlabels.functions.constants import NEUTRAL


def strip_prefix(df: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
    """Keep ``keep`` plus every ``prefix*`` column, the latter renamed without the prefix."""
    renamed = [F.col(c).alias(c[len(prefix):]) for c in df.columns if c.startswith(prefix)]
    return df.select(*keep, *renamed)


def drop_blank_text(df: DataFrame, text: str, blank: bool = True) -> DataFrame:
    """Drop rows without text; ``blank=False`` drops nulls only."""
    return df.where(~is_blank(text) if blank else F.col(text).isNotNull())


def filter_labels(df: DataFrame, col: str, labels: Sequence[str] | DataFrame) -> DataFrame:
    """Keep rows whose label is listed.  A DataFrame of labels becomes a left-semi join."""
    if isinstance(labels, DataFrame):
        wanted = labels.select(F.col(labels.columns[0]).alias(col))
        return df.join(wanted, col, "left_semi")
    return df.where(F.col(col).isin(list(labels)))


def fill_label(df: DataFrame, col: str, default: str = NEUTRAL) -> DataFrame:
    """Create the label column, or fill its gaps."""
    value = F.coalesce(F.col(col), F.lit(default)) if col in df.columns else F.lit(default)
    return df.withColumn(col, value)


def mismatch_filter(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows whose prediction differs from gold; a missing prediction is a mismatch."""
    return df.where(~F.col(gold).eqNullSafe(F.col(pred)))


def preview(df: DataFrame, cols: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in a stated order (a top-k, not a full sort)."""
    return df.select(*dict.fromkeys([*cols, *order])).orderBy(*order).limit(n).select(*cols)
