"""Running values along an order, for groups of any size.

A window over a group works in one task.  Here the rows are range-partitioned in
the wanted order, so a group that holds a third of them lies in many blocks, and
equal places in the order are split too.  Within a block a window does the work;
what the earlier blocks of a group add is carried in from a table of block totals.
Only the group that a block begins with can have earlier blocks, so that table has
at most one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlabels.functions.columns import join_null_safe
from textlabels.sources.workspace import materialize


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    """``df`` written in the order of ``keys, order``, with ``_at`` (place in that order) and ``_block``.

    Rows that are equal in both go by their place in ``df``.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_tie"]
    in_order = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie")
                .withColumn("_at", F.monotonically_increasing_id()))
    return materialize(in_order, "in-order").withColumn("_block", F.shiftright("_at", 33))


def _carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, local: Callable[[Window], Column], total: Column,
             merge: Callable[[str], Column], join: Callable[[Column, Column], Column], blocks: int | None) -> DataFrame:
    rows = _in_blocks(df, keys, order, blocks)
    within = Window.partitionBy("_block", *keys).orderBy("_at")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy("_block", *keys).agg(total.alias("_total")).withColumn("_carry", merge("_total").over(before))
             .where(F.col("_carry").isNotNull()).drop("_total"))
    done = join_null_safe(rows.withColumn("_local", local(within)), F.broadcast(carry), ["_block", *keys], "left")     # at most a row a block
    return done.withColumn(out, join(F.col("_local"), F.col("_carry"))).drop("_at", "_block", "_local", "_carry")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank", blocks: int | None = None) -> DataFrame:
    """Adds the place of each row in its group, from 1; equal rows get different places.  Null keys are a group."""
    return _carried(df, keys, order, out, lambda w: F.row_number().over(w), F.count("*"), F.sum,
                    lambda here, carry: here + F.coalesce(carry, F.lit(0)), blocks)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "previous",
                blocks: int | None = None) -> DataFrame:
    """Adds the largest ``value`` of the rows before this one in its group; null where there is none.  Null keys are a group."""
    return _carried(df, keys, order, out, lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(value), F.max,
                    lambda here, carry: F.greatest(here, carry), blocks)
