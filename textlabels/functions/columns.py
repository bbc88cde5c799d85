"""Column -> Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(cols: Sequence[Column]) -> Column:
    """Row-wise sum of several columns."""
    return reduce(add, cols)


def hash32(*parts: str | Column) -> Column:
    """First 32 bits of md5 over the parts joined by ':', as a bigint.

    md5 is used (not xxhash) because every SQL engine has it, so a split or a
    sample can be reproduced outside Spark.
    """
    text = F.concat_ws(":", *[as_col(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# --- labels -----------------------------------------------------------------

def label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def multi_hot(ids: str | Column, n: int) -> Column:
    """array of label ids -> 0/1 array of size n (plain codegen, no lambda)."""
    return F.array(*[F.array_contains(as_col(ids), F.lit(j)).cast("int") for j in range(n)])


def passes(p: Column, threshold: float, inclusive: bool) -> Column:
    return p >= F.lit(threshold) if inclusive else p > F.lit(threshold)


def argmax(probs: str | Column) -> Column:
    """Index of the largest element; the lowest index wins a tie."""
    p = as_col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(n / F.when(d != 0, d))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 = 2tp / (2tp + fp + fn), 0 where undefined."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# --- text -------------------------------------------------------------------

def strip(c: str | Column) -> Column:
    """Trim every kind of ASCII white space on both sides."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def is_blank(c: str | Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return ~F.coalesce(as_col(c).rlike(r"\S"), F.lit(False))


def raw_tokens(c: str | Column) -> Column:
    """White-space tokens; empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(as_col(c), F.lit("")), r"\s+"), "")


def tokens(c: str | Column) -> Column:
    """Lower-cased white-space tokens; empty array for null or blank text."""
    return raw_tokens(F.lower(as_col(c)))


def explode_rows(df, keep, array, *names: str):
    """``keep`` columns + one row per array element (two names: position and element).

    The outer form plus a filter on the result gives the rows of a plain
    explode.  The plain form makes Catalyst add a ``size(array) > 0`` filter
    below, which would compute an expensive array (tokens of a text) twice.
    """
    generator = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    return df.select(*keep, generator.alias(*names)).where(F.col(names[0]).isNotNull())


def join_null_safe(left, right, keys, how: str = "inner"):
    """Join on ``keys`` where null meets null; the key columns come from the left side."""
    held = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    return left.join(held, on, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def without_nan(df, col: str):
    """NaN in a floating-point column becomes null, that is, missing."""
    kind = df.schema[col].dataType.simpleString()
    return df.withColumn(col, F.nanvl(F.col(col), F.lit(None).cast(kind))) if kind in ("double", "float") else df
