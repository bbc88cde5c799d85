"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import materialize


def _canonical(edges: DataFrame) -> DataFrame:
    return (edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())


def _to_the_end(hooks: DataFrame) -> DataFrame:
    """Every node hooked to the last node of its chain of hooks; the length of the chain at least halves with each join."""
    while True:
        for _ in range(2):
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hooks = (hooks.join(up, "to", "left")
                     .select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        hooks = materialize(hooks, "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.select("node", "to")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that is not that smallest one itself.

    Each round hooks every node to its smallest neighbour (one map-side combined
    minimum), follows the chains of hooks to their ends and contracts the edges.
    A hooked node has no edges afterwards, so it is hooked in one round only.  A
    node with an edge is hooked or has a node hooked to it, so the nodes that still
    have edges at least halve in each round.  Nothing reaches the driver but the
    answers to "are edges left" and "are chains left".  Null ends and loops are no edges.
    """
    left = materialize(_canonical(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        hooks = _to_the_end(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")))
        rounds.append(hooks)
        of_hi = hooks.select(F.col("node").alias("hi"), F.col("to").alias("b"))
        of_lo = hooks.select(F.col("node").alias("lo"), F.col("to").alias("a"))
        moved = left.join(of_hi, "hi").join(of_lo, "lo", "left").select(F.coalesce("a", "lo").alias("a"), "b")
        left = materialize(_canonical(moved), "edges")
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    found = rounds[-1].select("node", F.col("to").alias("component"))
    for hooks in reversed(rounds[:-1]):
        final = found.select(F.col("node").alias("to"), "component")
        found = (hooks.join(final, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
                 .unionByName(found))
    return found
