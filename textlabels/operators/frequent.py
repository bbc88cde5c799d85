"""Frequent tokens by a mergeable summary and an exact recount of the candidates.

Each task keeps at most ``held`` counters.  When it has more, the ``held + 1``-th
largest count is taken off all of them, and counters that reach zero go; what was
taken off is added up as the task's debt.  So for every token

    kept(token) <= count(token) <= kept(token) + debt,

summed over the tasks of any part of the corpus; summaries of further parts are
added by ``unionByName``.  Let T be the k-th largest ``kept`` total.  At least k
tokens have a count of T or more, so a token among the first k (ties included) has
``kept + debt >= T``.  These are the candidates; only they are counted again.  If
the debt reaches T, a token without a counter could be among the first k, and all
tokens are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import explode_rows, tokens
from textlabels.functions.constants import BROADCAST_BYTES, ROW_BYTES
from textlabels.sources.workspace import materialize

HELD = 1 << 17          # counters of one task


def _reduced(table: pa.Table, held: int) -> tuple[pa.Table, int]:
    """At most ``held`` counters of ``table``, and what was taken off each."""
    if table.num_rows <= held:
        return table, 0
    counts = table.column("kept").to_numpy()
    off = int(np.partition(counts, len(counts) - held - 1)[len(counts) - held - 1])
    left = table.set_column(1, "kept", pa.array(counts - off))
    return left.filter(pc.greater(left.column("kept"), 0)), off


def _counters(held: int):
    """Batches of token arrays -> counters of the task, and one row without a token that holds its debt."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, debt = pa.table({"token": pa.array([], pa.string()), "kept": pa.array([], pa.int64())}), 0
        for batch in batches:
            found = pc.list_flatten(batch.column(0)).value_counts()
            new = pa.table({"token": found.field("values").cast(pa.string()), "kept": found.field("counts").cast(pa.int64())})
            both = pa.concat_tables([mine, new]).group_by("token").aggregate([("kept", "sum")])
            mine, off = _reduced(both.select(["token", "kept_sum"]).rename_columns(["token", "kept"]), held)
            debt += off
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([debt], pa.int64())], names=["token", "kept"])
        yield from mine.to_batches()
    return count


def token_summary(df: DataFrame, col: str, held: int = HELD) -> DataFrame:
    """``(token, kept)``: one summary of the tokens of ``df``; the row without a token holds the debt.

    A task sends at most ``held`` counters and one row, whatever it reads; only these are shuffled.
    """
    rows = df.select(tokens(col).alias("_tokens")).mapInArrow(_counters(held), "token string, kept bigint")
    return rows.groupBy("token").agg(F.sum("kept").cast("bigint").alias("kept"))


def frequent_tokens(df: DataFrame, col: str, k: int, specials: list[str] | None = None, summaries: DataFrame | None = None,
                    held: int = HELD) -> DataFrame:
    """``(token, freq)``: at least the ``k`` most frequent tokens of ``df`` with their exact counts, ties with the k-th included.

    ``summaries`` are those of all parts of ``df`` (see ``token_summary``); left out, one
    is made.  Tokens in ``specials`` do not count.  The result may hold more than ``k`` tokens.
    """
    special = F.col("token").isin(specials or [])
    made = token_summary(df, col, held) if summaries is None else summaries
    summary = materialize(made.groupBy("token").agg(F.sum("kept").cast("bigint").alias("kept")), "summary")
    debt = summary.where("token is null").agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]
    counters = summary.where(F.col("token").isNotNull() & ~special)
    if not debt:
        return counters.select("token", F.col("kept").alias("freq"))                 # nothing was taken off: these are the counts
    if k < 1:
        return counters.select("token", F.col("kept").alias("freq")).limit(0)
    top = counters.select("kept").orderBy(F.desc("kept")).limit(k)
    bound = top.agg(F.min("kept").alias("t"), F.count("*").alias("n")).first()
    words = explode_rows(df, [], tokens(col), "token").where(~special)
    if bound.n == k and bound.t > debt:
        chosen = counters.where(F.col("kept") + debt >= bound.t).select("token")
        size = chosen.agg(F.coalesce(F.sum(F.octet_length("token") + ROW_BYTES), F.lit(0))).first()[0]
        words = words.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, "token", "left_semi")
    return words.groupBy("token").agg(F.count("*").alias("freq"))
