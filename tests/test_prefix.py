import random

import pytest
from pyspark.sql import functions as F

from textlabels.operators import prefix as P


@pytest.mark.parametrize("blocks", [1, 4, 30])
def test_ranks_and_running_maxima_of_hot_groups(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([0, 0, 0, 1, 2, None]), i, rng.choice([None, float(rng.randint(0, 99))]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        best = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-1 if r[1] is None else r[1], r[2])), 1):
            want[r[2]] = (n, best)
            best = r[3] if best is None else best if r[3] is None else max(best, r[3])
    got = {r.i: r["rank"] for r in P.ranked(df, ["k"], ["t", "i"], blocks=blocks).collect()}
    assert got == {i: n for i, (n, _) in want.items()}
    got = {r.i: r.previous for r in P.running_max(df, ["k"], ["t", "i"], "v", blocks=blocks).collect()}
    assert got == {i: b for i, (_, b) in want.items()}


def test_equal_rows_are_dealt_out_and_keep_different_ranks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1).alias("t"))
    got = P.ranked(df, ["k"], ["t"], blocks=8)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 1001))
    blocks = P._in_blocks(df, ["k"], ["t"], 8).groupBy("_block").count().collect()
    assert len(blocks) >= 6 and max(b["count"] for b in blocks) < 400


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert P.ranked(df, ["k"], ["t"]).count() == 0 and P.running_max(df, ["k"], ["t"], "v").count() == 0
