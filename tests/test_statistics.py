import random

import numpy as np
import pytest

from textlabels.operators import statistics as A
from textlabels.operators import quantiles as Q

CASES = {
    "one": [3.0], "two": [1.0, 2.0], "constant": [5.0] * 40, "heavy value": [1.0] * 300 + [float(i) for i in range(600)],
    "outlier": [random.Random(1).random() for _ in range(500)] + [1e12], "negative": [-1.5, -7.0, 0.0, -0.25, 3.0],
    "ints": [float(random.Random(2).randint(0, 20)) for _ in range(777)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("limit,sketch,grid", [(100_000, 4_000, 1_024), (3, 8, 4)])
def test_exact_quantiles_whatever_the_sketch_and_the_limit(spark, monkeypatch, name, limit, sketch, grid):
    for setting, value in (("LIMIT", limit), ("SKETCH", sketch), ("GRID", grid)):
        monkeypatch.setattr(Q, setting, value)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(v,) for v in CASES[name]] + [(None,)], "v double")
    assert list(Q.exact_quantiles(df, [], "v", probs).first()) == pytest.approx(np.quantile(CASES[name], probs))


def test_quantiles_by_narrowing_order_few_rows_of_hot_groups(spark, monkeypatch):
    """Two hot groups, one of them null: several rounds, and what is ordered in the end is bounded for each wanted rank."""
    monkeypatch.setattr(Q, "LIMIT", 50)
    monkeypatch.setattr(Q, "SKETCH", 200)
    monkeypatch.setattr(Q, "GRID", 32)
    held, inside = [], Q._inside
    monkeypatch.setattr(Q, "_inside", lambda rows, places, keys: held.append(inside(rows, places, keys)) or held[-1])
    df = spark.range(90_000).selectExpr("nullif(id % 2, 1) as k", "if(id % 6 < 2, 7.0, pmod(hash(id), 100003) / 7) as v").repartition(6)
    df = df.unionByName(spark.createDataFrame([(5, 1.0), (5, float("nan")), (6, None)], "k long, v double"))
    got = {r.k: list(r)[1:] for r in Q.exact_quantiles(df, ["k"], "v", [0.05, 0.5, 0.9]).collect()}
    values = {}
    for r in df.collect():
        if r.v is not None and r.v == r.v:
            values.setdefault(r.k, []).append(r.v)
    assert got.keys() == values.keys() and all(got[k] == pytest.approx(np.quantile(values[k], [0.05, 0.5, 0.9])) for k in values)
    assert len(held) >= 4 and held[-1].count() <= 2 * 6 * 50          # rounds of a sketch and a count, then the rows that are ordered


def test_summaries_are_added_to_and_place_the_first_cuts(spark, monkeypatch):
    monkeypatch.setattr(Q, "LIMIT", 100)
    df = spark.range(60_000).selectExpr("id % 3 as k", "pmod(hash(id), 99991) / 3 as v")
    old, new = df.where("v < 20000 and k < 2"), df.where("not (v < 20000 and k < 2)")
    stored = Q.quantile_summary(old, ["k"], "v").unionByName(Q.quantile_summary(new, ["k"], "v"))
    probs = [0.0, 0.25, 0.5, 0.99]
    exact = {r.k: list(r)[1:] for r in Q.exact_quantiles(df, ["k"], "v", probs).collect()}
    values = {k: np.sort([r.v for r in df.where(f"k = {k}").collect()]) for k in range(3)}
    for r in Q.summary_quantiles(stored, ["k"], probs).collect():
        assert r.n == len(values[r.k])
        for p, q in zip(probs, list(r)[2:]):
            assert abs(np.searchsorted(values[r.k], q) - p * r.n) <= r.n / 1000 + 1
    for part in (stored, Q.quantile_summary(old, ["k"], "v"), Q.quantile_summary(df.limit(0), ["k"], "v")):
        assert {r.k: list(r)[1:] for r in Q.exact_quantiles(df, ["k"], "v", probs, part).collect()} == exact
    assert all(exact[k] == pytest.approx(np.quantile(values[k], probs)) for k in exact)
    assert Q.quantile_summary(df.limit(0), [], "v").count() == 1 and Q.summary_quantiles(Q.quantile_summary(df.limit(0), [], "v"), [], probs).count() <= 1


def test_box_stats_per_group(spark):
    rows = [(k, v) for k, values in CASES.items() for v in values]
    got = {r.k: r for r in A.box_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for k, values in CASES.items():
        r = got[k]
        assert [r.n, r["min"], r["max"]] == [len(values), min(values), max(values)]
        assert [r.q25, r.q50, r.q75] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]))


def test_describe(spark):
    values = CASES["ints"]
    r = A.describe(spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v int"), "v").first()
    assert list(r) == pytest.approx([len(values), np.mean(values), np.std(values, ddof=1), min(values),
                                     *np.quantile(values, [0.25, 0.5, 0.75]), max(values)])


def test_histogram_matches_numpy_and_closes_the_last_bin(spark):
    values = [float(v) for v in range(0, 81)]
    rows = sorted(A.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 40).collect())
    assert [r.n for r in rows] == list(np.histogram(values, 40)[0])
    same = A.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in same] == [3, 0, 0, 0]


def test_counts(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("c", 1)], "k string, s int")
    assert [tuple(r) for r in A.value_counts(df, ["k"]).collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert [tuple(r) for r in A.value_counts(df, ["k"], sort="key", n=2).collect()] == [("a", 1), ("b", 2)]
    assert A.top_n_values(df, "Speaker") is None
    assert [r.k for r in A.top_n_values(df, "k", 1).collect()] == ["b"]
    assert {tuple(r) for r in A.split_stats(df, "s", "k").collect()} == {(1, "a", 1, 3), (1, "b", 1, 3), (1, "c", 1, 3), (2, "b", 1, 1)}


def test_label_distribution_and_means(spark):
    df = spark.createDataFrame([([0, 1], [0.5, 0.0]), ([0], [0.7, 0.01])], "ids array<int>, p array<double>")
    labels = ["x", "y", "z"]
    assert {tuple(r) for r in A.label_distribution(df, "ids", labels).collect()} == {(0, "x", 2, 100.0), (1, "y", 1, 50.0), (2, "z", 0, 0.0)}
    assert A.label_distribution(df, "ids", labels, min_count=1).count() == 2
    assert [(r.label, round(r.mean_prob, 3)) for r in A.mean_probs(df, "p", labels).collect()] == [("x", 0.6)]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id bigint, `odd name` string")
    assert [tuple(r) for r in A.profile(df).collect()] == [(0, "id", "bigint", 2), (1, "odd name", "string", 1)]
