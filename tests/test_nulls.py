"""Rows that must not vanish: null keys and missing predictions."""

from textlabels.operators import comparison as C
from textlabels.operators import statistics as A


def test_running_best_with_null_runs(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 4.0), (None, 3, 6.0), ("a", 1, 1.0), ("a", 2, 3.0)], "run string, t int, v double")
    for blocks in (1, 5):
        got = sorted((r.run or "", r.t, r.previous_best or 0, r.chosen) for r in C.running_best(df, "run", ["t"], "v", blocks).collect())
        assert got == [("", 1, 0, False), ("", 3, 5.0, True), ("a", 1, 0, False), ("a", 2, 1.0, True)]


def test_groups_with_null_keys_or_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.min, r.q50, r.max) for r in A.box_stats(df, "k", "v").collect()}
    assert got == {None: (2, 1.0, 2.0, 3.0), "a": (1, 2.0, 2.0, 2.0), "b": (0, None, None, None)}


def test_split_stats_with_a_null_split(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), ("s", "x")], "split string, label string")
    assert sorted((r.split or "", r.n, r.split_rows) for r in A.split_stats(df).collect()) == [("", 1, 2), ("", 1, 2), ("s", 1, 1)]


def test_missing_predictions_are_wrong(spark):
    gold = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4)], "row_id int, gold string")
    preds = spark.createDataFrame([("m", 0, "a"), ("n", 0, "a"), ("n", 1, "b"), ("n", 2, "a"), ("n", 3, "b"), (None, 0, "a")],
                                  "model string, row_id int, pred string")
    got = {r.model: (r.n, r.accuracy, round(r.f1_macro, 6)) for r in C.evaluate_models(gold, preds).collect()}
    assert got == {"m": (4, 0.25, round(2 / 3 / 2, 6)), "n": (4, 1.0, 1.0), None: (4, 0.25, round(2 / 3 / 2, 6))}


def test_rows_that_one_model_predicted_are_counted(spark):
    preds = spark.createDataFrame([("x", 1, "a", "a"), ("y", 1, "a", "a"), ("x", 2, "a", "a"), ("y", 3, "a", "a"), ("y", 4, "a", "b")],
                                  "model string, row_id int, gold string, pred string")
    got = {r.category: r.n for r in C.error_counts(preds, "x", "y").collect()}
    assert got == {"both_correct": 1, "regression": 1, "improvement": 1, "persistent": 1}


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, nan), ("a", 2, 1.0), ("a", 3, 3.0), ("a", 4, nan)], "k string, t int, v double")
    row = A.describe(df, "v").first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (2, 2.0, 1.0, 2.0, 3.0)
    assert [(r.n, r.q50, r.max) for r in A.box_stats(df, "k", "v").collect()] == [(2, 2.0, 3.0)]
    assert [r.mean_value for r in A.group_mean(df, "k", "v").collect()] == [2.0]
    assert sum(r.n for r in A.histogram(df, "v", 4).collect()) == 2
    assert sorted((r.t, r.chosen) for r in C.running_best(df, "k", ["t"], "v").collect()) == [(2, False), (3, True)]
    assert [(r.best_value, r.t) for r in C.best_epoch(df, "k", ["t"], "v").collect()] == [(3.0, 3)]
