import random

import pytest
from pyspark.sql import functions as F

from published import PER_CLASS, RUNS
from textlabels.operators import comparison as C


def test_published_improvements(spark):
    rows = [(run, m, v) for m, base, new, _ in RUNS for run, v in (("base", base), ("new", new))]
    got = {r.metric: r for r in C.improvement_pct(spark.createDataFrame(rows, "model string, metric string, value double"), "base", "new").collect()}
    for metric, _, _, change in RUNS:
        assert got[metric].change_pct == pytest.approx(change) and got[metric].improved == (change > 0)


def test_published_per_class_comparison(spark):
    rows = [(run, x, v) for x, base, new, _ in PER_CLASS for run, v in (("base", base), ("new", new))]
    got = C.compare_f1(spark.createDataFrame(rows, "model string, label string, f1 double"), "base", "new").collect()
    # Ties (the two labels that stay at 0) are ordered by name.
    want = sorted(PER_CLASS, key=lambda r: (-(r[2] - r[1]), r[0]))
    assert [r.label for r in got] == [w[0] for w in want]
    assert [r.improvement for r in got] == pytest.approx([w[3] for w in want])
    assert sum(w[1] for w in PER_CLASS) / 28 == pytest.approx(RUNS[1][1])
    assert sum(w[2] for w in PER_CLASS) / 28 == pytest.approx(RUNS[1][2])


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(8)
    gold = {i: rng.choice("abc") for i in range(60)}
    rows = [(m, i, g, g if rng.random() < a else rng.choice("abc")) for m, a in (("old", 0.4), ("x", 0.6), ("y", 0.6)) for i, g in gold.items()]
    return rows, spark.createDataFrame(rows, "model string, row_id int, gold string, pred string")


def test_error_cases(spark, preds):
    rows, df = preds
    by = {(m, i): p for m, i, _, p in rows}
    gold = {i: g for _, i, g, _ in rows}
    cells = {"improvement": [], "regression": [], "persistent": [], "both_correct": []}
    for i in sorted(gold):
        o, n = by["old", i] == gold[i], by["x", i] == gold[i]
        cells["both_correct" if o and n else "improvement" if n else "regression" if o else "persistent"].append(i)
    assert {r.category: r.n for r in C.error_counts(df, "old", "x").collect()} == {k: len(v) for k, v in cells.items() if v}
    texts = spark.createDataFrame([(i, f"text {i} " + "z" * 300) for i in gold], "row_id int, text string")
    got = C.error_cases(df, texts, "text", "old", "x").collect()
    assert {(r.category, r.example, r.row_id) for r in got} == {
        (k, n + 1, i) for k in ("improvement", "regression", "persistent") for n, i in enumerate(cells[k][:5])}
    assert all(r.snippet.startswith(f"text {r.row_id} ") and len(r.snippet) == 203 for r in got)


def test_leaderboard_and_best_model(spark):
    metrics = spark.createDataFrame([("pub", 0.5), ("b", 0.7), ("a", 0.7), ("Simple Baseline", 0.9)], "model string, f1_macro double")
    assert [(r.model, r["rank"]) for r in C.leaderboard(metrics).collect()] == [("Simple Baseline", 1), ("a", 2), ("b", 3), ("pub", 4)]
    params = spark.createDataFrame([("a", 3)], "model string, epochs int")
    assert {r.model: r.epochs for r in C.leaderboard(metrics, params).collect()}["a"] == 3
    assert tuple(C.best_model(metrics, "pub", ["Simple Baseline"]).first()) == ("a", 0.7, "pub")
    assert tuple(C.best_model(metrics.where("model = 'pub'"), "pub").first()) == (None, None, "pub")


def test_model_without_predictions_stays(spark, preds):
    _, df = preds
    models = spark.createDataFrame([("old",), ("x",), ("none",)], "model string")
    gold = df.where("model = 'old'").select("row_id", "gold")
    got = {r.model: r for r in C.evaluate_models(gold, df.drop("gold"), models).collect()}
    assert set(got) == {"old", "x", "none"} and tuple(got["none"]) == ("none", 0, 0.0, 0.0)
    assert got["x"].n == 60


def test_running_best_in_blocks_equals_one_block(spark):
    rng = random.Random(4)
    # run 0 holds more than half of the rows
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, float(rng.randint(0, 60))) for i in range(600)]
    df = spark.createDataFrame(rows + [(9, 1, None), (9, 2, 1.0)], "run int, t int, v double")
    want, best = [], {}
    for run, t, v in rows + [(9, 2, 1.0)]:
        if run not in best or v > best[run]:
            want.append((run, t, v, best.get(run)))
            best[run] = v
    for blocks in (1, 3, 40):
        got = C.running_best(df, "run", ["t"], "v", blocks).collect()
        assert sorted((r.run, r.t, r.v) for r in got) == sorted(w[:3] for w in want)
        assert {(r.run, r.t): r.previous_best for r in got} == {w[:2]: w[3] for w in want}
        assert {(r.run, r.v) for r in got if r.chosen} == set(best.items())


def test_best_epoch_takes_the_first_maximum(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7), ("s", 1, None), ("s", 2, 0.1)], "run string, epoch int, f1 double")
    assert {tuple(r) for r in C.best_epoch(df, "run", ["epoch"], "f1").collect()} == {("r", 0.7, 2), ("s", 0.1, 2)}
