import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabels.operators import comparison as C
from textlabels.operators import descent as D

LABELS = ["x", "y"]
SIZE = 64


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        words = rng.choice(["good", "fine", "bad", "poor", *[f"n{j}" for j in range(12)]], int(rng.integers(1, 9)))
        rows.append((i, " ".join(words), int("good" in words), int("bad" in words and "n1" not in words)))
    return spark.createDataFrame(rows, "id int, text string, x int, y int").repartition(4)


def dense(rows):
    got = rows.collect()
    a = np.zeros((len(got), SIZE + 1))
    for i, r in enumerate(got):
        a[i, r.ids] = 1 / np.sqrt(max(len(r.ids), 1))
    a[:, -1] = 1
    return a, np.array([r.y for r in got]), np.array([r.weight if r.weight is not None else 0.0 for r in got])


def loss_by_hand(c, a, y, w, decay=0.0, pull=0.0, begin=0.0, weight=1.0):
    z = a @ c.T
    free = c.copy()
    free[:, -1] = 0
    return (weight * np.sum(w[:, None] * (np.logaddexp(0, z) - y * z)) / max(w.sum(), 1) + decay / 2 * np.sum(free ** 2)
            + pull / 2 * np.sum((c - begin) ** 2))


def test_loss_and_gradient_of_a_pass(spark, texts, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 50)                                  # several slices
    rows = D.features(texts, "text", LABELS, SIZE, validation=F.col("id") % 5 == 0)
    a, y, w = dense(rows)
    c = np.random.default_rng(0).standard_normal((2, SIZE + 1))
    loss, gradient, f1 = D._pass(rows, c)
    z = a @ c.T
    assert loss == pytest.approx(loss_by_hand(c, a, y, w))
    assert np.allclose(gradient, ((w[:, None] * (1 / (1 + np.exp(-z)) - y)).T @ a) / w.sum())
    held, said = w == 0, z > 0
    scores = [2 * np.sum(held & said[:, j] & (y[:, j] == 1)) / max(np.sum(held & said[:, j]) + np.sum(held & (y[:, j] == 1)), 1) for j in range(2)]
    assert f1 == pytest.approx(np.mean(scores)) and held.sum() == 48


def test_the_fit_reaches_the_minimum(spark, texts):
    rows = D.features(texts, "text", LABELS, SIZE)
    got = D.fit(rows, LABELS, 60, 1e-2, SIZE)
    a, y, w = dense(rows)
    c = np.zeros((2, SIZE + 1))
    for _ in range(20_000):                                              # plain gradient descent
        g = ((1 / (1 + np.exp(-(a @ c.T))) - y).T @ a) / len(a) + 1e-2 * np.c_[c[:, :-1], np.zeros(2)]
        c -= 1.5 * g
    assert loss_by_hand(got.last.coefficients, a, y, w, 1e-2) == pytest.approx(loss_by_hand(c, a, y, w, 1e-2), abs=1e-7)
    assert np.allclose(got.last.coefficients, c, atol=2e-3)
    losses = [loss for _, loss, _ in got.epochs]
    assert losses[0] == pytest.approx(2 * np.log(2)) and losses[-1] < 0.6 * losses[0]
    assert got.best is not None and (got.best.coefficients == got.last.coefficients).all()


def test_history_and_best_checkpoint(spark, texts):
    rows = D.features(texts, "text", LABELS, SIZE, validation=F.col("id") % 4 == 0)
    runs = {f"decay {d}": D.fit(rows, LABELS, 8, d, SIZE) for d in (1e-1, 1e-4)}
    table = D.history(runs, spark)
    assert table.columns == ["run", "epoch", "train_loss", "validation_f1"] and table.count() >= 10
    chosen = {r.run: r.epoch for r in C.best_epoch(table, "run", ["epoch"], "validation_f1").collect()}
    records = {r.run: r.epoch for r in C.running_best(table, "run", ["epoch"], "validation_f1").where("chosen").collect()}
    assert chosen == records
    for run, fitted in runs.items():
        best = max(fitted.epochs, key=lambda e: (e[2], -e[0]))
        assert chosen[run] == best[0]
        assert D._pass(rows, fitted.best.coefficients)[2] == best[2]     # the coefficients kept are those of that epoch


def test_warm_start_between_source_and_target(spark, texts):
    source_rows, target_rows = texts.where("id < 120"), texts.where("id >= 120").withColumn("x", F.lit(1) - F.col("x"))
    source = D.fit(D.features(source_rows, "text", LABELS, SIZE), LABELS, 30, 1e-2, SIZE).last
    same = D.warm_start(source, target_rows, "text", LABELS, 0.0)
    assert (same.best.coefficients == source.coefficients).all()
    a, y, w = dense(D.features(target_rows, "text", LABELS, SIZE))
    gaps, losses = [], []
    for weight in (0.01, 1.0, 1000.0):
        got = D.warm_start(source, target_rows, "text", LABELS, weight, 1e-2, 60).last.coefficients
        gaps.append(np.linalg.norm(got - source.coefficients))
        losses.append(loss_by_hand(got, a, y, w))
    assert gaps[0] < gaps[1] < gaps[2] and losses[0] > losses[1] > losses[2]
    alone = D.fit(D.features(target_rows, "text", LABELS, SIZE), LABELS, 60, 1e-5, SIZE).last.coefficients
    assert losses[2] == pytest.approx(loss_by_hand(alone, a, y, w), abs=0.02)


def test_predictions_and_awkward_rows(spark, texts):
    model = D.fit(D.features(texts, "text", LABELS, SIZE), LABELS, 30, 1e-4, SIZE).best
    got = {r.id: r.probs for r in model.predict(texts).collect()}
    gold = {r.id: (r.x, r.y) for r in texts.collect()}
    assert np.mean([(p[j] > 0.5) == gold[i][j] for i, p in got.items() for j in range(2)]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, " ", 1), (2, "good", None)], "id int, text string, x int").selectExpr("*", "x as y", "1 as ids")
    blank = 1 / (1 + np.exp(-model.coefficients[:, -1]))
    probs = [r.probs for r in model.predict(odd).orderBy("id", F.desc("text")).collect()]
    assert np.allclose(probs[0], blank) and len(probs) == 3
    assert D._pass(D.features(odd, "text", LABELS, SIZE), model.coefficients)[0] > 0
    none = D.fit(D.features(odd.where("false"), "text", LABELS, SIZE), LABELS, 3, 0.0, SIZE)
    assert (none.best.coefficients == 0).all() and none.epochs == [(0, 0.0, None)]
    with pytest.raises(ValueError, match="shape"):
        D.fit(D.features(odd, "text", LABELS, 32), LABELS, 1, 0.0, 32, model)
