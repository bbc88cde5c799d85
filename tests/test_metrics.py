import math
import random

import pytest
from pyspark.sql import functions as F

from published import DIALOGUE, OVERALL
from textlabels.functions.constants import DIALOGUE7
from textlabels.operators import metrics as E

ABCD = ["a", "b", "c", "d"]


def brute_prf(pairs, label):
    tp = sum(g == p == label for g, p in pairs)
    fp = sum(p == label != g for g, p in pairs)
    fn = sum(g == label != p for g, p in pairs)
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return p, r, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0, tp + fn


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    return [(rng.choice("abc"), rng.choice(["a", "b", "c", "d", "invalid"])) for _ in range(400)]


@pytest.fixture(scope="module")
def preds(spark, pairs):
    return spark.createDataFrame(pairs, "gold string, pred string")


def test_accuracy_counts_invalid_and_missing_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "invalid"), ("a", None)], "gold string, pred string")
    assert tuple(E.accuracy(df).first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(E.invalid_rate(df).first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(E.accuracy(df.where("gold = 'z'")).first()) == (0, 0, 0.0)


def test_macro_runs_over_the_union_of_classes(preds, pairs):
    classes = sorted({x for pair in pairs for x in pair})
    assert classes == ["a", "b", "c", "d", "invalid"]
    want = [brute_prf(pairs, c) for c in classes]
    got = {r.label: r for r in E.prf_per_class(preds).collect()}
    for c, (p, r, f, s) in zip(classes, want):
        assert tuple(got[c])[1:] == (pytest.approx(p), pytest.approx(r), pytest.approx(f), s)
    assert tuple(E.prf_macro(preds).first()) == (5, *[pytest.approx(sum(w[k] for w in want) / 5) for k in range(3)])


@pytest.mark.parametrize("labels,micro", [(["a", "b", "c", "d", "never"], "micro avg"), (["a", "b", "c", "d", "invalid"], "accuracy")])
def test_report(preds, pairs, labels, micro):
    rows = sorted(E.classification_report(preds, labels).collect(), key=lambda r: r.position)
    assert [r.label for r in rows] == [*labels, micro, "macro avg", "weighted avg"]
    per = [brute_prf(pairs, x) for x in labels]
    for r, want in zip(rows, per):
        assert (r.precision, r.recall, r.f1, r.support) == pytest.approx(want)
    n = sum(w[3] for w in per)
    assert rows[-2].f1 == pytest.approx(sum(w[2] for w in per) / len(per))
    assert rows[-1].precision == pytest.approx(sum(w[0] * w[3] for w in per) / n)
    if micro == "accuracy":
        assert rows[-3].f1 == pytest.approx(sum(g == p for g, p in pairs) / len(pairs))


def test_crosstab_rows_sum_to_one(preds, pairs):
    rows = {r.gold: r for r in E.crosstab(preds, ABCD).collect()}
    assert all(sum(r[x] for x in [*ABCD, "other"]) == pytest.approx(1) for r in rows.values())
    counts = {r.gold: r for r in E.crosstab(preds, ABCD, None).collect()}
    assert counts["a"]["other"] == sum(p == ("a", "invalid") for p in pairs)
    assert counts["b"]["d"] == sum(p == ("b", "d") for p in pairs)


def test_confused_pairs_break_ties_by_label(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", "a"), ("c", "a")], "gold string, pred string")
    assert [tuple(r) for r in E.confused_pairs(df, 2).collect()] == [("c", "a", 2), ("a", "b", 1)]


@pytest.mark.parametrize("epoch", [0, 1, 2])
def test_published_per_label_accuracies(spark, epoch):
    rows = []
    for label, (support, *accuracy) in DIALOGUE.items():
        right = round(support * accuracy[epoch])
        wrong = DIALOGUE7[(DIALOGUE7.index(label) + 1) % 7]
        rows += [(label, label)] * right + [(label, wrong)] * (support - right)
    got = {r.label: r for r in E.per_label_accuracy(spark.createDataFrame(rows, "gold string, pred string"), DIALOGUE7).collect()}
    for label, (support, *accuracy) in DIALOGUE.items():
        assert got[label].support == support and round(got[label].accuracy, 4) == accuracy[epoch]
    share, right = OVERALL[epoch]
    assert (got["overall"].correct, got["overall"].support) == (right, 1109)
    assert round(got["overall"].accuracy, 4) == share


def test_per_label_accuracy_of_an_absent_class_is_null(spark):
    df = spark.createDataFrame([("a", "a")], "gold string, pred string")
    assert {tuple(r) for r in E.per_label_accuracy(df, ["a", "b"]).collect()} == {
        ("a", 1, 1, 1.0), ("b", 0, 0, None), ("overall", 1, 1, 1.0)}


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    # the last label never occurs
    return [([int(rng.random() < 0.3) for _ in range(3)] + [0], [int(rng.random() < 0.3) for _ in range(3)] + [0],
             [rng.choice([0.0, 0.2, 0.5, 1.0]) for _ in range(4)]) for _ in range(200)]


def test_multilabel_metrics(spark, vectors):
    df = spark.createDataFrame(vectors, "g array<int>, p array<int>, q array<double>")
    counts = [[sum(g[j] * p[j] for g, p, _ in vectors), sum((1 - g[j]) * p[j] for g, p, _ in vectors),
               sum(g[j] * (1 - p[j]) for g, p, _ in vectors)] for j in range(4)]
    f1s = [2 * t / (2 * t + a + b) if t + a + b else 0.0 for t, a, b in counts]
    micro = [sum(c[k] for c in counts) for k in range(3)]
    clip = [[min(max(x, 1e-12), 1 - 1e-12) for x in q] for _, _, q in vectors]
    loss = -sum(math.log(x) if y else math.log(1 - x) for (g, _, _), q in zip(vectors, clip) for y, x in zip(g, q)) / 800
    want = dict(f1_micro=2 * micro[0] / (2 * micro[0] + micro[1] + micro[2]), f1_macro=sum(f1s) / 4,
                exact_match=sum(g == p for g, p, _ in vectors) / 200, loss=loss)
    assert E.multilabel_metrics(df, "g", "p", probs="q").first().asDict() == pytest.approx(want)
    assert E.f1_micro(df, "g", "p").first()[0] == pytest.approx(want["f1_micro"])
    assert E.f1_macro_ml(df, "g", "p").first()[0] == pytest.approx(want["f1_macro"])
    assert E.exact_match(df, "g", "p").first()[0] == pytest.approx(want["exact_match"])
    assert E.bce_loss(df, "g", "q").first()[0] == pytest.approx(loss)
    assert [r.f1 for r in sorted(E.f1_per_class(df, "g", "p", ABCD).collect())] == pytest.approx(f1s)

    report = {r.label: r for r in E.classification_report_ml(df, "g", "p", ABCD).collect()}
    assert report["d"].f1 == 0.0 and report["d"].support == 0
    assert report["macro avg"].f1 == pytest.approx(want["f1_macro"])
    assert report["micro avg"].f1 == pytest.approx(want["f1_micro"])
    row_f1 = [2 * sum(map(lambda x, y: x * y, g, p)) / (sum(g) + sum(p)) if sum(g) + sum(p) else 0.0 for g, p, _ in vectors]
    assert report["samples avg"].f1 == pytest.approx(sum(row_f1) / 200)


def test_ce_loss(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0])], "y int, q array<double>")
    assert E.ce_loss(df, "y", "q").first()[0] == pytest.approx((math.log(2) + 12 * math.log(10)) / 2)


def test_metrics_by_model_are_one_aggregation_each(spark, preds):
    both = preds.withColumn("model", F.lit("m")).unionByName(preds.withColumn("model", F.lit("n")))
    rows = E.prf_macro(both, by=["model"]).collect()
    assert {r.model for r in rows} == {"m", "n"} and rows[0].f1_macro == rows[1].f1_macro
