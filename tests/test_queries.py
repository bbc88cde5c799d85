"""Every registered query against its SQL twin."""

import os

import pytest

from compare import connect, differences
from textlabels.plans import QUERIES, SQL
from textlabels.plans import scoring_queries as S

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# solvers that work epoch by epoch; tests/test_descent.py holds them against plain numpy
WITHOUT_SQL = {"training_history", "warm_start_report"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def test_epoch_queries(spark):
    rows = QUERIES["training_history"](spark, SF_DIR).collect()
    for run in {r.run for r in rows}:
        mine = sorted((r for r in rows if r.run == run), key=lambda r: r.epoch)
        assert [r.epoch for r in mine] == list(range(len(mine))) and mine[-1].train_loss < 0.8 * mine[0].train_loss
        best = max(mine, key=lambda r: (r.validation_f1, -r.epoch))
        assert [r.epoch for r in mine if r.chosen] == [best.epoch] == [mine[0].best_epoch] and best.record
    report = {r.model: r for r in QUERIES["warm_start_report"](spark, SF_DIR).collect()}
    assert len(report) == 4 and len({r.n for r in report.values()}) == 1 and all(0 <= r.accuracy_quality <= 1 for r in report.values())


def test_wrong_models_are_told(spark):
    """A constant model, a wrong ranking and wrong best parameters differ from what SQL states."""
    rows = spark.createDataFrame([(i, "test" if i % 3 else "train", i % 2, 1) for i in range(60)], "id int, split string, label int, pred_id int")
    assert not S.beats_majority(rows).first().beats_majority
    assert S.beats_majority(rows.withColumn("pred_id", rows["label"])).first().beats_majority
    probs = rows.selectExpr("split", "array(0.9D, 0.1D) as probs", "label as quality", "label as toxic")
    told = probs.select("split", "quality", *S._fitted(probs)).where("split = 'train'").collect()
    assert any(r.fitted_quality != r.quality for r in told)

    class Model:
        def predict(self, df):
            return df.withColumn("probs", df["probs"])

    trials = spark.createDataFrame([(0, "COMPLETE", 0.4, {"a": "1"}), (1, "COMPLETE", 0.7, {"a": "2"})],
                                   "trial int, state string, value double, params map<string, string>")
    report = S.tuning_report(trials, Model(), probs)
    assert [(r.place, r.in_order) for r in report.orderBy("place").collect()] == [(1, True), (2, True)]
    assert not any(r.reproduced for r in report.collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


@pytest.mark.parametrize("probs", [S.train_multilabel_probs, S.adapt_domain_probs])
def test_trained_probabilities_are_probabilities(spark, probs):
    rows = probs(spark, SF_DIR).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 87
    assert all(len(r.probs) == 2 and 0 <= p <= 1 for r in rows for p in r.probs)
    assert len({round(p, 6) for r in rows for p in r.probs}) > 20


def test_entry(spark):
    import __spark_entry__
    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2] and {r.model for r in rows} == {"log_odds", "majority"}
