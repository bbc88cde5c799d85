import pytest
from pyspark.sql import functions as F

from textlabels.functions.constants import LABELS28
from textlabels.sources import tables as S
from textlabels.sources import workspace as W

NASTY = ['plain', 'with, comma', 'say "hi"', 'two\nlines', 'ends with backslash \\', '  padded  ', 'a\r\nb', "'", '""', 'tab\there']


@pytest.mark.parametrize("fmt", S.FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(list(enumerate(NASTY)), "id bigint, text string")
    S.write_table(df, f"{tmp_path}/t", fmt)
    back = S.read_table(spark, f"{tmp_path}/t", fmt, df.schema)
    assert sorted(map(tuple, back.collect())) == list(enumerate(NASTY))
    with pytest.raises(Exception):
        S.write_table(df, f"{tmp_path}/t", fmt)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        S.read_table(spark, "x", "xlsx", "a int")


def test_write_lines(spark, tmp_path):
    S.write_lines(spark.createDataFrame([(" a\nb\r\n\nc ",), (None,), ("d",)], "t string"), "t", f"{tmp_path}/l")
    assert sorted(r.value for r in S.read_lines(spark, f"{tmp_path}/l").collect()) == ["a b c", "d"]


def test_union_splits(spark):
    out = S.union_splits({"train": spark.createDataFrame([(1, "a")], "id int, speaker string"),
                          "test": spark.createDataFrame([(2,)], "id int")})
    assert {tuple(r) for r in out.select("split", "id", "speaker").collect()} == {("train", 1, "a"), ("test", 2, None)}


def test_one_split_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", [0], "train"), (2, "u", [1, 2], "test")], "doc_id bigint, text string, labels array<int>, split string")
    S.write_annotations(df, f"{tmp_path}/a")
    test = S.load_annotations(spark, f"{tmp_path}/a", "test")
    assert [(r.doc_id, r.labels) for r in test.collect()] == [(2, [1, 2])]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert S.load_annotations(spark, f"{tmp_path}/a").count() == 2


def test_results_document(spark, tmp_path):
    metrics = spark.createDataFrame([("b", 0.5, 0.4, 0.2), ("t", 0.6, 0.3, 0.1)], "model string, f1_micro double, f1_macro double, loss double")
    S.save_results(S.results_document(metrics, "b", "t", new_params={"batch_size": 32}, study={"n_trials": 10}), f"{tmp_path}/r")
    row = S.load_results(spark, f"{tmp_path}/r").first()
    assert row.baseline.test_metrics.f1_micro == 0.5 and row.tuned.hyperparameters.batch_size == 32 and row.study.n_trials == 10
    assert list(row.improvement) == pytest.approx([20.0, -25.0, 50.0])
    assert S.load_params(spark, f"{tmp_path}/r").first().asDict() == {"batch_size": 32, "dropout": 0.1, "weight_decay": 0.01}
    assert S.load_params(spark, f"{tmp_path}/none").first().asDict() == {"batch_size": 16, "dropout": 0.1, "weight_decay": 0.01}


def test_conform_input(spark):
    df = spark.createDataFrame([(1, "s", 1)], "id int, speech string, joy int")
    with pytest.warns(UserWarning, match="grief"):
        out = S.conform_input(df, required=["id"])
    assert out.columns[:3] == ["id", "text", "joy"] and set(LABELS28) <= set(out.columns)
    assert out.first().grief is None
    with pytest.raises(ValueError, match="primary"):
        S.conform_input(df, required=["primary"])
    with pytest.raises(ValueError, match="no text column"):
        S.conform_input(df.drop("speech"), labels=[])
    both = df.withColumn("text", F.lit("t"))
    assert S.conform_input(both, ["speech", "text"], labels=[]).columns == ["id", "text", "joy"]


class FakeSession:
    """A session with the given checkpoint and warehouse folders."""

    def __init__(self, folder):
        self.conf = {"spark.sql.warehouse.dir": "/wh/"} | ({"spark.checkpoint.dir": folder} if folder else {})
        self.sparkContext = self

    def getConf(self):
        return self.conf


def test_shared_folder_comes_from_the_session():
    assert W.shared_root(FakeSession("hdfs://x/cp/")) == "hdfs://x/cp"
    assert W.shared_root(FakeSession("/mnt/cp")) == "/mnt/cp"
    assert W.shared_root(FakeSession(None)) == "/wh/_work"


def test_written_tables_are_removed(spark):
    from pathlib import Path
    from urllib.parse import urlparse
    path = W.new_path(spark, "gone")
    spark.range(2).write.parquet(path)
    assert Path(urlparse(path).path).exists() and W.release(spark) >= 1
    assert not Path(urlparse(path).path).exists() and not W._WRITTEN


def test_materialize_reads_back_what_was_written(spark):
    df = spark.range(3).withColumn("x", F.lit("a"))
    back = W.materialize(df, "ids")
    assert back.columns == ["id", "x"] and sorted(map(tuple, back.collect())) == [(0, "a"), (1, "a"), (2, "a")]
    assert "Range" not in back._jdf.queryExecution().executedPlan().toString()
