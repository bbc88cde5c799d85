"""What the physical plans of the registered queries must not contain."""

import re

import pytest

from textlabels.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TRAINED = {"training_history", "warm_start_report", "train_multilabel", "train_multiclass", "train_multiclass_text", "tune", "adapt_domain_trained"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text                        # row-at-a-time Python
    assert ("ArrowEvalPython" in text) == (name == "batch_score")


@pytest.mark.parametrize("name,columns", [
    ("value_counts", {"conv_id", "turn", "role"}), ("box_stats", {"event_type", "value"}), ("split_two", {"doc_id"}),
    ("accuracy", {"doc_id"}), ("best_epoch", {"event_id", "ts", "user_id", "value"})])
def test_scans_read_only_what_they_need(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF_DIR)))
    assert schemas and {c.split(":")[0] for s in schemas for c in s.split(",")} == columns


def test_scoring_shuffles_one_row_per_text_or_chunk(spark):
    text = plan(QUERIES["linear_score"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_scoring_without_broadcasts_reads_no_text_twice(spark):
    """``score_long_text`` reads a union of two scans of the documents, one of which takes no text."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("linear_score", "score_long_text"):
            text = plan(QUERIES[name](spark, SF_DIR))
            assert "TakeOrderedAndProject" not in text
            assert len([s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "text:string" in s]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_free_text_is_split_once_for_all_labels(spark):
    assert plan(QUERIES["normalize_label"](spark, SF_DIR)).count("split(") == 1


def test_error_cases_limit_before_the_text_join(spark):
    text = plan(QUERIES["error_cases"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2
    assert re.search(r"BroadcastHashJoin \[row_id", text)
