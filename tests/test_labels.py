import pytest
from pyspark.sql import functions as F

from textlabels.functions.constants import COARSE7, DIALOGUE7, LABELS28, TAXONOMY
from textlabels.operators import labels as L
from textlabels.operators import projection as P

ABC = ["a", "b", "c"]


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture()
def probs(spark):
    return spark.createDataFrame(
        [(1, [0.3, 0.3, 0.1]), (2, [0.1, 0.2, 0.2]), (3, [0.5, 0.9, 0.31]), (4, [0.0, 0.0, 0.0])],
        "id int, probs array<double>")


def test_vocabularies():
    assert len(LABELS28) == len(set(LABELS28)) == 28 and LABELS28[27] == "neutral"
    assert sorted(x for fine in TAXONOMY.values() for x in fine) == sorted(LABELS28)
    assert {k: len(v) for k, v in TAXONOMY.items()} == {
        "anger": 3, "disgust": 1, "fear": 2, "joy": 12, "sadness": 5, "surprise": 4, "neutral": 1}
    assert sorted(COARSE7) == sorted(DIALOGUE7)


def test_thresholds_inclusive_exclusive_and_fallback(probs):
    assert one(L.threshold_labels(probs, "probs", ABC), "all_labels") == [
        (["a", "b"],), (["b"],), (["a", "b", "c"],), (["a"],)]
    exclusive = L.threshold_labels(probs, "probs", ABC, inclusive=False, fallback="neutral")
    assert one(exclusive, "all_labels") == [(["neutral"],), (["neutral"],), (["a", "b", "c"],), (["neutral"],)]
    assert one(L.threshold_labels(probs, "probs", ABC, 0.95, fallback=None), "all_labels")[0] == ([],)
    assert one(L.threshold_binary(probs, "probs"), "pred_vec") == [([0, 0, 0],), ([0, 0, 0],), ([0, 1, 0],), ([0, 0, 0],)]


def test_argmax_tie_goes_to_the_first_label(probs):
    assert one(L.argmax_label(probs, "probs", ABC), "primary") == [("a",), ("b",), ("b",), ("a",)]


def test_topk(probs):
    rows = L.topk_labels(probs, "probs", ABC, 2).collect()
    assert [r.topk_text for r in rows] == ["a:0.30, b:0.30", "b:0.20, c:0.20", "b:0.90, a:0.50", "a:0.00, b:0.00"]
    assert rows[2].topk[0].asDict() == {"label": "b", "prob": 0.9}


def test_expand_probs_uses_the_raw_threshold(probs):
    row = L.expand_probs(probs, "probs", ABC).where("id = 2").first()
    assert (row.prob_b, row.a, row.b, row.c) == (0.2, 0, 0, 0)


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([([0, 2],), ([],), ([1],)], "ids array<int>")
    wide = L.multi_hot_encode(df, "ids", ABC)
    assert one(wide, *ABC) == [(1, 0, 1), (0, 0, 0), (0, 1, 0)]
    assert one(L.multi_hot_decode(wide, ABC), "active", "active_text") == [(["a", "c"], "a,c"), ([], ""), (["b"], "b")]
    packed = L.multi_hot_encode(df, "ids", ABC, wide=False)
    assert one(L.multi_hot_decode(packed, ABC, vec="multi_hot"), "active_text") == [("a,c",), ("",), ("b",)]


def test_single_label_looks_only_at_the_listed_labels(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (0, 0, 1), (None, 1, 0)], "a int, b int, c int")
    assert one(L.single_label(df, ABC), "label") == [(None,), (None,), ("c",), ("b",)]
    assert one(L.single_label(df, ["a", "b"]), "label") == [("a",), (None,), (None,), ("b",)]


def test_rollup_is_a_logical_or_and_skips_absent_columns(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 1), (0, 0, 0)], "anger int, annoyance int, joy int")
    out = L.taxonomy_rollup(df)
    assert one(out, "coarse_anger", "coarse_joy", "coarse_fear") == [(1, 0, None), (0, 1, None), (0, 0, None)]
    assert P.strip_prefix(out, ["joy"], "coarse_").columns == ["joy", *COARSE7]
    ids = spark.createDataFrame([([2, 3, 17],), ([27],)], "ids array<int>")
    assert one(L.taxonomy_rollup_ids(ids, "ids"), "coarse_ids") == [([0, 3],), ([6],)]


def test_label_to_id_modes(spark):
    mapping = {x: i for i, x in enumerate(DIALOGUE7)}
    df = spark.createDataFrame([("joy",), ("boredom",)], "e string")
    assert one(L.label_to_id(df, "e", mapping, "null"), "label_id") == [(1,), (None,)]
    with pytest.raises(Exception, match="unknown label: boredom"):
        L.label_to_id(df, "e", mapping).collect()
    with pytest.raises(ValueError):
        L.label_to_id(df, "e", mapping, "skip")


def test_id_to_label(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (None,)], "i int")
    assert one(L.id_to_label(df, "i", ABC), "label") == [("a",), ("c",), (None,), (None,)]


@pytest.mark.parametrize("text,expected", [
    (" Joy \n", "joy"), ("i think joy", "joy"), ("joy.", "invalid"), ("", "invalid"), (None, "invalid"),
    ("sadness or joy", "joy"), ("ANGER", "anger"), ("it is\tfear\nnow", "fear")])
def test_normalize_label(spark, text, expected):
    df = spark.createDataFrame([(text,)], "o string")
    assert one(L.normalize_label(df, "o"), "label") == [(expected,)]


def test_projection(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, " \n"), (4, "y")], "id int, t string")
    assert one(P.drop_blank_text(df, "t"), "id") == [(1,), (4,)]
    assert one(P.drop_blank_text(df, "t", blank=False), "id") == [(1,), (3,), (4,)]
    assert one(P.fill_label(df, "t"), "t")[1] == ("neutral",)
    assert one(P.fill_label(df, "new", "z"), "new") == [("z",)] * 4
    assert one(P.preview(df, ["t"], 2, ["id"]), "t") == [("x",), (None,)]
    listed = spark.createDataFrame([("x",), ("q",)], "label string")
    assert one(P.filter_labels(df, "t", listed), "id") == one(P.filter_labels(df, "t", ["x", "q"]), "id") == [(1,)]
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "gold string, pred string")
    assert P.mismatch_filter(pairs).count() == 2
    assert one(L.lower_labels(df.select(F.upper("t").alias("t")), ["t"]), "t")[0] == ("x",)
