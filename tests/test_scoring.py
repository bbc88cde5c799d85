import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textlabels.operators import baselines as B
from textlabels.operators import scoring as M
from textlabels.operators import training as T

LABELS = ["x", "y"]


def fit_by_hand(rows):
    """rows: (text, (y0, y1), weight)."""
    n = sum(w for _, _, w in rows)
    pos = [sum(w * y[k] for _, y, w in rows) for k in range(2)]
    seen, held = Counter(), [Counter(), Counter()]
    for text, y, w in rows:
        for token in set(text.lower().split()):
            seen[token] += w
            for k in range(2):
                held[k][token] += w * y[k]
    weight = {t: [math.log((held[k][t] + 1) / (pos[k] + 2)) - math.log((seen[t] - held[k][t] + 1) / (n - pos[k] + 2))
                  for k in range(2)] for t in seen}
    return weight, [math.log((p + 1) / (n - p + 1)) for p in pos]


def score_by_hand(words, weight, bias):
    bag = set(words)
    return [1 / (1 + math.exp(-(bias[k] + sum(weight.get(t, [0, 0])[k] for t in bag) / len(bag)))) for k in range(2)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["the"] * 40 + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        n = rng.choice([1, 5, 30, 401, 760])
        rows.append((i, " ".join(rng.choice(words) for _ in range(n)), rng.randint(0, 1), rng.randint(0, 1)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame(corpus, "id int, text string, x int, y int")


@pytest.fixture(scope="module")
def model(frame):
    return M.logodds_fit(frame.where("id < 40"), "text", LABELS, LABELS).materialize()


@pytest.fixture(scope="module")
def by_hand(corpus):
    return fit_by_hand([(t, (a, b), 1.0) for i, t, a, b in corpus if i < 40])


def test_fit(model, by_hand):
    weight, bias = by_hand
    got = {r.token: [r.w0, r.w1] for r in model.weights.collect()}
    assert got.keys() == weight.keys() and model.n_tokens == len(weight)
    for token, w in weight.items():
        assert got[token] == pytest.approx(w)
    assert list(model.bias.first()) == pytest.approx(bias)


# A budget of a few tokens sends the others through the shuffled join.
@pytest.mark.parametrize("budget", [M.BROADCAST_BYTES, 80 * 3, 0])
def test_scores_do_not_depend_on_the_broadcast_budget(frame, corpus, model, by_hand, budget):
    got = {r.id: r.probs for r in M.linear_score(frame, "id", "text", model, broadcast_bytes=budget).collect()}
    for i, text, _, _ in corpus:
        assert got[i] == pytest.approx(score_by_hand(text.split(), *by_hand))


@pytest.mark.parametrize("budget", [M.BROADCAST_BYTES, 80 * 3])
def test_long_texts_are_averaged_over_chunks(spark, corpus, model, by_hand, budget):
    rows = [(i, t) for i, t, _, _ in corpus] + [(100, None), (101, " \n"), (102, "unknown words only")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in M.score_long_text(df, "id", "text", model, broadcast_bytes=budget).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:-3]:
        words = text.split()
        starts = [0] if len(words) <= 400 else range(0, len(words), 350)
        chunks = [score_by_hand(words[s:s + 400], *by_hand) for s in starts]
        want = np.mean(chunks, axis=0)
        assert got[i].probs == pytest.approx(list(want))
        assert got[i].num_chunks == (len(chunks) if len(chunks) > 1 else None)
        over = [x for x, p in zip(LABELS, want) if p >= 0.3]
        assert got[i].primary == LABELS[int(np.argmax(want))]
        assert got[i].all_labels == (over or [got[i].primary])
    for blank in (100, 101):
        assert tuple(got[blank]) == (blank, [0.0, 0.0], "neutral", ["neutral"], None)
    assert got[102].probs == pytest.approx([1 / (1 + math.exp(-b)) for b in by_hand[1]])


def test_label_table_keeps_the_rows_and_the_raw_threshold(spark, model):
    df = spark.createDataFrame([(1, "the w1", "meta"), (2, None, None)], "id int, text string, extra string")
    table = M.label_table(df, "id", "text", model, threshold=0.99)
    assert table.columns == ["id", "text", "extra", "primary_emotion", "all_emotions", "prob_x", "prob_y", "x", "y"]
    rows = {r.id: r for r in table.collect()}
    assert rows[1].all_emotions == rows[1].primary_emotion and (rows[1].x, rows[1].y) == (0, 0)
    assert (rows[2].primary_emotion, rows[2].all_emotions, rows[2].prob_x, rows[2].x) == ("neutral", "neutral", 0.0, 0)


def test_weighted_adaptation(frame, corpus):
    both = M.adapt_domain(frame.where("id < 20"), frame.where("id >= 20"), 3)
    got = {r.token: [r.w0, r.w1] for r in M.logodds_fit(both, "text", LABELS, LABELS, weight="weight").weights.collect()}
    want, _ = fit_by_hand([(t, (a, b), 1.0 if i < 20 else 3.0) for i, t, a, b in corpus])
    assert all(got[t] == pytest.approx(w) for t, w in want.items())


def test_model_round_trip(spark, model, tmp_path):
    model.save(f"{tmp_path}/m")
    again = M.LogOddsModel.load(spark, f"{tmp_path}/m", LABELS)
    assert again.n_tokens == model.n_tokens and again.labels == model.labels
    assert again.long_weights().count() == 2 * model.n_tokens and again.long_bias().count() == 2


def test_majority(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "e string")
    fitted = B.majority_fit(train, "e")
    assert tuple(fitted.first()) == ("a", 2)
    assert {r.pred for r in B.majority_predict(spark.range(5), fitted).collect()} == {"a"}


def test_search_is_seeded_and_in_bounds():
    a, b = (T.sample_params(T.SPACE, 20, s) for s in (1, 1))
    assert a == b != T.sample_params(T.SPACE, 20, 2)
    assert all(1e-5 <= p["weight_decay"] <= 0.1 and 2 <= p["epochs"] <= 5 and 0 <= p["elastic_net"] <= 0.3 for p in a)
    with pytest.raises(ValueError):
        T.sample_params({"z": ("gauss", 0, 1)}, 1, 1)


def test_train_and_tune(spark):
    rows = [(i, ("good fine " if i % 2 else "bad poor ") + f"n{i % 7}", i % 2, int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string, x int, y int")
    fitted = T.train_multilabel(df, "text", LABELS, LABELS, {"epochs": 5, "weight_decay": 0.0, "num_features": 64})
    got = fitted.predict(df).collect()
    assert len(got) == 120 and all(len(r.probs) == 2 for r in got)
    assert np.mean([(r.probs[0] > 0.5) == bool(r.x) for r in got]) > 0.95
    trials, best = T.tune(df.where("id < 80"), df.where("id >= 80"), "text", LABELS, n_trials=3, num_features=64)
    table = {r.trial: r for r in trials.collect()}
    assert set(table) == {0, 1, 2} and all(r.state == "COMPLETE" and 0 <= r.value <= 1 for r in table.values())
    top = T.best_trials(trials, 1).first()
    assert {k: str(v) for k, v in best.items()} == top.params


def test_a_failing_trial_is_recorded(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 2) for i in range(20)], "id int, text string, x int")
    space = {"weight_decay": ("choice", [-1.0, 0.1])}
    trials, best = T.tune(df, df, "text", ["x"], space, n_trials=6, num_features=16)
    states = {r.state: r.error for r in trials.collect()}
    assert set(states) == {"FAIL", "COMPLETE"} and states["FAIL"] and best == {"weight_decay": 0.1}
    with pytest.raises(RuntimeError, match="no trial completed"):
        T.tune(df, df, "text", ["x"], {"weight_decay": ("choice", [-1.0])}, n_trials=1, num_features=16)


def test_text_classes(spark):
    df = spark.createDataFrame([(i, ["red apple", "blue sky", "green tree"][i % 3] + f" w{i}", i % 3) for i in range(60)],
                               "id int, text string, y int")
    model = T.train_multiclass(df, "text", "y", {"epochs": 20, "weight_decay": 0.0, "num_features": 1 << 10})
    assert all(r.pred_id == r.y for r in T.predict_multiclass(df, "text", model).collect())


def test_every_text_is_scored_whatever_its_tokens(spark):
    """Blank texts, a token that is frequent here but unknown to the model, and a very long token."""
    long = "x" * 50_000
    train = spark.createDataFrame([(1, "good fine", 1), (2, f"bad {long}", 0), (3, "good", 1)], "id int, text string, y int")
    model = M.logodds_fit(train, "text", ["y"], ["y"]).materialize()
    rows = [(10, None), (11, " "), (12, "good"), (13, f"new {long}")] + [(20 + i, "new good") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string")
    results = []
    for budget in (0, 300, 1 << 20):
        got = {r.id: r.probs[0] for r in M.linear_score(df, "id", "text", model, budget).collect()}
        assert set(got) == {i for i, _ in rows} and got[10] == got[11]
        results.append({i: round(p, 12) for i, p in got.items()})
    assert results[0] == results[1] == results[2]


def test_scoring_asks_for_a_written_model(spark):
    df = spark.createDataFrame([(1, "a", 1)], "id int, text string, y int")
    with pytest.raises(ValueError, match="materialize"):
        M.linear_score(df, "id", "text", M.logodds_fit(df, "text", ["y"], ["y"]))


def test_rows_that_share_a_key_are_scored_each(spark, model):
    df = spark.createDataFrame([(1, "the w1"), (1, "w2 w3 w4"), (2, "the"), (None, "w5"), (None, "w6")], "id int, text string")
    alone = df.selectExpr("concat_ws(':', id, text) as id", "text")
    for budget in (0, M.BROADCAST_BYTES):
        for score in (M.linear_score, M.score_long_text):
            got = sorted(r.probs for r in score(df, "id", "text", model, broadcast_bytes=budget).collect())
            want = sorted(r.probs for r in score(alone, "id", "text", model, broadcast_bytes=budget).collect())
            assert len(got) == 5 and np.allclose(got, want)
    repeated = df.where("id = 2").unionByName(df.where("id = 2"))
    assert M.label_table(repeated, "id", "text", model).count() == 2
    for bad, why in (("id = 1", "has several texts: 1"), ("id is null", "id is null")):
        with pytest.raises(Exception, match=why):
            M.label_table(df.where(bad), "id", "text", model).collect()


def test_the_filter_lets_known_tokens_pass_and_few_others(spark):
    known = spark.range(3000).selectExpr("concat('k', id) as token")
    strangers = spark.range(20_000).selectExpr("concat('s', id) as token")
    test = M.membership_filter(known, "token", 3000)
    assert known.where(test).count() == 3000 and strangers.where(test).count() < 0.03 * 20_000
    assert strangers.where(M.membership_filter(known.where("false"), "token", 0)).count() == 0


def test_unknown_tokens_do_not_travel(spark, frame, model):
    """Rows with 50 tokens the model does not know and one that it knows only beyond the broadcast."""
    rows = [(i, f"the w{i % 60} " + " ".join(f"new{i}x{j}" for j in range(50))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string")
    frequent, others, n = M._split_weights(model, 80 * 3)
    assert n == others.count() > 50
    bags = df.selectExpr("id", "array_distinct(split(text, ' ')) as bag")
    partial = M._partial_scores(bags, ["id"], frequent, ["w0", "w1"], M.membership_filter(others, "token", n))
    travelling = partial.selectExpr("sum(size(_rest))").first()[0]
    assert 150 <= travelling < 200 + 0.05 * 10_000
    a, b = ({r.id: r.probs for r in M.linear_score(df, "id", "text", model, budget).collect()} for budget in (80 * 3, M.BROADCAST_BYTES))
    assert all(np.allclose(a[i], b[i]) for i in a)


def test_tokens_beyond_the_broadcast_are_not_gathered_by_bag(spark, frame, model):
    """Gathering them in lists sorts, and spills, every token of the texts once a task holds over 128 bags."""
    frequent, others, n = M._split_weights(model, 80 * 3)
    bags = frame.selectExpr("id", "array_distinct(split(text, ' ')) as bag")
    partial = M._partial_scores(bags, ["id"], frequent, ["w0", "w1"], M.membership_filter(others, "token", n))
    plan = partial._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    sums = partial.where("size(_rest) = 0")
    assert sums.count() == frame.count() == sums.select("id").distinct().count()
    rest = {(r.id, r.token) for r in partial.selectExpr("id", "explode(_rest) as token").collect()}
    known, first = ({r.token for r in t.collect()} for t in (others, frequent))
    assert rest == {(r.id, t) for r in bags.collect() for t in r.bag if t in known} and first


def test_tokens_of_many_rows_are_dealt_into_shares(spark, frame, model, monkeypatch):
    want = {r.id: r.probs for r in M.linear_score(frame, "id", "text", model).collect()}
    monkeypatch.setattr(M, "SHARE_ROWS", 4)
    got = {r.id: r.probs for r in M.linear_score(frame, "id", "text", model, 0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_a_bucketed_table_is_labelled_without_moving_its_text(spark, frame, model, tmp_path):
    from textlabels.sources import tables as S
    S.write_bucketed(frame, "speeches_b", f"{tmp_path}/b", ["id"], 4)
    spark.sql("DROP TABLE speeches_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = S.read_bucketed(spark, "speeches_b", f"{tmp_path}/b", frame.schema, ["id"], 4)
        plans = [M.label_table(t, "id", "text", model, buckets=b)._jdf.queryExecution().executedPlan().toString()
                 for t, b in ((table, 4), (frame, None))]
        moved = [any(re.search(r"\btext#", node.split("Exchange", 1)[0] + child) for node, child in exchanges(p)) for p in plans]
        assert moved == [False, True]
        got, want = (sorted(map(tuple, M.label_table(t, "id", "text", model, buckets=b).collect())) for t, b in ((table, 4), (frame, None)))
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[6:8] for r in got], [r[6:8] for r in want])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS speeches_b")


def exchanges(plan):
    """(line of an exchange, line below it) of a physical plan."""
    lines = plan.splitlines()
    return [(a, b) for a, b in zip(lines, lines[1:]) if re.search(r"\bExchange ", a)]
