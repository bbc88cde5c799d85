"""Queries of the metrics and of the model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlabels.functions.constants import DIALOGUE7, LABELS28
from textlabels.operators import comparison as C
from textlabels.operators import labels as L
from textlabels.operators import metrics as E
from textlabels.plans import inputs as I
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import LABEL_LIST, sql, strip, words

# The share of true positives; 0 where the denominator is 0.
_P = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END"
_R = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"


# --- single label -----------------------------------------------------------

@query("accuracy", sql("preds3", """
    SELECT model, count(*) AS n, sum((gold = pred)::int)::bigint AS correct, round(avg((gold = pred)::int), 6) AS accuracy
    FROM preds3 GROUP BY model"""))
def _(spark, sf):
    return rounded(E.accuracy(I.preds3(spark, sf), by=["model"]))


@query("invalid_rate", sql("raw_outputs", f"""
    SELECT count(*) AS n, sum(bad)::bigint AS n_invalid, round(avg(bad), 6) AS invalid_rate
    FROM (SELECT (NOT list_has_any({LABEL_LIST}, list_append({words('lower(output)')}, {strip('lower(output)')})))::int AS bad
          FROM raw_outputs)"""))
def _(spark, sf):
    return rounded(E.invalid_rate(L.normalize_label(I.raw_outputs(spark, sf), "output", out="pred")))


@query("prf_macro", sql("classes3", f"""
    SELECT model, count(*) AS n_classes, round(avg({_P}), 6) AS precision_macro, round(avg({_R}), 6) AS recall_macro,
           round(avg({_F1}), 6) AS f1_macro FROM classes3 GROUP BY model"""))
def _(spark, sf):
    return rounded(E.prf_macro(I.preds3(spark, sf), by=["model"]))


@query("per_label_accuracy", sql("utterance_preds", f"""
    SELECT label, coalesce(c, 0)::bigint AS correct, coalesce(s, 0)::bigint AS support, round(c / s, 6) AS accuracy
    FROM (SELECT unnest({DIALOGUE7!r}) AS label)
    LEFT JOIN (SELECT gold AS label, sum((gold = pred)::int)::double AS c, count(*)::double AS s
               FROM utterance_preds GROUP BY gold) USING (label)
    UNION ALL SELECT 'overall', sum((gold = pred)::int)::bigint, count(*), round(avg((gold = pred)::int), 6)
    FROM utterance_preds"""))
def _(spark, sf):
    return rounded(E.per_label_accuracy(I.utterance_preds(spark, sf), DIALOGUE7))


@query("confused_pairs", sql("preds3", """
    SELECT gold, pred, count(*) AS n FROM preds3 WHERE model = 'custom_a' AND gold <> pred
    GROUP BY gold, pred ORDER BY n DESC, gold, pred LIMIT 10"""))
def _(spark, sf):
    return E.confused_pairs(I.preds3(spark, sf).where(F.col("model") == "custom_a"))


@query("crosstab", sql("preds3", "SELECT gold, " + ", ".join(
    f"round(avg((pred = '{x}')::int), 6) AS {x}" for x in LABELS28) + ", 0.0::double AS other FROM preds3 GROUP BY gold"))
def _(spark, sf):
    return rounded(E.crosstab(I.preds3(spark, sf)))


_REPORT_AVERAGES = """
    SELECT {n}, '{micro}', sum(tp) / sum(tp + fp), sum(tp) / sum(tp + fn), 2 * sum(tp) / sum(2 * tp + fp + fn), sum(tp + fn)
    FROM c UNION ALL
    SELECT {n} + 1, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL
    SELECT {n} + 2, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
           sum(f1 * support) / sum(support), sum(support) FROM r"""


def _report(views: str, counts: str, n: int, micro: str, more: str = "") -> str:
    head = sql(views, "")
    return f"""{head},
c AS MATERIALIZED ({counts}),
r AS MATERIALIZED (SELECT label_id AS position, label, {_P} AS precision, {_R} AS recall, {_F1} AS f1, tp + fn AS support FROM c)
SELECT position::int AS position, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::bigint AS support
FROM (SELECT position, label, precision, recall, f1, support FROM r UNION ALL {_REPORT_AVERAGES.format(n=n, micro=micro)} {more})"""


@query("classification_report", _report("per_label labels28 runs", """
    SELECT label_id, label, tp, ps - tp AS fp, gs - tp AS fn FROM per_label JOIN labels28 USING (label_id)
    WHERE model = 'baseline'""", 28, "micro avg", f"""
    UNION ALL SELECT 31, 'samples avg', avg(CASE WHEN p = 0 THEN 0 ELSE t / p END), avg(t / g), avg(2 * t / (g + p)),
                     sum(g)
    FROM (SELECT list_sum(gold_vec)::double AS g, list_sum(pred_vec)::double AS p,
                 list_sum(list_transform(range(1, 29), lambda i: gold_vec[i] * pred_vec[i]))::double AS t
          FROM runs WHERE model = 'baseline')"""))
def _(spark, sf):
    return rounded(E.classification_report_ml(I.multilabel(spark, sf), "gold_vec", "pred_vec"))


_SHORT = LABELS28[:27]


@query("classification_report_single", _report("preds3 labels28", """
    SELECT label_id, label, sum((gold = label AND pred = label)::int)::double AS tp,
           sum((gold <> label AND pred = label)::int)::double AS fp, sum((gold = label AND pred <> label)::int)::double AS fn
    FROM preds3 JOIN labels28 ON gold = label OR pred = label
    WHERE model = 'custom_b' AND label_id < 27 GROUP BY label_id, label""", 27, "micro avg"))
def _(spark, sf):
    preds = I.preds3(spark, sf).where(F.col("model") == "custom_b")
    return rounded(E.classification_report(preds, _SHORT))


# --- multi label ------------------------------------------------------------

@query("f1_micro", sql("run_metrics", "SELECT model, round(f1_micro, 6) AS f1_micro FROM run_metrics"))
def _(spark, sf):
    return rounded(E.f1_micro(I.multilabel_runs(spark, sf), "gold_vec", "pred_vec", by=["model"]))


@query("f1_macro_ml", sql("run_metrics", "SELECT model, round(f1_macro, 6) AS f1_macro FROM run_metrics"))
def _(spark, sf):
    return rounded(E.f1_macro_ml(I.multilabel_runs(spark, sf), "gold_vec", "pred_vec", by=["model"]))


@query("exact_match", sql("runs", """
    SELECT model, round(avg((gold_vec = pred_vec)::int), 6) AS exact_match FROM runs GROUP BY model"""))
def _(spark, sf):
    return rounded(E.exact_match(I.multilabel_runs(spark, sf), "gold_vec", "pred_vec", by=["model"]))


@query("f1_per_class", sql("per_label labels28", """
    SELECT label_id, label, round(f1, 6) AS f1 FROM per_label JOIN labels28 USING (label_id) WHERE model = 'baseline'"""))
def _(spark, sf):
    return rounded(E.f1_per_class(I.multilabel(spark, sf), "gold_vec", "pred_vec"))


@query("bce_loss", sql("run_metrics", "SELECT round(loss, 6) AS loss FROM run_metrics WHERE model = 'baseline'"))
def _(spark, sf):
    return rounded(E.bce_loss(I.multilabel(spark, sf, probs=True), "gold_vec", "probs"))


@query("ce_loss", sql("gold28 scores28", """
    SELECT round(avg(-ln(greatest(probs[labels[1] + 1], 1e-12))), 6) AS loss FROM gold28 JOIN scores28 USING (doc_id)"""))
def _(spark, sf):
    docs = I.scores28(I.gold28(I.doc_ids(spark, sf)))
    return rounded(E.ce_loss(docs.withColumn("gold_id", F.get("labels", F.lit(0))), "gold_id", "probs"))


# --- comparison -------------------------------------------------------------

@query("evaluate_models", sql("metrics3", """
    SELECT model, n, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM metrics3
    UNION ALL SELECT 'never_ran', 0, 0, 0"""))
def _(spark, sf):
    gold = I.gold3(spark, sf)
    preds = I.preds3(spark, sf).drop("gold")
    models = spark.createDataFrame([(m,) for m in [*I.MODELS3, "never_ran"]], "model string")
    return rounded(C.evaluate_models(gold, preds, models))


@query("leaderboard", sql("metrics3", """
    SELECT model, n, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, epochs,
           row_number() OVER (ORDER BY f1_macro DESC, model)::int AS rank
    FROM metrics3 LEFT JOIN (VALUES ('custom_a', 3::int), ('custom_b', 5::int)) AS p(model, epochs) USING (model)"""))
def _(spark, sf):
    params = spark.createDataFrame([("custom_a", 3), ("custom_b", 5)], "model string, epochs int")
    return rounded(C.leaderboard(C.model_metrics(I.preds3(spark, sf)), params))


@query("best_model", sql("metrics3", """
    SELECT (SELECT model FROM metrics3 WHERE NOT contains(model, 'published') ORDER BY f1_macro DESC, model LIMIT 1) AS best_model,
           (SELECT round(max(f1_macro), 6) FROM metrics3 WHERE NOT contains(model, 'published')) AS best_f1_macro,
           (SELECT min(model) FROM metrics3 WHERE contains(model, 'published')) AS baseline_model"""))
def _(spark, sf):
    return rounded(C.best_model(C.model_metrics(I.preds3(spark, sf)), "published"))


_LONG_METRICS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, max({m}) FILTER (model = 'baseline') AS o, max({m}) FILTER (model = 'tuned') AS w, {s} AS sgn"
    " FROM run_metrics" for m, s in (("f1_micro", 1), ("f1_macro", 1), ("loss", -1)))


def run_metrics(spark, sf):
    """(model, f1_micro, f1_macro, exact_match, loss) of both runs, in one pass."""
    return E.multilabel_metrics(I.multilabel_runs(spark, sf, probs=True), "gold_vec", "pred_vec", by=["model"], probs="probs")


@query("improvement_pct", sql("run_metrics", f"""
    SELECT metric, round(o, 6) AS base_value, round(w, 6) AS new_value, round(sgn * (w - o) / o * 100, 6) + 0.0 AS change_pct,
           sgn * (w - o) / o > 0 AS improved FROM ({_LONG_METRICS})"""))
def _(spark, sf):
    wide = run_metrics(spark, sf)
    long = wide.unpivot("model", ["f1_micro", "f1_macro", "loss"], "metric", "value")
    return rounded(C.improvement_pct(long, "baseline", "tuned"))


_PER_CLASS = """
    SELECT label, b.f1 AS base_f1, t.f1 AS new_f1, t.f1 - b.f1 AS improvement
    FROM (SELECT * FROM per_label WHERE model = 'baseline') b JOIN (SELECT * FROM per_label WHERE model = 'tuned') t USING (label_id)
    JOIN labels28 USING (label_id)"""
_PER_CLASS_OUT = "SELECT label, round(base_f1, 6) AS base_f1, round(new_f1, 6) AS new_f1, round(improvement, 6) + 0.0 AS improvement"


@query("compare_per_class", sql("per_label labels28", f"{_PER_CLASS_OUT} FROM ({_PER_CLASS})"))
def _(spark, sf):
    return rounded(C.compare_per_class(I.multilabel_runs(spark, sf), "gold_vec", "pred_vec", "baseline", "tuned"))


@query("compare_per_class_ends", sql("per_label labels28", f"""
    {_PER_CLASS_OUT}, side FROM (
        (SELECT *, 'top' AS side FROM ({_PER_CLASS}) ORDER BY improvement DESC, label LIMIT 5)
        UNION ALL (SELECT *, 'bottom' FROM ({_PER_CLASS}) ORDER BY improvement, label DESC LIMIT 5))"""))
def _(spark, sf):
    return rounded(C.compare_per_class(I.multilabel_runs(spark, sf), "gold_vec", "pred_vec", "baseline", "tuned", n=5))


_OUTCOMES = """
    SELECT row_id, b.gold, b.pred AS base_pred, c.pred AS new_pred,
           CASE WHEN b.pred = b.gold AND c.pred = b.gold THEN 'both_correct' WHEN c.pred = b.gold THEN 'improvement'
                WHEN b.pred = b.gold THEN 'regression' ELSE 'persistent' END AS category
    FROM (SELECT * FROM preds3 WHERE model = 'published') b JOIN (SELECT * FROM preds3 WHERE model = 'custom_a') c USING (row_id)"""


@query("error_counts", sql("preds3", f"SELECT category, count(*) AS n FROM ({_OUTCOMES}) GROUP BY category"))
def _(spark, sf):
    return C.error_counts(I.preds3(spark, sf), "published", "custom_a")


_BEST = """
    best AS (SELECT model FROM metrics3 WHERE NOT contains(model, 'published') ORDER BY f1_macro DESC, model LIMIT 1)"""


def _best_and_baseline(spark, sf):
    """The predictions, and the names of the best model and of the first baseline (one row)."""
    preds = I.preds3(spark, sf)
    return preds, C.best_model(C.model_metrics(preds), "published").first()


@query("error_cases", sql("metrics3", f"""
    WITH {_BEST} SELECT row_id, gold, base_pred, new_pred, category, example::int AS example, substr(text, 1, 200) || '...' AS snippet
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS example
          FROM ({_OUTCOMES.replace("model = 'custom_a'", "model IN (SELECT model FROM best)")}) WHERE category <> 'both_correct')
    JOIN documents ON doc_id = row_id WHERE example <= 5"""))
def _(spark, sf):
    """Cases of the model found best against the baseline."""
    docs = I.documents(spark, sf).select(F.col("doc_id").alias("row_id"), "text")
    preds, names = _best_and_baseline(spark, sf)
    return C.error_cases(preds, docs, "text", names["baseline_model"], names["best_model"])


@query("best_model_confusions", sql("metrics3", f"""
    WITH {_BEST} SELECT model, gold, pred, count(*) AS n FROM preds3 JOIN best USING (model) WHERE gold <> pred
    GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10"""))
def _(spark, sf):
    """What the model found best mixes up."""
    preds, names = _best_and_baseline(spark, sf)
    mine = preds.where(F.col("model") == names["best_model"])
    return E.confused_pairs(mine).select(F.lit(names["best_model"]).alias("model"), "gold", "pred", "n")


@query("best_model_outcomes", sql("metrics3", f"""
    WITH {_BEST} SELECT CASE WHEN b.pred = b.gold AND c.pred = b.gold THEN 'both_correct' WHEN c.pred = b.gold THEN 'improvement'
                  WHEN b.pred = b.gold THEN 'regression' ELSE 'persistent' END AS category, count(*) AS n
    FROM (SELECT * FROM preds3 WHERE model = 'published') b JOIN (SELECT * FROM preds3 JOIN best USING (model)) c USING (row_id)
    GROUP BY 1"""))
def _(spark, sf):
    """Where the model found best differs from the baseline."""
    preds, names = _best_and_baseline(spark, sf)
    return C.error_counts(preds, names["baseline_model"], names["best_model"])


@query("running_best", """
    SELECT user_id, event_id, round(value, 6) AS value, round(previous_best, 6) AS previous_best,
           value = max(value) OVER (PARTITION BY user_id) AS chosen
    FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM events WHERE value IS NOT NULL)
    WHERE previous_best IS NULL OR value > previous_best""")
def _(spark, sf):
    events = I.table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    best = C.running_best(events, "user_id", ["ts", "event_id"], "value")
    return rounded(best.select("user_id", "event_id", "value", "previous_best", "chosen"))


@query("best_epoch", """
    SELECT user_id, round(value, 6) AS best_value, event_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r
          FROM events WHERE value IS NOT NULL) WHERE r = 1""")
def _(spark, sf):
    return rounded(C.best_epoch(I.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").drop("ts"))


