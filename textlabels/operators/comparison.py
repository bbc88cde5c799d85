"""Model comparison, ranking and error analysis over a long prediction table.

``preds(model, row_id, gold, pred)`` is keyed: rows of two models are matched
by ``row_id``, never by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlabels.functions.constants import LABELS28
from textlabels.operators.prefix import running_max
from textlabels.operators.metrics import class_counts, confusion_counts, f1_per_class
from textlabels.functions.columns import f1, join_null_safe, without_nan


def model_metrics(preds: DataFrame, model: str = "model", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(model, n, accuracy, f1_macro) for all models, from one pass over the predictions."""
    return _metrics(confusion_counts(preds, gold, pred, [model]), model)


def _metrics(confusion: DataFrame, model: str) -> DataFrame:
    hit = F.col("gold").eqNullSafe(F.col("pred"))
    sides = confusion.groupBy(model).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = class_counts(confusion, [model]).groupBy(model).agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_macro"))
    return join_null_safe(sides, macro, [model])


def evaluate_models(gold: DataFrame, preds: DataFrame, models: DataFrame | None = None, key: str = "row_id",
                    model: str = "model") -> DataFrame:
    """Metrics of every model against one gold table; a gold row without a prediction counts as wrong.

    ``models`` (one column ``model``) lists the models to report: one without
    predictions stays in the result with metrics 0.  Missing predictions are
    found by counts per class, so no row is repeated for each model.
    """
    found = confusion_counts(preds.select(model, key, "pred").join(gold.select(key, "gold"), key), by=[model])
    classes = gold.groupBy("gold").agg(F.count("*").alias("rows")).agg(
        F.collect_list(F.struct("gold", "rows"))).scalar()        # one entry per class
    each = found.select(model).distinct().select(model, F.explode(classes).alias("c")).select(model, "c.*")
    seen = found.groupBy(model, "gold").agg(F.sum("n").alias("seen"))
    missing = (join_null_safe(each, seen, [model, "gold"], "left")
               .select(model, "gold", F.lit(None).cast(found.schema["pred"].dataType).alias("pred"),
                       (F.col("rows") - F.coalesce("seen", F.lit(0))).alias("n")).where("n > 0"))
    metrics = _metrics(found.unionByName(missing), model)
    if models is None:
        return metrics
    return models.select(model).join(metrics, model, "left").select(
        model, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("f1_macro", F.lit(0.0)).alias("f1_macro"))


def leaderboard(metrics: DataFrame, params: DataFrame | None = None, by: str = "f1_macro",
                model: str = "model") -> DataFrame:
    """Models (or runs, with their parameters joined on) by macro F1 descending; ties by name.

    The rank window runs over one row per model.
    """
    table = metrics if params is None else metrics.join(params, model, "left")
    order = [F.desc(by), F.asc(model)]
    return table.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def best_model(metrics: DataFrame, baseline_pattern: str, exclude: Sequence[str] = (),
               model: str = "model") -> DataFrame:
    """One row: the best model that is no baseline, and the first baseline by name.

    Models whose name contains ``baseline_pattern`` are baselines; those that
    contain an entry of ``exclude`` are neither.  Ties go to the first name.
    """
    name = F.col(model)
    is_base = name.contains(baseline_pattern)
    skipped = F.lit(False)
    for text in exclude:
        skipped = skipped | name.contains(text)
    candidate = F.when(~is_base & ~skipped, F.struct((-F.col("f1_macro")).alias("neg"), name.alias("name")))
    best = F.min(candidate)
    return metrics.agg(best["name"].alias("best_model"), (-best["neg"]).alias("best_f1_macro"),
                       F.min(F.when(is_base, name)).alias("baseline_model"))


def improvement_pct(metrics: DataFrame, base: str, new: str, losses: Sequence[str] = ("loss",),
                    model: str = "model") -> DataFrame:
    """Per metric of ``metrics(model, metric, value)``: relative change in percent and whether it is better.

    Change is (new - old) / old * 100, with the sign turned for losses.
    """
    pair = (metrics.where(F.col(model).isin(base, new)).groupBy("metric").agg(
        F.max(F.when(F.col(model) == base, F.col("value"))).alias("base_value"),
        F.max(F.when(F.col(model) == new, F.col("value"))).alias("new_value")))
    gain = F.col("new_value") - F.col("base_value")
    signed = F.when(F.col("metric").isin(list(losses)), -gain).otherwise(gain)
    return pair.select("metric", "base_value", "new_value",
                       (signed / F.nullif(F.col("base_value"), F.lit(0.0)) * 100).alias("change_pct")
                       ).withColumn("improved", F.coalesce(F.col("change_pct") > 0, F.lit(False)))


def compare_f1(per_class: DataFrame, base: str, new: str, model: str = "model") -> DataFrame:
    """``per_class(model, label, f1)`` -> label, both F1 values, their difference; best improvement first."""
    return (per_class.where(F.col(model).isin(base, new)).groupBy("label").agg(
                F.max(F.when(F.col(model) == base, F.col("f1"))).alias("base_f1"),
                F.max(F.when(F.col(model) == new, F.col("f1"))).alias("new_f1"))
            .withColumn("improvement", F.col("new_f1") - F.col("base_f1"))
            .orderBy(F.desc("improvement"), "label"))


def compare_per_class(df: DataFrame, gold_vec: str, pred_vec: str, base: str, new: str,
                      labels: Sequence[str] = LABELS28, n: int | None = None, model: str = "model") -> DataFrame:
    """Per-label F1 of two models from their multi-label predictions, in one pass.

    With ``n`` only the n most improved (``top``) and the n least improved
    (``bottom``) labels are kept, tagged in ``side``.
    """
    table = compare_f1(f1_per_class(df.where(F.col(model).isin(base, new)), gold_vec, pred_vec, labels, [model]),
                       base, new, model)
    if n is None:
        return table
    # both ranks in one pass; the windows run over one row per label
    ends = {"top": [F.desc("improvement"), F.asc("label")], "bottom": [F.asc("improvement"), F.desc("label")]}
    sides = F.array(*[F.when(F.row_number().over(Window.orderBy(*order)) <= n, side) for side, order in ends.items()])
    return table.withColumn("side", sides).withColumn("side", F.explode("side")).where(F.col("side").isNotNull())


def _pair_outcomes(preds: DataFrame, base: str, new: str, key: str, model: str) -> DataFrame:
    """row_id, gold, both predictions and the category of the pair, in one pass over the predictions.

    A row that only one of the models predicted stays: the missing prediction is
    null and wrong.
    """
    side = lambda m: F.max(F.when(F.col(model) == m, F.col("pred")))
    pairs = (preds.where(F.col(model).isin(base, new)).groupBy(key)
             .agg(F.max("gold").alias("gold"), side(base).alias("base_pred"), side(new).alias("new_pred")))
    base_ok = F.col("base_pred").eqNullSafe(F.col("gold"))
    new_ok = F.col("new_pred").eqNullSafe(F.col("gold"))
    return pairs.withColumn(
        "category", F.when(~base_ok & new_ok, "improvement").when(base_ok & ~new_ok, "regression")
                     .when(~base_ok & ~new_ok, "persistent").otherwise("both_correct"))


def error_cases(preds: DataFrame, texts: DataFrame, text: str, base: str, new: str, n: int = 5, n_chars: int = 200,
                key: str = "row_id", model: str = "model") -> DataFrame:
    """First n improvements, regressions and persistent errors in row order, with a text snippet.

    The limit per category comes before the text join, so only 3n keys meet the
    text table: its text is scanned once and never shuffled.
    """
    first = Window.partitionBy("category").orderBy(key)
    chosen = (_pair_outcomes(preds, base, new, key, model).where(F.col("category") != "both_correct")
              .withColumn("example", F.row_number().over(first)).where(F.col("example") <= n))
    return texts.select(key, F.concat(F.substring(text, 1, n_chars), F.lit("...")).alias("snippet")).join(
        F.broadcast(chosen), key)       # at most 3n rows


def error_counts(preds: DataFrame, base: str, new: str, key: str = "row_id", model: str = "model") -> DataFrame:
    """Rows per category, all four cells."""
    return _pair_outcomes(preds, base, new, key, model).groupBy("category").agg(F.count("*").alias("n"))


def running_best(df: DataFrame, run: str, order: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """Rows that beat every earlier row of their run (strictly): the checkpoint rule.

    Adds ``previous_best`` (null for the first) and ``chosen`` on the row that
    stands in the end.  A run of any size is spread over ``blocks`` tasks (see
    ``prefix``).  A null run is a run; NaN is no value.
    """
    rows = without_nan(df, value).where(F.col(value).isNotNull())
    beaten = F.col("previous_best").isNull() | (F.col(value) > F.col("previous_best"))
    best = running_max(rows, [run], order, value, "previous_best", blocks).where(beaten)
    # few rows of a run are better than all before them
    return best.withColumn("chosen", F.col(value) == F.max(value).over(Window.partitionBy(run)))


def best_epoch(df: DataFrame, run: str, order: Sequence[str], value: str) -> DataFrame:
    """First row with the maximum value, per run (NaN is no value); combines map-side, so a hot run is no problem."""
    best = F.min(F.struct((-F.col(value)).alias("neg"), *order))
    return (without_nan(df, value).where(F.col(value).isNotNull()).groupBy(run).agg(best.alias("b"))
              .select(run, (-F.col("b.neg")).alias("best_value"), *[F.col(f"b.{c}") for c in order]))
