"""Evaluation metrics.

Single-label metrics all start from ``confusion_counts``: one map-side combined
group-by that turns any number of predictions into at most
models x labels x labels rows.  Multi-label metrics all start from
``label_counts``: one group-by over the cells that leaves one row per group and
label.  Whatever follows is arithmetic on those small tables.

Undefined precision, recall and F1 are 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import f1, label_array, ratio, total
from textlabels.functions.constants import INVALID, LABELS28

CLIP = 1e-12


def label_table(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label_id, label) in label order."""
    return df.sparkSession.createDataFrame(list(enumerate(labels)), "label_id int, label string")


# --- single label -----------------------------------------------------------

def confusion_counts(preds: DataFrame, gold: str = "gold", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """``by..., gold, pred, n``: the sufficient statistic of every single-label metric."""
    return preds.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(preds: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with gold = pred; an invalid or missing prediction is wrong."""
    ok = F.col(gold).eqNullSafe(F.col(pred))
    return preds.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"),
                                  F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("accuracy"))


def invalid_rate(preds: DataFrame, pred: str = "pred", by: Sequence[str] = (), marker: str = INVALID) -> DataFrame:
    """Number and share of unparseable outputs."""
    bad = F.col(pred) == marker
    return preds.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_invalid"),
                                  F.avg(F.coalesce(bad, F.lit(False)).cast("double")).alias("invalid_rate"))


def class_counts(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., label, tp, fp, fn``, one row per class seen in gold or in predictions."""
    hit = F.col("gold").eqNullSafe(F.col("pred"))
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    return (confusion.select(*by, F.explode(sides).alias("c"))
                     .where(F.col("c.label").isNotNull())
                     .groupBy(*by, F.col("c.label").alias("label"))
                     .agg(F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn")))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1")]


def prf_per_class(preds: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    counts = class_counts(confusion_counts(preds, gold, pred, by), by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "label", *_prf(tp, fp, fn), (tp + fn).alias("support"))


def prf_macro(preds: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 averaged over the union of the classes seen in gold or predictions."""
    return prf_per_class(preds, gold, pred, by).groupBy(*by).agg(
        F.count("*").alias("n_classes"), F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"))


def per_label_accuracy(preds: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred",
                       overall: str = "overall") -> DataFrame:
    """Per gold class: correct, support and accuracy (null when support is 0), then the overall row."""
    counts = (confusion_counts(preds, gold, pred).groupBy("gold")
              .agg(F.sum("n").alias("support"),
                   F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)).alias("correct")))
    names = label_table(preds, labels)
    value = F.col("correct") / F.nullif(F.col("support"), F.lit(0))
    per = (names.join(F.broadcast(counts.where(F.col("gold").isin(list(labels)))), names["label"] == counts["gold"], "left")
                .select("label", F.coalesce("correct", F.lit(0)).alias("correct"),
                        F.coalesce("support", F.lit(0)).alias("support")))
    whole = counts.agg(F.lit(overall).alias("label"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
                       F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    return per.unionByName(whole).withColumn("accuracy", value)


def confused_pairs(preds: DataFrame, n: int = 10, gold: str = "gold", pred: str = "pred",
                   by: Sequence[str] = ()) -> DataFrame:
    """The n most frequent (gold, pred) with gold != pred; ties by label."""
    return (confusion_counts(preds.where(F.col(gold) != F.col(pred)), gold, pred, by)
            .orderBy(F.desc("n"), *by, "gold", "pred").limit(n))


def crosstab(preds: DataFrame, labels: Sequence[str] = LABELS28, normalize: str | None = "index",
             gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Gold x predicted table, one column per label plus ``other`` (predictions outside the list).

    ``normalize='index'`` gives row shares (rows sum to 1), None gives counts.
    """
    known = F.when(F.col("pred").isin(list(labels)), F.col("pred")).otherwise("other")
    columns = [*labels, "other"]
    table = (confusion_counts(preds, gold, pred).withColumn("pred", known)
             .groupBy("gold").pivot("pred", columns).agg(F.sum("n")).na.fill(0, columns))
    if normalize == "index":
        rows = total([F.col(x) for x in columns])
        return table.select("gold", *[(F.col(x) / rows).alias(x) for x in columns])
    if normalize is not None:
        raise ValueError("normalize must be 'index' or None")
    return table


# --- multi label ------------------------------------------------------------

def label_counts(df: DataFrame, gold_vec: str, pred_vec: str, by: Sequence[str] = (), probs: str | None = None,
                 row_values: Mapping[str, Column] | None = None) -> DataFrame:
    """``by..., label_id, rows, tp, fp, fn`` (and ``bce``, the summed cross-entropy, when ``probs`` is given).

    Cells are exploded and combined map-side, so at most groups x labels rows
    leave a task.  ``row_values`` are expressions of the whole input row; their
    sums arrive on the row of label 0.
    """
    extra = dict(row_values or {})
    zipped = [F.col(gold_vec).alias("g"), F.col(pred_vec).alias("p"), *([F.col(probs).alias("q")] if probs else [])]
    cells = df.select(*by, *[c.alias(f"_{n}") for n, c in extra.items()],
                      F.posexplode(F.arrays_zip(*zipped)).alias("label_id", "c"))
    g, p = F.col("c.g"), F.col("c.p")
    sums = [F.count("*").alias("rows"), F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"),
            F.sum(g * (1 - p)).alias("fn")]
    if probs:
        sums.append(F.sum(_cross_entropy(g, F.col("c.q"))).alias("bce"))
    sums += [F.sum(F.when(F.col("label_id") == 0, F.col(f"_{n}"))).alias(n) for n in extra]
    return cells.groupBy(*by, "label_id").agg(*sums)


def _f1() -> Column:
    return f1(F.col("tp"), F.col("fp"), F.col("fn"))


def _micro() -> Column:
    return f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))


def f1_micro(df: DataFrame, gold_vec: str, pred_vec: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 over all cells."""
    return label_counts(df, gold_vec, pred_vec, by).groupBy(*by).agg(_micro().alias("f1_micro"))


def f1_macro_ml(df: DataFrame, gold_vec: str, pred_vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over *all* labels, those that never occur included with 0."""
    return label_counts(df, gold_vec, pred_vec, by).groupBy(*by).agg(F.avg(_f1()).alias("f1_macro"))


def exact_match(df: DataFrame, gold_vec: str, pred_vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose whole label vector is right."""
    same = F.col(gold_vec) == F.col(pred_vec)
    return df.groupBy(*by).agg(F.avg(same.cast("double")).alias("exact_match"))


def multilabel_metrics(df: DataFrame, gold_vec: str, pred_vec: str, by: Sequence[str] = (),
                       probs: str | None = None) -> DataFrame:
    """f1_micro, f1_macro, exact_match (and the mean loss when probabilities are given), in one pass."""
    same = (F.col(gold_vec) == F.col(pred_vec)).cast("bigint")
    counts = label_counts(df, gold_vec, pred_vec, by, probs, {"same": same})
    return counts.groupBy(*by).agg(
        _micro().alias("f1_micro"), F.avg(_f1()).alias("f1_macro"),
        (F.sum("same") / F.max("rows")).alias("exact_match"),
        *([(F.sum("bce") / F.sum("rows")).alias("loss")] if probs else []))


def f1_per_class(df: DataFrame, gold_vec: str, pred_vec: str, labels: Sequence[str] = LABELS28,
                 by: Sequence[str] = ()) -> DataFrame:
    """F1 per label, in label order."""
    return label_counts(df, gold_vec, pred_vec, by).select(
        *by, "label_id", F.get(label_array(labels), F.col("label_id")).alias("label"), _f1().alias("f1"))


# --- classification report --------------------------------------------------

def _line(position: Column, label: Column, precision: Column, recall: Column, score: Column, support: Column) -> Column:
    return F.struct(position.cast("int").alias("position"), label.alias("label"), precision.alias("precision"),
                    recall.alias("recall"), score.alias("f1"), support.alias("support"))


def _report(counts: DataFrame, labels: Sequence[str], micro_name: Column, *more: Column,
            carried: Sequence[Column] = ()) -> DataFrame:
    """Per-label lines and their averages from ``label_id, tp, fp, fn``: one row per label comes in.

    Rows with a null ``label_id`` (classes outside the list) give no line and take no part in the averages.
    """
    n = len(labels)
    hits, support = F.col("tp"), F.col("tp") + F.col("fn")
    precision, recall, score = ratio(hits, hits + F.col("fp")), ratio(hits, support), _f1()
    listed = F.col("label_id").isNotNull()
    line = _line(F.col("label_id"), F.get(label_array(labels), F.col("label_id")), precision, recall, score, support)
    lines = counts.select(F.when(listed, line).alias("l"), "label_id",
                          *[F.when(listed, F.col(c)).alias(c) for c in ("tp", "fp", "fn")], *carried)
    weight = F.col("l.support")

    def averaged(position: int, name: Column, mean) -> Column:
        return _line(F.lit(position), name, mean("precision"), mean("recall"), mean("f1"), F.sum(weight))

    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    averages = [
        _line(F.lit(n), micro_name, ratio(tp, tp + fp), ratio(tp, tp + fn), f1(tp, fp, fn), tp + fn),
        averaged(n + 1, F.lit("macro avg"), lambda c: F.avg(f"l.{c}")),
        averaged(n + 2, F.lit("weighted avg"), lambda c: ratio(F.sum(F.col(f"l.{c}") * weight), F.sum(weight))),
        *more]
    table = lines.agg(F.concat(F.collect_list("l"), F.array(*averages)).alias("report"))
    return table.select(F.explode("report").alias("r")).select("r.*")


def classification_report_ml(df: DataFrame, gold_vec: str, pred_vec: str,
                             labels: Sequence[str] = LABELS28) -> DataFrame:
    """Precision, recall, F1, support per label and their micro / macro / weighted / samples averages."""
    def size(vec: Column) -> Column:
        return F.aggregate(vec, F.lit(0), lambda a, x: a + x)

    gold, pred = F.col(gold_vec), F.col(pred_vec)
    sized = df.select(gold_vec, pred_vec, size(gold).alias("_g"), size(pred).alias("_p"),
                      size(F.zip_with(gold, pred, lambda x, y: x * y)).alias("_t"))
    t, g, p = F.col("_t"), F.col("_g"), F.col("_p")
    counts = label_counts(sized, gold_vec, pred_vec, row_values={
        "sp": ratio(t, p), "sr": ratio(t, g), "sf": ratio(2 * t, g + p)})
    rows = F.max("rows")
    samples = _line(F.lit(len(labels) + 3), F.lit("samples avg"), F.sum("sp") / rows, F.sum("sr") / rows,
                    F.sum("sf") / rows, F.sum("l.support"))
    return _report(counts, labels, F.lit("micro avg"), samples, carried=[F.col(c) for c in ("rows", "sp", "sr", "sf")])


def classification_report(preds: DataFrame, labels: Sequence[str] = LABELS28, gold: str = "gold",
                          pred: str = "pred") -> DataFrame:
    """The single-label report over a label list.

    The row after the labels is ``accuracy`` when the list covers every label
    seen, otherwise ``micro avg`` (over the listed labels only).
    """
    seen = class_counts(confusion_counts(preds, gold, pred))
    names = label_table(preds, labels).withColumnRenamed("label", "name")
    # both sides hold one row per class; classes outside the list keep a null label_id
    joined = names.join(seen, F.col("name") == F.col("label"), "full")
    counts = joined.select("label_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    micro_name = F.when(F.count_if(F.col("label_id").isNull()) == 0, "accuracy").otherwise("micro avg")
    return _report(counts, labels, micro_name)


# --- losses -----------------------------------------------------------------

def _cross_entropy(g: Column, q: Column) -> Column:
    q = F.least(F.greatest(q, F.lit(CLIP)), F.lit(1 - CLIP))
    return -F.when(g == 1, F.ln(q)).otherwise(F.ln(1 - q))


def bce_loss(df: DataFrame, gold_vec: str, probs: str) -> DataFrame:
    """Mean binary cross-entropy over rows x labels (a plain mean, not a mean of batch means)."""
    cells = df.select(F.explode(F.arrays_zip(F.col(gold_vec).alias("g"), F.col(probs).alias("q"))).alias("c"))
    return cells.agg(F.avg(_cross_entropy(F.col("c.g"), F.col("c.q"))).alias("loss"))


def ce_loss(df: DataFrame, gold_id: str, probs: str) -> DataFrame:
    """Mean of -ln p(gold class)."""
    p = F.least(F.greatest(F.get(F.col(probs), F.col(gold_id)), F.lit(CLIP)), F.lit(1.0))
    return df.agg(F.avg(-F.ln(p)).alias("loss"))
