"""Input views of the registered queries, derived by Spark from the given tables.

Labels, predictions and scores are pseudo-random functions of the row key
(md5), so every engine can rebuild them; there is one row per row of the table
they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabels.functions.columns import hash32, label_array, multi_hot
from textlabels.functions.constants import DIALOGUE7, LABELS28
from textlabels.operators.splitting import split_three
from textlabels.sources.workspace import materialize

MODELS3 = {"published": 45, "custom_a": 55, "custom_b": 50}
# model -> (tags of the hashes, percent of gold kept, percent of noise added)
RUNS = {"baseline": ("p", "q", "s", 60, 3), "tuned": ("p2", "q2", "s2", 75, 2)}
BINARY = ["quality", "toxic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document keys, the base of the hash-derived views."""
    return documents(spark, sf_dir).select("doc_id")


def _ids() -> Column:
    return F.array(*[F.lit(j) for j in range(28)])


def _h(tag: str, j: Column) -> Column:
    return hash32("doc_id", F.lit(tag), j)


def gold28(df: DataFrame) -> DataFrame:
    """Adds ``labels``: the gold label ids of a row, at least one."""
    drawn = F.filter(_ids(), lambda j: _h("g", j) % 100 < 6)
    return (df.withColumn("labels", drawn)
              .withColumn("labels", F.when(F.size("labels") == 0, F.array(F.lit(27))).otherwise(F.col("labels"))))


def _pred(run: str) -> Column:
    keep, noise, _, kept_pct, noise_pct = RUNS[run]
    return F.filter(_ids(), lambda j: (
        (F.array_contains("labels", j) & (_h(keep, j) % 100 < kept_pct)) | (_h(noise, j) % 100 < noise_pct)))


def _scores(run: str) -> Column:
    tag = RUNS[run][2]
    scale = F.when(F.col("doc_id") % 4 == 0, F.lit(0.29)).otherwise(F.lit(1.0))
    return F.transform(_ids(), lambda j: (_h(tag, j) % 101) / F.lit(100.0) * scale)


def pred28(df: DataFrame, run: str = "baseline") -> DataFrame:
    """Adds ``pred_labels`` to a table with gold ``labels``."""
    return df.withColumn("pred_labels", _pred(run))


def scores28(df: DataFrame, run: str = "baseline") -> DataFrame:
    """Adds ``probs``: two-decimal values, so ties and exact thresholds occur."""
    return df.withColumn("probs", _scores(run))


def multilabel_runs(spark: SparkSession, sf_dir: str, probs: bool = False, runs: tuple[str, ...] = tuple(RUNS)) -> DataFrame:
    """(model, doc_id, gold_vec, pred_vec[, probs]) of all runs, from one pass over the documents."""
    rows = gold28(doc_ids(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("model"), _pred(r).alias("pred_labels"),
                                        *([_scores(r).alias("probs")] if probs else [])) for r in runs]))
    return rows.select("doc_id", "labels", each.alias("r")).select("doc_id", "labels", "r.*").select(
        "model", "doc_id", multi_hot("labels", 28).alias("gold_vec"), multi_hot("pred_labels", 28).alias("pred_vec"),
        *(["probs"] if probs else []))


def multilabel(spark: SparkSession, sf_dir: str, run: str = "baseline", probs: bool = False) -> DataFrame:
    """(model, doc_id, gold_vec, pred_vec[, probs]) of one run."""
    return multilabel_runs(spark, sf_dir, probs, (run,))


def annotations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, one 0/1 column per label)."""
    df = gold28(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select(F.col("doc_id").alias("id"), "text", *[
        F.array_contains("labels", F.lit(j)).cast("int").alias(x) for j, x in enumerate(LABELS28)])


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    utt = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), F.col("role").alias("Speaker"),
        F.col("text").alias("Utterance"))
    part = hash32("utt_id", F.lit("split")) % 10
    draw = hash32("utt_id", F.lit("e")) % 14
    return utt.select(
        "utt_id", F.when(part < 8, "train").when(part == 8, "dev").otherwise("test").alias("split"),
        "Speaker", "Utterance",
        F.when(draw < 6, "neutral").when(draw < 9, "joy").when(draw < 11, "surprise").when(draw == 11, "anger")
         .when(draw == 12, "sadness").otherwise("disgust").alias("Emotion"))


def utterance_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, gold, pred): half of the predictions right, the rest drawn from all classes."""
    other = F.get(label_array(DIALOGUE7), (hash32("utt_id", F.lit("w")) % 7).cast("int"))
    return utterances(spark, sf_dir).select("utt_id", F.col("Emotion").alias("gold"), F.when(
        hash32("utt_id", F.lit("r")) % 100 < 50, F.col("Emotion")).otherwise(other).alias("pred"))


def gold3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, gold): the first gold label of every document."""
    df = gold28(doc_ids(spark, sf_dir))
    return df.select(F.col("doc_id").alias("row_id"), F.get(label_array(LABELS28), F.get("labels", F.lit(0))).alias("gold"))


def preds3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, gold, pred) for three models."""
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("pct")) for m, a in MODELS3.items()])
    rows = gold3(spark, sf_dir).select("row_id", "gold", F.explode(names).alias("m"))
    right = hash32("row_id", "m.model") % 100 < F.col("m.pct")
    other = F.get(label_array(LABELS28), (hash32("row_id", "m.model", F.lit("x")) % 28).cast("int"))
    return rows.select("m.model", "row_id", "gold", F.when(right, F.col("gold")).otherwise(other).alias("pred"))


RAW_OUTPUTS = [" Joy \nmore", "joy", "i think joy", "joy.", "", "sadness or joy", "ANGER"]


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, output): what a language model returns: an answer and the text after it, or only text."""
    answer = F.get(label_array(RAW_OUTPUTS), (hash32("doc_id", F.lit("o")) % 8).cast("int"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), F.coalesce(F.concat(answer, F.lit("\n"), "text"), "text").alias("output"))


def documents_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): all documents, and rows with null and blank texts besides (negative ids)."""
    more = doc_ids(spark, sf_dir).where("doc_id % 97 <= 1").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("doc_id") % 97 == 1, "   ").alias("text"))
    return documents(spark, sf_dir).select("doc_id", "text").unionByName(more)


def labelled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, quality, toxic, split): the documents with real binary labels, split exactly.

    The split of the (narrow) label table is written once, so that fitting,
    scoring and evaluation read the same assignment instead of deriving it again.
    """
    labels = materialize(split_three(table(spark, sf_dir, "labels"), "doc_id"), "labels-split")
    return documents(spark, sf_dir).select("doc_id", "text", "lang").join(labels, "doc_id")
