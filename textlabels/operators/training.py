"""spark.ml training: one binary model per label, a multi-class model, random search.

Solvers run as Spark jobs (gradients are tree-aggregated); the driver holds
only coefficient vectors, whose size is fixed by ``num_features`` or the
embedding length.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import tokens
from textlabels.functions.constants import EVAL_THRESHOLD
from textlabels.operators.metrics import multilabel_metrics

DEFAULTS = {"weight_decay": 0.01, "epochs": 10, "num_features": 1 << 18}

# Search space: kind and bounds per parameter.
SPACE = {
    "weight_decay": ("loguniform", 1e-5, 0.1),
    "epochs": ("int", 2, 5),
    "elastic_net": ("uniform", 0.0, 0.3),
    "standardize": ("choice", [True, False]),
}


def _estimator(params: Mapping, label: str, weight: str | None, family: str) -> LogisticRegression:
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, family=family,
        regParam=float(params.get("weight_decay", DEFAULTS["weight_decay"])),
        elasticNetParam=float(params.get("elastic_net", 0.0)),
        maxIter=int(params.get("epochs", DEFAULTS["epochs"])),
        standardization=bool(params.get("standardize", True)))
    return lr.setWeightCol(weight) if weight else lr


@dataclass(frozen=True)
class MultiLabelModel:
    labels: tuple[str, ...]
    features: PipelineModel
    models: tuple[LogisticRegressionModel, ...]

    def predict(self, df: DataFrame, text: str = "text", out: str = "probs") -> DataFrame:
        """Adds the probability vector in label order."""
        rows = self.features.transform(df.withColumn("_tokens", tokens(text)))
        return _append_probs(rows, self.models, out).drop("_tokens", "_tf", "features")


def _append_probs(rows: DataFrame, models: Sequence[LogisticRegressionModel], out: str) -> DataFrame:
    scratch = []
    for k, model in enumerate(models):
        fitted = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{k}")
        rows = fitted.transform(rows)
        scratch.append(f"_p{k}")
    value = F.array(*[vector_to_array(F.col(c))[1] for c in scratch])
    return rows.withColumn(out, value).drop(*scratch)


def _featurizer(num_features: int) -> Pipeline:
    return Pipeline(stages=[HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="features")])


def _text_features(df: DataFrame, text: str, columns: Sequence, num_features: int) -> tuple[PipelineModel, DataFrame]:
    """The fitted featurizer and the persisted ``features`` + ``columns``; the text is split once.

    The term frequencies are persisted and serve both the IDF and the features.
    The caller unpersists the result.
    """
    hashing, idf = _featurizer(num_features).getStages()
    tf = hashing.transform(df.select(tokens(text).alias("_tokens"), *columns)).drop("_tokens").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = idf.fit(tf)
        ready = fitted.transform(tf).drop("_tf").persist(StorageLevel.MEMORY_AND_DISK)
        ready.count()
    finally:
        tf.unpersist()
    return PipelineModel([hashing, fitted]), ready


def train_multilabel(df: DataFrame, text: str, targets: Sequence[str], labels: Sequence[str],
                     params: Mapping = DEFAULTS, weight: str | None = None, parallelism: int = 4) -> MultiLabelModel:
    """One logistic regression per label on shared, once-built features; ``parallelism`` labels fit side by side.

    ``num_features`` bounds the hashed vocabulary (2^18 by default): choose it well
    above the number of different tokens that matter.
    """
    num = int(params.get("num_features", DEFAULTS["num_features"]))
    features, ready = _text_features(df, text, [*[F.col(t).cast("double").alias(t) for t in targets], *([weight] if weight else [])], num)
    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            models = tuple(pool.map(lambda t: _estimator(params, t, weight, "binomial").fit(ready), targets))
    finally:
        ready.unpersist()
    return MultiLabelModel(tuple(labels), features, models)


@dataclass(frozen=True)
class TextClassModel:
    """Softmax model on the words of a text."""

    features: PipelineModel
    model: LogisticRegressionModel


def train_multiclass(df: DataFrame, col: str, label: str, params: Mapping = DEFAULTS) -> LogisticRegressionModel | TextClassModel:
    """Softmax classifier on a text column or on an array column of numbers; ``label`` holds class ids from 0."""
    if df.schema[col].dataType.typeName() == "string":
        num = int(params.get("num_features", DEFAULTS["num_features"]))
        features, ready = _text_features(df, col, [F.col(label).cast("double").alias("label")], num)
        try:
            return TextClassModel(features, _estimator(params, "label", None, "multinomial").fit(ready))
        finally:
            ready.unpersist()
    rows = df.select(array_to_vector(F.col(col).cast("array<double>")).alias("features"),
                     F.col(label).cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _estimator(params, "label", None, "multinomial").fit(rows)
    finally:
        rows.unpersist()


def predict_multiclass(df: DataFrame, col: str, model: LogisticRegressionModel | TextClassModel, out: str = "pred_id",
                       probs: str = "probs") -> DataFrame:
    if isinstance(model, TextClassModel):
        rows, fitted = model.features.transform(df.withColumn("_tokens", tokens(col))).drop("_tokens", "_tf"), model.model
    else:
        rows, fitted = df.withColumn("features", array_to_vector(F.col(col).cast("array<double>"))), model
    return (fitted.transform(rows).withColumn(out, F.col("prediction").cast("int"))
                 .withColumn(probs, vector_to_array("probability"))
                 .drop("features", "rawPrediction", "probability", "prediction"))


def sample_params(space: Mapping[str, tuple], n_trials: int, seed: int) -> list[dict]:
    """Seeded parameter sets; the same seed gives the same list."""
    rng = random.Random(seed)

    def draw(kind: str, *bounds):
        if kind == "loguniform":
            return math.exp(rng.uniform(math.log(bounds[0]), math.log(bounds[1])))
        if kind == "uniform":
            return rng.uniform(*bounds)
        if kind == "int":
            return rng.randint(*bounds)
        if kind == "choice":
            return rng.choice(bounds[0])
        raise ValueError(f"unknown kind {kind!r}")

    return [{name: draw(*spec) for name, spec in space.items()} for _ in range(n_trials)]


def tune(train: DataFrame, val: DataFrame, text: str, targets: Sequence[str], space: Mapping[str, tuple] = SPACE,
         n_trials: int = 10, seed: int = 42, parallelism: int = 4,
         num_features: int = DEFAULTS["num_features"]) -> tuple[DataFrame, dict]:
    """Random search for the macro F1 on the validation rows.

    Returns the trials table ``(trial, state, value, error, params)`` and the best
    parameters.  Features are built once; each trial is a set of Spark jobs,
    ``parallelism`` trials run side by side.  A trial that fails is recorded;
    if none completes, that is an error.
    """
    spark = train.sparkSession
    columns = [F.col(t).cast("double").alias(t) for t in targets]
    features, fit_rows = _text_features(train, text, columns, num_features)
    val_rows = (features.transform(val.select(tokens(text).alias("_tokens"), *columns)).select("features", *targets)
                .persist(StorageLevel.MEMORY_AND_DISK))

    def run(params: dict) -> tuple[str, float | None, str | None]:
        try:
            models = [_estimator(params, t, None, "binomial").fit(fit_rows) for t in targets]
            scored = _append_probs(val_rows, models, "probs").select(
                F.array(*[F.col(t).cast("int") for t in targets]).alias("gold"),
                F.transform("probs", lambda p: (p > EVAL_THRESHOLD).cast("int")).alias("pred"))
            return "COMPLETE", multilabel_metrics(scored, "gold", "pred").first()["f1_macro"], None
        except Exception as error:      # recorded as a failed trial, the search goes on
            return "FAIL", None, str(error)

    drawn = sample_params(space, n_trials, seed)
    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            outcome = list(pool.map(run, drawn))
    finally:
        fit_rows.unpersist()
        val_rows.unpersist()
    if all(state == "FAIL" for state, _, _ in outcome):
        raise RuntimeError(f"no trial completed; the first failed with: {outcome[0][2] if outcome else 'no trials'}")
    rows = [(i, state, value, error, {k: str(v) for k, v in params.items()})
            for i, (params, (state, value, error)) in enumerate(zip(drawn, outcome))]
    trials = spark.createDataFrame(
        rows, "trial int, state string, value double, error string, params map<string, string>")
    complete = [(value, -i) for i, (state, value, _) in enumerate(outcome) if state == "COMPLETE"]
    best = drawn[-max(complete)[1]]
    return trials, best


def best_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    """The n best completed trials, best first; ties by trial number."""
    return trials.where(F.col("state") == "COMPLETE").orderBy(F.desc("value"), "trial").limit(n)
