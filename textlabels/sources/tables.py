"""Reading and writing labelled tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.functions.constants import LABELS28, PARAM_DEFAULTS, TEXT_CANDIDATES_LABELLING
from textlabels.operators.text import corpus_lines
from textlabels.sources import csv_split

# Speech text holds quotes and line breaks, so CSV quoting doubles the quote
# character and a record may span lines.
_CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "lineSep": "\n",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "escapeQuotes": "true", "lineSep": "\n",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# text formats keep time stamps to the microsecond
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FORMATS = ("csv", "parquet", "json", "orc")


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str, schema: T.StructType | str,
               splits: bool = True, **options: str) -> DataFrame:
    """Load a table with a declared schema (nothing is inferred).

    A CSV record may span lines; such files are read by one task a split (see
    ``csv_split``).  With options that it does not know, or ``splits=False``,
    Spark's own reader takes each file in one task.  Pass ``multiLine="false"``
    for files with one record per line, which Spark splits itself.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    base = {"csv": {**_CSV_READ, **_TIMES}, "json": _TIMES}.get(fmt, {})
    chosen = {**base, **options}
    if fmt == "csv" and splits and csv_split.can_split(chosen):
        return csv_split.read(spark, path, T._parse_datatype_string(schema) if isinstance(schema, str) else schema, chosen)
    return spark.read.schema(schema).format(fmt).options(**chosen).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] = (), **options: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    base = {"csv": {**_CSV_WRITE, **_TIMES}, "json": _TIMES}.get(fmt, {})
    writer = df.write.mode(mode).format(fmt).options(**{**base, **options})
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, mode: str = "errorifexists") -> None:
    """A Parquet table at ``path``, named ``name`` in the catalog, with one sorted file for each bucket of ``keys``.

    The rows are shuffled once, here.  Joins and aggregates by ``keys`` with as many
    partitions then take the table as it lies.
    """
    (df.repartition(buckets, *keys).write.mode(mode).format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))


def read_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that ``write_bucketed`` left at ``path``, also in a session whose catalog does not know it yet."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def union_splits(splits: Mapping[str, DataFrame], out: str = "split") -> DataFrame:
    """Concatenate tables, keep where each row came from; columns match by name, gaps become null."""
    parts = [df.withColumn(out, F.lit(name)) for name, df in splits.items()]
    if not parts:
        raise ValueError("union_splits needs at least one table")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def write_annotations(df: DataFrame, path: str, mode: str = "errorifexists", split: str = "split") -> None:
    """Annotated rows as Parquet, one folder per split."""
    write_table(df, path, "parquet", mode, [split])


def load_annotations(spark: SparkSession, path: str, split: str | None = None,
                     schema: str = "doc_id bigint, text string, labels array<int>, split string") -> DataFrame:
    """Annotated rows of one split (only its folder is read) or of all splits."""
    df = spark.read.schema(schema).parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_lines(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    """One stripped document per line; line breaks inside a document become one blank."""
    df.where(F.col(col).isNotNull()).select(corpus_lines(col).alias("value")).write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n")


# --- results document -------------------------------------------------------

_HYPER = ("struct<learning_rate: double, batch_size: int, epochs: int, warmup_steps: int, "
          "warmup_ratio: double, weight_decay: double, dropout: double>")
_METRICS = "struct<f1_micro: double, f1_macro: double, loss: double>"
RESULTS_SCHEMA = (
    f"baseline struct<hyperparameters: {_HYPER}, test_metrics: {_METRICS}>, "
    f"tuned struct<hyperparameters: {_HYPER}, test_metrics: {_METRICS}>, "
    "improvement struct<f1_micro_pct: double, f1_macro_pct: double, loss_pct: double>, "
    "study struct<n_trials: int, n_completed: int, best_trial_number: int, best_val_f1: double>")


def results_document(metrics: DataFrame, base: str, new: str, base_params: Mapping[str, float] | None = None,
                     new_params: Mapping[str, float] | None = None, study: Mapping[str, float] | None = None,
                     model: str = "model") -> DataFrame:
    """``metrics(model, f1_micro, f1_macro, loss)`` of two runs -> one nested results row."""
    hyper_type = T._parse_datatype_string(RESULTS_SCHEMA)["baseline"].dataType["hyperparameters"].dataType
    study_type = T._parse_datatype_string(RESULTS_SCHEMA)["study"].dataType

    def literal_struct(values: Mapping[str, float] | None, kind: T.StructType):
        return F.struct(*[F.lit((values or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in kind])

    def measured(name: str):
        pick = F.max(F.when(F.col(model) == name, F.struct("f1_micro", "f1_macro", "loss")))
        return pick.alias("base" if name == base else "new")

    def change(metric: str, sign: int = 1):
        old, now = F.col(f"base.{metric}"), F.col(f"new.{metric}")
        return sign * (now - old) / F.nullif(old, F.lit(0.0)) * 100

    return metrics.agg(measured(base), measured(new)).select(
        F.struct(literal_struct(base_params, hyper_type).alias("hyperparameters"),
                 F.col("base").alias("test_metrics")).alias("baseline"),
        F.struct(literal_struct(new_params, hyper_type).alias("hyperparameters"),
                 F.col("new").alias("test_metrics")).alias("tuned"),
        F.struct(change("f1_micro").alias("f1_micro_pct"), change("f1_macro").alias("f1_macro_pct"),
                 change("loss", -1).alias("loss_pct")).alias("improvement"),
        literal_struct(study, study_type).alias("study"))


def save_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS_SCHEMA).json(path)


def load_params(spark: SparkSession, path: str, defaults: Mapping[str, float] = PARAM_DEFAULTS) -> DataFrame:
    """One row of tuned hyper-parameters.

    A missing document, or a missing value in it, gives the default.
    """
    try:
        tuned = load_results(spark, path).select("tuned.hyperparameters")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        tuned = spark.createDataFrame([], f"hyperparameters {_HYPER}")
    kind = tuned.schema["hyperparameters"].dataType
    return tuned.agg(F.first("hyperparameters").alias("h")).select(*[
        F.coalesce(F.col(f"h.{k}"), F.lit(v).cast(kind[k].dataType)).alias(k) for k, v in defaults.items()])


# --- input conformance ------------------------------------------------------

def find_text_column(columns: Sequence[str], candidates: Sequence[str]) -> str:
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"no text column: expected one of {list(candidates)}, found {list(columns)}")


def conform_input(df: DataFrame, text_candidates: Sequence[str] = TEXT_CANDIDATES_LABELLING,
                  required: Sequence[str] = (), labels: Sequence[str] = LABELS28, text: str = "text") -> DataFrame:
    """Bring a table to the expected shape with one projection.

    The first candidate present becomes ``text``; a missing required column is
    an error; missing label columns are reported and added as null.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    found = find_text_column(df.columns, text_candidates)
    missing = [x for x in labels if x not in df.columns]
    if missing:
        warnings.warn(f"label columns not in the table, added as null: {missing}", stacklevel=2)
    taken = [] if found == text else [text]
    kept = [F.col(c).alias(text) if c == found else F.col(c) for c in df.columns if c not in taken]
    return df.select(*kept, *[F.lit(None).cast("int").alias(x) for x in missing])
