"""Label operators: encode, decode, roll up, threshold, normalise.

All of them are single projections over the input: no shuffle, no job.
Probability vectors and multi-hot vectors are arrays in label order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import (
    argmax, as_col, label_array, multi_hot, passes, raw_tokens, strip, total,
)
from textlabels.functions.constants import (
    COARSE7, EVAL_THRESHOLD, INVALID, LABEL_THRESHOLD, LABELS28, TAXONOMY,
)


def multi_hot_encode(df: DataFrame, col: str, labels: Sequence[str] = LABELS28,
                     wide: bool = True, out: str = "multi_hot") -> DataFrame:
    """List of label ids -> one 0/1 column per label, or one 0/1 array."""
    if wide:
        return df.withColumns({
            name: F.array_contains(col, F.lit(j)).cast("int") for j, name in enumerate(labels)})
    return df.withColumn(out, multi_hot(col, len(labels)))


def multi_hot_decode(df: DataFrame, labels: Sequence[str] = LABELS28, vec: str | None = None,
                     out: str = "active") -> DataFrame:
    """0/1 columns (or one 0/1 array) -> active labels in label order + comma-joined text."""
    flags = [F.get(F.col(vec), F.lit(j)) if vec else F.col(x) for j, x in enumerate(labels)]
    active = F.array_compact(F.array(*[F.when(f == 1, F.lit(x)) for f, x in zip(flags, labels)]))
    return (df.withColumn(out, active)
              .withColumn(f"{out}_text", F.array_join(out, ",")))


def single_label(df: DataFrame, labels: Sequence[str] = LABELS28, out: str = "label") -> DataFrame:
    """The label if exactly one of the listed 0/1 columns is active, else null."""
    on = [F.coalesce(F.col(x) == 1, F.lit(False)) for x in labels]
    first = F.coalesce(*[F.when(f, F.lit(x)) for f, x in zip(on, labels)])
    return df.withColumn(out, F.when(total([f.cast("int") for f in on]) == 1, first))


def taxonomy_rollup(df: DataFrame, mapping: Mapping[str, Sequence[str]] = TAXONOMY,
                    targets: Sequence[str] = COARSE7, prefix: str = "coarse_") -> DataFrame:
    """Coarse 0/1 column = OR of the fine 0/1 columns it covers (fine columns that are absent are skipped)."""
    def covered(target: str) -> Column:
        cols = [F.col(x) for x in mapping.get(target, []) if x in df.columns]
        if not cols:
            return F.lit(None).cast("int")
        return F.greatest(*cols) if len(cols) > 1 else cols[0]

    return df.withColumns({prefix + t: covered(t) for t in targets})


def taxonomy_rollup_ids(df: DataFrame, col: str, labels: Sequence[str] = LABELS28,
                        mapping: Mapping[str, Sequence[str]] = TAXONOMY,
                        targets: Sequence[str] = COARSE7, out: str = "coarse_ids") -> DataFrame:
    """The same roll-up on id lists: fine ids -> distinct coarse ids, ascending."""
    hits = [F.when(F.arrays_overlap(F.col(col), F.array(*[F.lit(labels.index(x)) for x in mapping[t]])), F.lit(k))
            for k, t in enumerate(targets)]
    return df.withColumn(out, F.array_compact(F.array(*hits)))


def label_to_id(df: DataFrame, col: str, mapping: Mapping[str, int], mode: str = "fail",
                out: str = "label_id") -> DataFrame:
    """Class name -> id.  An unknown name fails the job, or gives null with ``mode='null'``."""
    if mode not in ("fail", "null"):
        raise ValueError("mode must be 'fail' or 'null'")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), F.col(col)).cast("int")
    if mode == "fail":
        message = F.concat(F.lit("unknown label: "), F.coalesce(F.col(col), F.lit("null")))
        found = F.when(found.isNotNull(), found).otherwise(F.raise_error(message).cast("int"))
    return df.withColumn(out, found)


def id_to_label(df: DataFrame, col: str, labels: Sequence[str] = LABELS28, out: str = "label") -> DataFrame:
    """Id -> class name; null when the id is out of range."""
    return df.withColumn(out, F.get(label_array(labels), F.col(col)))


def over_threshold(probs: str | Column, labels: Sequence[str], threshold: float, inclusive: bool) -> Column:
    p = as_col(probs)
    return F.array_compact(F.array(*[
        F.when(passes(F.get(p, F.lit(j)), threshold, inclusive), F.lit(x)) for j, x in enumerate(labels)]))


def threshold_labels(df: DataFrame, probs: str, labels: Sequence[str] = LABELS28,
                     threshold: float = LABEL_THRESHOLD, inclusive: bool = True,
                     fallback: str | None = "argmax", out: str = "all_labels") -> DataFrame:
    """Labels over the threshold; if none, ``[argmax]``, ``[fallback]`` or an empty list (fallback=None)."""
    hit = over_threshold(probs, labels, threshold, inclusive)
    if fallback is not None:
        other = F.get(label_array(labels), argmax(probs)) if fallback == "argmax" else F.lit(fallback)
        return (df.withColumn(out, hit)
                  .withColumn(out, F.when(F.size(out) == 0, F.array(other)).otherwise(F.col(out))))
    return df.withColumn(out, hit)


def threshold_binary(df: DataFrame, probs: str, threshold: float = EVAL_THRESHOLD, inclusive: bool = False,
                     out: str = "pred_vec") -> DataFrame:
    """0/1 vector from the raw threshold (no fallback: a row may be all 0)."""
    return df.withColumn(out, F.transform(probs, lambda p: passes(p, threshold, inclusive).cast("int")))


def argmax_label(df: DataFrame, probs: str, labels: Sequence[str] = LABELS28, out: str = "primary") -> DataFrame:
    """Most probable label; the first label wins a tie."""
    return df.withColumn(out, F.get(label_array(labels), argmax(probs)))


def topk_labels(df: DataFrame, probs: str, labels: Sequence[str] = LABELS28, k: int = 5,
                out: str = "topk") -> DataFrame:
    """The k most probable (label, prob), ties in label order, and their ``label:0.00`` rendering."""
    names = label_array(labels)
    ranked = F.array_sort(F.transform(probs, lambda p, j: F.struct((-p).alias("neg"), j.alias("j"))))
    best = F.transform(F.slice(ranked, 1, k), lambda s: F.struct(
        F.get(names, s["j"]).alias("label"), (-s["neg"]).alias("prob")))
    text = F.array_join(F.transform(out, lambda s: F.concat(s["label"], F.lit(":"), F.format_number(s["prob"], 2))), ", ")
    return df.withColumn(out, best).withColumn(f"{out}_text", text)


def expand_probs(df: DataFrame, probs: str, labels: Sequence[str] = LABELS28,
                 threshold: float = LABEL_THRESHOLD, inclusive: bool = True) -> DataFrame:
    """``prob_<label>`` and 0/1 ``<label>`` columns, from the raw threshold."""
    p = [F.get(F.col(probs), F.lit(j)) for j in range(len(labels))]
    cols = {}
    for value, name in zip(p, labels):
        cols[f"prob_{name}"] = value
        cols[name] = passes(value, threshold, inclusive).cast("int")
    return df.withColumns(cols)


def normalize_label(df: DataFrame, col: str, labels: Sequence[str] = LABELS28, out: str = "label") -> DataFrame:
    """Free text -> label: exact match, else the first label (in list order) among the words, else 'invalid'."""
    clean = strip(F.lower(F.col(col)))
    words = raw_tokens(F.lower(F.col(col)))
    token_hit = F.get(F.array_intersect(label_array(labels), words), F.lit(0))         # in list order
    return df.withColumn(out, F.coalesce(F.when(clean.isin(list(labels)), clean), token_hit, F.lit(INVALID)))


def lower_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Case-fold label columns."""
    return df.withColumns({c: F.lower(c) for c in cols})
