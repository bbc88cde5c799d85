"""Logistic regression by epochs, with a history, the best checkpoint, and a warm start.

Texts are hashed to word features and written once.  An epoch is one pass over
them: every task adds up its part of the loss, the gradient and the validation
counts; parts of the gradient are summed by slices of fixed length, so the sums
are spread over as many tasks as there are slices.  The driver keeps the
coefficients (labels * (features + 1) numbers, whatever the rows) and takes the
limited-memory BFGS step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.functions.columns import tokens
from textlabels.sources.workspace import materialize

SIZE = 1 << 18              # hashed features
SLICE = 1 << 16             # numbers of a slice of the gradient
MEMORY = 8                  # steps the solver remembers


@dataclass(frozen=True)
class EpochModel:
    """``coefficients``: (labels, features + 1), the last column for the bias."""

    labels: tuple[str, ...]
    coefficients: np.ndarray

    @property
    def size(self) -> int:
        return self.coefficients.shape[1] - 1

    def predict(self, df: DataFrame, text: str = "text", out: str = "probs") -> DataFrame:
        """Adds the probabilities in label order; a text without words has those of the bias."""
        shared = df.sparkSession.sparkContext.broadcast(self.coefficients)

        @F.arrow_udf("array<double>")
        def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for ids in batches:
                p = 1 / (1 + np.exp(-_margins(shared.value, *_flat(ids))))
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, len(p)), pa.int32()), pa.array(np.ascontiguousarray(p.T).ravel()))

        return df.withColumn(out, probabilities(word_features(text, self.size)))


@dataclass(frozen=True)
class Fitted:
    """The model of the best epoch, that of the last one, and ``(epoch, train_loss, validation_f1)`` of each."""

    best: EpochModel
    last: EpochModel
    epochs: list[tuple[int, float, float | None]] = field(default_factory=list)


def word_features(text: str, size: int = SIZE) -> Column:
    """Places of the distinct words of a text, hashed; together they weigh 1."""
    return F.array_distinct(F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")))


def features(df: DataFrame, text: str, targets: Sequence[str], size: int = SIZE, validation: Column | None = None,
             weight: str | None = None) -> DataFrame:
    """(ids, y, weight): the rows to learn from; validation rows weigh null.  Null targets count as 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))
    y = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(0.0)) for t in targets])
    return materialize(df.select(word_features(text, size).alias("ids"), y.alias("y"), F.when(~held, w).alias("weight")), "features")


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.flatten().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy())


def _margins(coefficients: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(labels, rows)"""
    row = np.repeat(np.arange(len(lengths)), lengths)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    return np.stack([np.bincount(row, c[flat], minlength=len(lengths)) * scale + c[-1] for c in coefficients])


def _pass(rows: DataFrame, coefficients: np.ndarray) -> tuple[float, np.ndarray, float | None]:
    """(mean loss, its gradient, macro F1 of the validation rows or None) at the coefficients; one Spark job."""
    k, width = coefficients.shape
    shared = rows.sparkSession.sparkContext.broadcast(coefficients)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gradient, facts = np.zeros((k, width)), np.zeros(2 + 4 * k)          # weight, loss; tp, fp, fn, rows by label
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths = _flat(batch.column("ids"))
            y = batch.column("y").flatten().to_numpy().reshape(-1, k).T
            w = batch.column("weight").to_numpy(zero_copy_only=False)
            z, scale = _margins(own, flat, lengths), 1 / np.sqrt(np.maximum(lengths, 1))
            learn = np.nan_to_num(w)
            facts[0] += learn.sum()
            facts[1] += (learn * (np.logaddexp(0, z) - y * z)).sum()
            for j in range(k):
                r = learn * (1 / (1 + np.exp(-z[j])) - y[j])
                gradient[j] += np.bincount(flat, np.repeat(r * scale, lengths), minlength=width)
                gradient[j, -1] += r.sum()
                held, said = np.isnan(w), z[j] > 0
                facts[2 + 4 * j:6 + 4 * j] += [np.sum(held & said & (y[j] > 0)), np.sum(held & said & (y[j] <= 0)),
                                              np.sum(held & ~said & (y[j] > 0)), held.sum()]
        parts = np.split(gradient.ravel(), range(SLICE, gradient.size, SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([facts, *parts], pa.list_(pa.float64()))],
                                         names=["part", "numbers"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, numbers in zip(batch.column("part").to_pylist(), batch.column("numbers")):
                here = numbers.values.to_numpy()
                total[part] = total[part] + here if part in total else here.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["part", "numbers"])

    schema = "part int, numbers array<double>"
    sums = rows.mapInArrow(add_up, schema).repartition("part").mapInArrow(merge, schema).toArrow()
    shared.unpersist()
    found = {p: np.array(n) for p, n in zip(sums.column("part").to_pylist(), (x.values.to_numpy() for x in sums.column("numbers")))}
    facts = found.pop(-1, np.zeros(2 + 4 * k))
    gradient = np.concatenate([found[i] for i in sorted(found)]).reshape(k, width) if found else np.zeros((k, width))
    weight = facts[0] or 1.0
    tp, fp, fn, n = facts[2:].reshape(k, 4).T
    f1 = float(np.mean(np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0))) if n.any() else None
    return float(facts[1] / weight), gradient / weight, f1


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], first: float) -> np.ndarray:
    """Two-loop recursion of limited-memory BFGS; without steps a gradient step that cannot overshoot."""
    d, held = gradient.copy(), []
    for s, y in reversed(steps):
        a = np.vdot(s, d) / np.vdot(s, y)
        d -= a * y
        held.append(a)
    if steps:
        s, y = steps[-1]
        d *= np.vdot(s, y) / np.vdot(y, y)
    else:
        d *= first
    for (s, y), a in zip(steps, reversed(held)):
        d += (a - np.vdot(y, d) / np.vdot(s, y)) * s
    return -d


def fit(rows: DataFrame, labels: Sequence[str], epochs: int = 20, decay: float = 1e-3, size: int = SIZE,
        start: EpochModel | None = None, pull: float = 0.0, weight: float = 1.0) -> Fitted:
    """Minimise ``weight * mean loss + decay/2 |c|^2 + pull/2 |c - start|^2`` over the rows of ``features``.

    Epoch 0 is the start (zeros, or ``start``).  The best epoch is the first with
    the largest macro F1 on the validation rows, or the last one without such rows.
    """
    begin = np.zeros((len(labels), size + 1)) if start is None else np.array(start.coefficients, float)
    if begin.shape != (len(labels), size + 1):
        raise ValueError(f"the start has the shape {begin.shape}, expected {(len(labels), size + 1)}")
    no_bias = np.ones_like(begin)
    no_bias[:, -1] = 0

    def evaluate(at: np.ndarray) -> tuple[float, float, np.ndarray, float | None]:
        loss, gradient, f1 = _pass(rows, at)
        whole = weight * loss + decay / 2 * np.sum((at * no_bias) ** 2) + pull / 2 * np.sum((at - begin) ** 2)
        return whole, loss, weight * gradient + decay * at * no_bias + pull * (at - begin), f1

    at = begin
    goal, loss, gradient, f1 = evaluate(at)
    history, best, best_f1 = [(0, loss, f1)], at, f1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for epoch in range(1, epochs + 1):
        d = _direction(gradient, steps, 1 / (0.5 * weight + decay + pull + 1e-12))
        slope, length = np.vdot(d, gradient), 1.0
        if -slope < 1e-14:
            break
        while True:
            goal2, loss2, gradient2, f1 = evaluate(at + length * d)
            if goal2 <= goal + 1e-4 * length * slope or length < 1e-3:
                break
            length /= 2
        change, bend = length * d, gradient2 - gradient
        if np.vdot(change, bend) > 1e-12 * np.vdot(bend, bend):
            steps = [*steps, (change, bend)][-MEMORY:]
        at, goal, loss, gradient = at + change, goal2, loss2, gradient2
        history.append((epoch, loss, f1))
        if f1 is None or f1 > best_f1:
            best, best_f1 = at, f1
    names = tuple(labels)
    return Fitted(EpochModel(names, best), EpochModel(names, at), history)


def history(runs: Mapping[str, Fitted], spark) -> DataFrame:
    """(run, epoch, train_loss, validation_f1) of several fits, for ``running_best`` and ``best_epoch``."""
    return spark.createDataFrame([(run, *e) for run, fitted in runs.items() for e in fitted.epochs],
                                 "run string, epoch int, train_loss double, validation_f1 double")


def warm_start(source: EpochModel, target: DataFrame, text: str, targets: Sequence[str], weight: float, pull: float = 1e-2,
               epochs: int = 20, validation: Column | None = None) -> Fitted:
    """Move a model to a new corpus: fit the target rows, pulled towards the coefficients of ``source``.

    ``weight`` is that of the target's loss: with 0 the source model comes back,
    the larger it is the less the source counts.  The source rows are not read.
    """
    rows = features(target, text, targets, source.size, validation)
    return fit(rows, source.labels, epochs, 0.0, source.size, source, pull, weight)
