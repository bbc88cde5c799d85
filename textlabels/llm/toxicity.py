"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another.  Each is a logistic model over
the words and word beginnings of the whole text, and over the probabilities of
the categories before it.  For fitting, those probabilities are out-of-fold: a
row's come from models that have not seen the row, as will be the case when
texts are scored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.llm.quality import held_out, labelled_sample

# Words that tell the kind of a toxic text, used to label the first categories.
CATEGORIES = {
    "insult": ["idiot", "moron", "loser", "clown", "scum"],
    "contempt": ["stupid", "disgusting", "trash", "pathetic", "worthless"],
}
LAST = "toxic"                 # the category that the labels give
SAMPLE_ROWS = 6000             # labelled rows the chain is fitted on, at most
FEATURES = 512                 # words and beginnings a category uses
LEAST_ROWS = 3                 # rows of the sample a feature has to be in
BEGINNINGS = (4, 5)            # bytes of a word's beginning
FOLDS, STEPS, RATE, SHRINK = 5, 120, 0.1, 1e-4
THRESHOLD = 0.5
_WORDS = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def features(text: str | None) -> set[bytes]:
    """Words and word beginnings (marked with "^") of a whole text, A-Z lower-cased."""
    found = set((text or "").encode().translate(_WORDS).split())
    return found.union(*({b"^" + w[:n] for w in found if len(w) > n} for n in BEGINNINGS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_one(row: np.ndarray, col: np.ndarray, n_features: int, y: np.ndarray, before: np.ndarray,
             use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(features, weights, bias, weights of the earlier categories), learned from the rows in ``use``."""
    on = use[row]
    seen = np.bincount(col[on], minlength=n_features).astype(float)
    hit = np.bincount(col[on], weights=y[row[on]], minlength=n_features)
    total, positive = use.sum(), max(y[use].sum(), 0.5)
    expected = seen * positive / max(total, 1)
    strength = np.abs(hit - expected) / np.sqrt(expected + 1)
    strength[seen < LEAST_ROWS] = 0
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = chosen[strength[chosen] > 0]
    place = np.full(n_features, -1)
    place[chosen] = np.arange(len(chosen))
    keep = on & (place[col] >= 0)
    ids = np.flatnonzero(use)
    back = np.full(len(use), -1)
    back[ids] = np.arange(len(ids))
    x = np.zeros((len(ids), len(chosen) + before.shape[1]), np.float32)
    x[back[row[keep]], place[col[keep]]] = 1
    x[:, len(chosen):] = before[ids]
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(positive / max(total - positive, 0.5)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    target = y[ids]
    for t in range(1, STEPS + 1):
        d = (_sigmoid(x @ w + b) - target) / max(len(ids), 1)
        g = np.append(x.T @ d.astype(np.float32) + SHRINK * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w -= step[:-1].astype(np.float32)
        b -= float(step[-1])
    return chosen, w[:len(chosen)], b, w[len(chosen):]


def _predict(row, col, n_rows, n_features, model, before) -> np.ndarray:
    chosen, w, b, chain = model
    weight = np.zeros(n_features)
    weight[chosen] = w
    return _sigmoid(np.bincount(row, weights=weight[col], minlength=n_rows) + b + before @ chain)


def fit(ids: list[str], texts: list[str], toxic: np.ndarray) -> dict:
    """The chain as plain values: names, bias and chain weights, and {feature: weights}."""
    sets = [features(t) for t in texts]
    count: dict[bytes, int] = {}
    for s in sets:
        for f in s:
            count[f] = count.get(f, 0) + 1
    names = sorted(f for f, n in count.items() if n >= LEAST_ROWS)
    index = {f: i for i, f in enumerate(names)}
    cols = [np.fromiter((index[f] for f in s if f in index), np.int64) for s in sets]
    row = np.repeat(np.arange(len(sets)), [len(c) for c in cols])
    col = np.concatenate([np.zeros(0, np.int64), *cols])
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids])
    seeds = {k: {w.encode() for w in words} for k, words in CATEGORIES.items()}
    targets = {k: np.array([bool(t) and bool(s & seeds[k]) for t, s in zip(toxic, sets)], float) for k in seeds}
    targets[LAST] = toxic.astype(float)
    everything = np.ones(len(sets), bool)
    before = np.zeros((len(sets), 0))
    chain, weights = [], {}
    for k, (name, y) in enumerate(targets.items()):
        model = _fit_one(row, col, len(names), y, before, everything)
        chain.append({"name": name, "bias": model[2], "earlier": [float(x) for x in model[3]]})
        for f, w in zip(model[0].tolist(), model[1].tolist()):
            weights.setdefault(names[f].hex(), [0.0] * len(targets))[k] = w
        out = np.zeros(len(sets))
        for part in range(FOLDS):
            if (fold == part).any():
                other = _fit_one(row, col, len(names), y, before, fold != part)
                out[fold == part] = _predict(row, col, len(sets), len(names), other, before)[fold == part]
        before = np.column_stack([before, out])
    return {"chain": chain, "weights": weights}


def train(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on a bounded sample in one task of the cluster; without labelled rows every probability is 0.5."""
    sample = labelled_sample(df, id_col, text_col, labels, [label_col], rows).select(
        F.col(id_col).cast("string"), text_col, F.col(label_col).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if rows_:
            ids, texts, y = zip(*rows_)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(list(ids), list(texts), np.array(y)))])], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model string").collect()
    if found:
        return json.loads(found[0]["model"])
    names = [*CATEGORIES, LAST]
    return {"chain": [{"name": n, "bias": 0.0, "earlier": [0.0] * k} for k, n in enumerate(names)], "weights": {}}


def probabilities(text: str | None, chain: list[dict], weights: dict[bytes, np.ndarray]) -> list[float]:
    """Of every category, in the order of the chain."""
    z = np.zeros(len(chain))
    for f in features(text) & weights.keys():
        z += weights[f]
    out: list[float] = []
    for k, link in enumerate(chain):
        out.append(float(_sigmoid(z[k] + link["bias"] + sum(w * p for w, p in zip(link["earlier"], out)))))
    return out


def score(df: DataFrame, id_col: str, text_col: str, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, one probability per earlier category, score, predicted) for every row.

    Null and empty texts have no features and get the chain's base rates.  Rows
    that repeat an id are all scored; a null id counts as not held out.  Further
    columns are not read.
    """
    chain, weights = model["chain"], {bytes.fromhex(f): np.array(w) for f, w in model["weights"].items()}
    names = [link["name"] for link in chain]

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def chained(texts: pa.Array) -> pa.Array:
        rows = [probabilities(t.as_py(), chain, weights) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))], names=names)

    return (df.select(id_col, held_out(id_col).alias("held_out"), chained(F.col(text_col)).alias("p"))
            .select(id_col, "held_out", *[F.col(f"p.{n}").alias(n) for n in names[:-1]], F.col(f"p.{names[-1]}").alias("score"),
                    F.when(F.col(f"p.{names[-1]}") >= threshold, 1).otherwise(0).alias("predicted")))
