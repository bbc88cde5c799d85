"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; learned filters of ``WIDTH`` bytes slide over them
in steps of ``STRIDE``.  Their responses are max-pooled over overlapping chunks
of ``2 * HALF`` steps that together cover the whole text; a small dense layer
turns each chunk's maxima into a logit, and the mean logit of all chunks into one
probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import free_names, tidy


DIM, WIDTH, STRIDE = 8, 8, 4
FILTERS, HIDDEN = 40, 16
HALF = 64                      # filter steps of half a chunk: 256 bytes
BLOCK = 1 << 14                # filter steps computed at a time
SAMPLE_ROWS = 6000             # labelled rows the network is fitted on, at most
ROW_CHUNKS = 3                 # chunks of a row it is fitted on, evenly spaced
SHORT = (24, 240)              # bytes of the short pieces
EPOCHS, BATCH, RATE = 8, 64, 2e-3
THRESHOLD = 0.3

Model = dict[str, np.ndarray]


def _padded(raw: bytes) -> np.ndarray:
    """Bytes, padded with zeros so that every byte is under a filter step."""
    steps = max(1, -(-max(len(raw) - (WIDTH - STRIDE), 1) // STRIDE))
    out = np.zeros(STRIDE * (steps - 1) + WIDTH, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _windows(raw: np.ndarray, m: Model) -> np.ndarray:
    """(steps, WIDTH * DIM) embedded bytes under the filters."""
    view = np.lib.stride_tricks.sliding_window_view(m["emb"][raw].ravel(), WIDTH * DIM)
    return np.ascontiguousarray(view[::STRIDE * DIM])


def pooled(raw: bytes, m: Model) -> np.ndarray:
    """(chunks, FILTERS + 1): largest response of every filter in every chunk of a whole text, and how full the chunk is."""
    data = _padded(raw)
    steps = (len(data) - WIDTH) // STRIDE + 1
    halves = max(1, steps // HALF)
    tops = []
    per = BLOCK // HALF
    for h in range(0, halves, per):
        a, b = h * HALF, steps if h + per >= halves else (h + per) * HALF
        act = _windows(data[a * STRIDE:(b - 1) * STRIDE + WIDTH], m) @ m["conv"]
        tops.append(np.maximum.reduceat(act, np.arange(min(per, halves - h)) * HALF, axis=0))
    top = np.concatenate(tops)
    if len(top) > 1:
        top = np.maximum(top[:-1], top[1:])
    fill = np.full((len(top), 1), min(1.0, steps / (2 * HALF)), np.float32)
    return np.concatenate([np.maximum(top + m["bias"], 0), fill], axis=1)


def score(raw: bytes, m: Model) -> float:
    hidden = np.maximum(pooled(raw, m) @ m["w1"] + m["b1"], 0)
    logit = float((hidden @ m["w2"] + m["b2"]).mean())
    return 1 / (1 + np.exp(-min(max(logit, -30.0), 30.0)))


def spaced_chunks(raw: bytes) -> list[bytes]:
    """At most ``ROW_CHUNKS`` chunks, evenly spaced over the whole text, and of longer texts a short piece besides.

    Short texts are rare; the pieces, of ``SHORT`` lengths, show the network what
    short texts of either kind look like.
    """
    span = (2 * HALF - 1) * STRIDE + WIDTH
    n = max(1, -(-(len(raw) - span) // (HALF * STRIDE)) + 1)
    starts = [min(int(c) * HALF * STRIDE, max(0, len(raw) - span)) for c in np.linspace(0, n - 1, min(n, ROW_CHUNKS))]
    low, high = SHORT
    size = low + zlib.crc32(raw) % (high - low)
    middle = len(raw) // 2
    return [raw[at:at + span] for at in starts] + ([raw[middle:middle + size]] if len(raw) > 2 * high else [])


def fit(chunks: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Adam on chunks, each with its text's label and a share of its text's weight."""
    rng = np.random.default_rng(seed)
    xs = [_padded(x) for x in chunks]
    y, w = labels.astype(np.float32), weights.astype(np.float32)
    scale = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
    m: Model = {"emb": rng.standard_normal((256, DIM)).astype(np.float32), "conv": scale(WIDTH * DIM, FILTERS),
                "bias": np.zeros(FILTERS, np.float32), "w1": scale(FILTERS + 1, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
                "w2": scale(HIDDEN, 1)[:, 0], "b2": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    offsets = np.arange(WIDTH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            parts = [xs[i] for i in pick]
            counts = np.array([(len(p) - WIDTH) // STRIDE + 1 for p in parts])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            win = np.concatenate([_windows(p, m) for p in parts])
            act = win @ m["conv"]
            top = np.maximum.reduceat(act, starts, axis=0)
            where = np.stack([starts[i] + act[starts[i]:starts[i] + counts[i]].argmax(axis=0) for i in range(len(parts))])
            z = top + m["bias"]
            fill = np.minimum(1, counts / (2 * HALF)).astype(np.float32)
            p1 = np.concatenate([np.maximum(z, 0), fill[:, None]], axis=1)
            a1 = p1 @ m["w1"] + m["b1"]
            h = np.maximum(a1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m["w2"] + m["b2"], -30, 30)))
            g = {}
            d = ((p - y[pick]) * w[pick] / w[pick].sum()).astype(np.float32)
            g["w2"], g["b2"] = h.T @ d, d.sum(keepdims=True)
            dh = d[:, None] * m["w2"] * (a1 > 0)
            g["w1"], g["b1"] = p1.T @ dh, dh.sum(0)
            dz = (dh @ m["w1"].T)[:, :-1] * (z > 0)
            g["bias"] = dz.sum(0)
            best = win[where]                                   # (batch, FILTERS, WIDTH * DIM)
            g["conv"] = np.einsum("bf,bfk->kf", dz, best)
            # only the winning window of a filter passes its gradient on to the bytes
            into = (dz[:, :, None] * m["conv"].T).reshape(-1, DIM)
            local = (where - starts[:, None])[:, :, None] * STRIDE + offsets
            under = np.stack([q[l] for q, l in zip(parts, local)]).ravel()
            g["emb"] = np.zeros_like(m["emb"])
            np.add.at(g["emb"], under, into)
            step += 1
            for k in m:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                m[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def held_out(id_col: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_cols: list[str], rows: int) -> DataFrame:
    """(id, text, labels...) of at most ``rows`` labelled ids that may be learned from, in order of a hash of the id.

    Only the ids of the sample are broadcast: at most ``rows`` of them.
    """
    chosen = (labels.where(~held_out(id_col) & F.col(id_col).isNotNull()).dropna(subset=label_cols)
              .groupBy(id_col).agg(*[F.max(c).alias(c) for c in label_cols])
              .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows))
    return (df.select(id_col, text_col).where(F.col(text_col).isNotNull())
            .join(F.broadcast(chosen), id_col).select(id_col, text_col, *label_cols))


def pack(m: Model) -> bytes:
    return b"".join(m[k].astype("<f4").tobytes() for k in sorted(m))


def unpack(raw: bytes) -> Model:
    shapes = {"emb": (256, DIM), "conv": (WIDTH * DIM, FILTERS), "bias": (FILTERS,), "w1": (FILTERS + 1, HIDDEN),
              "b1": (HIDDEN,), "w2": (HIDDEN,), "b2": (1,)}
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = np.frombuffer(raw, "<f4", n, at).reshape(shapes[k]).astype(np.float32)
        at += 4 * n
    return out


def train(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample in one task of the cluster; the driver gets the parameters only.

    Without labelled rows the model has zero weights and scores 0.5.
    """
    sample = (labelled_sample(df, id_col, text_col, labels, [label_col], rows)
              .select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("raw"),
                      F.col(label_col).cast("int").alias("y")))
    names = ["id", "at", "raw", "y", "w"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_ = [(i, at, x, y, 1 / len(parts)) for i, raw, y in zip(*(c.to_pylist() for c in b.columns))
                     for parts in [spaced_chunks(raw)] for at, x in enumerate(parts)]
            if rows_:
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if rows_:
            _, _, raw, y, w = zip(*rows_)
            yield pa.RecordBatch.from_arrays([pa.array([pack(fit(list(raw), np.array(y), np.array(w)))], pa.binary())], names=["model"])

    sample = sample.mapInArrow(cut, "id string, at int, raw binary, y int, w double")
    packed = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if packed:
        return unpack(bytes(packed[0]["model"]))
    size = sum(int(np.prod(s)) for s in ((256, DIM), (WIDTH * DIM, FILTERS), (FILTERS,), (FILTERS + 1, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)))
    return unpack(np.zeros(size, "<f4").tobytes())


def scorer(m: Model):
    """A Column function from text to probability, for whole texts of any length; null counts as empty."""
    packed = pack(m)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = unpack(packed)
        for texts in batches:
            yield pa.array([score((t.as_py() or "").encode(), own) for t in texts], pa.float64())
            tidy()

    return probability


def classify(df: DataFrame, id_col: str, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Null and empty texts get the score of an empty chunk.  Rows that repeat an
    id are all scored; a null id counts as not held out.  Further columns are not
    read.
    """
    return (df.select(id_col, held_out(id_col).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def keep_good(df: DataFrame, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``."""
    score, = free_names(df.columns, "_score")
    return df.withColumn(score, scorer(model)(F.col(text_col))).where(F.col(score) >= threshold).drop(score)
