"""What the operators share: reading, word splitting, runs of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlabels.sources.workspace import materialize  # noqa: F401  (shared helper)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# what separates words once A-Z are lower-cased: ASCII other than 0-9 and a-z
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores behind it as no column has (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is.

    ``lower`` does the same for pure ASCII and is the faster of the two.
    """
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    return F.filter(parts, lambda w: w != "")


def ascii_id_list(ids: Column) -> Column:
    """Comma-joined array of ids, sorted as strings."""
    return F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")


def tidy() -> None:
    """Give freed Arrow memory back; a worker that waits for its next stage should hold little."""
    pa.default_memory_pool().release_unused()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of batches sorted by ``keys`` into tables that end where a key ends.

    A table holds all rows of each of its keys.  What is held at a time is one
    batch and the rows of one key.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        starts = run_starts([plain(t.column(k)) for k in keys])
        last = int(starts[-1])
        if held:
            same = all(held[-1].column(k)[-1].as_py() == t.column(k)[0].as_py() for k in keys)
            if same and len(starts) == 1:
                held.append(t)
                continue
            cut = (int(starts[1]) if len(starts) > 1 else t.num_rows) if same else 0
            yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
            if last > cut:
                yield t.slice(cut, last - cut)
        elif last:
            yield t.slice(0, last)
        held = [t.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Positions where a new key begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for v in columns:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def plain(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers as it is, any other as Python objects."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    return np.array([*column.to_pylist(), None], dtype=object)[:-1]
