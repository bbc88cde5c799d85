"""CSV files whose records span lines, read by as many tasks as the files have splits.

A split may begin inside a quoted field, which only the bytes before it can tell.
So the read has three steps:

1. Every split is followed twice, as if it began outside and as if it began inside
   quotes, over its lines that hold a quote; that gives two bits a split.
2. The bits are composed in the order of the splits, which tells how each one begins.
3. Every split is cut into records.  Pieces of records that reach over a split's
   border are put together in a small table, and all records are parsed.

The driver holds two bits and the place of each split.  No task reads more than its
splits, and nothing is shuffled but the pieces at the borders.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.sources.workspace import materialize

# options that leave the places of records alone
_PARSER = {"header", "sep", "delimiter", "quote", "escape", "nullvalue", "emptyvalue", "nanvalue", "positiveinf", "negativeinf", "dateformat",
           "timestampformat", "timestampntzformat", "locale", "mode", "columnnameofcorruptrecord", "ignoreleadingwhitespace",
           "ignoretrailingwhitespace", "multiline", "linesep"}
_FILES = {"pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter"}
_TRUE = "true"

Places = dict[str, tuple[list[int], list[bool]]]


def can_split(options: Mapping[str, str]) -> bool:
    """Whether files with these options are read in splits: fields quoted with one character that is doubled inside, lines ending in a line feed."""
    o = {k.lower(): str(v) for k, v in options.items()}
    return (o.keys() <= _PARSER | _FILES and o.get("multiline", "").lower() == _TRUE and o.get("lineSep".lower()) == "\n"
            and len(o.get("quote", "")) == 1 and o.get("escape") == o.get("quote") and o.get("quote") != _separator(o)
            and o.get("ignoreleadingwhitespace", "").lower() == "false" and o.get("mode", "PERMISSIVE").upper() in ("PERMISSIVE", "FAILFAST"))


def _separator(options: Mapping[str, str]) -> str:
    return options.get("sep", options.get("delimiter", ","))


class Quotes:
    """Where quoted fields end: at a quote that is not doubled; text after it up to the separator belongs to the field."""

    def __init__(self, quote: bytes, separator: bytes):
        q = re.escape(quote)
        self.quote, self.separator = quote, separator
        self.rest = re.compile(b"[^%b]*+(?:%b%b[^%b]*+)*+%b" % (q, q, q, q, q))

    def open_after(self, line: bytes, inside: bool) -> bool:
        """Whether a quoted field is open at the end of a line that began inside one, or at the start of a record."""
        if self.quote not in line:
            return inside
        at = 0
        while True:
            if inside or line.startswith(self.quote, at):
                closed = self.rest.match(line, at if inside else at + 1)
                if not closed:
                    return True
                at, inside = closed.end(), False
            at = line.find(self.separator, at)
            if at < 0:
                return False
            at += len(self.separator)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line")))


def _follow(lines: DataFrame, quotes: Quotes) -> Places:
    """How the text stands after each split that holds a quote, by file: (places of the splits, whether a field is open after them)."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for file, start, line in _lines(batches):
            state = found.setdefault((file, start), [False, True])
            state[:] = [quotes.open_after(line, s) for s in state] if state[0] != state[1] else [quotes.open_after(line, state[0])] * 2
        rows = [(file, start, *state) for (file, start), state in found.items()]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "start", "outside", "inside"])

    rows = (lines.where(F.contains("line", F.lit(quotes.quote)))
            .mapInArrow(ends, "file string, start long, outside boolean, inside boolean").collect())
    places: Places = defaultdict(lambda: ([], []))
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        starts, after = places[r.file]
        after.append(r.inside if after and after[-1] else r.outside)
        starts.append(r.start)
    return dict(places)


def _cut(lines: DataFrame, quotes: Quotes, places: Places, header: bool, edges: bool) -> DataFrame:
    """Complete records (``line``), or the pieces at the borders of splits (``file, start, part, header, line``).

    ``part`` is 0 for what continues the record before the split and 1 for a
    record that the split begins and does not end.
    """
    shared = lines.sparkSession.sparkContext.broadcast(places)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, held, rows = shared.value, [], []
        split, inside, part, first = None, False, 1, False

        def piece() -> None:
            if edges and held:
                rows.append((*split, part, first, b"\n".join(held)))

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            names = ["file", "start", "part", "header", "line"]
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][0 if edges else 4:], names=names[0 if edges else 4:])

        for file, start, line in _lines(batches):
            if (file, start) != split:
                piece()
                split, held = (file, start), []
                starts, after = states.get(file, ([], []))
                before = bisect_left(starts, start)
                inside = before > 0 and after[before - 1]
                part, first = (0 if inside else 1), header and start == 0
            held.append(line)
            inside = quotes.open_after(line, inside)
            if not inside:
                if part == 0:
                    piece()
                elif not edges and not first:
                    rows.append((None, None, None, None, b"\n".join(held)))
                    if len(rows) >= 4096:
                        yield batch()
                        rows.clear()
                held, part, first = [], 1, False
        piece()
        yield batch()

    schema = "file string, start long, part int, header boolean, line binary" if edges else "line binary"
    return lines.mapInArrow(cut, schema)


def _joined(edges: DataFrame) -> DataFrame:
    """Records put together from their pieces; a record belongs to the split that began it."""
    in_order = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    began = edges.select("file", "start", "part", F.last(F.when(F.col("part") == 1, F.col("start")), True).over(in_order).alias("began"))
    piece = F.struct("start", "part", F.col("line").cast("string").alias("line"))
    return (edges.join(began, ["file", "start", "part"]).groupBy("file", "began")
            .agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("header").alias("header")).where(~F.col("header"))
            .select(F.array_join(F.transform("pieces", lambda p: p["line"]), "\n").alias("line")))


def read(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """Rows of CSV files, as Spark's reader gives them with ``multiLine``; see ``can_split`` for the options.

    The reader takes a quote for the start of a quoted field only at a field's start, so
    quotes inside unquoted fields are plain characters.  A field that is never closed
    takes in the rest of its file.  The two small passes over quotes and borders run at once,
    the records are read when the result is.
    """
    o = {k.lower(): str(v) for k, v in options.items()}
    quotes = Quotes(o["quote"].encode(), _separator(o).encode())
    text = spark.read.options(**{k: v for k, v in options.items() if k.lower() in _FILES}).text(path, lineSep="\n")
    folders = [c for c in text.columns if c != "value"]
    if folders:
        raise ValueError(f"CSV in partition folders ({folders}): read each folder, or the whole with splits=False")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.col("value").cast("binary").alias("line"))
    places = _follow(lines, quotes)
    header = o.get("header", "false").lower() == _TRUE
    records = _cut(lines, quotes, places, header, False).select(F.col("line").cast("string").alias("line"))
    if any(state for _, after in places.values() for state in after):
        records = records.unionByName(_joined(materialize(_cut(lines, quotes, places, header, True), "csv-edges")))
    parsed = F.from_csv("line", F.lit(_ddl(schema)), {k: v for k, v in options.items() if k.lower() in _PARSER - {"header", "multiline", "lineSep".lower()}})
    return records.where("line != ''").select(parsed.alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
