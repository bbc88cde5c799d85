"""Source divergence audit: a quadtree (k = 2) over the matrix of term counts by group.

A group is a (lang, source).  The kept terms of a language are dealt out by their
hash; each task cuts its terms into tiles and stores a tile as a k^2-tree: one bit
for each quadrant of a square, the bits of all-zero quadrants ending there, counts
only in the leaves that hold any.  Every pair of groups starts with the price of an
all-zero matrix, which has a closed form.  A tile then follows the quadrants of
both groups of a pair together, leaves where both are zero, and corrects the price
in leaves where one of them is not.

All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlabels.llm.common import materialize, plain, runs, tidy

UNIT = 1_000_000_000
SIDE = 8                       # rows and columns of a leaf
COLUMNS = 2048                 # terms of a tile
CELLS = 1 << 16                # counts of a tile, beyond the first term's
FLUSH = 200_000                # distinct terms that a task counts before it sends them on
CHUNK = 2048                   # leaf pairs priced at a time
RANKS = 200

# bytes to what separates terms: ASCII letters are lower-cased, other ASCII is a blank
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Groups = dict[str, list[str]]


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / size) for count <= size < 2^53, without numbers beyond a long: three decimal digits a step."""
    whole, rest = count // size, count % size
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // size, rest * 1000 % size
    return whole + 1


# --- counts ---------------------------------------------------------------------------------------

def term_counts(df: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(lang, source, term, n) for the terms that at least ``min_docs`` rows of the language hold.

    Terms are combined in the tasks that read the text, so the shuffle carries one
    row per group and term of a task's buffer.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = defaultdict(Counter), defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                     pa.array(list(terms.values()), pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()
            tidy()

        held = 0
        for batch in batches:
            for lang, source, raw in zip(*(batch.column(c) for c in ("lang", "source", "raw"))):
                group, terms = (lang.as_py(), source.as_py()), raw.as_py().translate(TERM_BYTES).split()
                held -= len(n[group])
                n[group].update(terms)
                docs[group].update(set(terms))
                held += len(n[group])
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    read = df.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), _text(text_col).cast("binary").alias("raw"))
    counts = (read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    return (counts.withColumn("docs", F.sum("docs").over(of_term)).where(F.col("docs") >= min_docs)
            .select("lang", "source", "term", "n"))


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- tiles ----------------------------------------------------------------------------------------

def grow(row: np.ndarray, column: np.ndarray, n: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k^2-tree of a sparse square matrix: (bits of the four quadrants of every inner node, level by level, counts of the leaves).

    ``size`` is a power of two times ``SIDE``.  Nodes of a level stand in the order of their
    parents and quadrants; only quadrants with a count have nodes below.
    """
    depth = (size // SIDE).bit_length() - 1
    path = np.zeros(len(row), np.int64)
    for bit in reversed(range(depth)):
        half = SIDE << bit
        path = path * 4 + (row // half % 2) * 2 + column // half % 2
    leaves, at = np.unique(path, return_inverse=True)
    counts = np.zeros((len(leaves), SIDE, SIDE), np.int64)
    counts[at, row % SIDE, column % SIDE] = n
    bits, nodes = [], leaves
    for _ in range(depth):
        above, parent = np.unique(nodes // 4, return_inverse=True)
        level = np.zeros((len(above), 4), bool)
        level[parent, nodes % 4] = True
        bits.append(level)
        nodes = above
    return bits[::-1], counts


def children(bits: np.ndarray) -> np.ndarray:
    """(nodes, 4) places of the nodes below, -1 for an all-zero quadrant; the last row stands for a node that is itself zero."""
    place = np.where(bits, np.cumsum(bits).reshape(bits.shape) - 1, -1)
    return np.vstack([place, np.full(4, -1)])


def size_for(rows: int, columns: int) -> int:
    return SIDE << max(0, (-(-max(rows, columns) // SIDE) - 1).bit_length())


def tiles(counts: DataFrame, groups: Groups) -> DataFrame:
    """(lang, terms, sums, bits, counts): tiles of all groups by at most ``COLUMNS`` terms.

    The counts arrive hashed by (lang, term), as their window left them.  Terms that
    the same groups hold stand side by side, so that zeros fill whole quadrants.
    """
    number = {lang: {s: i for i, s in enumerate(sources)} for lang, sources in groups.items()}

    def tile(lang: str, columns: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(columns)
        row = np.array([number[lang][s] for s in t.column("source").to_pylist()], np.int64)
        column = np.repeat(np.arange(len(columns)), [c.num_rows for c in columns])
        n, terms = t.column("n").to_numpy(), [c.column("term")[0].as_py() for c in columns]
        held = [tuple(sorted(r)) for r in np.split(row, np.cumsum([c.num_rows for c in columns])[:-1])]
        order = sorted(range(len(terms)), key=lambda c: (held[c], terms[c]))
        column = np.argsort(order)[column]
        sums = np.zeros(len(groups[lang]), np.int64)
        np.add.at(sums, row, n)
        bits, leaves = grow(row, column, n, size_for(len(groups[lang]), len(terms)))
        packed = b"".join(np.packbits(level).tobytes() for level in bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([[terms[c] for c in order]], pa.list_(pa.string())), pa.array([sums.tolist()], pa.list_(pa.int64())),
             pa.array([packed], pa.binary()), pa.array([leaves.astype("<i8").tobytes()], pa.binary())],
            names=["lang", "terms", "sums", "bits", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        cells, lang = 0, None
        for run in runs(batches, ["lang", "term"]):
            langs, terms = plain(run.column("lang")), plain(run.column("term"))
            starts = np.flatnonzero(np.r_[True, (langs[1:] != langs[:-1]) | (terms[1:] != terms[:-1])])
            for a, b in zip(starts, [*starts[1:], len(terms)]):
                if held and (langs[a] != lang or len(held) == COLUMNS or cells + b - a > CELLS):
                    yield tile(lang, held)
                    held, cells = [], 0
                held.append(run.slice(a, b - a))
                cells, lang = cells + b - a, langs[a]
        if held:
            yield tile(lang, held)
        tidy()

    return (counts.sortWithinPartitions("lang", "term")
            .mapInArrow(build, "lang string, terms array<string>, sums array<long>, bits binary, counts binary"))


# --- prices ---------------------------------------------------------------------------------------

class Tile:
    """A stored tile with the shares of its counts."""

    def __init__(self, terms: list[str], bits: bytes, counts: bytes, sizes: np.ndarray):
        self.terms, self.rows = terms, len(sizes)
        self.counts = np.frombuffer(counts, "<i8").reshape(-1, SIDE, SIDE)
        self.size = size_for(self.rows, len(terms))
        self.below, at, nodes, packed = [], 0, 1, np.frombuffer(bits, np.uint8)
        for _ in range((self.size // SIDE).bit_length() - 1):
            level = np.unpackbits(packed[at:at + -(-nodes * 4 // 8)], count=nodes * 4).astype(bool).reshape(-1, 4)
            at += -(-nodes * 4 // 8)
            self.below.append(children(level))
            nodes = int(level.sum())
        self.sizes = np.ones(-(-self.rows // SIDE) * SIDE, np.int64)
        self.sizes[:self.rows] = sizes
        self.zero = share(np.ones_like(self.sizes), self.sizes).reshape(-1, SIDE)          # of a count of 0, by blocks of rows

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(block of rows, block of columns) of every leaf."""
        block = np.zeros((1, 2), np.int64)
        for below in self.below:
            node, quadrant = np.nonzero(below[:-1] >= 0)
            block = block[node] * 2 + np.stack([quadrant // 2, quadrant % 2], 1)
        return block[:, 0], block[:, 1]

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Leaves of two blocks of rows over one block of columns, at least one of them not zero: (rows a, leaf a, rows b, leaf b).

        One level of quadrants at a time, for all pairs of blocks together; a zero leaf is -1.
        """
        a = b = rows_a = rows_b = columns = np.zeros(1, np.int64)
        for depth, below in enumerate(self.below):
            half = self.size >> (depth + 1)
            parts = []
            for top_a, top_b, left in product((0, 1), repeat=3):
                part = (below[a, 2 * top_a + left], 2 * rows_a + top_a, below[b, 2 * top_b + left], 2 * rows_b + top_b, 2 * columns + left)
                on = ((part[0] >= 0) | (part[2] >= 0)) & (part[1] * half < self.rows) & (part[3] * half < self.rows)
                parts.append([x[on] for x in part])
            a, rows_a, b, rows_b, columns = (np.concatenate(x) for x in zip(*parts))
        for at in range(0, len(a), CHUNK):
            yield rows_a[at:at + CHUNK], a[at:at + CHUNK], rows_b[at:at + CHUNK], b[at:at + CHUNK]

    def corrections(self) -> np.ndarray:
        """(groups, groups): what the counts of the tile add to the price of an all-zero tile."""
        blocks = len(self.zero)
        block, _ = self.leaves()
        shares = share(self.counts + 1, self.sizes.reshape(-1, SIDE)[block][:, :, None])
        flat = np.repeat(self.zero[:, :, None], SIDE, 2)
        shares = np.concatenate([shares, flat])                     # a zero leaf: the flat one of its rows
        total = np.zeros((blocks, blocks, SIDE, SIDE), np.int64)
        for rows_a, a, rows_b, b in self.pairs():
            p = shares[np.where(a >= 0, a, len(self.counts) + rows_a)][:, :, None, :]
            q = shares[np.where(b >= 0, b, len(self.counts) + rows_b)][:, None, :, :]
            p0, q0 = self.zero[rows_a][:, :, None], self.zero[rows_b][:, None, :]
            more = ((p - q) ** 2 // q).sum(-1) - SIDE * ((p0 - q0) ** 2 // q0)
            np.add.at(total, (rows_a, rows_b), more)
        return total.transpose(0, 2, 1, 3).reshape(blocks * SIDE, -1)[:self.rows, :self.rows]

    def over(self, size: int) -> tuple[np.ndarray, ...]:
        """(group, term, value) of the counts above 0 whose share is larger than the language's."""
        blocks, columns = self.leaves()
        of_term = np.zeros(-(-len(self.terms) // SIDE) * SIDE, np.int64).reshape(-1, SIDE)
        np.add.at(of_term, columns, self.counts.sum(1))
        leaf, row, column = np.nonzero(self.counts)
        group, term = blocks[leaf] * SIDE + row, columns[leaf] * SIDE + column
        p = share(self.counts[leaf, row, column] + 1, self.sizes[group])
        q = share(of_term.ravel()[term] + 1, np.full(len(term), size))
        on = p > q
        return group[on], term[on], ((p - q) ** 2 // q)[on]


def audit(df: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int = 3, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the term shares of each (lang, source) group are from others of its language.

    ``pair``: the other sources of the language, by the sum of floor((p - q)^2 / q)
    over all kept terms.  ``term``: the ``ranks`` terms of the group that lie most
    above the language's share.  Ranks by value descending, then item in UTF-8 order.

    Null lang, source and text count as empty texts.  Every row is a document, also
    one that repeats another.  A group without terms has pairs, and no terms; a
    language with one source has no pairs; an empty table gives an empty result.
    Further columns are not read.

    The driver holds the names and sizes of the groups: the result has one row for
    each ordered pair of them, so their number is at most about the square root of
    the rows to be returned.
    """
    spark = df.sparkSession
    names = df.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct().collect()
    groups: Groups = {lang: sorted((r.source for r in names if r.lang == lang), key=str.encode) for lang in {r.lang for r in names}}
    stored = materialize(tiles(term_counts(df, lang_col, source_col, text_col, min_docs), groups), "tiles")

    width = {r.lang: r.v for r in stored.groupBy("lang").agg(F.sum(F.size("terms")).alias("v")).collect()}
    found = stored.select("lang", F.posexplode("sums").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    held = {lang: np.zeros(len(sources), np.int64) for lang, sources in groups.items()}
    for r in found:
        held[r.lang][r["at"]] = r.n
    shared = spark.sparkContext.broadcast((groups, width, held))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_, width_, held_ = shared.value
        total: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                lang, size = row["lang"], width_[row["lang"]]
                tile = Tile(row["terms"], row["bits"], row["counts"], held_[lang] + size)
                total[lang] = total.get(lang, 0) + tile.corrections()
                group, term, value = tile.over(int(held_[lang].sum()) + size)
                order = np.argsort(group, kind="stable")
                for g, mine in zip(*_split(group[order], order)):
                    ranked = best[lang, g]
                    least = ranked[-1][0] if len(ranked) == ranks else 0
                    ranked += [(-value[i], tile.terms[term[i]].encode()) for i in mine if -value[i] <= least]
                    best[lang, g] = sorted(ranked)[:ranks]
        for lang, sums in total.items():
            n = len(sums)
            yield _rows(np.repeat(groups_[lang], n), lang, "pair", np.tile(groups_[lang], n), sums.ravel())
        for (lang, g), ranked in best.items():
            yield _rows([groups_[lang][g]] * len(ranked), lang, "term", [t.decode() for _, t in ranked], [-v for v, _ in ranked])
        tidy()

    priced = materialize(stored.select("lang", "terms", "bits", "counts")
                         .mapInArrow(price, "source string, lang string, part string, item string, value long"), "priced")
    sizes = spark.createDataFrame([(lang, s, width.get(lang, 0), int(held[lang][i]) + width.get(lang, 0))
                                   for lang, sources in groups.items() for i, s in enumerate(sources)],
                                  "lang string, source string, width long, size long")
    zero = F.expr(f"if(width = 0, 0, 1 + {UNIT} div size)")
    others = sizes.select("lang", F.col("source").alias("item"), zero.alias("q"))
    pairs = (sizes.select("lang", "source", "width", zero.alias("p")).join(others, "lang").where("source != item")
             .join(priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more")),
                   ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.expr("if(width = 0, 0, width * ((p - q) * (p - q) div q) + coalesce(more, 0))").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = priced.where("part = 'term'").select(*pairs.columns)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= ranks))


def _split(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first].tolist(), np.split(rows, first[1:]) if len(keys) else []


def _rows(source, lang: str, part: str, item, value) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays([pa.array(list(source), pa.string()), pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(list(item), pa.string()),
                                       pa.array(value, pa.int64())], names=["source", "lang", "part", "item", "value"])
