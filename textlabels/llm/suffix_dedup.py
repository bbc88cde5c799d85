"""Exact removal of repeated byte strings with a distributed sort of suffixes.

Every ``MATCH``-byte string picks, by its content alone, one of its first
``SPAN`` positions: the leftmost with the least hash of the bytes there.  Equal
strings pick the same place, so it is enough to sort the suffixes that begin at
picked places (about one in ``SPAN / 2`` bytes).  A picked place with ``left``
bytes in common before it and ``right`` bytes after it makes the strings that
begin up to ``left`` bytes before it equal, as far as ``MATCH`` bytes fit.

1. Each place gets two hashes: of the ``HEAD`` bytes that every equal string
   shares, and of its whole context.  Places whose head is unique are done, as
   are places whose whole context occurs twice.
2. The other suffixes are sorted: each task emits sorted runs, front-coded (bytes
   shared with the predecessor are a number) and cut by head; equal heads meet,
   and their runs are merged with a loser tree that carries common prefixes along
   and never compares known bytes again.  Neighbours in the merged order give
   the bytes in common.
3. A head with more than ``LARGE`` contexts is dealt out before it is merged.  Equal
   strings that begin at most half of ``SPAN`` before the place share a longer suffix,
   the others a longer left side, so each place goes once by either, and each half
   is halved again while a group is too big.  In a half the bytes that count are
   fewer: places that agree in all of them are copies there and one of them goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.llm.common import materialize, runs

MATCH, SPAN, GRAM = 200, 150, 16
HEAD = MATCH - SPAN + 1
LARGE = 4096
RUN = 100_000                  # suffixes of one sorted run
_BLOCK = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def _words_at(raw: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The eight bytes at each position as one number (unaligned view)."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))[at]


def _fold(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _MIX[0]
    return (h ^ (h >> _MIX[2])) * _MIX[1]


def picks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): the picked places and the starts of the strings that pick each."""
    strings = len(raw) - MATCH + 1
    if strings <= 0:
        return (np.zeros(0, np.int64),) * 3
    chosen = np.empty(strings, np.int64)
    for a in range(0, strings, _BLOCK):
        n = min(_BLOCK, strings - a)
        size = n + SPAN - 1
        part = raw[a:a + size + GRAM - 1]
        w = _words_at(part, slice(None))
        h = _fold(_fold(np.full(size, _MIX[1]), w[:size]), w[8:8 + size])
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(size, dtype=np.uint64)
        rows = -(-size // SPAN)
        grid = np.full(rows * SPAN, np.iinfo(np.uint64).max, np.uint64)
        grid[:size] = key
        grid = grid.reshape(rows, SPAN)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[SPAN - 1:SPAN - 1 + n])
        chosen[a:a + n] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + a
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[first], first, np.append(first[1:] - 1, strings - 1)


def _sides(data: bytes, place: int) -> tuple[bytes, bytes]:
    """Bytes before (reversed) and from a place, as far as a string that picks it can reach."""
    return data[max(0, place - SPAN + 1):place][::-1], data[place:place + MATCH]


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Head and context hash of every picked place."""
    raw = np.frombuffer(data, np.uint8)
    place, _, _ = picks(raw)
    head = np.full(len(place), _MIX[1])
    for k in [*range(0, HEAD - 8, 8), HEAD - 8] if len(place) else ():
        head = _fold(head, _words_at(raw, place + k))
    digest, reach = xxhash.xxh64_intdigest, SPAN - 1
    context = np.array([digest(data[max(0, p - reach):p + MATCH], min(p, reach)) for p in place.tolist()], np.uint64)
    return head.view(np.int64), context.view(np.int64)


@F.arrow_udf(T.StructType([T.StructField("head", T.ArrayType(T.LongType())), T.StructField("context", T.ArrayType(T.LongType()))]))
def _hashes(texts: pa.Array) -> pa.Array:
    found = [hashes((t.as_py() or "").encode()) for t in texts]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32))
    parts = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])))
             for k in (0, 1)]
    return pa.StructArray.from_arrays(parts, names=["head", "context"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings of which ``known`` bytes are equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merge of sorted runs of (lcp with the predecessor, string, payload).

    Yields (lcp with the string yielded before, string, payload) in order.  Each
    waiting string carries its common prefix with the last winner; of two, the
    one with the longer is smaller, and only equal ones are compared, from there on.
    """

    def __init__(self, sources: list[Iterator[tuple[int, bytes, object]]]):
        self._sources = sources
        self._size = 1
        while self._size < len(sources):
            self._size *= 2
        self._now: list[tuple[int, bytes, object] | None] = [next(s, None) for s in sources] + [None] * (self._size - len(sources))
        self._now = [x and (0, x[1], x[2]) for x in self._now]
        self._loser = [-1] * self._size

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs."""
        x, y = self._now[a], self._now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        shared = common_prefix(x[1], y[1], x[0])
        if x[1][shared:] <= y[1][shared:]:
            self._now[b] = (shared, y[1], y[2])
            return a, b
        self._now[a] = (shared, x[1], x[2])
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        level = list(range(self._size))
        at = self._size
        while len(level) > 1:
            at //= 2
            pairs = [self._play(level[2 * i], level[2 * i + 1]) for i in range(len(level) // 2)]
            for i, (_, lost) in enumerate(pairs):
                self._loser[at + i] = lost
            level = [won for won, _ in pairs]
        top = level[0]
        while (item := self._now[top]) is not None:
            yield item
            self._now[top] = next(self._sources[top], None)
            node = (top + self._size) // 2
            while node:
                top, self._loser[node] = self._play(top, self._loser[node])
                node //= 2


def front_code(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (suffix, reversed left side, row, place), each without the bytes it shares with its predecessor."""
    out, last, last_left = bytearray(), b"", b""
    for suffix, left, row, place in items:
        p, q = common_prefix(last, suffix), common_prefix(last_left, left)
        out += bytes((p, len(suffix) - p, q, len(left) - q)) + suffix[p:] + left[q:]
        out += row.to_bytes(8, "little", signed=True) + place.to_bytes(8, "little", signed=True)
        last, last_left = suffix, left
    return bytes(out)


def front_decode(run: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int]]]:
    """(lcp with the predecessor, suffix, (reversed left side, row, place))."""
    at, last, left = 0, b"", b""
    while at < len(run):
        p, n, q, m = run[at:at + 4]
        at += 4
        last = last[:p] + run[at:at + n]
        left = left[:q] + run[at + n:at + n + m]
        at += n + m
        yield p, last, (left, int.from_bytes(run[at:at + 8], "little", signed=True),
                        int.from_bytes(run[at + 8:at + 16], "little", signed=True))
        at += 16


def equal_strings(lcps: list[int], lefts: list[bytes]) -> np.ndarray:
    """(SPAN, suffixes) booleans: does the string beginning so many bytes before the place occur at another suffix?

    ``lcps[i]`` is the common prefix of suffix i and i - 1 in sorted order.
    """
    m = len(lefts)
    out = np.zeros((SPAN, m), bool)
    if m <= 6:
        for i in range(m):
            right = MATCH
            for j in range(i + 1, m):
                right = min(right, lcps[j])
                left = common_prefix(lefts[i], lefts[j])
                out[MATCH - right:left + 1, [i, j]] = True
        return out
    back = np.arange(SPAN)[:, None]
    right_class = np.cumsum(np.array([MATCH, *lcps[1:]]) < MATCH - back, axis=1)
    order = sorted(range(m), key=lefts.__getitem__)
    shared = [SPAN, *(common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:]))]
    left_class = np.empty((SPAN, m), np.int64)
    left_class[:, order] = np.cumsum(np.array(shared) < back, axis=1)
    both = right_class * (m + 1) + left_class
    by = np.argsort(both, axis=1, kind="stable")
    sorted_ = np.take_along_axis(both, by, axis=1)
    same = sorted_[:, 1:] == sorted_[:, :-1]
    twice = np.zeros((SPAN, m), bool)
    twice[:, 1:] |= same
    twice[:, :-1] |= same
    np.put_along_axis(out, by, twice, axis=1)
    return out


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, send, large) -> front-coded runs by head, or both sides of the places of large heads."""
    waiting: list[tuple[bytes, bytes, bytes, int, int]] = []
    for batch in batches:
        for row, text, send, large in zip(*(c.to_pylist() for c in batch.columns)):
            if not send and not large:
                continue
            data = text.encode()
            place, _, _ = picks(np.frombuffer(data, np.uint8))
            for i in send or ():
                left, suffix = _sides(data, int(place[i]))
                waiting.append((suffix[:HEAD], suffix, left, row, int(place[i])))
            if large:
                yield _emitted(wide=[(row, int(place[i]), *_sides(data, int(place[i]))) for i in large])
            if len(waiting) >= RUN:
                yield _sorted_runs(waiting)
                waiting = []
    if waiting:
        yield _sorted_runs(waiting)


def _emit_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, right, left, row, place) -> front-coded runs by head."""
    waiting: list[tuple[bytes, bytes, bytes, int, int]] = []
    for batch in batches:
        waiting += zip(*(c.to_pylist() for c in batch.columns))
        if len(waiting) >= RUN:
            yield _sorted_runs(waiting)
            waiting = []
    if waiting:
        yield _sorted_runs(waiting)


def _sorted_runs(items: list[tuple[bytes, bytes, bytes, int, int]]) -> pa.RecordBatch:
    items.sort()
    found, s = [], 0
    for e in range(1, len(items) + 1):
        if e == len(items) or items[e][0] != items[s][0]:
            found.append((items[s][0], front_code([x[1:] for x in items[s:e]])))
            s = e
    return _emitted(found=found)


_EMITTED = {"head": pa.binary(), "run": pa.binary(), "row": pa.int64(), "place": pa.int32(), "left": pa.binary(), "right": pa.binary()}


def _emitted(found=(), wide=()) -> pa.RecordBatch:
    rows = [(*x, None, None, None, None) for x in found] + [(None, None, *x) for x in wide]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _EMITTED.values())], names=list(_EMITTED))


def _divide(wide: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(row, place, left, right) of large heads -> ([row, first, last: starts of equal strings], [groups to be merged]).

    Round by round the offsets ``lo..hi`` (of string starts before the place) are halved.  Equal strings at such an offset
    share ``lo`` bytes of the left side and ``MATCH - hi`` of the suffix, which is the key of a group; its strings lie in ``hi``
    and ``MATCH - lo`` bytes, the context.  Keys and contexts are bytes, not hashes.  With one offset left, key and context are
    the string itself, so no group has two contexts and the rounds end.
    """
    ranges, groups = [], []
    part = lambda side, n: F.expr(f"substring({side}, 1, {n})")
    left_over = wide.select("row", "place", "left", "right", F.lit(0).alias("lo"), F.lit(SPAN - 1).alias("hi"))
    while not left_over.isEmpty():
        middle = F.expr("(lo + hi) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi")))).alias("half")
        dealt = (left_over.select("row", "place", "left", "right", halves).select("row", "place", "left", "right", "half.*")
                 .where(f"octet_length(left) >= lo and octet_length(right) >= {MATCH} - hi")
                 .select("row", "place", "lo", "hi", F.concat(part("left", "lo"), part("right", f"{MATCH} - hi")).alias("key"),
                         F.struct(part("left", "hi").alias("left"), part("right", f"{MATCH} - lo").alias("right")).alias("context")))
        dealt = materialize(dealt, "suffix-dealt")
        group = ["lo", "hi", "key"]
        kinds = materialize(dealt.groupBy(*group, "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")),
                            "suffix-contexts")
        copies = dealt.join(kinds.where("n > 1").select(*group, "context"), [*group, "context"])
        ranges.append(copies.select("row", F.expr("place - octet_length(context.left)").cast("int").alias("first"),
                                    F.expr(f"place - greatest(lo, {MATCH} - octet_length(context.right))").cast("int").alias("last")))
        sizes = materialize(kinds.groupBy(*group).agg(F.count("*").alias("contexts")).where("contexts > 1"), "suffix-sizes")
        varied = kinds.join(sizes, group).select("one.*", "context.*", *group, "contexts")
        bounds = [F.unhex(F.lpad(F.hex(c), 2, "0")) for c in ("lo", "hi")]        # longer than HEAD with the key, so no head is equal
        groups.append(varied.where(F.col("contexts") <= LARGE).select(F.concat(*bounds, "key").alias("head"), "right", "left", "row", "place"))
        left_over = materialize(varied.where(F.col("contexts") > LARGE).select("row", "place", "left", "right", "lo", "hi"), "suffix-large")
    return ranges, groups


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by head -> (row, first, last): starts of strings that occur elsewhere."""
    out: list[tuple[int, int, int]] = []
    for t in runs(batches, ["head"]):
        heads, coded = t.column("head").to_pylist(), t.column("run").to_pylist()
        s = 0
        for e in range(1, len(heads) + 1):
            if e < len(heads) and heads[e] == heads[s]:
                continue
            merged = list(LoserTree([front_decode(x) for x in coded[s:e]])) if e - s > 1 else list(front_decode(coded[s]))
            s = e
            if len(merged) < 2:
                continue
            flags = equal_strings([x[0] for x in merged], [x[2][0] for x in merged])
            for k in np.flatnonzero(flags.any(axis=0)).tolist():
                _, row, place = merged[k][2]
                out += [(row, place - b, place - a) for a, b in _stretches(flags[:, k])]
        if len(out) > 50_000:
            yield _ranges(out)
            out = []
    if out:
        yield _ranges(out)


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))],
                                      names=["row", "first", "last"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, whole, ranges) -> (row, kept, spans) of the texts that lose bytes."""
    for batch in batches:
        rows, kept, spans = [], [], []
        for row, text, whole, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            raw = np.frombuffer(data, np.uint8)
            change = np.zeros(len(raw) + 1, np.int64)
            if whole:
                _, first, last = picks(raw)
                np.add.at(change, first[whole], 1)
                np.add.at(change, last[whole] + MATCH, -1)
            for r in ranges or ():
                change[r["first"]] += 1
                change[r["last"] + MATCH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            if gone.any():
                rows.append(row)
                kept.append(raw[~gone].tobytes())
                spans.append([{"start": a, "stop": b + 1} for a, b in _stretches(gone)])
        if rows:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
                                             names=["row", "kept", "spans"])


def repeated_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, text_sha256, spans, kept) for every row of ``df``.

    ``spans`` are the maximal stretches of bytes that are covered by a ``MATCH``-byte
    string that also begins anywhere else (other texts, or elsewhere in the same one,
    overlaps included), ``kept`` the other bytes; both null for a text that loses
    nothing, whose digest is ``text_sha256``.  Rows that repeat id and text are
    copies of each other.  A null text counts as empty.  Null ids are kept;
    further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    places = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), "id", "digest", F.octet_length("text").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"), _hashes(F.col("text")).alias("h"))
        .select("row", "id", "digest", "n_bytes", "text_sha256", "h.head", "h.context"), "suffix-places")
    # counts are written before they are joined: both sides of the join are then dealt anew, and a hot key can be split
    shared = materialize(places.select(F.explode("head").alias("head")).groupBy("head").agg(F.count("*").alias("n"))
                         .where("n > 1").select("head"), "suffix-shared")
    pair = F.posexplode(F.arrays_zip("head", "context")).alias("i", "h")
    live = materialize(places.select("row", pair).select("row", "i", "h.head", "h.context").join(shared, "head"), "suffix-live")
    kinds = materialize(live.groupBy("head", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "i")).alias("one")),
                        "suffix-kinds")
    varied = materialize(kinds.groupBy("head").agg(F.count("*").alias("contexts")).where("contexts > 1"), "suffix-varied")
    # a place goes into the sort once for each context, if its head has several
    sorted_ = kinds.join(varied, "head").select("one.row", "one.i", (F.col("contexts") > LARGE).alias("large"))
    twice = live.join(kinds.where("n > 1").select("head", "context"), ["head", "context"]).select("row", "i")
    tasks = (sorted_.select("row", "i", F.when(F.col("large"), "large").otherwise("send").alias("what"))
             .unionByName(twice.select("row", "i", F.lit("whole").alias("what"))))
    pick = lambda what: F.collect_list(F.when(F.col("what") == what, F.col("i"))).alias(what)
    by_row = tasks.groupBy("row").agg(*map(pick, ("send", "large", "whole")))
    # rows that repeat id and text have the same places: one of them stands for all
    chosen = places.groupBy("id", "digest").agg(F.min("row").alias("row")).join(by_row, "row")
    named = chosen.select(F.col("id").alias("own"), F.col("digest").alias("own_digest"), "row", "send", "large", "whole")
    texts = materialize(docs.join(named, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")))
                        .select("row", "text", "send", "large", "whole"), "suffix-texts")
    schema = "head binary, run binary, row long, place int, left binary, right binary"
    emitted = materialize(texts.where("size(send) + size(large) > 0").select("row", "text", "send", "large").mapInArrow(_emit_runs, schema), "suffix-runs")
    copies, groups = _divide(emitted.where("head is null").select("row", "place", "left", "right"))
    to_merge = emitted.where("head is not null").select("head", "run")
    for group in groups:
        to_merge = to_merge.unionByName(group.mapInArrow(_emit_groups, schema).select("head", "run"))
    ranges = to_merge.repartition("head").sortWithinPartitions("head").mapInArrow(_merge, "row long, first int, last int")
    for found in copies:
        ranges = ranges.unionByName(found)
    by_text = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = (texts.select("row", "text", "whole").join(by_text, "row", "left").where("size(whole) > 0 or ranges is not null")
           .mapInArrow(_cut, "row long, kept binary, spans array<struct<start:int,stop:int>>"))
    cut = cut.join(chosen.select("row", F.col("id").alias("own"), F.col("digest").alias("own_digest")), "row").dropDuplicates(["row"])
    return (places.join(cut, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
            .select(F.col("id").alias(id_col), F.col("n_bytes").cast("long").alias("n_bytes"), "text_sha256", "spans", "kept"))
