"""Byte-level BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match.  The guess is its
encoding if every token encodes to itself and every two neighbours are
compatible, that is, no merge across their boundary would ever have been made.
The neighbours of all new words of a block are tested together in numpy.  Only
words whose guess fails are merged exactly.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textlabels.llm.common import tidy

# White space is spelled out: the tokenizer's \s is the Unicode property White_Space.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
          rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
CACHE_WORDS = 200_000      # words a worker remembers; then only those of the present block stay
BLOCK_BYTES = 2 << 20      # text encoded at a time
_NEVER = np.iinfo(np.int64).max


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairCodec:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, spec: dict):
        byte_of = _byte_chars()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.rank = np.full(size, -1, np.int64)          # of the merge that makes a token; -1: a byte
        self.left, self.right = np.arange(size), np.arange(size)
        self._rank_of: dict[tuple[int, int], int] = {}
        self._made: list[int] = []
        for r, merge in enumerate(merges):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            a, b, both = vocab[x], vocab[y], vocab[x + y]
            self._rank_of.setdefault((a, b), r)
            self._made.append(both)
            if self.rank[both] < 0:
                self.rank[both], self.left[both], self.right[both] = r, a, b
        codes = np.array([(a << 32) | b for a, b in self._rank_of], np.int64)
        order = np.argsort(codes)
        self._codes, self._ranks = codes[order], np.array([*self._rank_of.values()], np.int64)[order]
        special = set(self.special.values())
        self._id_of = {t: i for i, t in enumerate(self.token_bytes) if t and i not in special}
        # every prefix of a token -> its id if it is a token, else -1: a search ends where no token goes on
        self._prefix = {t[:n]: -1 for t in self._id_of for n in range(1, len(t) + 1)} | self._id_of
        self._sound: dict[int, bool] = {}
        self._split = regex.compile(_SPLIT)
        self._at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._cache: dict[str, bytes] = {}             # word -> its ids, four bytes each
        self._after_space: dict[str, bytes] = {}       # stretch between single spaces -> the ids of " " and it
        self.speculated = self.merged = 0

    # exact merging

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost first."""
        if len(word) > 64:
            return self._merge_long(word)
        ids = list(map(self.byte_id.__getitem__, word))
        get, none = self._rank_of.get, len(self._made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = self._made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for words of any length."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before, stamp = [*range(1, n), -1], [*range(-1, n - 1)], [0] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self._rank_of.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (r, i, stamp[i], stamp[j], j))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, si, sj, j = heapq.heappop(heap)
            if stamp[i] != si or stamp[j] != sj or after[i] != j:
                continue
            ids[i] = self._made[r]
            stamp[i] += 1
            stamp[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(x for x, s in zip(ids, stamp) if s >= 0)

    # speculation

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, get = [], 0, len(word), self._prefix.get
        while at < n:
            end = at + 1
            while end <= n and (found := get(word[at:end])) is not None:
                if found >= 0:
                    best, stop = found, end
                end += 1
            out.append(best)
            at = stop
        return out

    def sound(self, token: int) -> bool:
        """Does the token's own text encode to the token?"""
        known = self._sound.get(token)
        if known is None:
            known = self._sound[token] = self.merge(self.token_bytes[token]) == (token,)
        return known

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of neighbours a, b: would merging their joined bytes give just them?

        Undoes the merges on both sides of the boundary, the latest first.  The
        parts that face each other at a time would have merged if their merge
        ranks before the one that hid the left part, and not after the one that
        hid the right part (equal ranks merge from the left).
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        hid_a, hid_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            code = (a << 32) | b
            where = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
            r = np.where(self._codes[where] == code, self._ranks[where], _NEVER)
            bad = (r < hid_a) & (r <= hid_b)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            left = ra > rb
            hid_a, hid_b = np.where(left, ra, hid_a), np.where(left, hid_b, rb)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
            on = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, hid_a, hid_b = at[on], a[on], b[on], hid_a[on], hid_b[on]
        return good

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        guesses = [self.guess(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        word_of = np.repeat(np.arange(len(new)), [len(g) for g in guesses])
        fine = np.ones(len(new), bool)
        tokens = np.unique(flat)
        wrong = tokens[[not self.sound(int(t)) for t in tokens]]
        fine[word_of[np.isin(flat, wrong)]] = False
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        clash = ~self.compatible(flat[inner], flat[inner + 1])
        fine[word_of[inner[clash]]] = False
        for w, b, g, ok in zip(new, raw, guesses, fine.tolist()):
            self._cache[w] = array("i", g if ok else self.merge(b)).tobytes()
        self.speculated += int(fine.sum())
        self.merged += len(new) - int(fine.sum())

    # interface

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """(stretch of ordinary text, id of the special token after it or -1)."""
        at = 0
        for m in self._at_special.finditer(text) if self._at_special else ():
            yield text[at:m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], -1

    def _plain(self, text: str) -> list[str] | None:
        """Stretches of the text between single spaces, or None if it has other spaces or special tokens.

        A space before a character that is none always begins a word, so each
        stretch after the first can be split on its own, with its space.
        """
        if "  " in text or text[-1:] == " " or (self._at_special and self._at_special.search(text)):
            return None
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of every text."""
        split = self._split.findall
        cut = [self._plain(t) for t in texts]
        seen: set[str] = set()
        for stretches in cut:
            if stretches:
                seen.update(stretches[1:])
        new = seen.difference(self._after_space)
        if len(self._after_space) + len(new) > CACHE_WORDS:
            self._after_space = {x: self._after_space[x] for x in seen - new}
        units = {x: split(" " + x) for x in new}
        rest = [[(split(x[0]), -1)] if x else [(split(part), mark) for part, mark in self._pieces(t)]
                for t, x in zip(texts, cut)]
        needed = set(chain.from_iterable(units.values())).union(*(found for doc in rest for found, _ in doc))
        lack = needed.difference(self._cache)
        if len(self._cache) + len(lack) > CACHE_WORDS:
            self._cache = {w: self._cache[w] for w in needed - lack}
        if lack:
            self._learn(sorted(lack))
        word, unit, out = self._cache.__getitem__, self._after_space, []
        for x, found in units.items():
            unit[x] = word(found[0]) if len(found) == 1 else b"".join(map(word, found))
        for stretches, doc in zip(cut, rest):
            ids = b"".join(b"".join(map(word, found)) + (b"" if mark < 0 else mark.to_bytes(4, "little"))
                           for found, mark in doc)
            if stretches:
                ids += b"".join(map(unit.__getitem__, stretches[1:]))
            out.append(np.frombuffer(ids, "<i4"))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One per worker and file."""
    with open(path, encoding="utf-8") as f:
        return BytePairCodec(json.load(f))


def _blocks(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``BLOCK_BYTES`` of text (or one row)."""
    sizes = [0 if x is None else len(x) for x in batch.column(col).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BLOCK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def encode_decode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids array<int>, decoded string): every whole text encoded, and its ids decoded again.

    ``path`` is a byte-level tokenizer file that every worker can read.  The
    strings of special tokens become their ids; none is added.  A null text
    counts as empty: no ids, decoded to "".  Rows that repeat an id are all
    returned, null ids too; further columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _blocks(batch, 1):
                ids = own.encode_all([x or "" for x in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                decoded = pa.array([own.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded],
                                                 names=[id_col, "ids", "decoded"])
            tidy()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
