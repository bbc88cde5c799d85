import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlabels.llm import suffix_dedup as S


def slow(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + S.MATCH] for _, b in data for k in range(len(b) - S.MATCH + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - S.MATCH + 1):
            if count[b[k:k + S.MATCH]] > 1:
                gone[k:k + S.MATCH] = b"\1" * S.MATCH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fast(df):
    rows = S.repeated_bytes(df, "doc_id", "text").withColumn(
        "sha", F.coalesce(F.sha2("kept", 256), F.col("text_sha256"))).collect()
    return [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans or ()), len(r.spans or ()), r.sha) for r in rows]


KEY = lambda r: (r[0] is not None, r[0] or 0, r)


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passage = " ".join(word() for _ in range(120))
    rows = []
    for i in range(n):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        body = " ".join(word() for _ in range(rng.randint(0, 60)))
        rows.append((i, body + passage[a:b] + " " + word() + passage[a // 2:a // 2 + rng.randint(150, 400)]))
    return rows


def test_random_overlaps_against_brute_force(frame):
    rows = texts(random.Random(1), 60)
    assert sorted(fast(frame(rows))) == sorted(slow(rows))


def test_heads_with_many_contexts_give_the_same_result(frame, monkeypatch):
    monkeypatch.setattr(S, "LARGE", 3)
    rows = texts(random.Random(2), 60)
    assert sorted(fast(frame(rows))) == sorted(slow(rows))


@pytest.mark.parametrize("large", [2, 7])
def test_large_groups_of_near_copies_are_halved_down_to_single_strings(frame, monkeypatch, large):
    """Copies of one text with a change at any place, cut at either end: groups stay too big over many rounds."""
    monkeypatch.setattr(S, "LARGE", large)
    rng = random.Random(large)
    base = "".join(rng.choice("abcdefgh ") for _ in range(620))
    rows = []
    for i in range(70):
        t = list(base[rng.choice([0, rng.randint(0, 200)]):rng.choice([620, rng.randint(420, 620)])])
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        rows.append((i, "".join(t)))
    rounds, plain = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: rounds.append(name) or plain(df, name))
    assert sorted(fast(frame(rows))) == sorted(slow(rows))
    assert 4 <= rounds.count("suffix-dealt") <= 8


def test_rows_of_a_large_group_grow_with_its_places_only(spark):
    """Sides that differ at one end only: in each round one half is settled at once."""
    body = bytes(97 + k % 23 for k in range(S.SPAN - 1 + S.MATCH - 10))
    wide = spark.createDataFrame([(i, 500, bytearray(body[:S.SPAN - 1]), bytearray(body[S.SPAN - 1:] + bytes([i // 18, i % 18]) + b"z" * 8)) for i in range(300)],
                                 "row long, place int, left binary, right binary")
    old, S.LARGE = S.LARGE, 100
    try:
        ranges, groups = S._divide(wide)
    finally:
        S.LARGE = old
    assert sum(r.count() for r in ranges) <= 2 * 8 * 300 and sum(g.count() for g in groups) <= 8 * 300
    starts = {b for r in ranges for x in r.where("row = 7").collect() for b in range(x["first"], x["last"] + 1)}
    assert starts == {500 - b for b in range(10, S.SPAN)}          # the strings that end before the change; others are left to a merge


def test_awkward_rows(frame):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(700))
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, long), (5, long[100:]), (6, "a" * 1000), (7, long[:199]), (8, "z" + long[:200]),
            (9, "é" * 300), (9, "é" * 300), (10, long[:300] + long[:300])]
    assert sorted(fast(frame(rows)), key=KEY) == sorted(slow(rows), key=KEY)


def test_empty_table(frame):
    assert fast(frame([])) == []


def test_equal_strings_pick_the_same_place():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 101, 900, np.uint8)
    other = np.concatenate([rng.integers(97, 101, 333, np.uint8), body])
    place, first, last = S.picks(body)
    of = {s: int(p) for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
    place, first, last = S.picks(other)
    of_other = {s: int(p) for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
    assert all(of_other[s + 333] == p + 333 and s <= p < s + S.SPAN for s, p in of.items())


def test_places_do_not_depend_on_the_block(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000, np.uint8)
    want = [x.tolist() for x in S.picks(data)]
    monkeypatch.setattr(S, "_BLOCK", 700)
    assert [x.tolist() for x in S.picks(data)] == want


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    word = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
    for k in range(1, 9):
        parts = [sorted((word(), word()[::-1], n, n) for n in range(rng.randint(0, 30))) for _ in range(k)]
        merged = list(S.LoserTree([S.front_decode(S.front_code(p)) for p in parts]))
        want = sorted(x[0] for p in parts for x in p)
        assert [x[1] for x in merged] == want
        assert [x[0] for x in merged[1:]] == [S.common_prefix(a, b) for a, b in zip(want, want[1:])]


@pytest.mark.parametrize("m", [2, 5, 30])
def test_equal_strings(m):
    rng = random.Random(m)
    place = lambda: ("".join(rng.choice("ab") for _ in range(rng.choice([3, 149]))).encode(), b"h" * S.HEAD + b"a" * rng.randint(0, 149) + b"b")
    items = sorted(((r[:S.MATCH], l) for l, r in (place() for _ in range(m))))
    lcps = [0, *(S.common_prefix(a[0], b[0]) for a, b in zip(items, items[1:]))]
    got = S.equal_strings(lcps, [x[1] for x in items])
    for o in range(S.SPAN):
        keys = [(r[:S.MATCH - o], l[:o]) if len(r) >= S.MATCH - o and len(l) >= o else None for r, l in items]
        assert [bool(x) for x in got[o]] == [k is not None and keys.count(k) > 1 for k in keys]
