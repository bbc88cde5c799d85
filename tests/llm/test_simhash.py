import itertools
import random

import numpy as np
import pytest
import xxhash

from textlabels.llm import simhash as S
from textlabels.llm.components import connected_components


def slow_fingerprint(text):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = (text or "").encode().translate(lower).split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if linked(a, b) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c d é É x", "x " * 40000])
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_every_pair_within_the_radius_shares_a_bucket_on_each_level():
    rng = random.Random(1)
    for level in (1, 2, 3):
        masks = [int(m) for m in S.level_masks(level)]
        assert len(masks) == S.TABLES ** level
    for bits in itertools.combinations(range(64), 3):
        if rng.random() < 0.2:
            diff = sum(1 << b for b in bits)
            assert any(not int(m) & diff for m in S.level_masks(1))
    for group in range(0, S.TABLES ** 2, 37):        # refinements of one mask
        masks = [int(m) for m in S.level_masks(2)[group // S.TABLES * S.TABLES:][:S.TABLES]]
        parent = int(S.level_masks(1)[group // S.TABLES])
        free = [b for b in range(64) if not parent >> b & 1]
        for bits in itertools.combinations(free, 3):
            assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_a_bucket_of_the_last_level_is_bounded():
    free = [64 - int(m).bit_count() for m in S.level_masks(S.LEVELS)]
    assert 2 ** max(free) <= S.BUCKET


def test_near_duplicates_against_brute_force(spark, frame):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Short"), (5, "short"), (None, base[0]), (7, base[0]), (7, base[0])]
    for i in range(60):
        w = base[i % 6].split()
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    got = S.near_duplicates(frame(rows), "doc_id", "text").collect()
    assert len(got) == len(rows)
    fp = {t: slow_fingerprint(t) for _, t in rows}
    label = components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, t in rows:
        if i is not None:
            root = label[fp[t]]
            first[root] = min(first.get(root, i), i)
    want = sorted(((i if i is not None else -1), f"{fp[t]:016x}", first.get(label[fp[t]])) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want


def test_full_buckets_lose_no_link(spark, monkeypatch):
    """More near fingerprints than a bucket may hold: the refined buckets still connect them as brute force does."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 900:
        x = centre
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 300)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = connected_components(S.links(df), "fp", "other").collect()
    cluster = {r.node for r in found}
    assert len(cluster) >= 899 and len({r.component for r in found}) == 1


def test_empty_table(frame):
    assert S.near_duplicates(frame([]), "doc_id", "text").collect() == []


def test_keep_first_keeps_one_of_each_group_and_all_columns(frame):
    df = frame([(3, "a b c d"), (2, "A b c d"), (9, "something else here now"), (None, "a b c d")]).selectExpr("*", "0 as _gone")
    kept = S.keep_first(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 9]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (7, 7), (None, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 50)}, 300: 200}


def _chain(n):
    return [(i, i + 1) for i in range(1, n)]


def _tree(n, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1, 10 * n), n)
    return [(names[i], names[rng.randrange(max(0, i - 3), i)]) for i in range(1, n)]


@pytest.mark.parametrize("edges", [_chain(6), _chain(20), _chain(100), _tree(60, 1), _tree(60, 2), _tree(60, 3)])
def test_components_hold_every_node_once(spark, edges):
    first = min(min(e) for e in edges)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == sorted((n, first) for n in {n for e in edges for n in e} - {first})


def test_a_long_chain_of_links_returns_every_row_once(spark, monkeypatch):
    """Fingerprints and vectors linked in a chain: op6 and op4 return as many rows as they were given."""
    import math

    from pyspark.sql import functions as F
    from textlabels.llm import embedding_dedup

    fps = [sum(1 << (b % 62) for b in range(2 * i)) for i in range(30)]          # neighbours differ in 2 bits
    monkeypatch.setattr(S, "_fingerprints", lambda text: F.col("doc_id") * 0 + F.col("text").cast("long"))
    docs = spark.createDataFrame([(i, str(x)) for i, x in enumerate(fps)], "doc_id long, text string")
    got = S.near_duplicates(docs, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 0) for i in range(30)]
    vectors = [(i, [math.cos(0.25 * i), math.sin(0.25 * i)]) for i in range(20)]  # neighbours: cosine 0.969, next but one 0.878
    got = embedding_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted((r.vec_id, r.component_id) for r in got) == [(i, 0) for i in range(20)]
