import numpy as np
import pytest

from textlabels.llm import embedding_dedup as E


def slow(rows, threshold=0.95):
    units = [(i, E.unit(v)) for i, v in rows]
    links = {i: 0 for i, _ in rows}
    label = {i: i for i, _ in rows}
    pairs = [(a, b) for k, (a, u) in enumerate(units) for b, v in units[:k]
             if u is not None and v is not None and a is not None and b is not None and a != b and len(u) == len(v) and u @ v >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((-1 if i is None else i), links[i], label[i], i is not None and label[i] == i) for i, _ in rows)


def fast(df, **k):
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, r.component_id, r.kept)
                  for r in E.near_vectors(df, "vec_id", "embedding", **k).collect())


def clusters(rng, dim=64, groups=12, size=9):
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            out.append(centre + rng.standard_normal(dim) * rng.uniform(0.02, 0.35))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(out)]


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("block", [1024, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = clusters(np.random.default_rng(1))
    got, want = fast(spark.createDataFrame(rows, SCHEMA)), slow(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 100 and 0.97 * there <= found <= there


def test_a_hot_group_in_blocks_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + 0.01 * rng.standard_normal(32)).tolist()) for i in range(200)]
    assert fast(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == slow(rows)


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-4.0, 1.0, 0.0, 2.0]
    rows = [(1, v), (2, [2 * x for x in v]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [1.0, float("nan"), 3.0, 4.0]),
            (8, [float("inf")] * 4), (9, v[:3]), (None, v), (11, w), (12, [1e300 * x for x in w]), (13, [1e-300 * x for x in w])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as unit", "3 as keys")
    assert fast(df) == slow(rows)


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert fast(df) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert fast(df.limit(0)) == []


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, factor = E.code_of(x)
    estimate = codes @ (x @ E.rotation(64, 0)).T / 8 / factor[:, None]
    error = estimate - x @ x.T
    assert abs(error[~np.eye(400, dtype=bool)].mean()) < 0.005
    assert abs(np.diag(error)).max() < 1e-9
    bound = np.sqrt(1 - factor ** 2) / factor / np.sqrt(63)
    assert (abs(error) <= E.CONFIDENCE * bound[:, None] + 1e-9).mean() > 0.999


def test_tables_follow_the_wanted_recall():
    for n in (100, 10 ** 5, 10 ** 9):
        bits, tables = E.table_plan(n)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 1 - E.MISSED and 2 ** bits >= n
