import hashlib
import math

import pytest

from textlabels.operators import splitting as D


def rank_order(keys, seed=42):
    return sorted(keys, key=lambda k: (int(hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:8], 16), k))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 10, 101, 3000])
def test_exact_splits(spark, n):
    df = spark.range(n)
    order = rank_order(range(n))
    n_test = math.ceil(n * 0.2)
    got = {r.id for r in D.split_two(df, "id").where("split = 'test'").collect()}
    assert got == set(order[:n_test])

    n_test = math.ceil(n * 0.1)
    n_val = math.ceil((n - n_test) * (0.1 / 0.9))
    rows = {r.id: r.split for r in D.split_three(df, "id").collect()}
    assert {k for k, s in rows.items() if s == "test"} == set(order[:n_test])
    assert {k for k, s in rows.items() if s == "validation"} == set(order[n_test:n_test + n_val])
    assert len(rows) == n


def test_other_seed_gives_another_split(spark):
    a, b = ({r.id for r in D.split_two(spark.range(200), "id", seed=s).where("split = 'test'").collect()} for s in (1, 2))
    assert len(a) == len(b) == 40 and a != b


def test_a_key_that_fills_a_third_of_the_rows_stays_together(spark):
    keys = [(i,) for i in range(200)] + [(7,)] * 100
    rows = D.split_two(spark.createDataFrame(keys, "id int"), "id").collect()
    assert len(rows) == 300 and len({r.split for r in rows if r.id == 7}) == 1
    n_test = sum(r.split == "test" for r in rows)
    assert 60 <= n_test <= 60 + 100


def test_split_does_not_shuffle_the_rows(spark, capsys, tmp_path):
    spark.range(1000).selectExpr("id", "repeat('x', 50) AS payload").write.parquet(f"{tmp_path}/t")
    D.split_two(spark.read.parquet(f"{tmp_path}/t"), "id").explain()
    main_plan = capsys.readouterr().out.split("Subquery")[0]
    assert "Exchange" not in main_plan


def test_hash_split_is_a_projection(spark):
    rows = D.split_hash(spark.range(5000), "id", {"test": 0.1, "validation": 0.2}).collect()
    shares = {s: sum(r.split == s for r in rows) / 5000 for s in ("test", "validation", "train")}
    assert abs(shares["test"] - 0.1) < 0.02 and abs(shares["validation"] - 0.2) < 0.02


def test_sample(spark):
    assert [r.id for r in D.sample_n(spark.range(50), "id", 5).collect()] == rank_order(range(50))[:5]
    assert D.sample_n(spark.range(3), "id", 5).count() == 3
