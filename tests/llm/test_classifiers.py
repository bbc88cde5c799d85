import random
import zlib

import numpy as np
import pytest

from textlabels.llm import quality as Q
from textlabels.llm import toxicity as X


def corpus(rng, n=240):
    clean = lambda: " ".join(rng.choice("the of and reader house near water light over again".split()) for _ in range(rng.randint(5, 400)))
    rows = []
    for i in range(n):
        text = clean()
        kind = i % 6
        if kind == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if kind == 1:
            text = text.replace("again", "idiot again", 1) + " idiot"
        if kind == 2:
            text += " trash"
        rows.append((i, text, int(kind != 0), int(kind in (1, 2))))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1000, None), (1001, ""), (None, "the house"), (3, rows[3][1])],
                                 "doc_id long, text string").selectExpr("*", "'q' as score", "1 as quality", "2 as p")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(5000, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def check_rows(scored, docs):
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    for r in scored:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality(spark, tables):
    docs, labels = tables
    model = Q.train(docs, "doc_id", "text", labels, "quality")
    scored = Q.classify(docs, "doc_id", "text", model).collect()
    check_rows(scored, docs)
    right = [r.predicted == (r.doc_id % 6 != 0) for r in scored if r.held_out and r.doc_id < 240]
    assert np.mean(right) > 0.9
    again = Q.train(docs, "doc_id", "text", labels, "quality")
    assert all(np.array_equal(model[k], again[k]) for k in model)
    named = docs.selectExpr("*", "5 as _score")
    good = Q.keep_good(named, "text", model)
    assert good.columns == named.columns and {r._score for r in good.collect()} == {5}


def test_quality_without_labels_or_rows(spark, tables):
    docs, labels = tables
    model = Q.train(docs, "doc_id", "text", labels.limit(0), "quality")
    assert {r.score for r in Q.classify(docs, "doc_id", "text", model).collect()} == {0.5}
    assert Q.classify(docs.limit(0), "doc_id", "text", model).collect() == []


def test_chunks_cover_the_whole_text():
    """One changed stretch anywhere in a long text can change what is pooled."""
    model = Q.fit([b"plain text " * 50, b"$$$ " * 100] * 10, np.array([1, 0] * 10), np.ones(20))
    body = b"plain text " * 30_000
    top = Q.pooled(body, model).max(axis=0)
    for at in (0, 1, 4099, 150_003, len(body) - 8):
        changed = body[:at] + b"$$$$ $$$" + body[at + 8:]
        assert (Q.pooled(changed, model).max(axis=0) > top).any(), at


def test_pooling_does_not_depend_on_the_block(monkeypatch):
    model = Q.fit([b"plain text " * 50, b"$$$ " * 100] * 4, np.array([1, 0] * 4), np.ones(8))
    body = bytes(np.random.default_rng(1).integers(32, 127, 40_001, np.uint8))
    want = Q.pooled(body, model)
    monkeypatch.setattr(Q, "BLOCK", 4 * Q.HALF)
    assert np.allclose(Q.pooled(body, model), want, atol=1e-5) and 0 < Q.score(b"", model) < 1


def test_toxicity_chain(spark, tables):
    docs, labels = tables
    model = X.train(docs, "doc_id", "text", labels, "toxic")
    assert [c["name"] for c in model["chain"]] == ["insult", "contempt", "toxic"]
    assert [len(c["earlier"]) for c in model["chain"]] == [0, 1, 2]
    scored = X.score(docs, "doc_id", "text", model).collect()
    check_rows(scored, docs)
    right = [r.predicted == (r.doc_id % 6 in (1, 2)) for r in scored if r.held_out and r.doc_id < 240]
    assert np.mean(right) > 0.9
    assert X.score(docs.limit(0), "doc_id", "text", model).collect() == []
    flat = X.train(docs, "doc_id", "text", labels.limit(0), "toxic")
    assert {r.score for r in X.score(docs, "doc_id", "text", flat).collect()} == {0.5}


def test_earlier_probabilities_are_out_of_fold(monkeypatch):
    """No model that feeds a row's earlier probability may have seen the row."""
    seen = []
    original = X._fit_one
    monkeypatch.setattr(X, "_fit_one", lambda row, col, n, y, before, use: seen.append(use.copy()) or original(row, col, n, y, before, use))
    rows = corpus(random.Random(2), 60)
    X.fit([str(i) for i, *_ in rows], [t for _, t, _, _ in rows], np.array([x for *_, x in rows]))
    per = len(seen) // 3
    assert all(u.all() for u in seen[::per])
    for k in range(3):
        folds = [~u for u in seen[k * per + 1:(k + 1) * per]]
        assert np.sum(folds, axis=0).tolist() == [1] * len(rows)
