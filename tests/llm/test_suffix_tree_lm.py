import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlabels.llm import suffix_tree_lm as L

SCHEMA = "doc_id long, text string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def split(text):
    words, word = [], ""
    for c in (text or "").translate(ASCII) + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return [*words, "</end>"]


def slow(rows, root_share, depth):
    """The model in plain Python, with dictionaries of word tuples; returns (rows, contexts that stay, share of a word in a context)."""
    texts = [split(t) for i, t in rows if learns(i)]
    one = Counter(w for t in texts for w in t)
    total, distinct = sum(one.values()), len(one)
    enough = max(2, math.ceil(root_share * math.sqrt(total)))
    follow = defaultdict(Counter)
    for t in texts:
        for i, w in enumerate(t):
            for k in range(1, depth + 1):
                history = ["</end>", *t[:i]][-k:]
                if len(history) == k:
                    follow[tuple(history)][w] += 1
    frequent = {(w,) for w in one if one[w] >= enough or w == "</end>"}
    for k in range(1, depth + 1):
        frequent |= {(*h, w) for h in follow if len(h) == k and h in frequent for w, n in follow[h].items() if n >= enough and (w,) in frequent}
    stored = {h: {w: n for w, n in follow[h].items() if (*h, w) in frequent} for h in list(follow) if h in frequent}

    def share(h, w, tree=None):
        while h and tree is not None and h not in tree:
            h = h[1:]
        if not h:
            return (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
        size, own = sum(follow[h].values()), stored.get(h, {})
        rest = 1 - sum(n - 0.5 for n in own.values()) / size if own else 1
        return (own[w] - 0.5 if w in own else 0) / size + rest * share(h[1:], w)

    tree = set()
    for h, own in stored.items():
        gain = sum(n * math.log(share(h, w) / share(h[1:], w)) for w, n in own.items())
        size = sum(follow[h].values())
        if own:
            rest = 1 - sum(n - 0.5 for n in own.values()) / size
            gain += (size - sum(own.values())) * (math.log(rest) if rest else 0)
        if own and gain > 0.5 * len(own) * math.log(total):
            tree |= {h[k:] for k in range(len(h))}
    out = []
    for i, text in rows:
        t = split(text)
        logs = [math.log10(share(tuple(["</end>", *t[:j]][-depth:]), w, tree)) for j, w in enumerate(t)]
        out.append((-1 if i is None else i, not learns(i), len(t), sum(one[w] > 0 for w in t), total,
                    sum(math.log10((one[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), sum(logs)))
    return sorted(out), tree, share, one


def fast(df, **k):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in L.score(df, "doc_id", "text", L.training("doc_id"), **k).collect())


def prose(rng, n=80):
    out = []
    for i in range(n):
        words = ["The", "quick", "brown"]
        while rng.random() > 0.04:
            a = words[-1].lower()
            words.append({"the": ["quick", "lazy"], "quick": ["brown", "red"], "lazy": ["dog"], "dog": ["saw", "."], "saw": ["the"]}.get(
                a, ["the", "dog", "fox", "Émile"])[int(rng.integers(1 if a in ("lazy", "saw") else 2))] if rng.random() < 0.8 else f"x{rng.integers(90)}")
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("root_share,depth,head,p_min", [(0.01, 2, 1 << 20, 1e-6), (0.2, 3, 15, 0.01), (2, 1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, root_share, depth, head, p_min):
    """Also where most of the tree, or most words, are in tables alone."""
    monkeypatch.setattr(L, "FLUSH", 20)
    monkeypatch.setattr(L, "BLOCK", 50)
    monkeypatch.setattr(L, "HEAD", head)
    monkeypatch.setattr(L, "P_MIN", p_min)
    monkeypatch.setattr(L, "MAP_BITS", 1 << 15)
    rows = prose(np.random.default_rng(depth))
    got = fast(spark.createDataFrame(rows, SCHEMA).repartition(5), root_share=root_share, depth=depth)
    want, tree, _, _ = slow(rows, root_share, depth)
    assert tree and [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])       # better than the base on held-out texts


def test_contexts_differ_in_length_and_shares_sum_to_one():
    rows = prose(np.random.default_rng(2))
    _, tree, share, one = slow(rows, 0.01, 2)
    assert {len(h) for h in tree} == {1, 2} and ("x1",) not in tree and len({h for h in tree if len(h) == 1}) < len(one)
    for h in sorted(tree)[:20]:
        assert math.isclose(sum(share(h, w, tree) for w in [*one, "never seen"]), 1)


def test_awkward_rows(spark):
    long = "a b c d " * 30_000
    rows = [(0, None), (1, ""), (2, " \n\t "), (None, "a b"), (None, "a b"), (3, long), (3, long), (6, "A\x0bB c É"), (7, "zzz zzz yyy")]
    assert {learns(i) for i, _ in rows} == {True, False}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as word", "1 as n", "2 as row", "'y' as raw", "3 as ids", "4 as id", "5 as train")
    got, want = fast(df), slow(rows, L.ROOT_SHARE, L.DEPTH)[0]
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert fast(df.where("false")) == []


def test_the_tree_grows_with_the_corpus():
    """What the tree may hold is the corpus over the least count: ten times as much for a hundred times the tokens."""
    sizes = [n / L.least(n) for n in (10 ** 6, 10 ** 8, 10 ** 10, 10 ** 12)]
    assert all(9 < b / a < 11 for a, b in zip(sizes, sizes[1:]))


def test_nothing_to_learn_from(spark):
    rows = [(i, "a b") for i in range(60) if not learns(i)]
    assert rows and fast(spark.createDataFrame(rows, SCHEMA)) == [(i, True, 3, 0, 0, 0.0, 0.0) for i, _ in rows]


def test_texts_are_split_into_words_in_small_blocks(spark, monkeypatch):
    """A batch of 200 texts is coded block by block, with the same result; a text longer than a block stays whole."""
    import pyarrow as pa
    raw = [b"a b" * 5] * 100 + [b"word " * 500] + [b""] * 99
    sizes = [b.num_rows for b in L.blocks(iter([pa.RecordBatch.from_arrays([pa.array(raw)], names=["raw"])]),
                                          lambda b: L.pc.binary_length(b.column("raw")), 300)]
    assert sum(sizes) == 200 and sizes[:5] == [20] * 5 and sizes[5] <= 100
    docs = spark.createDataFrame([(i, x, True) for i, x in enumerate(raw)], "id long, raw binary, train boolean").coalesce(1)

    def result(block):
        monkeypatch.setattr(L, "TEXT_BLOCK", block)
        return sorted((r.id, r.n_tokens, r.ids, r.rare) for r in L.coded(docs, "bigint", [L.END, b"a"]).collect())

    assert result(300) == result(1 << 22)
