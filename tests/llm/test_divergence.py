import re
from collections import Counter

import numpy as np
import pytest

from textlabels.llm import divergence as D

SCHEMA = "doc_id long, lang string, source string, text string"


def slow(rows, min_docs=3, ranks=200):
    """The contract in plain Python over (id, lang, source, text)."""
    docs = [(lang or "", source or "", re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())) for _, lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        count = {s: Counter(t for _, source, terms in mine if source == s for t in terms) for s in {d[1] for d in mine}}
        every = sum(count.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(every)
        for s in p:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item.decode(), -v, rank) for part, ranked in (("pair", pairs), ("term", terms))
                    for rank, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def fast(df, **k):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in D.audit(df, "lang", "source", "text", **k).collect())


def corpus(rng, docs=150, sources=11, words=90):
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" + "é" * (i % 7 == 0) for i in range(words)]
    rows = []
    for i in range(docs):
        source = int(rng.integers(sources)) if i % 3 else 0                      # one source holds a third of all
        own = names[source * 4 % words:] + names[:source * 4 % words]
        text = " ".join(own[int(k)] for k in np.minimum(rng.geometric(0.06, int(rng.integers(1, 60))), words) - 1)
        rows.append((i, "en" if i % 4 else "fr", f"s{source}", text.upper() if i % 5 == 0 else text))
    return rows


@pytest.mark.parametrize("columns,cells,side_rows", [(2048, 1 << 16, 11), (16, 1 << 16, 11), (64, 40, 19)])
def test_against_brute_force(spark, monkeypatch, columns, cells, side_rows):
    monkeypatch.setattr(D, "COLUMNS", columns)
    monkeypatch.setattr(D, "CELLS", cells)
    rows = corpus(np.random.default_rng(columns), sources=side_rows)
    assert fast(spark.createDataFrame(rows, SCHEMA).repartition(6)) == slow(rows)


def test_awkward_rows(spark):
    rows = [(1, None, "a", "x y"), (1, None, "a", "x y"), (2, None, None, None), (3, "", "b", "x X x"), (None, "", "b", ""),
            (4, "de", "only", "lone"), (5, "es", "p", "one"), (6, "es", "q", "two"), (7, "en", "a", "é " * 50_000 + "É"),
            (8, "en", "b", "é z-z_z9z\x00z"), (9, "en", "c", "é z"), (10, "en", "d", "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as n", "'x' as item", "3 as value", "4 as rank", "5 as part")
    got = fast(df)
    assert got == slow(rows)
    assert [r for r in got if r[0] == "es"] == [("es", "p", "pair", "q", 0, 1), ("es", "q", "pair", "p", 0, 1)]
    assert fast(df.where("false")) == []


def test_ties_in_value_go_by_item_and_ranks_end(spark):
    rows = [(i, "en", f"s{i % 3}", " ".join(f"t{chr(97 + k)}" for k in range(i % 3, 26, 3))) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert fast(df, ranks=4) == slow(rows, ranks=4) and len({r[4] for r in slow(rows) if r[2] == "term"}) < 4


def test_small_buffers_count_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH", 5)
    rows = corpus(np.random.default_rng(5), docs=60)
    assert fast(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_shares_are_exact_beyond_a_long():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 1 << 53, 2000)
    count = (size * rng.random(2000)).astype(np.int64)
    assert D.share(count, size).tolist() == [1 + 1_000_000_000 * int(c) // int(s) for c, s in zip(count, size)]


def test_zero_quadrants_have_no_nodes_and_are_not_priced():
    rows, columns = np.arange(5), np.array([0, 1, 900, 901, 902])
    bits, leaves = D.grow(rows, columns, np.ones(5, np.int64), D.size_for(40, 1000))
    assert len(leaves) == 2 and sum(len(b) for b in bits) <= 2 * 7
    packed = b"".join(np.packbits(b).tobytes() for b in bits)
    tile = D.Tile([str(i) for i in range(1000)], packed, leaves.astype("<i8").tobytes(), np.full(40, 50))
    met = sum(len(p[0]) for p in tile.pairs())
    assert met == 2 * (5 + 4)                                    # of 5 * 5 * 125 pairs of leaves
