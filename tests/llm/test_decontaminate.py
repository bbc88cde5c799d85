import random
import re

import pytest

from textlabels.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, window):
    phrases = {(i, tuple(w[s:s + window])) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - window + 1))}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, p in phrases:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s:s + len(p)]) == p:
                    hit.update(range(s, s + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def run(spark, frame, docs, items, window=13):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(frame(docs), "doc_id", "text", bench, "item_id", "text", window)
    return [(r.doc_id, r.n_words, r.n_hit, sorted(str(x) for x in r["items"])) for r in got.collect()]


KEY = lambda r: (r[0] is not None, r[0] or 0, r)


def test_awkward_rows(spark, frame):
    item = "the cat sat on the mat and then it went away for good today"
    docs = [(1, None), (2, ""), (3, "..."), (4, f"x {item.upper()} y"), (4, f"x {item.upper()} y"), (None, item), (6, "a short one"),
            (7, "short"), (8, item + " " + item), (9, "é É the cat sat on the mat and then it went away for good")]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "Short"), (None, "one a"), (5, "the the the")]
    assert sorted(run(spark, frame, docs, items), key=KEY) == sorted(slow(docs, items, 13), key=KEY)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([(1, "a b")], [(1, "q r")])])
def test_empty_tables_and_no_match(spark, frame, docs, items):
    assert run(spark, frame, docs, items) == slow(docs, items, 13)


def test_random_texts_against_brute_force(spark, frame):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("a a a a b b c d e".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(25)]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    assert sorted(run(spark, frame, docs, items, 5)) == sorted(slow(docs, items, 5))


def test_proximity(spark, frame):
    index = D.build_index(frame([(1, "a x x b a"), (2, "b x x x x a")]), "doc_id", "text",
                          spark.createDataFrame([("a", 1), ("b", 2)], "term string, term_id long"))
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id int, term_id long, other_id long")
    got = D.proximity_matches(index, pairs, 3).collect()
    assert sorted((r.pos, r.other) for r in got) == [(0, 3), (4, 3)]


def test_plans_have_no_python(spark, frame):
    index = D.build_index(frame([(1, "a")]), "doc_id", "text", spark.createDataFrame([("a", 1)], "term string, term_id long"))
    assert "Python" not in index._jdf.queryExecution().executedPlan().toString()


def test_items_without_an_id_count(spark, frame):
    """An item with a null id that occurs covers words, makes a document contaminated and counts as one item without a name."""
    item, other = "one two three four five six seven", "red green blue"
    docs = [(1, item), (2, f"x {other} y"), (3, f"{item} {other}"), (4, "nothing of it")]
    items = [(None, item), (None, other), (7, other)]
    assert sorted(run(spark, frame, docs, items, 5)) == sorted(slow(docs, items, 5))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(D.scan(frame(docs), "doc_id", "text", bench, "item_id", "text", 5), "doc_id").collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got) == [(1, 7, 1, True), (2, 3, 2, True), (3, 10, 2, True), (4, 0, 0, False)]
    kept = D.drop_contaminated(frame(docs).selectExpr("*", "0 as _Gone"), "doc_id", "text", bench, "item_id", "text").collect()
    assert [r.doc_id for r in kept] == [4]
