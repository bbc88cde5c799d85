import hashlib
import random
import re

import pytest

from textlabels.llm import line_dedup as L


def n_words(line):
    return len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line))


def slow(rows, run=3, min_words=None):
    """Lines left of every (id, text), by comparing all runs; shorter ones if they have the words."""
    texts = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    seen, gone = set(), {}
    for i, t in texts:
        lines = t.split("\n")
        out = gone.setdefault((i, t), set())
        for n in range(1 if min_words else run, run + 1):
            for s in range(len(lines) - n + 1):
                window = tuple(lines[s:s + n])
                if n < run and sum(map(n_words, window)) < min_words:
                    continue
                if window in seen:
                    out.update(range(s, s + n))
                seen.add(window)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows]


CASES = {
    "awkward": [(1, None), (2, ""), (3, "\n\n\n\n\n"), (None, "a\nb\nc"), (5, "a\nb\nc\nd"), (6, "a\nb"), (7, "x\nx\nx\nx\nx"), (7, "x\nx\nx\nx\nx"), (4, "q\na\nb\nc")],
    "empty": [],
    "same id": [(1, "a\nb\nc"), (1, "z\na\nb\nc"), (0, "b\nc\ne")],
}


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES.keys())
def test_awkward_rows(frame, rows):
    got = L.remove_repeated_lines(frame(rows), "doc_id", "text").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(slow(rows), key=key)


@pytest.mark.parametrize("run", [2, 3, 5])
def test_random_runs_against_brute_force(frame, run):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    got = L.remove_repeated_lines(frame(rows), "doc_id", "text", run).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(slow(rows, run))
    assert all(r._n_lines - r._n_removed == len(slow(rows, run)[r.doc_id][1].split("\n")) or r.text == "" for r in got)


def test_long_passages_on_one_or_two_lines(frame):
    """With ``min_words`` repeats of one or two lines count if they have the words; short boilerplate lines stay."""
    long, a, b = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("l", 50), ("a", 30), ("b", 20)))
    rows = [(1, long), (2, long), (3, f"x\n{long}\ny"), (4, f"{a}\n{b}\nfooter"), (5, f"{a}\n{b}"), (6, f"{a}\nfooter"), (7, f"{long}\n{long}"),
            (None, f"q\n{a}"), (8, None), (9, ""), (10, "footer\n\nx\ny\nz"), (11, "x\ny\nz")]
    got = L.remove_repeated_lines(frame(rows), "doc_id", "text", min_words=50).collect()
    left = {1: long, 2: "", 3: "x\ny", 4: f"{a}\n{b}\nfooter", 5: "", 6: f"{a}\nfooter", 7: "", None: f"q\n{a}", 8: None, 9: "",
            10: "footer\n\nx\ny\nz", 11: ""}
    assert {r.doc_id: r.text for r in got} == left and len(got) == len(rows)


@pytest.mark.parametrize("run,min_words", [(3, 4), (3, 6), (4, 5)])
def test_runs_by_words_against_brute_force(frame, run, min_words):
    rng = random.Random(run * min_words)
    lines = ["", "a", "b c", "D, é-f g", "h i j k", "l m n o p q"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(30)] + [(None, "h i j k"), (31, None), (3, "b c\nb c")]
    got = L.remove_repeated_lines(frame(rows), "doc_id", "text", run, min_words).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(slow(rows, run, min_words), key=key)


def test_columns_with_the_names_used_inside(frame):
    df = frame([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, None)]).selectExpr(
        "*", "'i' as _id", "'l' as _lines", "'o' as _own", "'d' as _DIGEST", "'old' as _n_lines")
    got = {r.doc_id: r for r in L.remove_repeated_lines(df, "doc_id", "text").collect()}
    assert got[2].text == "d" and got[2]._n_lines == 4 and got[2]._n_removed == 3
    assert [got[1][c] for c in ("_id", "_lines", "_own", "_DIGEST")] == ["i", "l", "o", "d"] and got[None].text is None
