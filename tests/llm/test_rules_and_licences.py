import re

from textlabels.llm import license_scan as L
from textlabels.llm import url_rules as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.example.net", "", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block"), ("b.c", "/abc", "block"), ("a.b.c", "/a", "allow")]
URLS = [None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "http://NET/", "http://Example.NET/en/1?q#f", "https://m.example.net/en/x1",
        "http://a.example.net", "http://a.example.net/en/x", "http://example.net?x/en/", "http://xexample.net/en/", "ftp://u@example.com:80/de/",
        "http://example.com/de/", "http://www.example.com/DE/", "http://é.org/fr/É", "http://org/fr/", "a://b://c", "http://a.b.c/abc", "http://net./",
        "http://x.net/" + "y" * 50_000]


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_rules_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[7]), (7, URLS[7])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as path", "1 as verdict", "2 as domain")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = U.judge(df, "page_id", "url", rules).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, *slow(u)) for i, u in rows), key=key)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert U.judge(pages.limit(0), "page_id", "url", rules).collect() == []
    assert [tuple(r) for r in U.judge(pages, "page_id", "url", rules.limit(0)).collect()] == [(1, "x.net", "/", None, "allow")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


TEXTS = [None, "", "...", "MIT License, the mit  license", "mit licenses", "General Public License", "general public apache license",
         "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under cc by an nc 4 0", "x " * 60_000 + "apache license",
         "This source code form is subject to the terms of the Mozilla Public License", "mozilla public nothing license"]


def test_base_places_against_brute_force(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])]
    got = L.scan(frame(rows), "doc_id", "text").collect()
    want = []
    for i, t in rows:
        w = words(t)
        places = [(k, label) for label, p in L.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[8] == "cc-by-nc" and labels[9] == "" and labels[11] == "mpl" and labels[12] == "" and labels[7] == "mit"
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def test_no_files_and_no_python(frame):
    assert L.scan(frame([]), "doc_id", "text").collect() == []
    assert "Python" not in L.scan(frame([(1, "mit license")]), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_texts_with_several_notices(frame):
    """Every notice of a text is found, whichever words are rarer and however many other licence words the text has."""
    notices = {f"{label} {no}": (label, text) for no, (label, _, text) in enumerate(L.TEMPLATES)}
    rows, want, i = [], {}, 0
    for a, (la, ta) in notices.items():
        for b, (lb, tb) in notices.items():
            rows.append((i, f"{ta} . and {tb}"))
            want[i], i = {la, lb}, i + 1
    words_of = sorted({w for _, _, t in L.TEMPLATES for w in t.split()} - set(L.FUNCTION_WORDS))
    for label, text in notices.values():
        rows.append((i, " x ".join(words_of) + " x " + text))
        want[i], i = {label}, i + 1
    rows += [(i + k, "licensed under cc by nc 4 0 in version 3") for k in range(30)]     # makes its words the more common ones
    got = {r.doc_id: r for r in L.scan(frame(rows), "doc_id", "text").collect()}
    assert all(want[k] <= set(got[k].labels.split(",")) for k in want)
    assert all(got[k].score == 1 for k in want)
