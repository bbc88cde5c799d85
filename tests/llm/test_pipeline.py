"""The pipeline against plain Python: each stage on what its predecessor kept."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_lines import slow as slow_lines
from test_simhash import components, slow_fingerprint
from textlabels.llm import quality

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[s:s + 13]) for s in range(max(1, len(w) - 12))} if w else set()


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    return read("documents"), read("labels"), [(r.item_id, r.text) for r in read("benchmark").collect()]


def test_rows_of_the_pipeline(spark, tables):
    docs, labels, items = tables
    model = quality.train(docs, "doc_id", "text", labels, "quality")
    rows = [(r.doc_id, r.text) for r in docs.collect() if quality.score((r.text or "").encode(), model) >= quality.THRESHOLD]
    before = dict(rows)
    rows = [(i, t) for i, t in slow_lines(rows, 3, 50) if t or before[i] == t]
    fp = {t: slow_fingerprint(t) for _, t in rows}
    label = components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(label[fp[t]], i)
    rows = [(i, t) for i, t in rows if first[label[fp[t]]] == i]
    phrases = {p for _, t in items for p in windows(t)}
    sizes = {len(p) for p in phrases}

    def clean(text):
        w = words(text)
        hit = {k for n in sizes for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in phrases for k in range(s, s + n)}
        return not (hit and 20 * len(hit) >= len(w))

    rows = [(i, t) for i, t in rows if clean(t)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and got == want
