import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlabels.functions.constants import LABELS28
from textlabels.operators import text as X
from textlabels.operators.frequent import frequent_tokens, token_summary


def chunk_starts(n, size=400, step=350):
    return [0] if 0 < n <= size else list(range(0, n, step))


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (399, 1), (400, 1), (401, 2), (700, 2), (701, 3), (1051, 4)])
def test_chunk_counts(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(words))], "id int, text string")
    rows = sorted(X.chunk_tokens(df, "text").collect(), key=lambda r: r.chunk)
    assert len(rows) == chunks
    assert [r.tokens for r in rows] == [words[s:s + 400] for s in chunk_starts(n)]


def test_chunks_of_null_and_blank_text(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "A b")], "id int, text string")
    assert [(r.id, r.chunk, r.tokens) for r in X.chunk_tokens(df, "text").collect()] == [(3, 0, ["a", "b"])]


def test_text_is_tokenised_once_per_row(spark, capsys):
    df = spark.createDataFrame([(1, "A b")], "id int, text string")
    X.chunk_tokens(df, "text").explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_lengths_and_snippets(spark):
    df = spark.createDataFrame([("  two words ",), ("",), (None,), ("x" * 300,)], "t string")
    rows = X.snippet(X.word_count(X.char_length(df, "t"), "t"), "t", 5).collect()
    assert [(r.n_char, r.n_words, r.snippet) for r in rows] == [
        (12, 2, "  two..."), (0, 0, "..."), (None, 0, "..."), (300, 1, "xxxxx...")]
    assert [len(r.t) for r in X.truncate_text(df, "t", 7).collect()] == [7, 0, 0, 7]


def test_first_line(spark):
    df = spark.createDataFrame([("\n a b \nc",), ("x",), ("",)], "t string")
    assert [r.line for r in X.first_line(df, "t").collect()] == ["a b ", "x", ""]


def test_prompt_keeps_placeholders_inside_the_text(spark):
    df = spark.createDataFrame([("say {input} $1",), (None,)], "t string")
    rows = X.build_prompt(df, "t").collect()
    assert rows[0].prompt.endswith('Sentence: "say {input} $1"\nAllowed emotions: ' + ",".join(LABELS28) + "\nEmotion =")
    assert rows[0].prompt.startswith('Sentence: "I\'ve never felt worse."\n') and rows[0].prompt.count("Sentence:") == 5
    assert "Emotion = sadness\n\n" in rows[0].prompt and 'Sentence: ""' in rows[1].prompt


def test_messages(spark):
    df = spark.createDataFrame([(7, t, "user", f"m{t}") for t in random.Random(1).sample(range(25), 25)],
                               "conv int, turn bigint, role string, text string")
    assert X.chat_messages(df.where("turn = 3"), "text").first().messages[0].asDict() == {"role": "user", "content": "m3"}
    rows = sorted(X.conversation_messages(df, "conv", "turn", "role", "text", segment=10).collect(), key=lambda r: r.segment)
    assert [len(r.messages) for r in rows] == [10, 10, 5]
    assert [m.content for r in rows for m in r.messages] == [f"m{t}" for t in range(25)]


def test_long_conversations_are_cut_by_rank(spark):
    """1,500 messages with one turn number, a null conversation, equal messages."""
    rows = [(1, 5, "user", f"m{i}") for i in range(1500)] + [(None, t, "user", "same") for t in (1, 1, 1, 2)] + [(2, 0, "a", "x")]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, text string").repartition(4)
    for segment, blocks in ((100, 7), (3, 2)):
        got = X.conversation_messages(df, "conv", "turn", "role", "text", segment, blocks).collect()
        for conv in (1, None, 2):
            mine = sorted((r.segment, [m.content for m in r.messages]) for r in got if r.conv == conv)
            want = [r[3] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))]
            assert [s for s, _ in mine] == list(range(-(-len(want) // segment)))
            assert all(len(m) == segment for _, m in mine[:-1]) and [c for _, m in mine for c in m] == want


def test_encoding_keeps_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b a a"), (None, "a"), (None, "b")], "id int, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    got = sorted((r.id or 0, r.ids) for r in X.encode_ids(df, "id", "text", vocab, 3).collect())
    assert got == [(0, [3, -1, -1]), (0, [4, -1, -1]), (1, [3, 4, -1]), (1, [4, 3, 3])]


def test_vocab_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, "a b"), (3, ""), (4, "zz " + "a " * 9), (5, None)], "id int, text string")
    vocab = X.vocab_build(df, "text", size=5)
    assert [tuple(r) for r in vocab.orderBy("id").collect()] == [
        ("<unk>", 0, 0), ("<s>", 1, 0), ("</s>", 2, 0), ("a", 3, 11), ("b", 4, 3)]
    rows = {r.id: (r.ids, r.mask) for r in X.encode_ids(df, "id", "text", vocab, 5).collect()}
    assert rows[1] == ([4, 3, 4, 0, -1], [1, 1, 1, 1, 0])
    assert rows[3] == rows[5] == ([-1] * 5, [0] * 5)
    assert rows[4] == ([0, 3, 3, 3, 3], [1] * 5)


def test_char_coverage(spark):
    text = "aaaaaabbbc"
    df = spark.createDataFrame([(text,)], "t string")
    full = X.char_coverage(df, "t").collect()
    assert {r.char: r.freq for r in full} == Counter(text)
    assert [r.char for r in X.char_coverage(df, "t", 0.9).orderBy(F.desc("freq")).collect()] == ["a", "b"]
    assert [r.char for r in X.char_coverage(df, "t", 0.91).orderBy(F.desc("freq")).collect()] == ["a", "b", "c"]


def test_assemble_corpus(spark):
    a = spark.createDataFrame([(" x\n",), (None,)], "u string")
    b = spark.createDataFrame([("y", 1)], "text string, k int")
    out = X.assemble_corpus([(a, "u", "first"), (b, "text", "second")])
    assert sorted(tuple(r) for r in out.collect()) == [("first", "x"), ("second", "y")]


def test_vocabulary_by_summaries(spark):
    """Few counters a task: the same vocabulary, proved by the debt; rare tokens have no counter, ties with the last token are kept."""
    common = [f"c{i % 40} C{i % 7} tie{i % 5}" for i in range(4000)]
    texts = [(i, f"{t} once{i} <s>") for i, t in enumerate(common)] + [(-1, None), (-2, " ")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    for size in (0, 3, 13, 52, 60):
        want = sorted(map(tuple, X.vocab_build(df, "text", size).collect()))
        for held in (40, 200, 100_000):
            assert sorted(map(tuple, X.vocab_build(df, "text", size, held=held).collect())) == want
    parts = [token_summary(df.where(c), "text", 200) for c in ("id % 2 = 0", "id % 2 <> 0")]
    stored = parts[0].unionByName(parts[1])
    assert sorted(map(tuple, X.vocab_build(df, "text", 13, summaries=stored).collect())) == sorted(map(tuple, X.vocab_build(df, "text", 13).collect()))
    exact = {r.token: r.freq for r in frequent_tokens(df, "text", 10_000).collect()}
    kept = {r.token: r.kept for r in token_summary(df, "text", 200).collect()}
    debt = kept.pop(None)
    assert debt > 0 and len(kept) <= 3 * 200
    assert all(kept.get(t, 0) <= n <= kept.get(t, 0) + debt for t, n in exact.items())
    chosen = frequent_tokens(df, "text", 10, ["<s>"], held=200)
    text = chosen._jdf.queryExecution().executedPlan().toString()
    assert chosen.count() < 60 and text.index("HashAggregate") < text.index("LeftSemi")       # rare tokens go before they are counted
    assert frequent_tokens(df.limit(0), "text", 5).count() == 0
