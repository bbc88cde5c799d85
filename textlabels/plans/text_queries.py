"""Queries of the text, split and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlabels.functions.constants import SPECIAL_TOKENS, VOCAB_SIZE
from textlabels.operators import splitting as D
from textlabels.operators import text as X
from textlabels.plans import inputs as I
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import h, sql, strip, text_list, toks, words

_VOCAB = f"""
    SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 2)::int AS id, freq
    FROM (SELECT token, count(*) AS freq FROM (SELECT unnest({toks('text')}) AS token FROM documents)
          WHERE NOT list_contains({text_list(SPECIAL_TOKENS)}, token) GROUP BY token ORDER BY freq DESC, token LIMIT 7997)"""


@query("truncate_text", sql("documents_gaps", "SELECT doc_id, substr(coalesce(text, ''), 1, 2000) AS text FROM documents_gaps"))
def _(spark, sf):
    return X.truncate_text(I.documents_gaps(spark, sf), "text")


@query("snippet", sql("documents_gaps", """
    SELECT doc_id, substr(coalesce(text, ''), 1, 200) || '...' AS snippet,
           substr(coalesce(text, ''), 1, 50) || '...' AS short_snippet FROM documents_gaps"""))
def _(spark, sf):
    docs = X.snippet(X.snippet(I.documents_gaps(spark, sf), "text"), "text", 50, "short_snippet")
    return docs.drop("text")


@query("char_length", "SELECT doc_id, length(text)::int AS n_char FROM documents")
def _(spark, sf):
    return X.char_length(I.documents(spark, sf).select("doc_id", "text"), "text").drop("text")


@query("word_count", sql("documents_gaps", f"""
    SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len({words('text')}) END::int AS n_words FROM documents_gaps"""))
def _(spark, sf):
    return X.word_count(I.documents_gaps(spark, sf), "text").drop("text")


@query("first_line", sql("documents_gaps", f"SELECT doc_id, split_part({strip('text')}, chr(10), 1) AS line FROM documents_gaps"))
def _(spark, sf):
    return X.first_line(I.documents_gaps(spark, sf), "text").select("doc_id", "line")


# The template once more, independent of the operator under test.
_PROMPT_SQL = """
    WITH allowed AS (
        SELECT 'admiration,amusement,anger,annoyance,approval,caring,confusion,curiosity,desire,disappointment,disapproval,disgust,'
            || 'embarrassment,excitement,fear,gratitude,grief,joy,love,nervousness,optimism,pride,realization,relief,remorse,sadness,'
            || 'surprise,neutral' AS a),
    shots AS (SELECT * FROM (VALUES (1, 'I''ve never felt worse.', 'sadness'), (2, 'This is the best day ever!', 'joy'),
                                    (3, 'Wow! I can''t believe it!', 'surprise'), (4, 'That''s so rude!', 'anger')) AS t(i, s, e)),
    head AS (SELECT string_agg('Sentence: "' || s || '"' || chr(10) || 'Allowed emotions: ' || a || chr(10) || 'Emotion = ' || e
                               || chr(10) || chr(10), '' ORDER BY i) AS h FROM shots, allowed)
    SELECT conv_id, turn, h || 'Sentence: "' || coalesce(text, '') || '"' || chr(10) || 'Allowed emotions: ' || a || chr(10)
           || 'Emotion =' AS prompt FROM conversations, head, allowed"""


@query("build_prompt", _PROMPT_SQL)
def _(spark, sf):
    return X.build_prompt(I.table(spark, sf, "conversations"), "text").select("conv_id", "turn", "prompt")


@query("chat_messages", """
    SELECT conv_id, turn, 1::int AS n_messages, 'user: ' || text AS prompt FROM conversations""")
def _(spark, sf):
    one = X.chat_messages(I.table(spark, sf, "conversations"), "text")
    return one.select("conv_id", "turn", F.size("messages").alias("n_messages"), _lines("messages").alias("prompt"))


def _lines(col: str):
    return F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query("conversation_messages", """
    SELECT conv_id, r // 4 AS segment, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY r) AS dialogue
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS r FROM conversations) GROUP BY ALL""")
def _(spark, sf):
    turns = I.table(spark, sf, "conversations")
    dialogue = X.conversation_messages(turns, "conv_id", "turn", "role", "text", segment=4)
    return dialogue.select("conv_id", "segment", F.size("messages").cast("bigint").alias("n_messages"),
                           _lines("messages").alias("dialogue"))


@query("tokenize", f"""
    SELECT doc_id, len(t)::int AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, {toks('text')} AS t FROM documents)""")
def _(spark, sf):
    return X.tokenize(I.documents(spark, sf), "text").select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("encode_ids", f"""
    WITH vocab AS MATERIALIZED ({_VOCAB}),
    pos AS (SELECT doc_id, unnest(range(1, 129)) AS i, ts FROM (SELECT doc_id, {toks('text')} AS ts FROM documents))
    SELECT doc_id, string_agg(CASE WHEN i > len(ts) THEN '-1' ELSE coalesce(id, 0)::varchar END, ' ' ORDER BY i) AS ids,
           string_agg(CASE WHEN i > len(ts) THEN '0' ELSE '1' END, '' ORDER BY i) AS mask
    FROM pos LEFT JOIN vocab ON vocab.token = ts[i] GROUP BY doc_id""")
def _(spark, sf):
    docs = I.documents(spark, sf)
    coded = X.encode_ids(docs, "doc_id", "text", X.vocab_build(docs, "text"))
    return coded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
                        F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


_VOCAB_TABLE = f"""
    SELECT token, id, freq FROM ({_VOCAB}) UNION ALL
    SELECT * FROM (VALUES {', '.join(f"('{t}', {i}::int, 0::bigint)" for i, t in enumerate(SPECIAL_TOKENS))}) AS s"""


@query("vocab_build", _VOCAB_TABLE)
def _(spark, sf):
    return X.vocab_build(I.documents(spark, sf), "text")


@query("vocab_from_summary", _VOCAB_TABLE)
def _(spark, sf):
    return X.vocab_build(I.documents(spark, sf), "text", held=4 * VOCAB_SIZE)


@query("char_coverage", """
    SELECT char, freq, round((before + freq)::double / total, 6) AS covered
    FROM (SELECT char, freq, coalesce(sum(freq) OVER (ORDER BY freq DESC, char
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before,
                 (sum(freq) OVER ())::bigint AS total
          FROM (SELECT char, count(*) AS freq FROM (SELECT unnest(string_split(text, '')) AS char FROM documents)
                WHERE char <> '' GROUP BY char))
    WHERE before < 1.0::double * total""")
def _(spark, sf):
    return rounded(X.char_coverage(I.documents(spark, sf), "text"))


@query("assemble_corpus", sql("documents_gaps", " UNION ALL ".join(
    f"SELECT '{tag}' AS source, {strip('text')} AS text FROM {name} WHERE text IS NOT NULL"
    for tag, name in (("documents", "documents_gaps"), ("conversations", "conversations"), ("benchmark", "benchmark")))))
def _(spark, sf):
    return X.assemble_corpus([
        (I.documents_gaps(spark, sf), "text", "documents"),
        (I.table(spark, sf, "conversations"), "text", "conversations"),
        (I.table(spark, sf, "benchmark"), "text", "benchmark")])


@query("chunk_tokens", sql("chunks", """
    SELECT doc_id, chunk::int AS chunk, len(tokens)::int AS n_tokens, array_to_string(tokens, ' ') AS chunk_text FROM chunks"""))
def _(spark, sf):
    docs = I.documents_gaps(spark, sf)
    return X.chunk_tokens(docs, "text").select(
        "doc_id", "chunk", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("chunk_text"))


# --- splits and samples -----------------------------------------------------

_DOC_HASH = h("doc_id", "'42'")


@query("split_two", f"""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_DOC_HASH}, doc_id) <= ceil(count(*) OVER () * 0.2::double)
                        THEN 'test' ELSE 'train' END AS split FROM documents""")
def _(spark, sf):
    return D.split_two(I.documents(spark, sf).select("doc_id"), "doc_id")


@query("split_three", f"""
    SELECT doc_id, CASE WHEN r <= nt THEN 'test'
                        WHEN r <= nt + ceil((n - nt) * {0.1 / 0.9!r}::double) THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT doc_id, r, n, ceil(n * 0.1::double) AS nt
          FROM (SELECT doc_id, row_number() OVER (ORDER BY {_DOC_HASH}, doc_id) AS r, count(*) OVER () AS n FROM documents))""")
def _(spark, sf):
    return D.split_three(I.documents(spark, sf).select("doc_id"), "doc_id")


@query("split_hash", sql("utterances", f"""
    SELECT utt_id, CASE WHEN x < floor(0.1::double * 4294967296) THEN 'test'
                        WHEN x < floor((0.1::double + 0.1::double) * 4294967296) THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT utt_id, {h('utt_id', "'42'")} AS x FROM utterances)"""))
def _(spark, sf):
    utt = I.utterances(spark, sf).select("utt_id")
    return D.split_hash(utt, "utt_id", {"test": 0.1, "validation": 0.1}, out="part")


@query("sample_n", sql("utterances", f"""
    SELECT utt_id, Emotion, Utterance FROM utterances ORDER BY {h('utt_id', "'42'")}, utt_id LIMIT 500"""))
def _(spark, sf):
    return D.sample_n(I.utterances(spark, sf).select("utt_id", "Emotion", "Utterance"), "utt_id", 500)
