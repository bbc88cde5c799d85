"""Text operators: lengths, snippets, prompts, tokens, vocabularies, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlabels.functions.columns import explode_rows, join_null_safe, raw_tokens, strip, tokens
from textlabels.functions.constants import (
    BROADCAST_BYTES, CHUNK_OVERLAP, CHUNK_SIZE, LABELS28, PROMPT_BLOCK, PROMPT_SHOTS, ROW_BYTES, SPECIAL_TOKENS, VOCAB_SIZE,
)
from textlabels.operators.frequent import frequent_tokens
from textlabels.operators.prefix import ranked
from textlabels.sources.workspace import materialize


def truncate_text(df: DataFrame, col: str, n: int = 2000, out: str | None = None) -> DataFrame:
    """First n characters; null becomes the empty string."""
    return df.withColumn(out or col, F.substring(F.coalesce(F.col(col), F.lit("")), 1, n))


def snippet(df: DataFrame, col: str, n: int = 200, out: str = "snippet") -> DataFrame:
    """First n characters followed by ``...`` (always appended)."""
    return df.withColumn(out, F.concat(F.substring(F.coalesce(F.col(col), F.lit("")), 1, n), F.lit("...")))


def char_length(df: DataFrame, col: str, out: str = "n_char") -> DataFrame:
    return df.withColumn(out, F.length(col))


def word_count(df: DataFrame, col: str, out: str = "n_words") -> DataFrame:
    """Number of white-space separated words; 0 for null or blank text."""
    return df.withColumn(out, F.size(raw_tokens(col)))


def first_line(df: DataFrame, col: str, out: str = "line") -> DataFrame:
    """Strip, then keep what precedes the first newline."""
    return df.withColumn(out, F.substring_index(strip(col), "\n", 1))


def prompt_template(shots: Sequence[tuple[str, str]] = PROMPT_SHOTS, labels: Sequence[str] = LABELS28,
                    separator: str = ",") -> str:
    """The few-shot template; ``{input}`` marks the place of the text."""
    allowed = separator.join(labels)
    blocks = [PROMPT_BLOCK.format(sentence=s, allowed=allowed) + f" {y}" for s, y in shots]
    return "\n\n".join([*blocks, PROMPT_BLOCK.format(sentence="{input}", allowed=allowed)])


def build_prompt(df: DataFrame, col: str, shots: Sequence[tuple[str, str]] = PROMPT_SHOTS,
                 labels: Sequence[str] = LABELS28, separator: str = ",", out: str = "prompt") -> DataFrame:
    """Few-shot prompt per row.  The template is rendered once; rows only splice their text in."""
    head, *rest = prompt_template(shots, labels, separator).split("{input}")
    text = F.coalesce(F.col(col), F.lit(""))
    parts = [F.lit(head)]
    for piece in rest:
        parts += [text, F.lit(piece)]
    return df.withColumn(out, F.concat(*parts))


def chat_messages(df: DataFrame, content: str, role: str | Column = "user", out: str = "messages") -> DataFrame:
    """One prompt per row -> ``array<struct<role, content>>`` with one message."""
    who = F.lit(role) if isinstance(role, str) else role
    return df.withColumn(out, F.array(F.struct(who.alias("role"), F.col(content).alias("content"))))


def conversation_messages(df: DataFrame, conv: str, turn: str, role: str, content: str,
                          segment: int = 1000, blocks: int | None = None) -> DataFrame:
    """Dialogue turns -> ordered message arrays, one row per conversation and segment.

    Messages stand in the order of their turn; those of one turn go by role, then by
    the md5 of their content.  Every ``segment`` messages of that order begin a new
    row (segment 0, 1, ...), so no array is longer, whatever the turn numbers are.
    Conversations longer than that are ranked in blocks (see ``prefix``); the others
    are gathered as they are.
    """
    parts = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(content).alias("content"),
                      F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary")).alias("_digest"))
    order = ["_turn", "role", "_digest"]

    def gather(rows: DataFrame, place: Sequence[str], part: Column) -> DataFrame:
        message = F.struct(F.struct(*place).alias("place"), F.struct("role", "content").alias("message"))
        return (rows.groupBy("_conv", part.cast("bigint").alias("segment")).agg(F.array_sort(F.collect_list(message)).alias("m"))
                .select(F.col("_conv").alias(conv), "segment", F.transform("m", lambda m: m["message"]).alias("messages")))

    sizes = parts.groupBy("_conv").agg(F.count("*").alias("_size"))
    long = materialize(sizes.where(F.col("_size") > segment).select("_conv", F.lit(True).alias("_long")), "long")
    if long.isEmpty():
        return gather(parts, order, F.lit(0))
    marked = join_null_safe(parts, long, ["_conv"], "left")
    short = gather(marked.where(F.col("_long").isNull()), order, F.lit(0))
    places = ranked(marked.where("_long").drop("_long"), ["_conv"], order, "_rank", blocks)
    return short.unionByName(gather(places, ["_rank"], F.floor((F.col("_rank") - 1) / segment)))


def tokenize(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(col))


def encode_ids(df: DataFrame, key: str, col: str, vocab: DataFrame, max_len: int = 128,
               pad_id: int = -1, unk_id: int = 0) -> DataFrame:
    """Tokens -> fixed-length ``ids`` and ``mask``, truncated and padded on the right; one result per row, also for rows that share a key.

    A vocabulary of up to ``BROADCAST_BYTES`` measured bytes is broadcast (see
    ``vocab_build``), a larger one is left to the planner; the only other shuffle
    regroups the <= max_len ids of each row and carries no text.
    """
    # Splitting stops after max_len words; posexplode_outer keeps rows without words.
    text = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"^\s+", "")
    words = F.slice(F.array_remove(F.split(text, r"\s+", max_len + 1), ""), 1, max_len)
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), key, words.alias("_words"))
    short = numbered.select("_row", key, F.posexplode_outer("_words").alias("_pos", "_token"))
    codes = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_code"))
    held = codes.agg(F.coalesce(F.sum(F.octet_length("_token") + ROW_BYTES), F.lit(0))).first()[0]
    ids = (short.join(F.broadcast(codes) if held <= BROADCAST_BYTES else codes, "_token", "left")
                .groupBy("_row", key)
                .agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct(
                    "_pos", F.coalesce("_code", F.lit(unk_id)).alias("code"))))).alias("_seq")))
    n = F.size("_seq")
    return ids.select(
        key,
        F.concat(F.transform("_seq", lambda s: s["code"]), F.array_repeat(F.lit(pad_id), max_len - n)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), max_len - n)).alias("mask"))


def vocab_build(df: DataFrame, col: str, size: int = VOCAB_SIZE,
                specials: Sequence[str] = SPECIAL_TOKENS, held: int | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """``(token, id, freq)``: specials first, then tokens by frequency desc, token asc.

    Counts combine map-side; the top-k keeps at most ``size`` rows, so the
    numbering window runs over a bounded table.  With ``held`` counters a task, or
    with stored ``summaries`` of all parts of ``df``, only tokens that can be among
    those are counted (see ``frequent``); the result is the same.
    """
    if held is None and summaries is None:
        counts = explode_rows(df, [], tokens(col), "token").groupBy("token").agg(F.count("*").alias("freq"))
    else:
        counts = frequent_tokens(df, col, max(size - len(specials), 0), list(specials), summaries, held or size)
    order = [F.desc("freq"), F.asc("token")]
    top = counts.where(~F.col("token").isin(list(specials))).orderBy(*order).limit(max(size - len(specials), 0))
    rank = F.row_number().over(Window.orderBy(*order))
    numbered = top.select("token", (rank - 1 + len(specials)).cast("int").alias("id"), "freq")
    fixed = df.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(specials)], "token string, id int, freq bigint")
    return fixed.unionByName(numbered)


def char_coverage(df: DataFrame, col: str, coverage: float = 1.0) -> DataFrame:
    """Most frequent characters that together reach ``coverage`` of all characters.

    The running sum is over the character table, which Unicode bounds.
    """
    counts = (explode_rows(df, [], F.split(col, ""), "char")
              .where(F.col("char") != "").groupBy("char").agg(F.count("*").alias("freq")))
    order = [F.desc("freq"), F.asc("char")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (counts.withColumn("before", F.coalesce(F.sum("freq").over(before), F.lit(0)))
                  .withColumn("total", F.sum("freq").over(whole))
                  .where(F.col("before") < F.lit(coverage) * F.col("total"))
                  .select("char", "freq", ((F.col("before") + F.col("freq")) / F.col("total")).alias("covered")))


def assemble_corpus(parts: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """``[(df, text column, source tag)]`` -> ``(source, text)``: nulls dropped, text stripped."""
    out = None
    for df, col, tag in parts:
        piece = df.where(F.col(col).isNotNull()).select(F.lit(tag).alias("source"), strip(col).alias("text"))
        out = piece if out is None else out.unionByName(piece)
    if out is None:
        raise ValueError("assemble_corpus needs at least one part")
    return out


def chunk_tokens(df: DataFrame, col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 blank: bool = False) -> DataFrame:
    """One row per (input row, chunk): ``chunk`` number and ``tokens``; rows without tokens give none,
    or with ``blank`` one without a number.

    Chunks start at 0, size-overlap, 2(size-overlap), ... while the start lies
    inside the text; a text of up to ``size`` tokens is one chunk.  The slices
    are cut before exploding, so a long text costs its own length times
    size/(size-overlap), not its length times its number of chunks.
    """
    step = size - overlap
    keep = [c for c in df.columns if c != col]
    held = df.select(*keep, tokens(col).alias("_tokens")).withColumn("_n", F.size("_tokens"))
    n = F.col("_n")
    starts = (F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(1)))
               .otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))))
    chunks = F.transform(starts, lambda s: F.slice("_tokens", s, size))
    if blank:
        return held.select(*keep, F.posexplode_outer(chunks).alias("chunk", "tokens"))
    return explode_rows(held, keep, chunks, "chunk", "tokens")


def corpus_lines(col: str) -> Column:
    """One stripped line per document: inner line breaks folded to one blank."""
    return strip(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"[\r\n]+", " "))
