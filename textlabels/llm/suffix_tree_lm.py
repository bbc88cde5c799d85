"""Language-model scoring with a probabilistic suffix tree over words.

The root's distribution is the smoothed one of single tokens, over every word of
the corpus.  Below it stand contexts of one, two, ... preceding words.  A sequence of
words is a candidate when it occurs at least ``ROOT_SHARE`` times the square root of the
corpus size; the tree grows with the corpus.  A context stays when its
next-token distribution diverges enough from that of its longest proper suffix:
the divergence times the context's count must exceed half the logarithm of the
corpus size for each next token it stores (the Bayesian information criterion).
Suffixes of a context that stays, stay too.

A context gives its stored next tokens a discounted share and hands the rest to its
suffix, so every distribution sums to one down to the root.  A token is scored in
the longest context of the tree that ends just before it.  Since the suffixes of a
context of the tree are in it too, the logarithm of that share is a sum: the root's,
``rest`` for each context of the tree that ends before the token, and ``gain`` for each stored
sequence that ends with it.  So a text is scored by adding up weights of its sequences.

The tree is counted, built and kept in tables; no part of it grows on the driver.  The
weights of the ``HEAD`` most frequent sequences are broadcast.  A bitmap of fixed size tells
which other sequences may have a weight; only those meet the rest of the tree in a shuffle.  The
scores do not depend on ``HEAD``.  Sequences are named by 64-bit hashes of their words;
the base score and the known words are not, they are counted by the words themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import materialize, tidy

P_MIN = 1e-6                   # words of at least this share of the tokens are broadcast with their numbers
ROOT_SHARE = 0.01              # least count of a sequence in the tree, as a share of the root of all tokens
LEAST = 2                      # and at least this
HEAD = 1 << 20                 # sequences whose weights are broadcast
MAP_BITS = 1 << 27             # of the bitmaps that tell which sequences may be in a table; a power of two from 2 ** 15
DEPTH = 2                      # words of the longest context
DISCOUNT = 0.5                 # taken from each stored count
FLUSH = 300_000                # distinct words that a task counts before it sends them on
BLOCK = 1 << 19                # tokens looked up at a time
TEXT_BLOCK = 1 << 22           # bytes of text split into words at a time
END = b"\n"                    # no word holds white space
END_ID = 0                     # its number; a text begins after an end

ODD = np.uint64(0x9E3779B97F4A7C15)        # fixed values: multipliers that mix 64-bit numbers
MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def training(id_col: str, remainder: int = 1, folds: int = 5) -> Column:
    """Rows to learn from; a null id is one."""
    return ~F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == remainder, F.lit(False))


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text between ASCII white space, A-Z lower-cased."""
    return raw.lower().split()


def blocks(batches: Iterator[pa.RecordBatch], lengths: Callable[[pa.RecordBatch], pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """Whole texts, cut so that the ``lengths`` of a block add up to about ``most`` beyond its first text's."""
    for batch in batches:
        ends = np.cumsum(lengths(batch).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def n_ids(batch: pa.RecordBatch) -> pa.Array:
    return pc.list_value_length(batch.column("ids"))


# --- words ----------------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the column ``raw``: every word and, once a row, the end.  Combined in the tasks that read the text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
            n.clear()
            tidy()
            return out

        for batch in batches:
            for raw in batch.column(0):
                n.update(tokens(raw.as_py()))
                n[END] += 1
                if len(n) >= FLUSH:
                    yield flush()
        yield flush()

    return docs.select("raw").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_code(word: bytes) -> int:
    """A negative 64-bit number for a word."""
    return xxhash.xxh64_intdigest(word) % 2 ** 63 - 2 ** 63


def coded(docs: DataFrame, kind: str, words: list[bytes]) -> DataFrame:
    """(row, id, train, n_tokens, ids, rare): the tokens as places in ``words``, or as codes, and then in ``rare`` with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    struct = pa.struct([("word", pa.binary()), ("times", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        for batch in blocks(batches, lambda b: pc.binary_length(b.column("raw")), TEXT_BLOCK):
            ids, others, sizes, n_others = [], [], [], []
            for raw in batch.column("raw"):
                here = tokens(raw.as_py())
                known = np.fromiter(map(number.get, here, repeat(-1)), np.int64, len(here))
                unnumbered = np.flatnonzero(known < 0).tolist()
                rare = Counter(here[i] for i in unnumbered)
                code_of = {w: word_code(w) for w in rare}
                known[unnumbered] = [code_of[here[i]] for i in unnumbered]
                ids += [known, np.array([END_ID], np.int64)]
                others += rare.items()
                sizes.append(len(here) + 1)
                n_others.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in others], pa.binary()), pa.array([n for _, n in others], pa.int64())],
                                               fields=list(struct))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "train")), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(_offsets(sizes), pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(_offsets(n_others), pairs)],
                names=["row", "id", "train", "n_tokens", "ids", "rare"])
            tidy()

    schema = f"row long, id {kind}, train boolean, n_tokens long, ids array<long>, rare array<struct<word: binary, times: long>>"
    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "train", "raw").mapInArrow(code, schema)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())


# --- sequences ------------------------------------------------------------------------------------

def joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Name of the sequence of a context and the token after it."""
    x = context.view(np.uint64) * ODD + token.view(np.uint64)
    for shift, by in zip((30, 27), MIXERS):
        x = (x ^ (x >> np.uint64(shift))) * by
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def sequences(ids: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """([name of the sequence of 1, 2, ... ``depth`` + 1 tokens that ends at each], [whether there is one]), after a leading end.

    A token's name is its place among the numbered words, or its code.  A sequence may
    begin and end with an end, but not reach over one.
    """
    flat = np.r_[END_ID, ids]
    after_end = np.r_[True, flat[:-1] == END_ID]
    names, there = [flat], [np.ones(len(flat), bool)]
    for length in range(1, depth + 1):
        on = np.r_[False, there[-1][:-1]]
        there.append(on & ~after_end if length > 1 else on)
        names.append(joined(before(names[-1]), flat))
    return names, there


def before(names: np.ndarray) -> np.ndarray:
    """For every token the sequence that ends before it."""
    return np.r_[names[:1], names[:-1]]


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, modulo ``MAP_BITS``, as bytes; put together by Spark."""
    bit = F.pmod("key", F.lit(MAP_BITS)) + 1
    parts = (keys.groupBy(F.bitmap_bucket_number(bit).alias("at"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow())
    out = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for at, bits in zip(parts.column("at").to_pylist(), parts.column("bits").to_pylist()):
        out[at - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def marked(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = names & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def sequence_counts(texts: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """(context, token, n) of the sequences of ``length`` + 1 tokens; of those that ``bits`` does not mark without their first or last not all."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, n_ids, BLOCK):
            names, there = sequences(batch.column("ids").flatten().to_numpy(), length)
            good = marked(names[length - 1], shared.value)
            on = np.flatnonzero(there[length] & good & np.r_[False, good[:-1]])
            _, first, n = np.unique(names[length][on], return_index=True, return_counts=True)
            at = on[first]
            yield pa.RecordBatch.from_arrays([pa.array(names[length - 1][at - 1]), pa.array(names[0][at]), pa.array(n.astype(np.int64))],
                                             names=["context", "token", "n"])
            del names, there, good, on, first, n, at
            tidy()

    return (texts.select("ids").mapInArrow(count, "context long, token long, n long")
            .groupBy("context", "token").agg(F.sum("n").alias("n")))


# --- tree -----------------------------------------------------------------------------------------

def coded_words(words: DataFrame) -> DataFrame:
    """(key, n) of words without a number."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.array([word_code(w) for w in batch.column("word").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("n")], names=["key", "n"])

    return words.select("word", "n").mapInArrow(add, "key long, n long")


def named(found: DataFrame) -> DataFrame:
    """(key, context, suffix, n, size) of sequences, from ``within``, the context without its first token (null: it has one only)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, token = (batch.column(c).to_numpy() for c in ("context", "token"))
            single = batch.column("within").is_null().to_numpy(zero_copy_only=False)
            within = batch.column("within").fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(joined(context, token)), batch.column("context"),
                                              pa.array(np.where(single, token, joined(within, token))), batch.column("n"), batch.column("size")],
                                             names=["key", "context", "suffix", "n", "size"])

    return found.select("context", "token", "within", "n", "size").mapInArrow(add, "key long, context long, suffix long, n long, size long")


def with_shares(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """(key, context, suffix, n, size, below, left, share, total_gain, stored) of sequences.

    ``below`` is the last token's share in the context's suffix, ``left`` what the context hands to that,
    ``total_gain`` what the context's distribution is better than its suffix's, over its occurrences.
    """
    sized = found.join(shorter.select(F.col("key").alias("context"), F.col("suffix").alias("within"), F.col("n").alias("size")), "context")
    rows = materialize(named(sized).join(shorter.select(F.col("key").alias("suffix"), F.col("share").alias("below")), "suffix"), "tree-sequences")
    left = 1 - (F.sum("n") - DISCOUNT * F.count("*")) / F.first("size")
    rows = rows.join(rows.groupBy("context").agg(left.alias("left"), F.count("*").alias("stored"), F.sum("n").alias("seen")), "context")
    rows = rows.withColumn("share", (F.col("n") - DISCOUNT) / F.col("size") + F.col("left") * F.col("below"))
    gain = (F.sum(F.col("n") * F.log(F.col("share") / F.col("below")))
            + F.first((F.col("size") - F.col("seen")) * F.log("left")))
    return rows.join(rows.groupBy("context").agg(gain.alias("total_gain")), "context").drop("seen")


def weights(texts: DataFrame, words: DataFrame, total: int, distinct: int, at_least: int, depth: int) -> DataFrame:
    """(key, n, gain, rest): what a sequence adds to a score that ends with it, and to that of the token after it."""
    root = (F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))
    shorter = materialize(words.where((F.col("n") >= at_least) | (F.col("key") == END_ID))
                          .select("key", F.lit(None).cast("long").alias("suffix"), "n", root.alias("share")), "tree-words")
    levels = []
    for length in range(1, depth + 1):
        found = sequence_counts(texts, bitmap(shorter), length).where(F.col("n") >= at_least)
        shorter = materialize(with_shares(found, shorter), "tree-shares")
        levels.append(shorter)

    # the contexts that stay, longest first; a level's contexts are sequences of the level above
    out, forced = [], None
    for length in reversed(range(1, depth + 1)):
        level = levels[length - 1]
        stays = level.where(F.col("total_gain") > 0.5 * F.col("stored") * math.log(max(total, 2))).select("context").distinct()
        if forced is not None:
            stays = stays.union(forced).distinct()
        stays = materialize(stays, "tree-contexts")
        kept = level.join(stays, "context")
        rest = F.log10("left")
        out.append(kept.select("key", "n", (F.log10(F.col("share") / F.col("below")) - rest).alias("gain"), F.lit(0.0).alias("rest")))
        out.append(kept.groupBy(F.col("context").alias("key")).agg(F.first("size").alias("n"), F.lit(0.0).alias("gain"), F.first(rest).alias("rest")))
        if length > 1:
            forced = levels[length - 2].join(stays.select(F.col("context").alias("key")), "key").select(F.col("suffix").alias("context"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    return materialize(every.groupBy("key").agg(F.max("n").alias("n"), F.sum("gain").alias("gain"), F.sum("rest").alias("rest")), "tree-weights")


def token_scores(names: list[np.ndarray], there: list[np.ndarray], keys: np.ndarray, gain: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What the sequences in the sorted ``keys`` add to the root's log10 share of every token."""
    out = np.zeros(len(names[0]))
    if not len(keys):
        return out
    places = [np.minimum(np.searchsorted(keys, x), len(keys) - 1) for x in names]
    found = [keys[at] == x for at, x in zip(places, names)]
    for length in range(1, len(names)):
        on = there[length]
        out += np.where(on & found[length], gain[places[length]], 0)
        out[1:] += np.where(on[1:] & found[length - 1][:-1], rest[places[length - 1][:-1]], 0)
    return out


def unresolved(names: list[np.ndarray], there: list[np.ndarray], keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, key, is context) of the sequences that ``bits`` marks and ``keys`` does not hold, in the order of the tokens."""
    at, key, context = [], [], []
    may = [marked(x, bits) & ~np.isin(x, keys) for x in names]
    for length in range(1, len(names)):
        for spots, of in ((np.flatnonzero(there[length] & may[length]), names[length]),
                          (np.flatnonzero(there[length] & np.r_[False, may[length - 1][:-1]]), before(names[length - 1]))):
            at.append(spots)
            key.append(of[spots])
            context.append(np.full(len(spots), of is not names[length]))
    order = np.argsort(np.concatenate(at), kind="stable")
    return tuple(np.concatenate(x)[order] for x in (at, key, context))


def least(total: int, root_share: float = ROOT_SHARE) -> int:
    return max(LEAST, math.ceil(root_share * math.sqrt(total)))


def score(df: DataFrame, id_col: str, text_col: str, train: Column, root_share: float = ROOT_SHARE, depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    The rows where ``train`` holds are learned from.  ``base_score`` is the log10
    probability of the tokens (words and one end) one by one, ``score`` that of the
    suffix tree.  Null and empty texts are an end alone.  Rows that repeat an id or a
    text count and are scored each; null ids too.  Without rows to learn from every
    token is unknown and has the probability 1.  Further columns are not read.

    The text is read twice; its tokens are written once as numbers.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"),
                     F.coalesce(train, F.lit(False)).alias("train"))
    counts = materialize(word_counts(docs.where("train")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    numbered = max(LEAST, math.ceil(P_MIN * total))
    end = F.col("word") == F.lit(END)
    frequent = counts.where((F.col("n") >= numbered) | end).orderBy(~end, F.desc("n"), "word").toArrow()
    words, n_words = frequent.column("word").to_pylist() or [END], frequent.column("n").to_numpy()
    n_words = n_words if len(n_words) else np.zeros(1, np.int64)
    logs = np.log10((n_words + 0.5) / (total + 0.5 * (distinct + 1)))

    texts = materialize(coded(docs, df.schema[id_col].dataType.simpleString(), words), "tokens")
    at_least = least(total, root_share)
    in_numbers = spark.createDataFrame(pa.table({"key": np.arange(len(n_words)), "n": n_words}))
    others = counts.where((F.col("n") < numbered) & (F.col("n") >= at_least) & ~end)
    tree = weights(texts.where("train"), in_numbers.union(coded_words(others)), total, distinct, at_least, depth)
    top = tree.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    tail = None
    if top.num_rows == HEAD:
        last_n, last_key = (top.column(c)[-1].as_py() for c in ("n", "key"))
        tail = tree.where((F.col("n") < last_n) | ((F.col("n") == last_n) & (F.col("key") > last_key)))
    order = np.argsort(top.column("key").to_numpy())
    head = tuple(top.column(c).to_numpy()[order] for c in ("key", "gain", "rest"))
    shared = spark.sparkContext.broadcast((logs, n_words > 0, head, None if tail is None else bitmap(tail)))
    spot = pa.struct([("key", pa.int64()), ("context", pa.bool_())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, seen, head, bits = shared.value
        for batch in blocks(batches, n_ids, BLOCK):
            ids = batch.column("ids").flatten().to_numpy()
            sizes = batch.column("n_tokens").to_numpy()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            numbers = np.maximum(ids, 0)
            names, there = sequences(ids, depth)
            more = token_scores(names, there, *head)[1:]
            parts = [np.add.reduceat(x, starts) for x in (((ids >= 0) & seen[numbers]).astype(np.int64), np.where(ids >= 0, logs[numbers], 0.0), more)]
            at, key, context = unresolved(names, there, head[0], bits) if bits is not None else (np.zeros(0, np.int64),) * 3
            spots = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(context.astype(bool))], fields=list(spot))
            per_text = np.bincount(np.searchsorted(starts, at - 1, side="right") - 1, minlength=len(starts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "train", "n_tokens")), *map(pa.array, parts), pa.ListArray.from_arrays(_offsets(per_text), spots)],
                names=["row", "id", "train", "n_tokens", "known", "base", "tree", "spots"])
            tidy()

    kind = texts.schema["id"].dataType.simpleString()
    scored = (texts.select("row", "id", "train", "n_tokens", "ids")
              .mapInArrow(add_up, f"row long, id {kind}, train boolean, n_tokens long, known long, base double, tree double, "
                                  "spots array<struct<key: bigint, context: boolean>>"))
    share = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (distinct + 1))
    adds = [texts.select("row", F.inline("rare")).join(counts.where(F.col("n") < numbered), "word", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
                                F.sum(F.col("times") * F.log10(share)).alias("rare_score"))]
    if tail is None:
        scored = scored.drop("spots").withColumn("tail_score", F.lit(0.0))
    else:
        scored = materialize(scored, "scored")
        adds.append(scored.select("row", F.inline("spots")).join(tail.drop("n"), "key")
                    .groupBy("row").agg(F.sum(F.when(F.col("context"), F.col("rest")).otherwise(F.col("gain"))).alias("tail_score")))
    for add in adds:
        scored = scored.join(add, "row", "left")
    base = F.col("base") + F.coalesce("rare_score", F.lit(0.0))
    return scored.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("tree") + F.coalesce("tail_score", F.lit(0.0))).alias("score"))
