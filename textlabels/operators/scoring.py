"""Training and scoring of the relational log-odds model, long-text labelling, plug-in models.

The model is a table.  Over the *distinct* tokens of a document or chunk:

    w(token, label) = ln((c1 + 1) / (n1 + 2)) - ln((c0 + 1) / (n0 + 2))
    b(label)        = ln((n1 + 1) / (n0 + 1))
    p(label)        = sigmoid(b + sum(w) / number of distinct tokens)

c1/c0 count positive/negative training documents that hold the token, n1/n0
positive/negative training documents.  Unknown tokens weigh 0 but count in the
denominator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlabels.functions.columns import argmax, explode_rows, label_array, passes, sigmoid, tokens
from textlabels.functions.constants import BROADCAST_BYTES, CHUNK_OVERLAP, CHUNK_SIZE, LABEL_THRESHOLD, NEUTRAL, ROW_BYTES
from textlabels.operators.labels import over_threshold
from textlabels.operators.text import chunk_tokens
from textlabels.sources.workspace import materialize

# The filter for the other tokens: bits a token, at most so many in all, bits set by each token.
_FILTER_BITS, _FILTER_MOST, _FILTER_HASHES = 10, 1 << 27, 4
# A token left over in more rows than this (and than one in 10,000 of all) is dealt into shares of that size.
SHARE_ROWS = 1_000_000


@dataclass(frozen=True)
class LogOddsModel:
    """``weights(token, n_docs, w0..wk)`` and the one-row ``bias(b0..bk)``, k in label order.

    ``n_tokens`` is the number of weight rows, known once the model is written.
    """

    labels: tuple[str, ...]
    weights: DataFrame
    bias: DataFrame
    n_tokens: int | None = None

    def materialize(self) -> LogOddsModel:
        """Write both tables once, so that scoring does not repeat the training."""
        if self.n_tokens is not None:
            return self
        weights = materialize(self.weights, "weights")
        return LogOddsModel(self.labels, weights, materialize(self.bias, "bias"), weights.count())

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.weights.write.mode(mode).parquet(f"{path}/weights")
        self.bias.write.mode(mode).parquet(f"{path}/bias")

    @staticmethod
    def load(spark: SparkSession, path: str, labels: Sequence[str]) -> LogOddsModel:
        weights = spark.read.parquet(f"{path}/weights")
        return LogOddsModel(tuple(labels), weights, spark.read.parquet(f"{path}/bias"), weights.count())

    def long_weights(self) -> DataFrame:
        """(token, label, w)."""
        return self.weights.select("token", F.explode(F.array(*[
            F.struct(F.lit(x).alias("label"), F.col(f"w{k}").alias("w")) for k, x in enumerate(self.labels)])).alias("r")
            ).select("token", "r.*")

    def long_bias(self) -> DataFrame:
        """(label, b)."""
        return self.bias.select(F.explode(F.array(*[
            F.struct(F.lit(x).alias("label"), F.col(f"b{k}").alias("b")) for k, x in enumerate(self.labels)])).alias("r")
            ).select("r.*")


def logodds_fit(df: DataFrame, text: str, targets: Sequence[str | Column], labels: Sequence[str],
                weight: str | None = None) -> LogOddsModel:
    """Fit on rows with a text column and one 0/1 target per label.

    One pass over the tokens for all labels; counts combine map-side, so a
    token that every document holds is one row per task in the shuffle.
    """
    y = [F.col(t) if isinstance(t, str) else t for t in targets]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.array_distinct(tokens(text)).alias("bag"), w.alias("wt"),
                     *[(v.cast("double") * w).alias(f"y{k}") for k, v in enumerate(y)])
    k_all = range(len(labels))
    sizes = rows.agg(F.struct(F.sum("wt").alias("n"), *[F.sum(f"y{k}").alias(f"n{k}") for k in k_all]).alias("s"))
    n = sizes.scalar()
    counts = (explode_rows(rows, ["wt", *[f"y{k}" for k in k_all]], F.col("bag"), "token")
                  .groupBy("token")
                  .agg(F.sum("wt").alias("n_docs"), *[F.sum(f"y{k}").alias(f"c{k}") for k in k_all])
                  .withColumn("n", n))

    def log_odds(k: int) -> Column:
        c1, n1 = F.col(f"c{k}"), F.col(f"n.n{k}")
        c0, n0 = F.col("n_docs") - c1, F.col("n.n") - n1
        return (F.ln((c1 + 1) / (n1 + 2)) - F.ln((c0 + 1) / (n0 + 2))).alias(f"w{k}")

    weights = counts.select("token", "n_docs", *[log_odds(k) for k in k_all])
    bias = sizes.select(*[
        F.ln((F.col(f"s.n{k}") + 1) / (F.col("s.n") - F.col(f"s.n{k}") + 1)).alias(f"b{k}") for k in k_all])
    return LogOddsModel(tuple(labels), weights, bias)


def _split_weights(model: LogOddsModel, budget: int) -> tuple[DataFrame, DataFrame, int]:
    """The weights of the most frequent tokens, at most ``budget`` measured bytes, the others, and how many others there are.

    The cut lies between two powers of two of ``n_docs``, read off a table of at
    most 64 rows: nothing is sorted or limited.
    """
    size = F.octet_length("token") + F.lit(ROW_BYTES + 8 * len(model.labels))
    power = F.floor(F.log2(F.greatest(F.col("n_docs"), F.lit(1.0)))).cast("int")
    sizes = (model.weights.groupBy(power.alias("power")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
             .orderBy(F.desc("power")).collect())
    cut, used, n_others = 1 << 62, 0, 0
    for row in sizes:
        used += row["bytes"]
        if used > budget:
            n_others += row["n"]
        else:
            cut = row["power"]
    frequent = power >= F.lit(cut if cut < 64 else 64)
    names = [f"w{k}" for k in range(len(model.labels))]
    return (model.weights.where(frequent).select("token", *names), model.weights.where(~frequent).select("token", *names), n_others)


def _filter_places(token: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), token), F.lit(bits)) for i in range(_FILTER_HASHES)]


def membership_filter(tokens_: DataFrame, token: str, n: int) -> Column:
    """A condition on the column ``token``: false only for tokens that ``tokens_`` does not hold (a Bloom filter).

    The filter is one array of words of 64 bits, at most ``_FILTER_MOST`` bits
    (16 MB) however many tokens there are; a fuller one lets more strangers pass.
    """
    bits = min(_FILTER_MOST, max(64, 1 << (_FILTER_BITS * max(n, 1) - 1).bit_length()))
    place = tokens_.select(F.explode(F.array(*_filter_places(token, bits))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    words = place.groupBy((F.col("place") / 64).cast("long").alias("id")).agg(F.bit_or(one).alias("word"))
    every = tokens_.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    packed = materialize(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda s: s["word"]).alias("words")), "filter")
    words_ = packed.scalar()

    def is_set(at: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
        return F.get(words_, (at / 64).cast("int")).bitwiseAND(mask) != 0

    return reduce(and_, [is_set(at) for at in _filter_places(token, bits)])


def _partial_scores(bags: DataFrame, keys: Sequence[str], frequent: DataFrame, names: Sequence[str], known: Column | None) -> DataFrame:
    """``keys, n`` and the sums of the broadcast weights, a row for each bag.

    With ``known`` also ``_rest``, empty there, and a row of its own for every other
    token for which ``known`` holds: weights 0 and the token in ``_rest``.  Tokens are not
    gathered by bag: that would sort, and spill, every token of the texts.
    """
    size = F.coalesce(F.size("bag"), F.lit(0)).alias("n")
    tokens_of = bags.select(*keys, size, F.explode_outer("bag").alias("token"))
    sums = (tokens_of.join(F.broadcast(frequent), "token", "left").groupBy(*keys, "n").agg(*[F.sum(c).alias(c) for c in names])
            .select(*keys, "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]))
    if known is None:
        return sums
    rest = explode_rows(bags, [*keys, size], F.col("bag"), "token").where(known).join(F.broadcast(frequent.select("token")), "token", "left_anti")
    return (sums.withColumn("_rest", F.array().cast("array<string>"))
            .unionByName(rest.select(*keys, "n", *[F.lit(0.0).alias(c) for c in names], F.array("token").alias("_rest"))))


def _rest_sums(partial: DataFrame, keys: Sequence[str], others: DataFrame, names: Sequence[str]) -> DataFrame:
    """``keys, n`` and the weights that the tokens in ``_rest`` add.

    A token that many rows hold is dealt into shares, and its weights repeated
    for each.  At most 10,000 tokens can be that frequent.
    """
    rest = partial.select(*keys, "n", F.explode("_rest").alias("token"))
    counts = rest.groupBy("token").agg(F.count("*").alias("rows"))
    least = counts.agg(F.greatest(F.lit(SHARE_ROWS), F.coalesce(F.sum("rows"), F.lit(0)) / 10_000)).first()[0]
    shares = counts.where(F.col("rows") > least).select("token", F.ceil(F.col("rows") / SHARE_ROWS).cast("int").alias("_shares"))
    if shares.isEmpty():
        return rest.join(others, "token").select(*keys, "n", *names)
    shares = F.broadcast(materialize(shares, "shares"))         # at most 10,000 rows
    dealt = (rest.join(shares, "token", "left")
             .withColumn("_share", F.pmod(F.xxhash64(*keys), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares"))
    spread = (others.join(shares, "token", "left")
              .withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares"))
    return dealt.join(spread, ["token", "_share"]).select(*keys, "n", *names)


def _score_bags(bags: DataFrame, keys: Sequence[str], model: LogOddsModel,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keys, bag`` (distinct tokens, null or empty for a blank text) -> ``keys, n, p0..pk``; ``keys`` tell the rows apart.

    The weights of the most frequent tokens, as many as fit in
    ``broadcast_bytes``, are broadcast and summed where the text is read.  If that
    is all of them, nothing else is done.  Otherwise the bags are written once with a number, so
    that the text is read once, and a filter tells which tokens the model may know
    besides; those meet the other weights in a shuffle, each with its bag's number.  Tokens that the model does not
    know do not travel.  A bag without tokens has ``n`` = 0 and the probabilities of
    the bias.
    """
    if model.n_tokens is None:
        raise ValueError("score with a written model: call materialize() on it first")
    k_all = range(len(model.labels))
    names = [f"w{k}" for k in k_all]
    frequent, others, n_others = _split_weights(model, broadcast_bytes)
    if n_others:
        bags = materialize(bags.withColumn("_bag", F.monotonically_increasing_id()), "bags")
        partial = materialize(_partial_scores(bags, ["_bag"], frequent, names, membership_filter(others, "token", n_others)), "partial-scores")
        sums = (partial.where(F.size("_rest") == 0).select("_bag", "n", *names).unionByName(_rest_sums(partial, ["_bag"], others, names))
                .groupBy("_bag", "n").agg(*[F.sum(c).alias(c) for c in names]).join(bags.select("_bag", *keys), "_bag"))
    else:
        sums = _partial_scores(bags, keys, frequent, names, None)
    bias = model.bias.select(F.struct("*").alias("b")).scalar()
    return sums.withColumn("b", bias).select(*keys, "n", *[
        sigmoid(F.col(f"b.b{k}") + F.when(F.col("n") > 0, F.col(f"w{k}") / F.nullif(F.col("n"), F.lit(0))).otherwise(F.lit(0.0)))
        .alias(f"p{k}") for k in k_all])


def linear_score(df: DataFrame, key: str, text: str, model: LogOddsModel,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key, probs`` for every row, also for rows that share a key: whole texts scored as one bag; without tokens the bias decides."""
    bags = df.select(F.monotonically_increasing_id().alias("_row"), key, F.array_distinct(tokens(text)).alias("bag"))
    scored = _score_bags(bags, ["_row", key], model, broadcast_bytes)
    return scored.select(key, F.array(*[F.col(f"p{k}") for k in range(len(model.labels))]).alias("probs"))


def _score_chunks(df: DataFrame, key: str, text: str, model: LogOddsModel, size: int, overlap: int,
                  broadcast_bytes: int) -> DataFrame:
    """``key, _digest, probs, chunks`` for every row: unweighted mean over the chunks of a text; both null for a blank text."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), key, F.xxhash64(text).alias("_digest"), text)
    kept = ["_row", key, "_digest"]
    bags = chunk_tokens(rows, text, size, overlap, blank=True).select(*kept, "chunk", F.array_distinct("tokens").alias("bag"))
    k_all = range(len(model.labels))
    per_chunk = _score_bags(bags, [*kept, "chunk"], model, broadcast_bytes)
    real = F.col("n") > 0
    means = per_chunk.groupBy(*kept).agg(F.count_if(real).alias("chunks"),
                                         *[F.avg(F.when(real, F.col(f"p{k}"))).alias(f"p{k}") for k in k_all])
    some = F.col("chunks") > 0
    return means.select(key, "_digest", F.when(some, F.array(*[F.col(f"p{k}") for k in k_all])).alias("probs"),
                        F.when(some, F.col("chunks")).alias("chunks"))


def _decide(joined: DataFrame, labels: Sequence[str], threshold: float, blank_label: str) -> DataFrame:
    """probs/chunks (null for blank texts) -> the prediction record columns."""
    blank = F.col("probs").isNull()
    zeros = F.array(*[F.lit(0.0) for _ in labels])
    primary = F.when(blank, F.lit(blank_label)).otherwise(F.get(label_array(labels), argmax("probs")))
    hit = over_threshold("probs", labels, threshold, inclusive=True)
    return (joined.withColumn("primary", primary)
                  .withColumn("all_labels", F.when(blank | (F.size(hit) == 0), F.array("primary")).otherwise(hit))
                  .withColumn("num_chunks", F.when(F.col("chunks") > 1, F.col("chunks")))
                  .withColumn("probs", F.coalesce("probs", zeros))
                  .drop("chunks"))


def score_long_text(df: DataFrame, key: str, text: str, model: LogOddsModel, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, threshold: float = LABEL_THRESHOLD, blank_label: str = NEUTRAL,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One prediction record per row, also for rows that share a key: ``key, probs, primary, all_labels, num_chunks``.

    Texts over ``size`` tokens are scored chunk by chunk and averaged;
    ``num_chunks`` is set for those only.  Blank texts have probabilities 0 and
    ``blank_label``.
    """
    scored = _score_chunks(df, key, text, model, size, overlap, broadcast_bytes).drop("_digest")
    return _decide(scored, model.labels, threshold, blank_label)


def label_table(df: DataFrame, key: str, text: str, model: LogOddsModel, size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, threshold: float = LABEL_THRESHOLD, blank_label: str = NEUTRAL,
                broadcast_bytes: int = BROADCAST_BYTES, buckets: int | None = None) -> DataFrame:
    """Original rows + ``primary_emotion``, ``all_emotions``, ``prob_<label>`` and 0/1 ``<label>``.

    The scores come back by key.  Rows may be repeated, but a null key, or one that
    stands with two texts, is an error.  If ``df`` is a table bucketed by ``key`` into
    ``buckets`` (``sources.tables.write_bucketed``), only the scores are shuffled; the
    text stays where it is.

    The 0/1 columns use the raw threshold, so a row whose label is only the arg-max,
    or a blank row, has them all 0.
    """
    def refuse(what: str, kind: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{key} {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(kind)

    whole = df.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(refuse("is null", df.schema[key].dataType.simpleString())))
    scored = _score_chunks(whole, key, text, model, size, overlap, broadcast_bytes)
    if buckets:
        scored = scored.repartition(buckets, key)
    one_text = F.min("_digest") == F.max("_digest")
    by_key = scored.groupBy(key).agg(F.when(one_text, F.any_value("probs")).otherwise(refuse("has several texts", "array<double>")).alias("probs"),
                                     F.any_value("chunks").alias("chunks"))
    done = _decide(df.join(by_key, key, "left"), model.labels, threshold, blank_label)
    probs = [F.get(F.col("probs"), F.lit(k)) for k in range(len(model.labels))]
    return done.select(
        *df.columns, F.col("primary").alias("primary_emotion"),
        F.array_join("all_labels", ",").alias("all_emotions"),
        *[p.alias(f"prob_{x}") for p, x in zip(probs, model.labels)],
        *[passes(p, threshold, True).cast("int").alias(x) for p, x in zip(probs, model.labels)])


def batch_score(df: DataFrame, make_predict_fn: Callable, cols: Sequence[str], batch_size: int = 32,
                return_type: T.DataType = T.ArrayType(T.DoubleType()), out: str = "probs", **options) -> DataFrame:
    """Score with any vectorised model.

    ``make_predict_fn()`` loads the model once per Python worker and returns a
    function from numpy batches to predictions; rows travel in Arrow batches.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size, **options)
    return df.withColumn(out, udf(*[F.col(c) for c in cols]))


def adapt_domain(source: DataFrame, target: DataFrame, weight: float, out: str = "weight") -> DataFrame:
    """Training rows for moving a model to a new corpus: target rows weigh ``weight``, source rows 1.

    Fit the result with ``logodds_fit(..., weight=out)`` or ``train_multilabel(..., weight=out)``.
    """
    return source.withColumn(out, F.lit(1.0)).unionByName(target.withColumn(out, F.lit(float(weight))))
