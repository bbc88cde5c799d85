"""Queries of the models: baselines, log-odds model, plug-in, spark.ml training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F


from textlabels.functions.constants import EVAL_THRESHOLD, LABELS28
from textlabels.operators import baselines as B
from textlabels.operators import comparison as C
from textlabels.operators import descent as D
from textlabels.operators import metrics as E
from textlabels.operators import scoring as M
from textlabels.operators import training as T
from textlabels.operators.labels import threshold_binary
from textlabels.operators.splitting import split_hash, split_three
from textlabels.plans import inputs as I
from textlabels.plans.inputs import BINARY
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import LABEL_LIST, h, sql, toks
from textlabels.sources import tables as S
from textlabels.sources.workspace import new_path

_PIVOT = "max(prob) FILTER (label = 'quality') AS p_quality, max(prob) FILTER (label = 'toxic') AS p_toxic"


def _pair(probs: str = "probs"):
    return [F.get(F.col(probs), F.lit(k)).alias(f"p_{x}") for k, x in enumerate(BINARY)]


def fit_binary(spark, sf):
    """The log-odds model of the two real labels, from the training split."""
    train = I.labelled_split(spark, sf).where(F.col("split") == "train")
    return M.logodds_fit(train, "text", BINARY, BINARY).materialize()


# --- baselines --------------------------------------------------------------

_MAJORITY = "SELECT Emotion AS label, count(*) AS n FROM utterances WHERE split = 'train' GROUP BY 1 ORDER BY n DESC, label LIMIT 1"


@query("majority_fit", sql("utterances", f"""
    SELECT 'utterances' AS data, label, n FROM ({_MAJORITY})
    UNION ALL SELECT 'documents', label, n FROM (
        SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, label LIMIT 1)"""))
def _(spark, sf):
    train = I.utterances(spark, sf).where(F.col("split") == "train")
    both = [("utterances", B.majority_fit(train, "Emotion")), ("documents", B.majority_fit(I.documents(spark, sf), "lang"))]
    a, b = (df.select(F.lit(name).alias("data"), "label", "n") for name, df in both)
    return a.unionByName(b)


@query("majority_predict", sql("utterances", f"""
    SELECT utt_id, split, Emotion AS gold, (SELECT label FROM ({_MAJORITY})) AS pred FROM utterances"""))
def _(spark, sf):
    utt = I.utterances(spark, sf)
    model = B.majority_fit(utt.where(F.col("split") == "train"), "Emotion")
    return B.majority_predict(utt, model).select("utt_id", "split", F.col("Emotion").alias("gold"), "pred")


# --- log-odds model ---------------------------------------------------------

@query("logodds_fit", sql("weights2 bias2", """
    SELECT token, label, round(w, 6) + 0.0 AS weight FROM weights2
    UNION ALL SELECT NULL, label, round(b, 6) + 0.0 FROM bias2"""))
def _(spark, sf):
    model = fit_binary(spark, sf)
    bias = model.long_bias().select(F.lit(None).cast("string").alias("token"), "label", F.col("b").alias("weight"))
    return rounded(model.long_weights().withColumnRenamed("w", "weight").unionByName(bias))


@query("linear_score", sql("scored2", f"""
    SELECT doc_id, round(p_quality, 6) AS p_quality, round(p_toxic, 6) AS p_toxic
    FROM (SELECT doc_id, {_PIVOT} FROM scored2 GROUP BY doc_id)"""))
def _(spark, sf):
    scored = M.linear_score(I.documents(spark, sf), "doc_id", "text", fit_binary(spark, sf))
    return rounded(scored.select("doc_id", *_pair()))


@query("score_long_text", sql("long2 documents_gaps", f"""
    SELECT doc_id, round(coalesce(p_quality, 0), 6) AS p_quality, round(coalesce(p_toxic, 0), 6) AS p_toxic,
           CASE WHEN p_quality IS NULL THEN 'neutral' WHEN p_quality >= p_toxic THEN 'quality' ELSE 'toxic' END AS primary_label,
           CASE WHEN p_quality IS NULL THEN 'neutral' WHEN p_quality >= 0.3 AND p_toxic >= 0.3 THEN 'quality,toxic'
                WHEN p_quality >= 0.3 THEN 'quality' WHEN p_toxic >= 0.3 THEN 'toxic'
                WHEN p_quality >= p_toxic THEN 'quality' ELSE 'toxic' END AS all_labels,
           CASE WHEN chunks > 1 THEN chunks END AS num_chunks
    FROM documents_gaps LEFT JOIN (SELECT doc_id, max(chunks) AS chunks, {_PIVOT} FROM long2 GROUP BY doc_id) USING (doc_id)"""))
def _(spark, sf):
    docs = I.documents_gaps(spark, sf)
    scored = M.score_long_text(docs, "doc_id", "text", fit_binary(spark, sf))
    return rounded(scored.select("doc_id", *_pair(), F.col("primary").alias("primary_label"),
                                 F.array_join("all_labels", ",").alias("all_labels"), "num_chunks"))


_P28 = [f"coalesce(p{j}, 0)" for j in range(28)]


@query("label_table", sql("long28 documents_gaps", f"""
    SELECT doc_id, text,
           CASE WHEN p0 IS NULL THEN 'neutral' ELSE {LABEL_LIST}[list_position(ps, list_max(ps))] END AS primary_emotion,
           CASE WHEN p0 IS NULL THEN 'neutral' ELSE array_to_string(list_transform(
               CASE WHEN list_max(ps) >= 0.3 THEN list_filter(range(1, 29), lambda i: ps[i] >= 0.3)
                    ELSE [list_position(ps, list_max(ps))::bigint] END, lambda i: {LABEL_LIST}[i]), ',') END AS all_emotions,
           {', '.join(f"round(coalesce(p{j}, 0), 6) AS prob_{x}, (coalesce(p{j}, 0) >= 0.3)::int AS {x}"
                      for j, x in enumerate(LABELS28))}
    FROM (SELECT *, [{', '.join(_P28)}] AS ps FROM documents_gaps LEFT JOIN long28 USING (doc_id))"""))
def _(spark, sf):
    gold = split_three(I.gold28(I.documents(spark, sf).select("doc_id", "text")), "doc_id")
    train = gold.where(F.col("split") == "train")
    targets = [F.array_contains("labels", F.lit(j)).cast("int") for j in range(28)]
    model = M.logodds_fit(train, "text", targets, LABELS28).materialize()
    return rounded(M.label_table(I.documents_gaps(spark, sf), "doc_id", "text", model))


@query("label_table_bucketed", sql("long2 documents_gaps", """
    SELECT doc_id, text, round(coalesce(p_quality, 0), 6) AS prob_quality, round(coalesce(p_toxic, 0), 6) AS prob_toxic,
           (coalesce(p_quality, 0) >= 0.3)::int AS quality, (coalesce(p_toxic, 0) >= 0.3)::int AS toxic,
           CASE WHEN p_quality IS NULL THEN 'neutral' WHEN p_quality >= p_toxic THEN 'quality' ELSE 'toxic' END AS primary_emotion,
           CASE WHEN p_quality IS NULL THEN 'neutral' WHEN p_quality >= 0.3 AND p_toxic >= 0.3 THEN 'quality,toxic'
                WHEN p_quality >= 0.3 THEN 'quality' WHEN p_toxic >= 0.3 THEN 'toxic'
                WHEN p_quality >= p_toxic THEN 'quality' ELSE 'toxic' END AS all_emotions
    FROM documents_gaps LEFT JOIN (SELECT doc_id, """ + _PIVOT + """ FROM long2 GROUP BY doc_id) USING (doc_id)"""))
def _(spark, sf):
    """The same on a table bucketed by its key; the weights of rare tokens are left to a shuffle behind the filter."""
    path = new_path(spark, "bucketed")
    name = "documents_" + path.rsplit("-", 1)[-1]
    S.write_bucketed(I.documents_gaps(spark, sf), name, path, ["doc_id"], 16)
    return rounded(M.label_table(spark.table(name), "doc_id", "text", fit_binary(spark, sf), broadcast_bytes=1 << 18, buckets=16))


@query("adapt_domain", sql("labels_split doc_tokens", f"""
    WITH rows AS MATERIALIZED (
        SELECT doc_id, token, quality, toxic, CASE WHEN lang = 'en' THEN 1.0::double ELSE 2.5::double END AS wt
        FROM (SELECT doc_id, lang, unnest(list_distinct({toks('text')})) AS token FROM documents)
        JOIN labels_split USING (doc_id) WHERE split = 'train'),
    docs AS (SELECT DISTINCT doc_id, quality, toxic, wt FROM rows),
    n AS (SELECT sum(wt) AS n, sum(wt * quality) AS nq, sum(wt * toxic) AS nt FROM docs)
    SELECT token, round(ln((cq + 1) / (nq + 2)) - ln((df - cq + 1) / (n - nq + 2)), 6) + 0.0 AS w_quality,
           round(ln((ct + 1) / (nt + 2)) - ln((df - ct + 1) / (n - nt + 2)), 6) + 0.0 AS w_toxic
    FROM (SELECT token, sum(wt) AS df, sum(wt * quality) AS cq, sum(wt * toxic) AS ct FROM rows GROUP BY token) CROSS JOIN n"""))
def _(spark, sf):
    train = I.labelled_split(spark, sf).where(F.col("split") == "train")
    both = M.adapt_domain(train.where(F.col("lang") == "en"), train.where(F.col("lang") != "en"), 2.5)
    model = M.logodds_fit(both, "text", BINARY, BINARY, weight="weight")
    return rounded(model.weights.select("token", *[F.col(f"w{k}").alias(f"w_{x}") for k, x in enumerate(BINARY)]))


@query("adaptation_report", sql("labels_split", f"""
    WITH rows AS MATERIALIZED (
        SELECT doc_id, token, quality, toxic, lang, split
        FROM (SELECT doc_id, lang, unnest(list_distinct({toks('text')})) AS token FROM documents) JOIN labels_split USING (doc_id)),
    models AS (SELECT * FROM (VALUES ('adapted', 2.5::double), ('source', 0.0::double)) AS t(model, other)),
    weighted AS (SELECT model, token, doc_id, quality, toxic, CASE WHEN lang = 'en' THEN 1.0::double ELSE other END AS w
                 FROM rows CROSS JOIN models WHERE split = 'train'),
    n AS (SELECT model, sum(w) AS n, sum(w * quality) AS nq, sum(w * toxic) AS nt
          FROM (SELECT DISTINCT model, doc_id, quality, toxic, w FROM weighted) GROUP BY model),
    weights AS (
        SELECT model, token, ln((cq + 1) / (nq + 2)) - ln((df - cq + 1) / (n - nq + 2)) AS wq,
               ln((ct + 1) / (nt + 2)) - ln((df - ct + 1) / (n - nt + 2)) AS wt
        FROM (SELECT model, token, sum(w) AS df, sum(w * quality) AS cq, sum(w * toxic) AS ct FROM weighted WHERE w > 0 GROUP BY ALL)
        JOIN n USING (model)),
    scored AS (
        SELECT model, doc_id, quality, toxic, max(ln((nq + 1) / (n - nq + 1))) + sum(coalesce(wq, 0)) / count(*) AS zq,
               max(ln((nt + 1) / (n - nt + 1))) + sum(coalesce(wt, 0)) / count(*) AS zt
        FROM (SELECT * FROM rows CROSS JOIN models WHERE split = 'test' AND lang <> 'en') LEFT JOIN weights USING (model, token)
        JOIN n USING (model) GROUP BY model, doc_id, quality, toxic)
    SELECT model, count(*) AS n, round(avg(((zq > 0)::int = quality)::int), 6) AS accuracy_quality,
           round(avg(((zt > 0)::int = toxic)::int), 6) AS accuracy_toxic FROM scored GROUP BY model"""))
def _(spark, sf):
    """The model of the source rows and the adapted one, side by side on held-out rows of the target."""
    data = I.labelled_split(spark, sf)
    train, held_out = data.where(F.col("split") == "train"), data.where((F.col("split") == "test") & (F.col("lang") != "en"))
    source = train.where(F.col("lang") == "en")
    both = M.adapt_domain(source, train.where(F.col("lang") != "en"), 2.5)
    models = {"source": M.logodds_fit(source, "text", BINARY, BINARY),
              "adapted": M.logodds_fit(both, "text", BINARY, BINARY, weight="weight")}
    gold, out = held_out.select("doc_id", *BINARY), None
    for name, model in models.items():
        scored = M.linear_score(held_out, "doc_id", "text", model.materialize()).join(gold, "doc_id")
        right = {x: F.avg(((F.get("probs", F.lit(k)) > EVAL_THRESHOLD).cast("int") == F.col(x)).cast("double")) for k, x in enumerate(BINARY)}
        row = scored.agg(F.lit(name).alias("model"), F.count("*").alias("n"), *[v.alias(f"accuracy_{x}") for x, v in right.items()])
        out = row if out is None else out.unionByName(row)
    return rounded(out)


# --- plug-in model ----------------------------------------------------------

# A 64 x 10 weight matrix given by a rule, so that SQL can repeat it.
def _matrix() -> np.ndarray:
    d, k = np.meshgrid(np.arange(64), np.arange(10), indexing="ij")
    return ((d * 7 + k * 13) % 11 - 5) / 10.0


def make_linear_model():
    """Stands for loading any model: returns batch -> class probabilities."""
    matrix = _matrix()

    def predict(batch: np.ndarray) -> np.ndarray:
        z = batch.astype(np.float64) @ matrix
        return 1.0 / (1.0 + np.exp(-z))

    return predict


@query("batch_score", """
    SELECT vec_id, k::int AS pred_id, round(1 / (1 + exp(-z)), 5) AS top_prob
    FROM (SELECT vec_id, k, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS r
          FROM (SELECT vec_id, k, sum(x::double * ((d * 7 + k * 13) % 11 - 5) / 10.0::double) AS z
                FROM (SELECT vec_id, unnest(range(0, 64)) AS d, unnest(embedding) AS x FROM embeddings)
                CROSS JOIN (SELECT unnest(range(0, 10)) AS k) GROUP BY vec_id, k)) WHERE r = 1""")
def _(spark, sf):
    rows = I.table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = M.batch_score(rows, make_linear_model, ["embedding"], 256, input_tensor_shapes=[[64]])
    top = F.array_max("probs")
    return scored.select("vec_id", (F.array_position("probs", top) - 1).cast("int").alias("pred_id"),
                         F.round(top, 5).alias("top_prob"))


# --- end to end -------------------------------------------------------------

def compare_on_test(spark, sf):
    """Fit on train, score the test texts chunk by chunk, compare with the majority label set.

    documents + labels -> split -> log-odds model -> chunk scores -> threshold
    -> multi-label metrics of both models -> leaderboard.
    """
    data = I.labelled_split(spark, sf)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    model = M.logodds_fit(train, "text", BINARY, BINARY).materialize()

    gold = F.array(*[F.col(x) for x in BINARY])
    scored = M.score_long_text(test.select("doc_id", "text"), "doc_id", "text", model).select("doc_id", "probs")
    learned = threshold_binary(test.select("doc_id", gold.alias("gold_vec")).join(scored, "doc_id"), "probs",
                               EVAL_THRESHOLD).select(F.lit("log_odds").alias("model"), "gold_vec", "pred_vec")

    label_set = F.concat_ws(",", *[F.col(x) for x in BINARY])
    majority = B.majority_fit(train.select(label_set.alias("label_set")), "label_set")
    constant = B.majority_predict(test.select(gold.alias("gold_vec")), majority, out="label_set").select(
        F.lit("majority").alias("model"), "gold_vec", F.split("label_set", ",").cast("array<int>").alias("pred_vec"))

    metrics = E.multilabel_metrics(learned.unionByName(constant), "gold_vec", "pred_vec", ["model"])
    return rounded(C.leaderboard(metrics))


query("compare_on_test", sql("labels_split doc_long2", f"""
    WITH train AS (SELECT quality, toxic, count(*) AS n FROM labels_split WHERE split = 'train' GROUP BY ALL),
    top AS (SELECT quality AS mq, toxic AS mt FROM train ORDER BY n DESC, concat(quality, ',', toxic) LIMIT 1),
    preds AS (
        SELECT 'log_odds' AS model, quality AS gq, toxic AS gt, (p_quality > 0.5)::int AS pq, (p_toxic > 0.5)::int AS pt
        FROM labels_split JOIN (SELECT doc_id, {_PIVOT} FROM doc_long2 GROUP BY doc_id) USING (doc_id) WHERE split = 'test'
        UNION ALL SELECT 'majority', quality, toxic, mq, mt FROM labels_split CROSS JOIN top WHERE split = 'test'),
    sums AS (SELECT model, sum(gq * pq)::double AS tq, sum(gq + pq)::double AS sq, sum(gt * pt)::double AS tt,
                    sum(gt + pt)::double AS st, avg((gq = pq AND gt = pt)::int) AS em FROM preds GROUP BY model),
    final AS (SELECT model, CASE WHEN sq + st = 0 THEN 0 ELSE 2 * (tq + tt) / (sq + st) END AS f1_micro,
                     (CASE WHEN sq = 0 THEN 0 ELSE 2 * tq / sq END + CASE WHEN st = 0 THEN 0 ELSE 2 * tt / st END) / 2 AS f1_macro,
                     em FROM sums)
    SELECT model, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, round(em, 6) AS exact_match,
           row_number() OVER (ORDER BY f1_macro DESC, model)::int AS rank FROM final"""))(compare_on_test)


# --- trained models -----------------------------------------------------------
# Fitted numbers have no SQL form.  The queries return what SQL can state and a wrong
# model misses: the labels of the rows a model was fitted on, or that it is right on
# test rows far more often than the largest class is.

def _fitted(scored):
    """The predictions on training rows, which must be their labels; null on others."""
    return [F.when(F.col("split") == "train", (F.get("probs", F.lit(k)) > EVAL_THRESHOLD).cast("int")).alias(f"fitted_{x}")
            for k, x in enumerate(BINARY)]


_FITTED_SQL = ", ".join(f"CASE WHEN split = 'train' THEN {x} END AS fitted_{x}" for x in BINARY)


def beats_majority(scored, margin: float = 0.2):
    """Adds ``beats_majority``: accuracy of ``pred_id`` on test rows at least the share of the largest class plus ``margin``."""
    test = scored.where(F.col("split") == "test")
    right = test.agg(F.avg((F.col("label") == F.col("pred_id")).cast("double"))).scalar()
    largest = test.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return scored.withColumn("beats_majority", right >= largest + margin)


def train_multilabel_probs(spark, sf):
    data = I.labelled_split(spark, sf)
    model = T.train_multilabel(data.where(F.col("split") == "train"), "text", BINARY, BINARY)
    return model.predict(data).select("doc_id", "split", *BINARY, "probs")


@query("train_multilabel", sql("labels_split", f"""
    SELECT doc_id, split, quality, toxic, {_FITTED_SQL} FROM labels_split JOIN documents USING (doc_id)"""))
def _(spark, sf):
    scored = train_multilabel_probs(spark, sf)
    return scored.select("doc_id", "split", *BINARY, *_fitted(scored))


_PART = f"CASE WHEN {h('{key}', "'42'")} < floor(0.2::double * 4294967296) THEN 'test' ELSE 'train' END AS split"


@query("train_multiclass", f"""
    SELECT vec_id, {_PART.replace('{key}', 'vec_id')},
           CASE WHEN embedding[1] + embedding[2] > 0.1 THEN 0 WHEN embedding[1] > embedding[3] THEN 1 ELSE 2 END::int AS label,
           true AS beats_majority FROM embeddings""")
def _(spark, sf):
    """Classes that the vector decides (the table's own labels have nothing to do with it)."""
    x = [F.get("embedding", F.lit(i)) for i in range(3)]
    label = F.when(x[0] + x[1] > F.lit(0.1), 0).when(x[0] > x[2], 1).otherwise(2)
    rows = split_hash(I.table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label")), "vec_id", {"test": 0.2})
    model = T.train_multiclass(rows.where(F.col("split") == "train"), "embedding", "label", {"epochs": 30, "weight_decay": 0.0})
    return beats_majority(T.predict_multiclass(rows, "embedding", model)).select("vec_id", "split", "label", "beats_majority")


_LANGS = ["de", "en", "es", "fr"]


@query("train_multiclass_text", f"""
    SELECT doc_id, {_PART.replace('{key}', 'doc_id')}, (list_position({_LANGS}, lang) - 1)::int AS label, true AS beats_majority
    FROM documents""")
def _(spark, sf):
    label = (F.array_position(F.array(*map(F.lit, _LANGS)), F.col("lang")) - 1).cast("int")
    rows = split_hash(I.documents(spark, sf).select("doc_id", "text", label.alias("label")), "doc_id", {"test": 0.2})
    model = T.train_multiclass(rows.where(F.col("split") == "train"), "text", "label")
    return beats_majority(T.predict_multiclass(rows, "text", model)).select("doc_id", "split", "label", "beats_majority")


@query("tune", """
    SELECT unnest(range(1, 11))::int AS place, 'COMPLETE' AS state, true AS in_order, true AS reproduced,
           ['elastic_net', 'epochs', 'standardize', 'weight_decay']::varchar AS params""")
def _(spark, sf):
    """Trials, best first; ``in_order``: none is better than the one before it; ``reproduced``: the best parameters give the best value again."""
    data = I.labelled_split(spark, sf)
    train, val = (data.where(F.col("split") == s) for s in ("train", "validation"))
    trials, best = T.tune(train, val, "text", BINARY)
    return tuning_report(trials, T.train_multilabel(train, "text", BINARY, BINARY, best), val)


def tuning_report(trials, model, val):
    scored = model.predict(val).select(F.array(*[F.col(x).cast("int") for x in BINARY]).alias("gold"),
                                       F.transform("probs", lambda p: (p > EVAL_THRESHOLD).cast("int")).alias("pred"))
    again = E.multilabel_metrics(scored, "gold", "pred").select("f1_macro").first()[0]
    w = Window.orderBy(F.desc("value"), "trial")                # one row a trial
    names = F.array_join(F.array_sort(F.map_keys("params")), ", ")
    in_order = F.coalesce(F.col("value") <= F.lag("value").over(w), F.lit(True)) & F.col("value").between(0, 1)
    best = F.max("value").over(Window.partitionBy())
    return T.best_trials(trials).select(F.row_number().over(w).alias("place"), "state", in_order.alias("in_order"),
                                        (F.abs(best - F.lit(again)) < 1e-9).alias("reproduced"),
                                        F.concat(F.lit("["), names, F.lit("]")).alias("params"))


def adapt_domain_probs(spark, sf):
    data = I.labelled_split(spark, sf)
    train = data.where(F.col("split") == "train")
    both = M.adapt_domain(train.where(F.col("lang") == "en"), train.where(F.col("lang") != "en"), 2.5)
    model = T.train_multilabel(both, "text", BINARY, BINARY, weight="weight")
    return model.predict(data).select("doc_id", "lang", "split", *BINARY, "probs")


@query("adapt_domain_trained", sql("labels_split", f"""
    SELECT doc_id, lang, split, quality, toxic, {_FITTED_SQL} FROM labels_split JOIN documents USING (doc_id)"""))
def _(spark, sf):
    scored = adapt_domain_probs(spark, sf)
    return scored.select("doc_id", "lang", "split", *BINARY, *_fitted(scored))


# --- epochs -------------------------------------------------------------------

def _epoch_rows(spark, sf):
    return I.labelled_split(spark, sf).where(F.col("split") != "test")


@query("training_history")
def _(spark, sf):
    """Two runs epoch by epoch, the epochs that beat all before them, and the one kept."""
    rows = D.features(_epoch_rows(spark, sf), "text", BINARY, validation=F.col("split") == "validation")
    runs = {f"decay {decay:g}": D.fit(rows, BINARY, 12, decay) for decay in (1e-2, 1e-4)}
    table = D.history(runs, spark)
    best = C.running_best(table, "run", ["epoch"], "validation_f1").select("run", "epoch", F.lit(True).alias("record"), "chosen")
    last = C.best_epoch(table, "run", ["epoch"], "validation_f1").select("run", F.col("epoch").alias("best_epoch"))
    no = F.lit(False)
    return rounded(table.join(best, ["run", "epoch"], "left").join(last, "run").select(
        "run", "epoch", "train_loss", "validation_f1", F.coalesce("record", no).alias("record"), F.coalesce("chosen", no).alias("chosen"), "best_epoch"))


@query("warm_start_report")
def _(spark, sf):
    """The English model, its move to the other languages, and how right each is on held-out rows of those."""
    data = I.labelled_split(spark, sf)
    learn, other = data.where(F.col("split") == "train"), F.col("lang") != "en"
    source = D.fit(D.features(learn.where(~other), "text", BINARY), BINARY, 15, 1e-4).last
    moved = {f"weight {w:g}": D.warm_start(source, learn.where(other), "text", BINARY, w, epochs=15).last for w in (0.1, 1.0, 10.0)}
    held, out = data.where((F.col("split") != "train") & other), None
    for name, model in {"source": source, **moved}.items():
        right = [F.avg(((F.get("probs", F.lit(k)) > EVAL_THRESHOLD).cast("int") == F.col(x)).cast("double")).alias(f"accuracy_{x}")
                 for k, x in enumerate(BINARY)]
        row = model.predict(held).agg(F.lit(name).alias("model"), F.count("*").alias("n"), *right)
        out = row if out is None else out.unionByName(row)
    return rounded(out)
