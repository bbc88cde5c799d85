"""Queries of the projection and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlabels.functions.constants import COARSE7, DIALOGUE7, LABELS28, TAXONOMY
from textlabels.operators import labels as L
from textlabels.operators import projection as P
from textlabels.plans import inputs as I
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import LABEL_LIST, sql, strip, text_list, words

_COARSE_SQL = {t: f"greatest({', '.join(fine)})" for t, fine in TAXONOMY.items()}
_FLAGS = ", ".join(LABELS28)


# --- projections and filters ------------------------------------------------

@query("strip_prefix", sql("annotations_wide", "SELECT id, text, " + ", ".join(
    f"{_COARSE_SQL[t]} AS {t}" for t in COARSE7) + " FROM annotations_wide"))
def _(spark, sf):
    return P.strip_prefix(L.taxonomy_rollup(I.annotations_wide(spark, sf)), ["text", "id"], "coarse_")


@query("drop_blank_text", sql("documents_gaps", r"""
    SELECT doc_id, text FROM documents_gaps WHERE text IS NOT NULL AND regexp_matches(text, '\S')"""))
def _(spark, sf):
    return P.drop_blank_text(I.documents_gaps(spark, sf), "text")


@query("filter_labels", sql("preds3", f"""
    SELECT model, row_id, gold, pred FROM preds3 WHERE list_contains({text_list(COARSE7)}, gold)"""))
def _(spark, sf):
    return P.filter_labels(I.preds3(spark, sf), "gold", COARSE7)


@query("fill_label", """
    SELECT doc_id, lang, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'neutral') AS emotion,
           'neutral' AS created
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    labels = I.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("emotion"))
    docs = I.documents(spark, sf).select("doc_id", "lang").join(labels, "doc_id", "left")
    return P.fill_label(P.fill_label(docs, "emotion"), "created")


@query("mismatch_filter", sql("preds3", "SELECT model, row_id, gold, pred FROM preds3 WHERE gold <> pred"))
def _(spark, sf):
    return P.mismatch_filter(I.preds3(spark, sf))


@query("preview", "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, sf):
    return P.preview(I.documents(spark, sf), ["doc_id", "lang", "text"], 10, ["doc_id"])


# --- labels -----------------------------------------------------------------

@query("multi_hot_encode", sql("gold28", "SELECT doc_id, " + ", ".join(
    f"list_contains(labels, {j})::int AS {x}" for j, x in enumerate(LABELS28)) + " FROM gold28"))
def _(spark, sf):
    docs = I.gold28(I.doc_ids(spark, sf))
    return L.multi_hot_encode(docs, "labels").drop("labels")


@query("multi_hot_decode", sql("gold28", f"""
    SELECT doc_id, len(a) AS n_active, array_to_string(a, ',') AS active_text
    FROM (SELECT doc_id, list_transform(labels, lambda j: {LABEL_LIST}[j + 1]) AS a FROM gold28)"""))
def _(spark, sf):
    wide = I.annotations_wide(spark, sf).drop("text")
    return L.multi_hot_decode(wide).select(
        F.col("id").alias("doc_id"), F.size("active").cast("bigint").alias("n_active"), "active_text")


@query("single_label", sql("gold28", f"""
    SELECT doc_id, CASE WHEN len(labels) = 1 THEN {LABEL_LIST}[labels[1] + 1] END AS label,
           CASE WHEN len(c) = 1 THEN c[1] END AS coarse_label
    FROM (SELECT doc_id, labels, list_filter(list_transform(labels, lambda j: {LABEL_LIST}[j + 1]),
                                             lambda x: list_contains({text_list(COARSE7)}, x)) AS c FROM gold28)"""))
def _(spark, sf):
    wide = I.annotations_wide(spark, sf).drop("text")
    both = L.single_label(L.single_label(wide), COARSE7, out="coarse_label")
    return both.select(F.col("id").alias("doc_id"), "label", "coarse_label")


@query("taxonomy_rollup", sql("annotations_wide", "SELECT id, " + ", ".join(
    f"{_COARSE_SQL[t]} AS coarse_{t}" for t in COARSE7) + ", array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {_COARSE_SQL[t]} = 1 THEN '{k}' END" for k, t in enumerate(COARSE7))
    + "], lambda x: x IS NOT NULL), ',') AS coarse_ids FROM annotations_wide"))
def _(spark, sf):
    docs = L.multi_hot_encode(I.gold28(I.documents(spark, sf).select(F.col("doc_id").alias("id"), "doc_id")), "labels")
    both = L.taxonomy_rollup_ids(L.taxonomy_rollup(docs), "labels")
    return both.select("id", *[f"coarse_{t}" for t in COARSE7],
                       F.array_join(F.col("coarse_ids").cast("array<string>"), ",").alias("coarse_ids"))


@query("label_to_id", sql("utterances", "SELECT utt_id, Emotion, CASE Emotion " + " ".join(
    f"WHEN '{x}' THEN {i}" for i, x in enumerate(DIALOGUE7)) + " END AS label_id FROM utterances"))
def _(spark, sf):
    utt = I.utterances(spark, sf).select("utt_id", "Emotion")
    return L.label_to_id(utt, "Emotion", {x: i for i, x in enumerate(DIALOGUE7)})


@query("id_to_label", sql("gold28", f"""
    SELECT doc_id, label_id, {LABEL_LIST}[label_id + 1] AS label
    FROM (SELECT doc_id, unnest(labels)::int AS label_id FROM gold28)"""))
def _(spark, sf):
    docs = I.gold28(I.doc_ids(spark, sf))
    return L.id_to_label(docs.select("doc_id", F.explode("labels").alias("label_id")), "label_id")


_LABEL_PROBS = f"""
    SELECT doc_id, probs,
           list_filter(range(0, 28), lambda j: probs[j + 1] >= 0.3::double) AS incl,
           list_filter(range(0, 28), lambda j: probs[j + 1] > 0.3::double) AS excl,
           list_position(probs, list_max(probs)) - 1 AS top
    FROM scores28"""


@query("threshold_labels", sql("scores28", f"""
    SELECT doc_id,
           array_to_string(list_transform(CASE WHEN len(incl) = 0 THEN [top::bigint] ELSE incl END,
                                          lambda j: {LABEL_LIST}[j + 1]), ',') AS all_labels,
           array_to_string(list_transform(CASE WHEN len(excl) = 0 THEN [27::bigint] ELSE excl END,
                                          lambda j: {LABEL_LIST}[j + 1]), ',') AS sample_labels
    FROM ({_LABEL_PROBS})"""))
def _(spark, sf):
    docs = I.scores28(I.doc_ids(spark, sf))
    both = L.threshold_labels(docs, "probs")
    both = L.threshold_labels(both, "probs", inclusive=False, fallback="neutral", out="sample_labels")
    return both.select("doc_id", F.array_join("all_labels", ",").alias("all_labels"),
                       F.array_join("sample_labels", ",").alias("sample_labels"))


@query("threshold_binary", sql("scores28", """
    SELECT doc_id, array_to_string(list_transform(probs, lambda p: (p > 0.5::double)::int), '') AS pred_vec,
           array_to_string(list_transform(probs, lambda p: (p >= 0.3::double)::int), '') AS label_vec
    FROM scores28"""))
def _(spark, sf):
    docs = L.threshold_binary(I.scores28(I.doc_ids(spark, sf)), "probs")
    docs = L.threshold_binary(docs, "probs", 0.3, True, out="label_vec")
    return docs.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), "").alias(c)
                                   for c in ("pred_vec", "label_vec")])


@query("argmax_label", sql("scores28", f"""
    SELECT doc_id, {LABEL_LIST}[top + 1] AS primary_label, round(list_max(probs), 6) AS top_prob
    FROM ({_LABEL_PROBS})"""))
def _(spark, sf):
    docs = I.scores28(I.doc_ids(spark, sf))
    return rounded(L.argmax_label(docs, "probs", out="primary_label").select(
        "doc_id", "primary_label", F.array_max("probs").alias("top_prob")))


@query("topk_labels", sql("scores28 labels28", """
    SELECT doc_id, string_agg(label || ':' || printf('%.2f', p), ', ' ORDER BY p DESC, label_id) AS topk_text
    FROM (SELECT doc_id, label_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id) AS r
          FROM (SELECT doc_id, unnest(range(0, 28))::int AS label_id, unnest(probs) AS p FROM scores28))
    JOIN labels28 USING (label_id) WHERE r <= 5 GROUP BY doc_id"""))
def _(spark, sf):
    docs = I.scores28(I.doc_ids(spark, sf))
    return L.topk_labels(docs, "probs").select("doc_id", "topk_text")


@query("expand_probs", sql("scores28", "SELECT doc_id, " + ", ".join(
    f"round(probs[{j + 1}], 6) AS prob_{x}, (probs[{j + 1}] >= 0.3::double)::int AS {x}"
    for j, x in enumerate(LABELS28)) + " FROM scores28"))
def _(spark, sf):
    docs = I.scores28(I.doc_ids(spark, sf))
    return rounded(L.expand_probs(docs, "probs").drop("probs"))


@query("normalize_label", sql("raw_outputs", f"""
    SELECT row_id, CASE WHEN list_contains({LABEL_LIST}, c) THEN c ELSE coalesce(
               list_filter({LABEL_LIST}, lambda x: list_contains(w, x))[1], 'invalid') END AS label
    FROM (SELECT row_id, {strip('lower(output)')} AS c, {words('lower(output)')} AS w FROM raw_outputs)"""))
def _(spark, sf):
    return L.normalize_label(I.raw_outputs(spark, sf), "output").select("row_id", "label")


@query("lower_labels", sql("preds3", """
    SELECT model, row_id, lower(upper(gold)) AS gold, lower(upper(pred)) AS pred FROM preds3"""))
def _(spark, sf):
    shouted = I.preds3(spark, sf).withColumns({"gold": F.upper("gold"), "pred": F.upper("pred")})
    return L.lower_labels(shouted, ["gold", "pred"])
