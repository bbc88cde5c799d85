"""Queries of the descriptive aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlabels.operators import statistics as A
from textlabels.operators.quantiles import exact_quantiles, quantile_summary
from textlabels.operators.text import word_count
from textlabels.plans import inputs as I
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import sql, words
from textlabels.sources.workspace import materialize


@query("value_counts", sql("utterances", "SELECT Emotion, Speaker, count(*) AS n FROM utterances GROUP BY ALL"))
def _(spark, sf):
    return A.value_counts(I.utterances(spark, sf), ["Emotion", "Speaker"])


@query("label_distribution", sql("gold28 labels28", """
    SELECT label_id, label, count(doc_id) AS positives,
           round(count(doc_id) * 100.0::double / (SELECT count(*) FROM gold28), 6) AS pct
    FROM labels28 LEFT JOIN (SELECT doc_id, unnest(labels)::int AS label_id FROM gold28) USING (label_id)
    GROUP BY label_id, label"""))
def _(spark, sf):
    return rounded(A.label_distribution(I.gold28(I.doc_ids(spark, sf)), "labels"))


@query("mean_probs", sql("scores28 labels28", """
    SELECT label_id, label, round(sum(p::DECIMAL(38,15))::DOUBLE / count(p), 6) AS mean_prob
    FROM (SELECT unnest(range(0, 28))::int AS label_id, unnest(probs) AS p FROM scores28) JOIN labels28 USING (label_id)
    GROUP BY label_id, label HAVING avg(p) > 0.01"""))
def _(spark, sf):
    return rounded(A.mean_probs(I.scores28(I.doc_ids(spark, sf)), "probs"))


@query("describe", f"""
    SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::double AS min,
           round(quantile_cont(v::double, 0.25), 6) AS q25, round(quantile_cont(v::double, 0.5), 6) AS q50,
           round(quantile_cont(v::double, 0.75), 6) AS q75, max(v)::double AS max
    FROM (SELECT len({words('text')}) AS v FROM documents)""")
def _(spark, sf):
    # describe() reads its column several times: derive the numbers from the text once.
    lengths = word_count(I.documents(spark, sf).select("doc_id", "text"), "text").select("n_words")
    return rounded(A.describe(materialize(lengths, "lengths"), "n_words"))


@query("group_mean", sql("utterances", f"""
    SELECT Emotion, round(avg(len({words('Utterance')})), 6) AS mean_value FROM utterances GROUP BY Emotion"""))
def _(spark, sf):
    return rounded(A.group_mean(word_count(I.utterances(spark, sf), "Utterance"), "Emotion", "n_words"))


@query("top_n_values", sql("utterances", """
    SELECT Speaker, count(*) AS n FROM utterances GROUP BY Speaker ORDER BY n DESC, Speaker LIMIT 15"""))
def _(spark, sf):
    return A.top_n_values(I.utterances(spark, sf), "Speaker")


@query("split_stats", sql("utterances", """
    SELECT split, Emotion, n, sum(n) OVER (PARTITION BY split)::bigint AS split_rows
    FROM (SELECT split, Emotion, count(*) AS n FROM utterances GROUP BY ALL)"""))
def _(spark, sf):
    return A.split_stats(I.utterances(spark, sf), "split", "Emotion")


@query("grouped_accuracy", sql("preds3", """
    SELECT gold, sum((gold = pred)::int)::bigint AS correct, count(*) AS n, round(avg((gold = pred)::int), 6) AS accuracy
    FROM preds3 GROUP BY gold"""))
def _(spark, sf):
    return rounded(A.grouped_accuracy(I.preds3(spark, sf)))


@query("histogram", """
    WITH e AS MATERIALIZED (SELECT min(value) AS lo, (max(value) - min(value)) / 40 AS w FROM events),
    c AS (SELECT least(CASE WHEN w > 0 THEN floor((value - lo) / w) ELSE 0 END, 39)::int AS bin, count(*) AS n
          FROM events CROSS JOIN e WHERE value IS NOT NULL GROUP BY 1)
    SELECT bin, round(lo + bin * w, 6) AS left_edge, round(lo + (bin + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(0, 40))::int AS bin) LEFT JOIN c USING (bin) CROSS JOIN e""")
def _(spark, sf):
    return rounded(A.histogram(I.table(spark, sf, "events"), "value"))


@query("box_stats", """
    SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
           round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
    FROM events GROUP BY event_type""")
def _(spark, sf):
    return rounded(A.box_stats(I.table(spark, sf, "events"), "event_type", "value"))


@query("profile", """
    SELECT position, "column", type, non_null FROM (
        SELECT unnest([0, 1, 2, 3, 4])::int AS position, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS "column",
               unnest(['bigint', 'string', 'string', 'string', 'bigint']) AS type,
               unnest([count(doc_id), count(text), count(lang), count(source), count(n_chars)]) AS non_null FROM documents)""")
def _(spark, sf):
    return A.profile(I.documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars"))


@query("quantiles_by_summary", """
    SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type HAVING count(value) > 0""")
def _(spark, sf):
    """Summaries of each user range, as if written when its rows came, place the cuts of exact quantiles."""
    events = I.table(spark, sf, "events")
    parts = quantile_summary(events.withColumn("part", F.col("user_id") % 4), ["part", "event_type"], "value")
    found = exact_quantiles(events, ["event_type"], "value", [0.01, 0.5, 0.99], parts.drop("part"))
    return rounded(found.select("event_type", F.col("q0").alias("p1"), F.col("q1").alias("p50"), F.col("q2").alias("p99")))
