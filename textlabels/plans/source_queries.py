"""Queries of the sources and sinks; round trips go through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlabels.functions.constants import LABELS28
from textlabels.operators.splitting import split_three
from textlabels.plans import inputs as I
from textlabels.plans.evaluation_queries import run_metrics
from textlabels.plans.registry import query, rounded
from textlabels.plans.sqlviews import h, sql, strip
from textlabels.sources import tables as S
from textlabels.sources.workspace import new_path


@query("read_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    docs = I.documents(spark, sf)
    path = new_path(spark, "documents-csv")
    S.write_table(docs, path, "csv")
    return S.read_table(spark, path, "csv", docs.schema)


@query("write_table", "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts_us FROM events")
def _(spark, sf):
    events = I.table(spark, sf, "events")
    back = events
    for fmt, parts in (("parquet", ["event_type"]), ("json", []), ("orc", [])):
        path = new_path(spark, f"events-{fmt}")
        S.write_table(back, path, fmt, partition_by=parts)
        back = S.read_table(spark, path, fmt, events.schema)
    # of either timestamp type; the sessions run in UTC
    return back.select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("write_lines", sql("documents_gaps", f"""
    SELECT {strip("regexp_replace(text, '[' || chr(13) || chr(10) || ']+', ' ', 'g')")} AS value
    FROM documents_gaps WHERE text IS NOT NULL"""))
def _(spark, sf):
    path = new_path(spark, "corpus-lines")
    S.write_lines(I.documents_gaps(spark, sf), "text", path)
    return S.read_lines(spark, path)


@query("union_splits", sql("utterances", "SELECT split, utt_id, Speaker, Utterance, Emotion FROM utterances"))
def _(spark, sf):
    utt = I.utterances(spark, sf)
    parts = {name: utt.where(F.col("split") == name).drop("split") for name in ("train", "dev", "test")}
    return S.union_splits(parts).select("split", "utt_id", "Speaker", "Utterance", "Emotion")


@query("load_annotations", sql("gold28", f"""
    SELECT CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil((n - nt) * {0.1 / 0.9!r}::double) THEN 'validation'
                ELSE 'train' END AS split, doc_id, text, array_to_string(labels, ',') AS labels
    FROM (SELECT *, ceil(n * 0.1::double) AS nt
          FROM (SELECT doc_id, text, row_number() OVER (ORDER BY {h('doc_id', "'42'")}, doc_id) AS r, count(*) OVER () AS n
                FROM documents)) JOIN gold28 USING (doc_id)"""))
def _(spark, sf):
    docs = split_three(I.gold28(I.documents(spark, sf).select("doc_id", "text")), "doc_id")
    path = new_path(spark, "annotations")
    S.write_annotations(docs, path)
    parts = [S.load_annotations(spark, path, s) for s in ("train", "validation", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("split", "doc_id", "text", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("results_json", sql("run_metrics", """
    SELECT round(b.f1_micro, 6) AS base_f1_micro, round(b.f1_macro, 6) AS base_f1_macro, round(b.loss, 6) AS base_loss,
           round(t.f1_micro, 6) AS tuned_f1_micro, round(t.f1_macro, 6) AS tuned_f1_macro, round(t.loss, 6) AS tuned_loss,
           round((t.f1_micro - b.f1_micro) / b.f1_micro * 100, 6) + 0.0 AS f1_micro_pct,
           round((t.f1_macro - b.f1_macro) / b.f1_macro * 100, 6) + 0.0 AS f1_macro_pct,
           round(-(t.loss - b.loss) / b.loss * 100, 6) + 0.0 AS loss_pct,
           32::int AS batch_size, 0.1::double AS dropout, 0.05::double AS weight_decay
    FROM (SELECT * FROM run_metrics WHERE model = 'baseline') b, (SELECT * FROM run_metrics WHERE model = 'tuned') t"""))
def _(spark, sf):
    document = S.results_document(run_metrics(spark, sf), "baseline", "tuned",
                                  new_params={"batch_size": 32, "weight_decay": 0.05})
    path = new_path(spark, "results")
    S.save_results(document, path)
    params = S.load_params(spark, path).select(F.struct("*").alias("p")).scalar()
    return rounded(S.load_results(spark, path).withColumn("p", params).select(
        *[F.col(f"{side}.test_metrics.{m}").alias(f"{alias}_{m}")
          for side, alias in (("baseline", "base"), ("tuned", "tuned")) for m in ("f1_micro", "f1_macro", "loss")],
        "improvement.*", "p.*"))


_ABSENT = ["grief", "relief"]


@query("conform_input", sql("annotations_wide", "SELECT id, text, " + ", ".join(
    f"CAST(NULL AS INTEGER) AS {x}" if x in _ABSENT else x for x in LABELS28) + " FROM annotations_wide"))
def _(spark, sf):
    table = I.annotations_wide(spark, sf).drop(*_ABSENT).withColumnRenamed("text", "speech")
    return S.conform_input(table, required=["id"])
