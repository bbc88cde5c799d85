"""The input views once more, as common table expressions for DuckDB."""

from __future__ import annotations

from textlabels.functions.constants import DIALOGUE7, LABELS28
from textlabels.plans.inputs import MODELS3, RAW_OUTPUTS, RUNS


def h(*parts: str) -> str:
    """The 32-bit md5 hash of the parts joined by ':'."""
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::bigint"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def toks(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({col}), '\s+'), lambda x: x <> '')"


def words(col: str) -> str:
    return rf"list_filter(regexp_split_to_array({col}, '\s+'), lambda x: x <> '')"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


LABEL_LIST = text_list(LABELS28)


def _pred(run: str) -> str:
    keep, noise, _, kept, added = RUNS[run]
    return (f"list_filter(range(0, 28), lambda j: (list_contains(labels, j) AND {h('doc_id', repr(keep), 'j')} % 100 < {kept})"
            f" OR {h('doc_id', repr(noise), 'j')} % 100 < {added})")


def _scores(run: str) -> str:
    tag = RUNS[run][2]
    return (f"list_transform(range(0, 28), lambda j: ({h('doc_id', repr(tag), 'j')} % 101) / 100.0::double"
            " * (CASE WHEN doc_id % 4 = 0 THEN 0.29::double ELSE 1.0::double END))")


def _vec(col: str) -> str:
    return f"list_transform(range(0, 28), lambda j: list_contains({col}, j)::int)"


_raw_cases = " ".join(f"WHEN {i} THEN " + text_list([v])[1:-1] for i, v in enumerate(RAW_OUTPUTS))

def _chunks(source: str) -> str:
    return f"""
        SELECT doc_id, c AS chunk, ts[c * 350 + 1 : c * 350 + 400] AS tokens
        FROM (SELECT doc_id, ts, unnest(CASE WHEN len(ts) <= 400 THEN [0::bigint]
                                            ELSE range(0, (len(ts) + 349) // 350) END) AS c
              FROM (SELECT doc_id, {toks('text')} AS ts FROM {source} WHERE text IS NOT NULL)
              WHERE len(ts) > 0)"""


def _long2(source: str) -> str:
    return f"""
        SELECT doc_id, label, avg(p) AS prob, count(*) AS chunks
        FROM (SELECT doc_id, chunk, label, 1 / (1 + exp(-(max(b) + sum(coalesce(w, 0)) / count(*)))) AS p
              FROM (SELECT doc_id, chunk, token, label, b FROM {source} CROSS JOIN bias2)
              LEFT JOIN weights2 USING (token, label) GROUP BY doc_id, chunk, label)
        GROUP BY doc_id, label"""


VIEWS = {
    "labels28": f"SELECT unnest(range(0, 28))::int AS label_id, unnest({LABEL_LIST}) AS label",
    "gold28": f"""
        SELECT doc_id, CASE WHEN len(l) = 0 THEN [27::bigint] ELSE l END AS labels
        FROM (SELECT doc_id, list_filter(range(0, 28), lambda j: {h('doc_id', "'g'", 'j')} % 100 < 6) AS l FROM documents)""",
    "pred28": f"SELECT doc_id, labels, {_pred('baseline')} AS pred_labels FROM gold28",
    "scores28": f"SELECT doc_id, {_scores('baseline')} AS probs FROM documents",
    "runs": " UNION ALL ".join(
        f"SELECT '{r}' AS model, doc_id, {_vec('labels')} AS gold_vec, {_vec(_pred(r))} AS pred_vec, {_scores(r)} AS probs"
        " FROM gold28" for r in RUNS),
    # one row per model, document and label
    "cells": """
        SELECT model, doc_id, unnest(range(0, 28))::int AS label_id, unnest(gold_vec) AS g, unnest(pred_vec) AS p,
               unnest(probs) AS prob FROM runs""",
    "per_label": """
        SELECT model, label_id, sum(g * p)::double AS tp, sum(g)::double AS gs, sum(p)::double AS ps,
               CASE WHEN sum(g) + sum(p) = 0 THEN 0 ELSE 2.0::double * sum(g * p) / (sum(g) + sum(p)) END AS f1
        FROM cells GROUP BY model, label_id""",
    "run_metrics": """
        SELECT c.model, c.f1_micro, f.f1_macro, c.loss
        FROM (SELECT model, 2.0::double * sum(g * p) / (sum(g) + sum(p)) AS f1_micro,
                     avg(-(CASE WHEN g = 1 THEN ln(least(greatest(prob, 1e-12), 1 - 1e-12))
                                    ELSE ln(1 - least(greatest(prob, 1e-12), 1 - 1e-12)) END)) AS loss
              FROM cells GROUP BY model) c
        JOIN (SELECT model, avg(f1) AS f1_macro FROM per_label GROUP BY model) f USING (model)""",
    "annotations_wide": "SELECT doc_id AS id, text, " + ", ".join(
        f"list_contains(labels, {j})::int AS {x}" for j, x in enumerate(LABELS28)) + " FROM documents JOIN gold28 USING (doc_id)",
    "utterances": f"""
        SELECT utt_id, CASE WHEN s < 8 THEN 'train' WHEN s = 8 THEN 'dev' ELSE 'test' END AS split, Speaker, Utterance,
               CASE WHEN e < 6 THEN 'neutral' WHEN e < 9 THEN 'joy' WHEN e < 11 THEN 'surprise' WHEN e = 11 THEN 'anger'
                    WHEN e = 12 THEN 'sadness' ELSE 'disgust' END AS Emotion
        FROM (SELECT utt_id, Speaker, Utterance, {h('utt_id', "'split'")} % 10 AS s, {h('utt_id', "'e'")} % 14 AS e
              FROM (SELECT conv_id * 1000 + turn AS utt_id, role AS Speaker, text AS Utterance FROM conversations))""",
    "preds3": f"""
        SELECT model, row_id, gold,
               CASE WHEN {h('row_id', 'model')} % 100 < pct THEN gold
                    ELSE {LABEL_LIST}[({h('row_id', 'model', "'x'")} % 28) + 1] END AS pred
        FROM (SELECT doc_id AS row_id, {LABEL_LIST}[labels[1] + 1] AS gold FROM gold28)
        CROSS JOIN (VALUES {', '.join(f"('{m}', {a})" for m, a in MODELS3.items())}) AS models(model, pct)""",
    "classes3": """
        SELECT model, label, sum(tp)::double AS tp, sum(fp)::double AS fp, sum(fn)::double AS fn
        FROM (SELECT model, gold AS label, (gold = pred)::int AS tp, 0 AS fp, (gold <> pred)::int AS fn FROM preds3
              UNION ALL SELECT model, pred, 0, 1, 0 FROM preds3 WHERE gold <> pred)
        GROUP BY model, label""",
    "metrics3": """
        SELECT model, n, accuracy, f1_macro
        FROM (SELECT model, count(*) AS n, avg((gold = pred)::int) AS accuracy FROM preds3 GROUP BY model)
        JOIN (SELECT model, avg(2 * tp / (2 * tp + fp + fn)) AS f1_macro FROM classes3 GROUP BY model) USING (model)""",
    "raw_outputs": f"""
        SELECT doc_id AS row_id, coalesce(CASE {h('doc_id', "'o'")} % 8 {_raw_cases} END || chr(10) || text, text) AS output
        FROM documents""",
    "documents_gaps": """
        SELECT doc_id, text FROM documents
        UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 97 = 1 THEN '   ' END FROM documents WHERE doc_id % 97 <= 1""",
    "labels_split": f"""
        SELECT doc_id, quality, toxic, CASE WHEN r <= nt THEN 'test'
               WHEN r <= nt + ceil((n - nt) * {0.1 / 0.9!r}::double) THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, ceil(n * 0.1::double) AS nt FROM (
              SELECT *, row_number() OVER (ORDER BY {h('doc_id', "'42'")}, doc_id) AS r, count(*) OVER () AS n FROM labels))""",
    # distinct tokens of whole documents
    "doc_tokens": f"""
        SELECT doc_id, unnest(list_distinct({toks('text')})) AS token FROM documents""",
    # chunks of texts with gaps, and of the documents as they are
    "chunks": _chunks("documents_gaps"),
    "doc_chunks": _chunks("documents"),
    "chunk_tokens": "SELECT doc_id, chunk, unnest(list_distinct(tokens)) AS token FROM chunks",
    "doc_chunk_tokens": "SELECT doc_id, chunk, unnest(list_distinct(tokens)) AS token FROM doc_chunks",
    # training documents of the two real labels, in long form
    "truth2": """
        SELECT doc_id, 'quality' AS label, quality AS y, split FROM labels_split
        UNION ALL SELECT doc_id, 'toxic', toxic, split FROM labels_split""",
    "bias2": """
        SELECT label, sum(y)::double AS n1, sum(1 - y)::double AS n0,
               ln((sum(y) + 1)::double / (sum(1 - y) + 1)) AS b
        FROM truth2 WHERE split = 'train' GROUP BY label""",
    "weights2": """
        SELECT token, label, ln((c1 + 1) / (n1 + 2)) - ln((c0 + 1) / (n0 + 2)) AS w
        FROM (SELECT token, label, sum(y)::double AS c1, sum(1 - y)::double AS c0
              FROM doc_tokens JOIN truth2 USING (doc_id) WHERE split = 'train' GROUP BY token, label)
        JOIN bias2 USING (label)""",
    "scored2": """
        SELECT doc_id, label, 1 / (1 + exp(-(max(b) + sum(coalesce(w, 0)) / count(*)))) AS prob
        FROM (SELECT doc_id, token, label, b FROM doc_tokens CROSS JOIN bias2)
        LEFT JOIN weights2 USING (token, label) GROUP BY doc_id, label""",
    "long2": _long2("chunk_tokens"),
    "doc_long2": _long2("doc_chunk_tokens"),
    "utterance_preds": f"""
        SELECT utt_id, Emotion AS gold, CASE WHEN {h('utt_id', "'r'")} % 100 < 50 THEN Emotion
               ELSE {text_list(DIALOGUE7)}[({h('utt_id', "'w'")} % 7) + 1] END AS pred FROM utterances""",
    "docs_train": f"""
        SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {h('doc_id', "'42'")}, doc_id) AS r,
                                   count(*) OVER () AS n FROM documents)
        WHERE r > ceil(n * 0.1::double) + ceil((n - ceil(n * 0.1::double)) * {0.1 / 0.9!r}::double)""",
    "counts28": "SELECT count(*)::double AS n, " + ", ".join(
        f"sum(list_contains(labels, {j})::int)::double AS n{j}" for j in range(28)) + " FROM gold28 JOIN docs_train USING (doc_id)",
    "weights28": "SELECT token, " + ", ".join(
        f"ln((c{j} + 1) / (n{j} + 2)) - ln((df - c{j} + 1) / (n - n{j} + 2)) AS w{j}" for j in range(28)) + """
        FROM (SELECT token, count(*)::double AS df, """ + ", ".join(
            f"sum(list_contains(labels, {j})::int)::double AS c{j}" for j in range(28)) + """
              FROM doc_tokens JOIN docs_train USING (doc_id) JOIN gold28 USING (doc_id) GROUP BY token) CROSS JOIN counts28""",
    "long28": "SELECT doc_id, " + ", ".join(f"avg(p{j}) AS p{j}" for j in range(28)) + " FROM (SELECT doc_id, chunk, " + ", ".join(
        f"1 / (1 + exp(-(max(ln((n{j} + 1) / (n - n{j} + 1))) + sum(coalesce(w{j}, 0)) / count(*)))) AS p{j}" for j in range(28)) + """
        FROM chunk_tokens LEFT JOIN weights28 USING (token) CROSS JOIN counts28 GROUP BY doc_id, chunk) GROUP BY doc_id""",
}

# view -> views it reads
_NEEDS = {
    "pred28": ["gold28"], "runs": ["gold28"], "cells": ["runs"], "per_label": ["cells"],
    "run_metrics": ["cells", "per_label"], "annotations_wide": ["gold28"], "preds3": ["gold28"],
    "classes3": ["preds3"], "metrics3": ["preds3", "classes3"], "chunks": ["documents_gaps"],
    "chunk_tokens": ["chunks"], "truth2": ["labels_split"], "bias2": ["truth2"],
    "weights2": ["doc_tokens", "truth2", "bias2"], "scored2": ["doc_tokens", "bias2", "weights2"],
    "long2": ["chunk_tokens", "bias2", "weights2"], "doc_chunk_tokens": ["doc_chunks"],
    "doc_long2": ["doc_chunk_tokens", "bias2", "weights2"], "utterance_preds": ["utterances"],
    "counts28": ["gold28", "docs_train"], "weights28": ["doc_tokens", "gold28", "docs_train", "counts28"],
    "long28": ["chunk_tokens", "weights28", "counts28"],
}


def sql(views: str, body: str) -> str:
    """A query that starts with the named views (blank separated) and everything they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        visit(name)
    # read more than once by their consumers
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in order)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
