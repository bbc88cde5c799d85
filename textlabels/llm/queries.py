"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from textlabels.llm import (
    bpe, centroids, decontaminate, divergence, embedding_dedup, license_scan, line_dedup, quality, simhash, suffix_dedup, suffix_tree_lm,
    toxicity, url_rules,
)
from textlabels.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "quality")
    return quality.classify(docs, "doc_id", "text", model)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, "doc_id", "text", model)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), "page_id", "url", rules)


OP3_SQL = """
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), "doc_id", "text")
    n_removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]), F.lit(0))
    return found.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"),
                        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200)) AS s FROM d)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
marked AS (SELECT r, s, s > lag(s) OVER (PARTITION BY r ORDER BY s) + 200 AS gap FROM w SEMI JOIN twice USING (m)),
islands AS (
  SELECT r, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT r, s, sum(coalesce(gap, false)::int) OVER (PARTITION BY r ORDER BY s) AS k FROM marked) GROUP BY r, k),
cuts AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM islands
  UNION ALL SELECT r, max(b), (SELECT len(h) // 2 FROM d WHERE d.r = islands.r) FROM islands GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM cuts JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM islands GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text",
                                            min_words=line_dedup.MIN_WORDS)
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                       F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
runs AS (
  SELECT doc_id, digest, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, words, lead(words, 1) OVER w AS words_b
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words FROM lines)
  WINDOW w AS (PARTITION BY doc_id, digest ORDER BY i)),
counted AS (
  SELECT doc_id, digest, i, 3 AS n, line, b, c FROM runs WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, digest, i, 2, line, b, NULL FROM runs WHERE b IS NOT NULL AND words + words_b >= 50
  UNION ALL SELECT doc_id, digest, i, 1, line, NULL, NULL FROM runs WHERE words >= 50),
later AS (
  SELECT doc_id, digest, i, n FROM counted
  QUALIFY row_number() OVER (PARTITION BY n, line, b, c ORDER BY doc_id NULLS FIRST, digest, i) > 1),
gone AS (SELECT DISTINCT doc_id, digest, i + j AS i FROM later, (VALUES (0), (1), (2)) t(j) WHERE j < n),
kept AS (
  SELECT l.doc_id, l.digest, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.digest = g.digest AND l.i = g.i
  GROUP BY ALL)
SELECT d.doc_id, k.n_lines, k.n_removed, sha256(k.text) AS kept_sha256
FROM documents d JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.digest
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), "doc_id", "text",
                                 table(spark, sf_dir, "benchmark"), "item_id", "text")
    return decontaminate.report(scanned, "doc_id")


WORDS_SQL = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")
OP10_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(13, len(w)) - 1) AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM windows),
spots AS (
  SELECT r, s, n, list_slice(w, s, s + n - 1) AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item_id FROM spots JOIN windows USING (phrase)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""


def _values(rows) -> str:
    return "(VALUES " + ", ".join(repr(tuple(r)) for r in rows) + ")"


_VOCABULARY = sorted({w for _, phrase, text in license_scan.TEMPLATES for w in f"{phrase} {text}".split()}
                     - set(license_scan.FUNCTION_WORDS) | {w for _, p in license_scan.BASE_PHRASES for w in p.split()})
OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
p AS (SELECT * FROM (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE term IN {tuple(_VOCABULARY)!r}),
base AS (
  SELECT label, r, pos - off AS start FROM p JOIN {_values(
      (no, label, i, len(p.split()), w) for no, (label, p) in enumerate(license_scan.BASE_PHRASES) for i, w in enumerate(p.split()))}
      AS b(no, label, off, size, term) USING (term) GROUP BY no, label, size, r, pos - off HAVING count(*) = size),
template AS (SELECT * FROM {_values(
    (no, label, i, w) for no, (label, _, text) in enumerate(license_scan.TEMPLATES) for i, w in enumerate(text.split())
    if w not in license_scan.FUNCTION_WORDS)} AS t(no, label, place, term)),
held AS (SELECT DISTINCT r, term FROM p),
idf AS (SELECT term, round(ln(((SELECT count(*) FROM d) + 1.0::double) / count(*)), 6) AS idf FROM held GROUP BY term),
verified AS (
  SELECT no, r, pos - off AS shift FROM p JOIN {_values(
      (no, len(text.partition(phrase)[0].split()) + i, len(phrase.split()), w)
      for no, (_, phrase, text) in enumerate(license_scan.TEMPLATES) for i, w in enumerate(phrase.split()))}
      AS k(no, off, size, term) USING (term) GROUP BY no, size, r, pos - off HAVING count(*) = size),
met AS (
  SELECT no, label, r, shift, sum(CASE WHEN k <= 8 THEN idf END) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY no, label, r, shift ORDER BY idf DESC, term) AS k
        FROM (SELECT DISTINCT no, label, r, shift, term, idf
              FROM p JOIN template USING (term) JOIN idf USING (term) JOIN verified USING (no, r) WHERE pos - place = shift))
  GROUP BY ALL HAVING count(*) >= 2),
most AS (
  SELECT no, sum(idf) AS most
  FROM (SELECT no, idf FROM (SELECT DISTINCT no, term FROM template) JOIN idf USING (term)
        QUALIFY row_number() OVER (PARTITION BY no ORDER BY idf DESC, term) <= 8) GROUP BY no),
aligned AS (
  SELECT r, label, least(1.0::double, round(weight / most, 6)) AS score
  FROM met JOIN most USING (no)),
bases AS (SELECT r, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY r),
everything AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(score) AS score
  FROM (SELECT r, label, 0.5::double AS score FROM base UNION ALL SELECT r, label, score FROM aligned) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(bases.l, '') AS base_labels, coalesce(everything.l, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN everything USING (r)
"""


def op11_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), "doc_id", "text", suffix_tree_lm.training("doc_id"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "lang", "source", "text")


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _op13_sql(rounds: int = 5) -> str:
    steps = ["""
v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT 40))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c{i}.q[i]) * (v.q[i] - c{i}.q[i])))::BIGINT AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
    FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c) JOIN v USING (r)
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_url_rules": op3_url_rules,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffix_tree_lm": op11_suffix_tree_lm,
    "op12_divergence": op12_divergence,
    "op13_centroids": op13_centroids,
}
SQL: dict[str, str] = {
    "op3_url_rules": OP3_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_divergence": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
