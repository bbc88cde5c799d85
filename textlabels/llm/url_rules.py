"""Host and path rules for URLs by a sort-merge range join.

A rule (host, path) and each domain of a URL's host (the host itself and every
parent) are written as a canonical key: the labels reversed, a zero character,
the path.  A rule then covers the interval of keys that begin with its own, and
such intervals are nested or apart.  Rules and URL keys of one domain are sorted
together and swept once; a stack holds the rules that are open at the place, the
innermost on top.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import lower_ascii

SALTS = 64          # shares into which the keys of one domain are dealt; its rules go to each
_FIELDS = ["host", "path", "rule_host", "rule_path", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or a text without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _domain(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (domain, salt, key, kind): the innermost open rule of every URL key that has one."""
    group, stack = None, []
    for batch in batches:
        out = []
        for domain, salt, key, kind, host, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if (domain, salt) != group:
                group, stack = (domain, salt), []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host, verdict))
            elif stack:
                rule, rule_host, found = stack[-1]
                out.append((host, key[len(domain) + 1:], rule_host, rule[len(domain) + 1:], found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=_FIELDS)


def judge(df: DataFrame, id_col: str, url_col: str, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``df``.

    ``rules`` is (host, path, verdict).  A rule fits its host and all subdomains
    if the URL's path starts with the rule's; the longest host + path wins, of
    equally long ones the longer host.  Where no rule fits, rule is null and
    verdict ``otherwise``.  Rules with a null are none; of rules for the same
    place with different verdicts "block" holds.  Null urls have an empty host
    and path.  Rows that repeat an id are all judged; further columns are not
    read.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    own = (rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path")
           .agg(F.max_by("verdict", F.struct((F.col("verdict") == "block").cast("int"), "verdict")).alias("verdict"))
           .withColumn("domain", _domain(F.split("host", r"\.", -1))))
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _domain(F.slice(labels, i, F.size(labels))))
    points = (pages.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("domain"))
              .join(own.select("domain").distinct(), "domain", "left_semi"))
    key = F.concat("domain", F.lit("\0"), "path").alias("key")
    rows = points.select(
        "domain", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"), key, F.lit(1).alias("kind"),
        "host", F.lit(None).cast("string").alias("verdict"))
    rows = rows.unionByName(own.select("domain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), key,
                                       F.lit(0).alias("kind"), "host", "verdict"))
    found = (rows.repartition("domain", "salt").sortWithinPartitions("domain", "salt", "key", "kind")
             .mapInArrow(_sweep, ", ".join(f"{f} string" for f in _FIELDS)))
    rule = F.concat("rule_host", "rule_path")
    longest = F.struct(F.char_length(rule), F.char_length("rule_host"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), longest).alias("best"))
    return (pages.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")))
