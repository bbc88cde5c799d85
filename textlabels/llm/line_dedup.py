"""Removal of runs of lines that stand earlier in the corpus, found by winnowing.

Of every ``min_run`` neighbouring lines the one with the smallest hash is
selected (the leftmost of equals), so two equal runs of that many lines select
the same line at the same place.  Only selected lines are exchanged; those whose
hash occurs once are dropped.  The places of the others are extended to both
sides by up to ``min_run - 1`` lines: each run of ``min_run`` lines around one is
compared with its equals, and all but the earliest in the order (id, text digest,
line) are deleted.  Longer repeats consist of such runs.

Shorter runs count too if ``min_words`` is given: all runs of fewer lines that
hold at least so many words together are compared, without winnowing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabels.llm.common import free_names, materialize, words

MIN_RUN = 3
MIN_WORDS = 50         # a run of fewer lines counts if it holds so many words; the queries use it


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def selected_lines(df: DataFrame, id_col: str, text_col: str, min_run: int) -> DataFrame:
    """(id, digest, n, pos, mark, around): the window minima of every text, once each.

    ``around`` holds the hashes of the lines from ``pos - min_run + 1`` to
    ``pos + min_run - 1`` as far as the text reaches, ``low`` the line of its first.
    """
    rows = (df.where(F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.md5(text_col).alias("digest"),
                    F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x)).alias("h"))
            .withColumn("n", F.size("h")).where(F.col("n") >= min_run))
    # of a window: the least (hash, line)
    minimum = lambda i: F.least(*[F.struct(F.get("h", i + j).alias("h"), (i + j).alias("p")) for j in range(min_run)])
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - min_run), minimum))
    return (rows.select("id", "digest", "n", "h", F.explode(picks).alias("x"))
            .select("id", "digest", "n", F.col("x.p").alias("pos"), F.col("x.h").alias("mark"),
                    F.greatest(F.lit(0), F.col("x.p") - (min_run - 1)).alias("low"), "h")
            .withColumn("around", F.slice("h", F.col("low") + 1, F.least(F.col("n"), F.col("pos") + min_run) - F.col("low")))
            .drop("h"))


def wordy_runs(df: DataFrame, id_col: str, text_col: str, min_run: int, min_words: int) -> DataFrame:
    """(id, digest, start, run): all runs of fewer than ``min_run`` lines with ``min_words`` words or more, once each."""
    rows = (df.where(F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.md5(text_col).alias("digest"),
                    F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(words(x)).alias("w"))).alias("x")))
    # the runs are cut before they are exploded, so that no row of a long text carries all of it
    cut = lambda n: F.transform("x", lambda _, i: F.struct(i.alias("start"), F.slice("x", i + 1, n).alias("run")))
    total = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["w"])
    held = [F.filter(cut(n), lambda r: (F.size(r["run"]) == n) & (total(r["run"]) >= min_words)) for n in range(1, min_run)]     # noqa: B023
    return (rows.select("id", "digest", F.explode(F.concat(*held)).alias("r"))
            .select("id", "digest", F.col("r.start").alias("start"), F.col("r.run.h").alias("run")).distinct())


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """(id, digest, lines array<int>): the lines to delete, for every text that has some."""
    places = materialize(selected_lines(df, id_col, text_col, min_run).distinct(), "line-minima")
    # counts are written before they are joined: both sides of the join are then dealt anew, and a hot key can be split
    shared = materialize(places.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1").select("mark"), "line-shared")
    start = F.explode(F.sequence(F.col("low"), F.least(F.col("pos"), F.col("n") - min_run)))
    runs = (places.join(shared, "mark").select("id", "digest", "low", "around", start.alias("start"))
            .select("id", "digest", "start", F.slice("around", F.col("start") - F.col("low") + 1, min_run).alias("run"))
            .distinct())
    if min_words is not None:
        runs = runs.unionByName(wordy_runs(df, id_col, text_col, min_run, min_words))
    runs = materialize(runs, "line-runs")
    place = F.struct("id", "digest", "start")
    first = materialize(runs.groupBy("run").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
                        .select("run", "first"), "line-first")
    later = runs.join(first, "run").where(place != F.col("first"))
    return (later.select("id", "digest", F.explode(F.sequence("start", F.col("start") + F.size("run") - 1)).alias("line"))
            .groupBy("id", "digest").agg(F.collect_set("line").alias("lines")))


def remove_repeated_lines(df: DataFrame, id_col: str, text_col: str, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """The rows and columns of ``df``, with the text that is left, and ``_n_lines``, ``_n_removed`` (long).

    Lines end at "\\n".  Rows that repeat both id and text count as one text and
    keep the same lines; of equal texts with different ids the one with the
    smaller id keeps them.  A null id comes before all others.  A null text stays null
    with no lines, an empty one is one empty line.  Overlapping repeats inside a
    text count: of five equal lines the first stays.  With ``min_words`` runs of
    fewer than ``min_run`` lines are removed as well if they have so many words.
    Columns of ``df`` named like the two counts are replaced by them.
    """
    others = [c for c in df.columns if c.lower() not in ("_n_lines", "_n_removed")]
    own, twin, digest, lines = free_names(others, "_own", "_id", "_digest", "_lines")
    gone = repeated_lines(df, id_col, text_col, min_run, min_words).select(
        F.col("id").alias(twin), F.col("digest").alias(digest), F.col("lines").alias(lines))
    text = F.col(text_col)
    joined = df.select(*others, F.md5(text).alias(own)).join(
        gone, F.col(id_col).eqNullSafe(F.col(twin)) & (F.col(own) == F.col(digest)), "left")
    left = F.filter(_lines(text), lambda line, i: ~F.array_contains(lines, i))
    return joined.select(
        *[F.when(F.col(lines).isNull(), text).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c)
          for c in others],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("long").alias("_n_lines"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n_removed"))
