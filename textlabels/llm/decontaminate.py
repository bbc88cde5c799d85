"""Benchmark decontamination with a positional inverted index of the training texts.

The index holds the postings (term, document, position) of every term that a
benchmark item uses, and the length of every document.  A window of an item is
looked up like a phrase: the postings of its rarest terms, each shifted by the
term's offset, are intersected; what is left is checked against the postings of
all its terms.  Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlabels.llm.common import ascii_id_list, free_names, materialize, words

WINDOW = 13
RAREST = 3                     # lists that are intersected before the rest is looked up
BROADCAST_BYTES = 32 << 20     # measured size up to which a table of the benchmark is broadcast


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it; left to the planner if not."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def query_terms(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, pos, term): the words of every item that has words, written once.

    ``item`` numbers the different (id, words); it is never null.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).distinct()
    return materialize(items.withColumn("item", F.monotonically_increasing_id())
                       .select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term")), "query-terms")


def build_index(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(doc, term_id, pos, id, n_words): postings of the vocabulary's terms.

    ``vocabulary`` is (term, term_id).  ``doc`` numbers the rows of ``df``.  The
    posting with a null term_id carries the row's id and its number of words.
    """
    rows = df.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # a null in front stands for the document itself
    tokens = rows.select("doc", "id", F.size("w").alias("n_words"),
                         F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("pos", "term"))
    own = F.col("term").isNull()
    hits = tokens.join(_small(vocabulary, F.octet_length("term") + 24), "term", "left").where(own | F.col("term_id").isNotNull())
    return hits.select("doc", "term_id", (F.col("pos") - 1).alias("pos"), F.when(own, F.col("id")).alias("id"),
                       F.when(own, F.col("n_words")).alias("n_words"))


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, doc, start, size): where a window of an item stands word for word.

    ``terms`` is (item, n, pos, term_id).  A window is ``window``
    consecutive words of an item, or all of its words if it has fewer.
    """
    postings = index.where(F.col("term_id").isNotNull()).select("doc", "term_id", "pos")
    df_of = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    known = terms.join(df_of, "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    size = F.least(F.col("n"), F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - size + 1), F.least(F.col("pos"), F.col("n") - size)))
    in_window = known.select("item", "pos", "term_id", "df", size.alias("size"), starts.alias("first"))
    w = Window.partitionBy("item", "first")
    ranked = materialize(
        in_window.withColumn("least", F.min("df").over(w)).where("least > 0")      # else a term is in no document
        .withColumn("rank", F.row_number().over(w.orderBy("df", "pos"))), "windows")
    # windows with the same rarest places share one look-up
    anchors = ranked.where(F.col("rank") <= rarest)
    sets = anchors.groupBy("item", "first").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    keyed = anchors.join(sets, ["item", "first"])
    lookups = keyed.select("item", "places", "pos", "term_id").distinct()
    lists = postings.join(_small(lookups.withColumnRenamed("pos", "at"), F.lit(80)), "term_id")
    aligned = (lists.groupBy("item", "places", "doc", (F.col("pos") - F.col("at")).alias("shift"))
               .agg(F.count("*").alias("met")).where(F.col("met") == F.size("places")))
    windows = sets.join(ranked.select("item", "first", "size").distinct(), ["item", "first"])
    asked = (aligned.join(windows, ["item", "places"])
             .select("item", "first", "size", "doc", (F.col("shift") + F.col("first")).alias("start"))
             .where("start >= 0"))
    asked = materialize(asked, "asked")
    # the places an alignment needs, each once, are looked up in the full lists
    rest = ranked.select("item", "first", "pos", "term_id")
    places = (asked.select("item", "first", "doc", (F.col("start") - F.col("first")).alias("shift"))
              .join(rest, ["item", "first"])
              .select("item", "doc", "shift", F.col("pos").alias("at"), (F.col("pos") + F.col("shift")).alias("pos"), "term_id")
              .distinct())
    found = materialize(places.join(postings, ["doc", "pos", "term_id"]).select("item", "doc", "shift", "at"), "found")
    need = (asked.select("*", (F.col("start") - F.col("first")).alias("shift"))
            .select("item", "first", "size", "doc", "start", "shift",
                    F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("at")))
    return (need.join(found, ["item", "doc", "shift", "at"])
            .groupBy("item", "first", "size", "doc", "start").agg(F.count("*").alias("met"))
            .where("met = size").select("item", "doc", "start", "size").distinct())


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(pair_id, doc, pos, other): two terms within ``slop`` words of each other.

    ``pairs`` is (pair_id, term_id, other_id).  Positions are joined by blocks of
    ``slop`` words, so that only neighbouring blocks of one document meet.
    """
    postings = index.where(F.col("term_id").isNotNull()).select("doc", "term_id", "pos")
    a = (postings.join(pairs, "term_id").select("pair_id", "other_id", "doc", "pos")
         .withColumn("block", F.explode(F.array(*[(F.col("pos") / slop).cast("long") + i for i in (-1, 0, 1)]))))
    b = postings.select(F.col("term_id").alias("other_id"), "doc", F.col("pos").alias("other"),
                        (F.col("pos") / slop).cast("long").alias("block"))
    near = a.join(b, ["other_id", "doc", "block"]).where(f"pos != other and abs(pos - other) <= {int(slop)}")
    return near.select("pair_id", "doc", "pos", "other")


def numbered_terms(terms: DataFrame) -> DataFrame:
    """(term, term_id): the different words of the items, numbered."""
    return materialize(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")


def scan(df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
         window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items array, n_items): how much of every row stands in a window of a benchmark item.

    One row for each row of ``df``, also for repeated or null ids.  Null and
    blank texts have no words and hit nothing.  Items of null or blank text have
    no windows; rows that repeat an item count once.  Items with a null id
    cover words and count as one in ``n_items``, but are not listed.  Further columns are not read.
    """
    terms = query_terms(benchmark, item_col, item_text)
    numbers = numbered_terms(terms)
    index = materialize(build_index(df, id_col, text_col, numbers), "postings")
    hits = materialize(phrase_matches(index, terms.join(numbers, "term"), window), "hits")
    covered = (hits.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
               .distinct().groupBy("doc").agg(F.count("*").alias("n_hit")))
    ids = terms.select("item", "item_id").distinct()
    items = (hits.select("doc", "item").distinct().join(_small(ids, F.lit(40)), "item").groupBy("doc")
             .agg(F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("unnamed")))
    docs = index.where("term_id is null").select("doc", F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"))
    empty = F.array().cast(ids.select(F.array("item_id").alias("a")).schema["a"].dataType)
    return (docs.join(covered.join(items, "doc"), "doc", "left")
            .select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", empty).alias("items"),
                    F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items")))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(scanned: DataFrame, id_col: str) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    return scanned.select(id_col, "n_words", "n_hit", "n_items",
                          F.sha2(ascii_id_list(F.col("items")), 256).alias("items_sha256"),
                          contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def drop_contaminated(df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """The rows of ``df`` whose id has no contaminated row; rows without an id stay."""
    name, = free_names(df.columns, "_gone")
    bad = (scan(df, id_col, text_col, benchmark, item_col, item_text)
           .where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col(id_col).alias(name)).distinct())
    return df.join(bad, df[id_col] == F.col(name), "left_anti")
