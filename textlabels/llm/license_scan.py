"""License scan with a positional index of rare license words.

The places of the words that license notices use (function words apart) are
indexed for all files.  Every place where a template's mandatory phrase stands,
word for word, is one alignment of file and template; all words of the template
are looked up where the alignment has them.  It counts once different words
agree, and is scored by its words of highest IDF over all files.  Only DataFrame
operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlabels.llm.common import materialize
from textlabels.llm.decontaminate import build_index

# Phrases whose places are all reported, and their labels.
BASE_PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# Fixed values: (label, mandatory phrase, wording of a public license notice).
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "hereby granted free", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0 you may not use this file except in "
     "compliance with the license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation"),
    ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
]
# Words of the templates that are not indexed.
FUNCTION_WORDS = "a and any are as for in is it may not of or that the this to under use with you work".split()
WEIGHED = 8             # highest-IDF words of an alignment, and of its template, that the score weighs
LEAST_MET = 2           # different words that have to agree on an alignment
BASE_SCORE = 0.5        # score of a file with a base phrase, at least


def _phrase_table(spark: SparkSession, phrases: list[tuple]) -> DataFrame:
    """(no, label, offset, size, term), one row for each word of each (label, phrase)."""
    rows = [(no, label, i, len(p.split()), w) for no, (label, p) in enumerate(phrases) for i, w in enumerate(p.split())]
    return spark.createDataFrame(rows, "no int, label string, offset int, size int, term string")


def phrase_places(postings: DataFrame, phrases: list[tuple]) -> DataFrame:
    """(no, label, doc, start): all places where a phrase's words stand consecutively."""
    table = F.broadcast(_phrase_table(postings.sparkSession, phrases))
    return (postings.join(table, "term").groupBy("no", "label", "size", "doc", (F.col("pos") - F.col("offset")).alias("start"))
            .agg(F.count("*").alias("met")).where("met = size").select("no", "label", "doc", "start"))


def alignments(postings: DataFrame, n_docs: Column | int, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """(no, label, doc, shift, score): verified alignments of files with templates."""
    spark = postings.sparkSession
    rows = [(no, label, i, w) for no, (label, _, text) in enumerate(templates) for i, w in enumerate(text.split())
            if w not in FUNCTION_WORDS]
    table = spark.createDataFrame(rows, "no int, label string, at int, term string")
    held = postings.groupBy("doc", "term").agg(F.count("*").alias("n"))
    idf = materialize(held.groupBy("term").agg(F.round(F.log((n_docs + 1.0) / F.count("*")), 6).alias("idf")), "license-idf")
    # words of a template before its mandatory phrase
    keys = spark.createDataFrame([(no, len(text.partition(phrase)[0].split())) for no, (_, phrase, text) in enumerate(templates)],
                                 "no int, key_at int")
    verified = (phrase_places(postings, [(label, phrase) for label, phrase, _ in templates]).join(F.broadcast(keys), "no")
                .select("no", "label", "doc", (F.col("start") - F.col("key_at")).alias("shift")))
    # all words of the template, where the alignment has them
    wanted = verified.join(F.broadcast(table.drop("label").join(F.broadcast(idf), "term")), "no").withColumn("pos", F.col("shift") + F.col("at"))
    total = lambda idfs: F.aggregate(
        F.slice(F.sort_array(idfs, asc=False), 1, WEIGHED), F.lit(0).cast("decimal(30,6)"), lambda s, x: (s + x).cast("decimal(30,6)"))
    met = (wanted.join(postings, ["doc", "pos", "term"]).select("no", "label", "doc", "shift", "term", "idf").distinct()
           .groupBy("no", "label", "doc", "shift")
           .agg(F.count("*").alias("words"), total(F.collect_list(F.col("idf").cast("decimal(20,6)"))).alias("weight"))
           .where(F.col("words") >= LEAST_MET))
    # the most a template can gather: its own highest-IDF words
    best = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("idf"), "term"))
    most = (table.select("no", "term").distinct().join(F.broadcast(idf), "term").withColumn("rank", best)
            .where(F.col("rank") <= WEIGHED).groupBy("no").agg(F.sum(F.col("idf").cast("decimal(20,6)")).alias("most")))
    score = F.least(F.lit(1.0), F.round((F.col("weight") / F.col("most")).cast("double"), 6))
    return met.join(F.broadcast(most), "no").select("no", "label", "doc", "shift", score.alias("score"))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``df``.

    n_base counts all places of the base phrases, first_word and last_word are
    their smallest and largest start (null without any).  ``labels`` adds those
    of the verified templates.  ``score`` is the share of a template's rare
    weight that is aligned (the highest-IDF words of both), the largest over its templates, at least
    ``BASE_SCORE`` with a base phrase, 0 without any label.  A null text counts as
    empty.  Rows that repeat an id, and null ids, are all returned; further
    columns are not read.
    """
    spark = df.sparkSession
    vocabulary = sorted({w for _, phrase, text in TEMPLATES for w in f"{phrase} {text}".split()} - set(FUNCTION_WORDS)
                        | {w for _, p in BASE_PHRASES for w in p.split()})
    index = materialize(build_index(df, id_col, text_col, spark.createDataFrame(
        [(w, i) for i, w in enumerate(vocabulary)], "term string, term_id long")), "license-postings")
    names = F.broadcast(spark.createDataFrame([(i, w) for i, w in enumerate(vocabulary)], "term_id long, term string"))
    postings = index.where("term_id is not null").join(names, "term_id").select("doc", "term", "pos")
    docs = index.where("term_id is null")
    base = materialize(phrase_places(postings, BASE_PHRASES), "license-base")
    by_doc = base.groupBy("doc").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set("label").alias("base"))
    aligned = (alignments(postings, docs.count()).groupBy("doc")
               .agg(F.collect_set("label").alias("more"), F.max("score").alias("aligned")))
    none = F.array().cast("array<string>")
    base_labels, more = F.coalesce("base", none), F.coalesce("more", none)
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return (docs.join(by_doc.join(aligned, "doc", "full"), "doc", "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word", "last_word", joined(base_labels).alias("base_labels"),
        joined(F.array_union(base_labels, more)).alias("labels"),
        F.greatest(F.coalesce("aligned", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)).alias("score")))
