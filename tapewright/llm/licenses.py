"""Licence scans by diagonal voting. DataFrame functions only.

Words of all texts (ASCII letters lower-cased; letters, digits and anything past
ASCII) are written as rolling word 2-grams and joined, by hash and by the words
themselves, to the positions at which licence templates hold them. Hits of one
template at one offset (document position minus template position) are a
diagonal; each distinct template position votes once. A diagonal with a vote from
every 2-gram of the template is a place where the template stands word for word.
A diagonal and those up to ``DRIFT`` words after it (a quarter of the template's words at
most) merge, so a few inserted or missing
words don't split a match, and no chain of stray hits can lengthen a span. A merged span
is verified by order: what counts is the longest run of its hits in which template positions rise with
document positions, so words of a template in another order are no match. Of spans whose diagonals
lie that close together, the one with the largest share counts.

Phrases count only where they stand whole. Notices are longer templates that also
count with ``SHARE`` of their 2-grams. Null text has no words; texts with fewer
than two words have no hits. Repeated rows (same id and text) get the same
result; null ids are ids. Hits meet again by document, never by licence. An empty table
gives an empty result; texts are taken whole, however long. Columns other than doc_id and
text are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import ascii_lower, materialize

# fixed values: the phrases and labels that a scan always reports
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer templates of the method's own, each with its label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "mozilla public license": "mpl",
    "all rights reserved": "reserved",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "boost software license": "bsl",
    "eclipse public license": "epl",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DRIFT, SHARE = 3, 0.7


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def templates(spark: SparkSession, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per template 2-gram; size is that of the templates, not of the data."""
    rows = []
    for n, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        w = text.split()
        if len(w) < 2:
            raise ValueError(f"a template has two words or more: {text!r}")
        rows += [(n, label, n < len(phrases), len(w), p, a, b) for p, (a, b) in enumerate(zip(w, w[1:]))]
    schema = "template int, label string, phrase boolean, n_template int, at int, ta string, tb string"
    return spark.createDataFrame(rows, schema).withColumn("th", F.xxhash64("ta", "tb"))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``(doc_id, tk, template.., at, pos)``: every rolling 2-gram of every text that a
    template holds; ``tk`` is a hash of the text."""
    listed = _key(docs).withColumn("w", words(F.col("text"))).drop("text").filter(F.size("w") > 1)
    pairs = F.zip_with(F.col("w"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rolling = listed.select("doc_id", "tk", F.posexplode(pairs).alias("pos", "g")).select("doc_id", "tk", "pos", "g.a", "g.b").filter("b is not null")
    same = (F.xxhash64("a", "b") == F.col("th")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    return rolling.join(F.broadcast(grams), same).select("doc_id", "tk", "template", "label", "phrase", "n_template", "at", "pos")


def rising(hits: Column, size: Column) -> Column:
    """Length of the longest run of ``hits`` (an array of struct<pos, at>, ``at`` under ``size``) in which both
    numbers rise: the longest run that ends at each template position is kept in an array."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), (-h["at"]).alias("back"))))
    none = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0))

    def longer(best: Column, hit: Column) -> Column:
        at = -hit["back"]
        before = F.when(at > 0, F.array_max(F.slice(best, F.lit(1), at))).otherwise(0)
        return F.transform(best, lambda x, i: F.when(i == at, F.greatest(x, before + 1)).otherwise(x))

    return F.aggregate(ordered, none, longer, lambda best: F.array_max(best))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans ``(doc_id, tk, template, label, phrase, start, end, score, exact)``;
    word positions, end exclusive. Exact places are spans of their own."""
    doc = ["doc_id", "tk", "template", "label", "phrase", "n_template"]
    votes = found.withColumn("diagonal", F.col("pos") - F.col("at"))
    # written once: exact places and merged spans both come from it
    votes = materialize(votes.groupBy(*doc, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high")))
    full = F.col("n_template") - 1
    exact = votes.filter(F.size("ats") == full)
    places = exact.select("doc_id", "tk", "template", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_template")).alias("end"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    along = Window.partitionBy("doc_id", "tk", "template").orderBy("diagonal")
    drift = F.least(F.lit(DRIFT), F.floor(F.col("n_template") / 4).cast("int"))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int"), F.lit(1))
    near_by = F.collect_list(F.struct("diagonal", "ats", "low", "high")).over(along.rangeBetween(0, DRIFT))
    merged = votes.filter("not phrase").withColumn("island", F.sum(apart).over(along)).withColumn("whole", F.size("ats") == full)
    merged = merged.withColumn("near", F.filter(near_by, lambda v: v["diagonal"] - F.col("diagonal") <= drift))
    merged = merged.withColumn("hits", F.flatten(F.transform("near", lambda v: F.transform(v["ats"], lambda a: F.struct((v["diagonal"] + a).alias("pos"), a.alias("at"))))))
    enough = F.size(F.array_distinct(F.col("hits.at"))) >= SHARE * full
    merged = merged.withColumns({"votes": F.when(enough, rising(F.col("hits"), full)).otherwise(0), "start": F.array_min(F.col("near.low")), "end": F.array_max(F.col("near.high")) + 2})
    best = merged.groupBy(*doc, "island").agg(F.bool_or("whole").alias("whole"), F.max_by(F.struct("votes", "start", "end"), F.struct("votes", -F.col("diagonal"))).alias("b"))
    score = F.col("b.votes") / full
    near = best.filter(~F.col("whole") & (score >= SHARE)).select("doc_id", "tk", "template", "label", "phrase", "b.start", "b.end", score.alias("score"), F.lit(False).alias("exact"))
    return places.unionByName(near)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_base (places of phrases),
    first_word, last_word (smallest and largest start of such a place), base_labels,
    labels (with the notices'; both sorted and joined by commas), score (the best
    verified span's share of votes, 0 without one)."""
    found = spans(hits(docs, templates(docs.sparkSession, phrases, notices)))
    base = F.col("phrase") & F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_doc = found.groupBy("doc_id", "tk").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    per_doc = per_doc.withColumnsRenamed({"doc_id": "d", "tk": "k"})
    rows = _key(docs).select("doc_id", "tk", F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(per_doc, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["tk"] == F.col("k")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
