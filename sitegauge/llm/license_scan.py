"""License scan by diagonal voting.

Every run of k consecutive words of a text is hashed and joined with the positions of the same run in templates. A hit votes for a
diagonal, its place in the text less its place in the template. Diagonals of one document and template that lie within the template's
``gap`` are merged (inserted or missing words shift them), and a merged span is a match when it holds at least the template's
``share`` of runs and is no longer than twice the template. Phrases have no gap and need all their runs: these are exact places.

Only DataFrame functions. The templates are constants, so their table is broadcast; hits are few rows of numbers, texts never move.

* Words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z is lower-cased. NULL and empty texts have none:
  zero counts, NULL positions, empty labels, score 0.
* Hits are gathered by id and digest of the text, so rows equal in both get equal results and stay; NULL ids take part.
* Spans may overlap, also those of several templates. A very long text is one row of words while it is cut into runs.
* Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    k: int
    gap: int
    share: float
    base: bool


def phrase(label: str, text: str, base: bool = False) -> Template:
    """All words must stand consecutively."""
    return Template(label, tuple(text.split()), 2, 0, 1.0, base)


def notice(label: str, text: str) -> Template:
    """Most words must stand in order; up to eight may be put in or left out at a place."""
    return Template(label, tuple(text.split()), 4, 8, 0.7, False)


#: The phrases every scan has to report.
BASE = (phrase("cc-by", "cc by", True), phrase("gpl", "general public license", True), phrase("reserved", "all rights reserved", True))

#: Names of licenses, and the wording of common notices.
OWN = (
    phrase("mit", "mit license"), phrase("apache-2.0", "apache license version 2 0"), phrase("mpl-2.0", "mozilla public license version 2 0"),
    phrase("bsd", "bsd license"), phrase("cc-by-nc", "cc by nc"), phrase("cc-by-sa", "cc by sa"), phrase("cc-by", "creative commons attribution"),
    phrase("lgpl", "lesser general public license"), phrase("agpl", "affero general public license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                  "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                  "publish distribute sublicense and or sell copies of the software"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met"),
    notice("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                  "published by the free software foundation"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
TEMPLATES = BASE + OWN


def words_of(text: Column) -> Column:
    """Words of a text; other letters than A-Z keep their case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _runs(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(template, at, run, k): a row for each run of each template, a few hundred constants."""
    rows = [(i, at, list(t.words[at:at + t.k])) for i, t in enumerate(templates) for at in range(len(t.words) - t.k + 1)]
    table = spark.createDataFrame(rows, "template int, at int, run array<string>")
    hashed = F.lit(None).cast("bigint")
    for k in {t.k for t in templates}:
        hashed = F.when(F.size("run") == k, F.xxhash64(*[F.col("run")[j] for j in range(k)])).otherwise(hashed)
    return table.withColumn("hash", hashed)


def hits(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, digest, template, diagonal, runs): the places of a template that vote for each diagonal."""
    sizes = sorted({t.k for t in templates})
    words = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), words_of(F.col("text")).alias("w"))
    shifted = [F.slice("w", F.lit(j + 1), F.greatest(F.size("w"), F.lit(1))).alias(f"w{j}") for j in range(max(sizes))]
    rolled = words.select("doc_id", "digest", F.posexplode(F.arrays_zip(*shifted)).alias("place", "z"))
    names = [F.col("z")[f"w{j}"] for j in range(max(sizes))]
    # Behind the last word of a text stand NULLs: no run.
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.when(names[k - 1].isNotNull(), F.xxhash64(*names[:k])).alias("hash")) for k in sizes])
    grams = rolled.select("doc_id", "digest", "place", "z", F.explode(each).alias("g")).filter("g.hash IS NOT NULL")
    seen = F.slice(F.array(*names), F.lit(1), F.col("g.k"))
    runs = F.broadcast(_runs(docs.sparkSession, templates))
    met = grams.join(runs, F.col("g.hash") == runs["hash"]).filter(seen == F.col("run"))
    return met.groupBy("doc_id", "digest", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("runs"))


def spans(votes: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, digest, template, first, last, found): merged diagonals, with the first and last word and the share of runs found."""
    def of(value) -> Column:
        return F.element_at(F.array(*[F.lit(value(t)) for t in templates]), F.col("template") + 1)
    # A group is what one text holds of one template.
    along = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > of(lambda t: t.gap), F.lit(True))
    numbered = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    merged = numbered.groupBy("doc_id", "digest", "template", "span").agg(
        F.min(F.col("diagonal") + F.array_min("runs")).alias("first"),
        (F.max(F.col("diagonal") + F.array_max("runs")) + of(lambda t: t.k) - 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("held"))
    share = (F.col("held") / of(lambda t: len(t.words) - t.k + 1)).alias("found")
    verified = (F.col("found") >= of(lambda t: t.share)) & (F.col("last") - F.col("first") < 2 * of(lambda t: len(t.words)))
    return merged.select("doc_id", "digest", "template", "first", "last", share).withColumn("verified", verified)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is the largest share of a template that one span holds, be it verified or not.
    """
    found = spans(hits(docs, templates), templates)
    base = F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.col("template") + 1) & F.col("verified")
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, label))), ",")
    by_text = found.groupBy("doc_id", "digest").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("verified")).alias("labels"), F.max("found").alias("score"))
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
                       F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(by_text["doc_id"]) & (rows["digest"] == by_text["digest"])
    return rows.join(by_text, same, "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
