"""License scans by diagonal voting, in DataFrame operations only.

Templates are word sequences.  All rolling word k-grams of the documents are joined with the
templates' positions by hash; a hit at document word p and template word t votes for
the diagonal p - t, and the gram's words are compared, so a hash collision never votes.
Votes are added up by (document, template, diagonal), neighbouring diagonals of a long
template are merged into a span (words put in or left out move the diagonal), and a
span is verified by the share of template words that its hits cover: all of a
phrase on one diagonal, `COVER` of a long template.

The templates are a fixed, small table: they are broadcast if they have at most
`BROADCAST_GRAMS` grams and joined by a shuffle otherwise.

Defined results: a null text has no words and no places; repeated rows return a row
each; a null id is kept; places of different phrases may overlap and each counts; an empty
table returns no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import text_of, written

LONG, SHORT = 5, 2
COVER = 0.6
#: Diagonals this close belong to one span.
DRIFT = 8
BROADCAST_GRAMS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        import re

        return [w for w in re.split(SEPARATORS, self.text.translate(str.maketrans(_UPPER, _LOWER))) if w]

    @property
    def width(self) -> int:
        """The gram length: phrases vote with pairs of words, texts with longer grams."""
        return LONG if len(self.words) >= 3 * LONG else SHORT


# Phrases and opening texts of public licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def words_of(text: Column) -> Column:
    """The words of a text: runs of 0-9, a-z (after lower-casing A-Z) and characters beyond ASCII."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def grams(words: Column, width: int) -> Column:
    """The rolling grams, space-joined, by position."""
    first = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(first, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, width)]))


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(tpl, at, total, width, gram, h) for each gram of each template."""
    rows = [(n, at, len(t.words), t.width, " ".join(t.words[at : at + t.width])) for n, t in enumerate(templates) for at in range(len(t.words) - t.width + 1)]
    found = spark.createDataFrame(rows, "tpl int, at int, total int, width int, gram string").withColumn("h", F.xxhash64("gram"))
    return F.broadcast(found) if len(rows) <= BROADCAST_GRAMS else found


def places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, tpl, first, last, cover): the verified spans; h tells texts with the same id apart, first and last are words from 0."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(docs, text_col)).alias("h"), words_of(text_of(docs, text_col)).alias("words"))
    widths = sorted({t.width for t in templates})
    rolled = [source.select("id", "h", F.posexplode(grams(F.col("words"), k)).alias("pos", "gram")) for k in widths]
    library = template_grams(docs.sparkSession, templates)
    hits = None
    for k, one in zip(widths, rolled, strict=True):
        mine = library.filter(F.col("width") == k).select("tpl", "at", "total", F.col("gram").alias("g"), F.col("h").alias("gh"))
        mine = F.broadcast(mine) if sum(max(0, len(t.words) - t.width + 1) for t in templates) <= BROADCAST_GRAMS else mine
        voted = one.join(mine, (F.xxhash64("gram") == F.col("gh")) & (F.col("gram") == F.col("g"))).select("id", "h", "tpl", "total", F.lit(k).alias("width"), "pos", "at")
        hits = voted if hits is None else hits.unionByName(voted)
    # One vote for each template position of a diagonal, however often a row is repeated.
    diagonal = hits.groupBy("id", "h", "tpl", "total", "width", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    phrase = diagonal.filter((F.col("width") == SHORT) & (F.size("ats") == F.col("total") - SHORT + 1)).select("id", "h", "tpl", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("total") - 1).alias("last"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy("id", "h", "tpl")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by.orderBy("diagonal")) > DRIFT).cast("int")
    merged = diagonal.filter(F.col("width") != SHORT).withColumn("new", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("new").over(by.orderBy("diagonal")))
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("width") - 1))))
    spans = (
        merged.withColumns({"low": F.col("diagonal") + F.array_min("ats"), "high": F.col("diagonal") + F.array_max("ats") + F.col("width") - 1, "words": covered})
        .groupBy("id", "h", "tpl", "run", "total")
        .agg(F.min("low").alias("first"), F.max("high").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n"))
        .withColumn("cover", F.round(F.col("n") / F.col("total"), 6))
        .filter(F.col("cover") >= COVER)
    )
    return phrase.unionByName(spans.select("id", "h", "tpl", "first", "last", "cover"))


def labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, the base places and labels, all labels, and the best cover as `score`."""
    table = docs.sparkSession.createDataFrame([(n, t.label, t.base) for n, t in enumerate(templates)], "tpl int, label string, base boolean")
    found = places(docs, templates, id_col, text_col).join(F.broadcast(table), "tpl")
    mine = F.col("base")
    summed = found.groupBy("id", "h").agg(
        F.count_if(mine).alias("n_base"),
        F.min(F.when(mine, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(mine, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(mine, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(docs, text_col)).alias("h"), F.size(words_of(text_of(docs, text_col))).cast("long").alias("n_words"))
    # A written table: Spark knows its size, and can split the documents of an id and text that hold much of the rows.
    joined = base.join(written(summed, "licenses").withColumnsRenamed({"id": "i", "h": "k"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left")
    return joined.select("id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
