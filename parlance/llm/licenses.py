"""License scans by diagonal voting, in DataFrame operations only.

Templates are phrases and notices. Every rolling k-gram of a text's words is
hashed and joined to the template positions with that hash; the words of a gram
are compared too, so equal hashes alone prove nothing. A match at text word p
and template word t votes for the diagonal p - t: on one diagonal the template
stands word by word, words put in or left out move the rest of it to a
neighbouring diagonal. Votes are counted by diagonal, neighbouring diagonals of
one template are merged, and a merged span counts once the template's positions
that it covers reach the template's threshold and it is not stretched beyond
``STRETCH`` times the template's length. A diagonal that reaches the threshold
alone is a place of its own, so text around it cannot hide it.

An exact template (threshold 1) is the place of its words standing
consecutively; its diagonals are not merged.

The templates are a stated list, so they are broadcast; all that a text keeps
after the join are its votes, and one shuffle by row brings those together.

Edge cases: a null or empty text has no words and no places; a template needs at
least k words; repeated rows, null ids and rows that share an id are rows of
their own; a place within another counts too; of a very long text no word is
left out, and its work is linear in its words and votes; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram. The shortest template has as many.
GRAM = 2
#: Longest merged span, as a multiple of its template's words.
STRETCH = 1.5

#: Between words: ASCII but letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A phrase with its label; ``threshold`` is the least share of its grams that a place must cover."""

    label: str
    text: str
    threshold: float = 0.8

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(_BETWEEN, self.text.lower()) if w]


#: Names of licenses, found word by word.
NAMES = (
    Template("gpl", "gnu general public license", 1.0),
    Template("apache", "apache license", 1.0),
    Template("cc-by", "cc by", 1.0),
    Template("mit", "mit license", 1.0),
)

#: Further names and the notices that stand for a license without naming it; fixed values.
NOTICES = (
    Template("agpl", "gnu affero general public license", 1.0),
    Template("bsd", "bsd license", 1.0),
    Template("cc-by-nc", "cc by nc", 1.0),
    Template("cc-by-sa", "cc by sa", 1.0),
    Template("cc0", "cc0 1 0 universal", 1.0),
    Template("lgpl", "gnu lesser general public license", 1.0),
    Template("mpl", "mozilla public license", 1.0),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.

    The Kelvin sign is the one other character whose lower case is an ASCII
    letter by itself; another one takes its place, as no template holds either.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("İ")))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _positions(spark: SparkSession, templates: tuple[Template, ...], gram: int) -> DataFrame:
    """(hash, g0.., template, at, grams, size, slack): every gram of every template."""
    rows = []
    for k, t in enumerate(templates):
        words = t.words
        if len(words) < gram:
            raise ValueError(f"a template needs at least {gram} words: {t.text!r}")
        grams = len(words) - gram + 1
        slack = 0 if t.threshold >= 1 else max(1, len(words) // 5)
        rows += [(*words[i : i + gram], k, i, grams, len(words), slack) for i in range(grams)]
    names = ", ".join(f"t{i} string" for i in range(gram))
    table = spark.createDataFrame(rows, f"{names}, template int, at int, grams int, size int, slack int")
    return table.withColumn("hash", F.xxhash64(*(f"t{i}" for i in range(gram))))


def votes(documents: DataFrame, templates: tuple[Template, ...], *, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, pos, template, at, grams, size, slack): a row per vote, and one for each text's start."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    counted = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"g{i}") for i in range(gram)]
    each = counted.select("row", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "g"))
    grams = each.select("row", "doc_id", "n_words", "pos", *(F.col(f"g.g{i}").alias(f"g{i}") for i in range(gram)))
    grams = grams.withColumn("hash", F.xxhash64(*(f"g{i}" for i in range(gram))))
    table = _positions(documents.sparkSession, templates, gram)
    same = [grams["hash"] == table["hash"], *(grams[f"g{i}"] == table[f"t{i}"] for i in range(gram))]
    joined = grams.join(F.broadcast(table), same, "left").where("template is not null or coalesce(pos, 0) = 0")
    return joined.select("row", "doc_id", "n_words", "pos", "template", "at", "grams", "size", "slack")


def scan_licenses(
    documents: DataFrame,
    templates: tuple[Template, ...] = NAMES + NOTICES,
    *,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, places) of each row; places: array of (label, template, first, last, coverage).

    ``template`` is its place in the list, ``first`` and ``last`` are word
    numbers from 0, ``coverage`` is the covered share of the template's grams.
    """
    threshold = F.element_at(F.array(*(F.lit(float(t.threshold)) for t in templates)), F.col("template") + 1)
    label = F.element_at(F.array(*(F.lit(t.label) for t in templates)), F.col("template") + 1)
    row = ["row", "doc_id", "n_words"]
    # Grouped and ordered by row from here on: one shuffle serves all.
    dealt = votes(documents, templates, gram=gram, doc_id=doc_id, text=text).repartition("row")
    key = [*row, "template", "grams", "size", "slack"]
    lines = dealt.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("first"),
        (F.max("pos") + gram - 1).alias("last"),
        F.collect_list("at").alias("covered"),
    )
    # A single vote beside a long template is a common word pair; the text's first one stays to stand for the text.
    weak = F.size("covered") < F.least(F.lit(2), F.col("grams"))
    lines = lines.where(F.col("template").isNull() | ~weak | (F.col("first") == 0)).withColumn("template", F.when(~weak, F.col("template")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    alone = F.size("covered") >= threshold * F.col("grams")
    marked = lines.withColumn("alone", alone).withColumn("apart", F.coalesce(apart, F.lit(True)))
    # What reaches the threshold alone starts and ends a span of its own.
    cut = F.col("apart") | F.col("alone") | F.coalesce(F.lag("alone").over(along), F.lit(False))
    spans = marked.withColumn("span", F.sum(cut.cast("long")).over(along)).groupBy(*key, "span").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.first("grams")).alias("coverage"),
    )
    holds = (F.col("coverage") >= threshold) & (F.col("last") - F.col("first") < STRETCH * F.col("size"))
    place = F.struct(label.alias("label"), "template", "first", "last", "coverage")
    return spans.groupBy(*row).agg(F.array_sort(F.collect_list(F.when(holds, place))).alias("places")).select("doc_id", "n_words", "places")


def summarise(scanned: DataFrame, names: int = len(NAMES)) -> DataFrame:
    """Counts, labels and a score of each row of ``scan_licenses``; the first ``names`` templates are the base phrases.

    ``score`` is the largest coverage of a place, 1 for a name, 0 without any.
    """
    base = F.filter("places", lambda p: p["template"] < names)
    starts = F.transform(base, lambda p: p["first"].cast("long"))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )
