"""License scans by diagonal voting, in DataFrame operations only.

Templates are word sequences. All rolling word k-gram hashes of every text are joined with the k-grams' template
positions; a hit at word w and template position t votes for the diagonal w - t, that is for the place where the
template would start. Votes are summed by diagonal, diagonals that are at most SHIFT apart are merged (words put in or
left out move the rest of a notice to a neighbouring diagonal), and a merged span counts where its grams, compared as
text, cover enough of the template: all of it for a base phrase, COVERAGE of it and its telling phrases for a notice.

A text is split into words once and exploded in generated code; what is shuffled is one row for each document (its
sentinel, which brings the word count) and one for each hit. The template table is broadcast below MAX_GRAMS rows, and
left to the planner beyond. Hits are grouped by document, so a document's own length bounds its group.

Defined results: null text is the empty text; a text without a phrase has n_base 0, null first_word and last_word, and
empty labels; repeated rows (same doc_id and text) each get a row; null doc_ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import SEPARATORS

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of common public licence notices and their labels, with the phrases that tell it from the others;
#: a span without all of them does not count, however much of the rest it covers.
NOTICES = {
    "apache-2.0": (("licensed under the apache license version 2 0", "apache license"), ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org")),
    "mit": (("released under the mit license", "mit license"), ("licensed under the mit license", "mit license"), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge")),
    "gpl-3.0": (("licensed under the gnu general public license version 3", "gnu general", "version 3"), ("gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public", "version 3")),
    "gpl-2.0": (("licensed under the gnu general public license version 2", "gnu general", "version 2"), ("gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public", "version 2")),
    "lgpl": (("licensed under the gnu lesser general public license version", "lesser general"), ("gnu lesser general public license as published by the free software foundation", "lesser general")),
    "agpl-3.0": (("licensed under the gnu affero general public license version 3", "affero general"), ("gnu affero general public license as published by the free software foundation", "affero general")),
    "bsd": (("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary"), ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote"), ("licensed under the bsd license", "bsd license")),
    "mpl-2.0": (("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"), ("licensed under the mozilla public license version 2 0", "mozilla public")),
    "cc-by-nc": (("licensed under cc by nc 4 0", "by nc"), ("licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial")),
    "cc-by-sa": (("licensed under cc by sa 4 0", "by sa"), ("licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike")),
    "cc0-1.0": (("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"), ("dedicated to the public domain under cc0 1 0 universal", "cc0 1")),
    "isc": (("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),),
    "unlicense": (("this is free and unencumbered software released into the public domain", "unencumbered software"),),
}
#: Words of a gram: of base phrases, of notices under LONG_WORDS words, of longer ones.
SHORT, MID, LONG, LONG_WORDS = 2, 3, 4, 12
SHIFT, COVERAGE = 4, 0.6
MAX_GRAMS = 100_000
_TEMPLATE = "template int, label string, is_base boolean, t_words int, t_grams int, t_marks int, gram string, t_at int, marks int"


def template_grams(base: dict[str, str], notices: dict[str, tuple[tuple[str, ...], ...]]) -> list[tuple]:
    """(template, label, is base, words, grams, all marks, gram, position, marks) for each k-gram.

    Bit n of the marks says that a gram holds the notice's n-th telling phrase. Notices have at least MID words, phrases two.
    """
    rows = []
    named = [(phrase, label, True, ()) for phrase, label in base.items()] + [(text, label, False, telling) for label, texts in notices.items() for text, *telling in texts]
    for number, (text, label, is_base, telling) in enumerate(named):
        words = text.split()
        k = SHORT if is_base else MID if len(words) < LONG_WORDS else LONG
        made = [" ".join(words[at : at + k]) for at in range(len(words) - k + 1)]
        marks = [sum((f" {phrase} " in f" {gram} ") << n for n, phrase in enumerate(telling)) for gram in made]
        rows += [(number, label, is_base, len(words), len(made), (1 << len(telling)) - 1, gram, at, marks[at]) for at, gram in enumerate(made)]
    return rows


def _gram(words: Column, at: Column, k: int) -> Column:
    """Hash of k words from `at`, null where the text ends before."""
    return F.when(at + k <= F.size(words), F.xxhash64(F.lit(k), *(F.get(words, at + i) for i in range(k))))


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, tuple[tuple[str, ...], ...]] | None = None, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, shift: int = SHIFT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    spark = docs.sparkSession
    rows = template_grams(BASE if base is None else base, NOTICES if notices is None else notices)
    templates = spark.createDataFrame(rows, _TEMPLATE)
    split = F.split("gram", " ")
    k = F.size(split)
    hashes = F.when(k == SHORT, _gram(split, F.lit(0), SHORT)).when(k == MID, _gram(split, F.lit(0), MID)).otherwise(_gram(split, F.lit(0), LONG))
    templates = templates.select(hashes.alias("hash"), *templates.columns)
    #: One row without a gram meets each document's sentinel.
    sentinel = spark.createDataFrame([(-1, "", False, 0, 0, 0, "", 0, 0)], _TEMPLATE)
    templates = templates.unionByName(sentinel.withColumn("hash", F.lit(0).cast("long")))
    templates = F.broadcast(templates) if len(rows) <= MAX_GRAMS else templates

    # The Kelvin sign is the one non-ASCII letter whose lower case is a whole ASCII word character; it must not match k.
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å"))
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.array_remove(F.split(F.lower(raw), SEPARATORS), "").alias("words"))
    each = words.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("at", "word"))
    at = F.coalesce("at", F.lit(0))
    own = [_gram(F.col("words"), at, k) for k in (SHORT, MID, LONG)]
    grams = F.when(at == 0, F.array(*own, F.lit(0).cast("long"))).otherwise(F.array(*own))
    rolled = each.select("doc_id", "text_hash", "words", at.alias("at"), F.explode(grams).alias("hash"))
    found = rolled.join(templates, "hash").filter((F.col("template") < 0) | (F.array_join(F.slice("words", F.col("at") + 1, F.size(F.split("gram", " "))), " ") == F.col("gram")))
    found = found.select("doc_id", "text_hash", F.when(F.col("template") < 0, F.size("words")).alias("n_words"), "template", "label", "is_base", "t_words", "t_grams", "t_marks", "t_at", "marks", (F.col("at") - F.col("t_at")).alias("diagonal"))

    votes = found.groupBy("doc_id", "text_hash", "template", "label", "is_base", "t_words", "t_grams", "t_marks", "diagonal").agg(F.collect_set("t_at").alias("places"), F.bit_or("marks").alias("marks"), F.max("n_words").alias("n_words"), F.count("*").alias("n_rows"))
    # Summed votes only, so that many equal rows are a row here; what follows needs a document's rows together.
    votes = votes.repartition("doc_id", "text_hash")
    order = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > shift, F.lit(True))
    spans = votes.withColumn("span", F.sum(apart.cast("int")).over(order))
    spans = spans.groupBy("doc_id", "text_hash", "template", "label", "is_base", "t_words", "t_grams", "t_marks", "span").agg(F.bit_or("marks").alias("marks"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words"), F.max("n_rows").alias("n_rows"))
    covered = F.col("votes") / F.col("t_grams")
    doc, kept = F.col("template") < 0, (F.col("template") >= 0) & (covered >= F.when(F.col("is_base"), 1.0).otherwise(coverage)) & (F.col("marks") == F.col("t_marks"))
    exact = kept & F.col("is_base")
    out = spans.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(doc, F.col("n_rows"))).alias("n_rows"),
        F.max(F.when(doc, F.col("n_words"))).cast("long").alias("n_words"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(kept, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~doc, covered)), F.lit(0.0)).alias("score"),
        F.count(F.when(kept, 1)).alias("n_spans"),
    )
    return out.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int")))).drop("row", "n_rows", "text_hash")
