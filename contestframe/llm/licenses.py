"""License scans by diagonal voting.

The words of a text and of every template are cut into rolling k-grams. A document's k-gram hashes are joined with
the templates' on the hash; a match votes for the diagonal (place in the document minus place in the
template) if the words agree. Votes are added per document, template and diagonal; diagonals that lie within a
template's `slack` of each other are merged, so words may be missing or added. A span is verified by the share of
the template's words that its votes cover. Phrases have no slack and must be covered in whole.

The templates are a fixed table of the library (some hundred rows), and that table alone is broadcast.

Defined results: null and empty texts have no words and no spans; the spans of equal rows are counted once
and every row gets them; equal ids with different texts are different documents; ids may be null; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import lowered, on_key, written

K = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A wording of a license: its label, its words, and by how many words a match may be longer or shorter."""

    label: str
    words: str
    slack: int = 0
    cover: float = 1.0


#: The phrases that name a license.
PHRASES = (
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("gpl", "general public license"),
)
#: Customary notices. Names with a version have no slack, as another version is another license.
NOTICES = (
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-notice", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", 3, 0.6),
    Template("mit-notice", "released under the mit license", 1, 0.8),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, 0.8),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 3, 0.8),
    Template("lgpl", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.8),
    Template("mpl-2.0", "mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3, 0.8),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 2, 0.8),
)
TEMPLATES = PHRASES + NOTICES


def words(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters and other non-ASCII characters, A-Z lower-cased."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _grams(found: Column) -> Column:
    """Rolling k-grams: hash and words of each, null where fewer than k words are left."""
    return F.transform(
        F.slice(found, 1, F.greatest(F.size(found) - (K - 1), F.lit(0))),
        lambda w, n: F.struct(F.xxhash64(w, F.get(found, n + 1)).alias("hash"), w.alias("one"), F.get(found, n + 1).alias("two")),
    )


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, label, slack, cover, size, place, hash and words of every k-gram of every template."""
    rows = [(n, t.label, t.slack, t.cover, t.words.split()) for n, t in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, slack int, cover double, words array<string>")
    each = frame.select("template", "label", "slack", "cover", F.size("words").alias("size"), F.posexplode(_grams(F.col("words"))).alias("place", "g"))
    return each.select("template", "label", "slack", "cover", "size", "place", F.col("g.hash").alias("t_hash"), F.col("g.one").alias("t_one"), F.col("g.two").alias("t_two"))


def find_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """_id, _sum, template, label, start, similarity of every verified span. `docs`: _id, _sum, words."""
    grams = docs.select("_id", "_sum", F.posexplode(_grams(F.col("words"))).alias("at", "g")).select("_id", "_sum", "at", "g.*")
    table = F.broadcast(template_grams(docs.sparkSession, templates))
    votes = grams.join(table, F.col("hash") == F.col("t_hash")).where("one = t_one and two = t_two")
    lines = votes.groupBy("_id", "_sum", "template", "label", "slack", "cover", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"))
    # one document's diagonals of one template
    beside = Window.partitionBy("_id", "_sum", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(beside)
    runs = lines.withColumn("new", F.when(gap <= F.col("slack"), 0).otherwise(1)).withColumn("run", F.sum("new").over(beside))
    merged = runs.groupBy("_id", "_sum", "template", "label", "cover", "size", "run").agg(
        F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("start"))
    covered = F.size(F.array_distinct(F.concat("places", F.transform("places", lambda p: p + 1))))
    spans = merged.withColumn("similarity", covered / F.col("size"))
    return spans.where("similarity >= cover").select("_id", "_sum", "template", "label", F.col("start").cast("bigint").alias("start"), "similarity")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: id, n_words, spans (label, start, similarity, phrase or not) by start."""
    own = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_sum"), words(F.col(text)).alias("words"))
    phrase = F.col("template") < len([t for t in templates if t in PHRASES])
    found = find_spans(own, templates).groupBy("_id", "_sum").agg(
        F.array_sort(F.collect_list(F.struct("start", "label", phrase.alias("phrase"), "similarity"))).alias("spans"))
    sizes = own.select("_id", "_sum", F.size("words").cast("bigint").alias("n_words"))
    return on_key(sizes, written(found)).select(F.col("_id").alias(doc_id), "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
