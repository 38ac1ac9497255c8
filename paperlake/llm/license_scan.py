"""Licence scan by a positional rare-token index (native DataFrame operators only).

Templates are short licence notices. Their rare words (words in few templates) have postings (template, position). A file
looks up the postings of all its licence words, which weigh by their IDF over all files; postings that agree on the offset
file position - template position are one alignment; an alignment counts if it covers enough of the template's IDF mass and
the template's mandatory phrase stands where the alignment says, give or take SLACK words.

Defined results: null and empty texts have no words, no places and no labels; repeated rows are scanned one by one.
Words are compared after lower-casing A-Z only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import store, table

#: The phrases and labels that every scan reports.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as their licences ask for them: label, mandatory phrase, text. A parameter of scan().
TEMPLATES = (
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3.0", "gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the terms of the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "licensed under the terms of the gnu affero general public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "isc license", "released under the isc license"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc0", "cc0 1 0 universal", "released under cc0 1 0 universal public domain dedication"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
)
#: Splits text into words; A-Z need no lower-casing for that.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLACK = 2


def rare_words(templates=TEMPLATES, share: float = 1 / 3) -> set[str]:
    """Words in at most this share of the templates, and the first words of all phrases."""
    df: dict[str, int] = {}
    for _, _, text in templates:
        for w in set(text.split()):
            df[w] = df.get(w, 0) + 1
    firsts = {p.split()[0] for p in [*BASE_PHRASES, *(t[1] for t in templates)]}
    few = {w for w, n in df.items() if n <= share * len(templates) and len(w) > 2}
    return few - {"this", "and", "the", "with", "you", "may", "not", "use", "are", "any", "into"} | firsts


def places(words: Column, hits: Column, phrase: str) -> Column:
    """Positions at which the words of a phrase stand one after another, found from the hits of its first word."""
    first, *rest = phrase.split()

    def stands(h):
        ok = h["term"] == first
        for k, w in enumerate(rest, 1):
            ok = ok & F.coalesce(F.get(words, h["pos"] + k) == w, F.lit(False))
        return ok

    return F.transform(F.filter(hits, stands), lambda h: h["pos"])


def scan(docs: DataFrame, *, templates=TEMPLATES, min_coverage: float = 0.3) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, labels and score. See the module for the method."""
    vocabulary = sorted(rare_words(templates))
    phrases = sorted({*BASE_PHRASES, *(t[1] for t in templates)})
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() may turn a letter outside ASCII into one inside; such words are told by the raw word at their place
    step = docs.select("doc_id", t.alias("t")).select("doc_id", "t", F.array_remove(F.split("t", NOT_WORD), "").alias("raw"))
    step = step.select("doc_id", F.xxhash64("t").alias("text_hash"), "raw", F.when(F.lower("t") == F.col("t"), F.col("raw")).otherwise(F.array_remove(F.split(F.lower("t"), NOT_WORD), "")).alias("w"))
    some = F.arrays_overlap("w", F.array(*map(F.lit, vocabulary)))
    found = F.filter(F.transform("w", lambda x, i: F.when(x.isin(vocabulary), i)), lambda i: i.isNotNull())
    step = step.select("*", F.when(some, found).otherwise(F.array().cast("array<int>")).alias("at"))
    at = F.filter("at", lambda i: F.get("raw", i).rlike(r"^[0-9A-Za-z]+$"))
    step = step.select("*", F.transform(at, lambda i: F.struct(F.get("w", i).alias("term"), i.alias("pos"))).alias("hits"))
    held = store(step.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "hits",
        F.struct(*[places(F.col("w"), F.col("hits"), p).alias(f"p{k}") for k, p in enumerate(phrases)]).alias("places")), "licence-hits")

    # IDF over all files: at most len(vocabulary) rows come to the driver
    counts = held.where(F.size("hits") > 0).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["term"]))).alias("term")).groupBy("term").count().collect()
    n_docs = held.count()
    df = {r["term"]: r["count"] for r in counts}
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    postings = [(k, w, p, idf[w]) for k, (_, _, text) in enumerate(templates) for p, w in enumerate(text.split()) if w in idf]
    masses = [sum(x[3] for x in postings if x[0] == k) for k in range(len(templates))]

    # every licence word of a file is looked up in the postings; one row per (file, template, offset) is left
    files = held.where(F.size("hits") > 0).select("doc_id", "text_hash", "hits", "places").dropDuplicates(["doc_id", "text_hash"])
    looked = files.select("doc_id", "text_hash", F.explode("hits").alias("h"))
    spark = docs.sparkSession
    index = spark.createDataFrame(postings, "template int, term string, tpos int, idf double")
    aligned = (
        looked.select("doc_id", "text_hash", F.col("h.term").alias("term"), F.col("h.pos").alias("pos"))
        .join(F.broadcast(index), "term")  # the postings of the templates: a parameter, not data
        .groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("tpos")).alias("offset"))
        .agg(F.sum("idf").alias("mass"))
    )
    size = F.element_at(F.array(*[F.lit(m) for m in masses]), F.col("template") + 1)
    aligned = aligned.select("doc_id", "text_hash", "template", "offset", F.least(F.lit(1.0), F.col("mass") / size).alias("coverage")).where(F.col("coverage") >= min_coverage)
    # verify the mandatory phrase near the aligned place
    verified = None
    for k, (label, phrase, text) in enumerate(templates):
        words = text.split()
        lead = next((i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()), 0)
        here = F.exists(F.col("places")[f"p{phrases.index(phrase)}"], lambda p: F.abs(p - F.col("offset") - F.lit(lead)) <= SLACK)  # noqa: B023
        ok = F.when((F.col("template") == k) & here, F.lit(label))
        verified = ok if verified is None else F.coalesce(verified, ok)
    # files with a licence word only, by sort-merge on both sides: Spark may split hot partitions
    proven = (
        aligned.alias("a").join(files.select("doc_id", "text_hash", "places").alias("f").hint("merge"), F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.text_hash") == F.col("f.text_hash")))
        .select("a.doc_id", "a.text_hash", "coverage", verified.alias("label")).where("label is not null")
        .groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    )
    base = F.concat(*[F.col("places")[f"p{phrases.index(p)}"] for p in BASE_PHRASES])
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.col("places")[f"p{phrases.index(p)}"]) > 0, F.lit(label)) for p, label in BASE_PHRASES.items()]))
    out = held.select("doc_id", "text_hash", "n_words", base.alias("base"), F.sort_array(base_labels).alias("base_labels"))
    out = out.alias("d").join(proven.alias("v").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.text_hash") == F.col("v.text_hash")), "left")
    labels = F.sort_array(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce("coverage", F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
