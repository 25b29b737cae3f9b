"""License scan with a positional index of rare template words; built-in functions only.

Document frequencies of all template words are counted over the whole corpus. Each template is indexed with positions
under the rarest word (highest IDF) of each of its mandatory phrases and then its rarest words that the corpus has at
all; one whose phrases hold a word that the corpus lacks cannot occur. A document's index words are looked up,
postings are intersected by relative position (template start = word position - template position), and a start where
enough rare words agree is verified: the template's mandatory phrases must stand in the window around it.

Phrases with a label of their own (``BASE``) are counted everywhere and exactly. Defined results: null and empty
texts have no words, no labels and score 0; rows that share a doc_id are told apart by their texts; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.nativewords import words
from lodestrata.llm.storage import materialise

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, template, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "obtaining a copy"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it", "general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution", "international license"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["without fee"]),
]

#: Rare words that index a template; how many must agree on a start; words of slack around the window.
INDEX_WORDS, AGREE, SLACK = 4, 2, 3


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _base(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_words, the exact phrases' columns and the distinct template words it holds."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), words(F.col("text")).alias("words"))
    rows = rows.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("found"),
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"),
    )
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    for i, phrase in enumerate(BASE):
        parts = F.when(F.contains("line", F.lit(f" {phrase} ")), F.split("line", f" {phrase}(?= )", -1))
        rows = rows.withColumn(f"parts{i}", parts)
    for i, phrase in enumerate(BASE):
        head, tail = F.element_at(f"parts{i}", 1), F.element_at(f"parts{i}", -1)
        rows = rows.withColumns({
            f"n{i}": F.coalesce(F.size(f"parts{i}") - 1, F.lit(0)).cast("long"), f"first{i}": spaces(head),
            f"last{i}": F.col("n_words") - (spaces(tail) - 1) - len(phrase.split()),
        })
        rows = rows.withColumn(f"n{i}", F.greatest(F.col(f"n{i}"), F.lit(0)))
    labels = F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))
    n = range(len(BASE))
    return rows.select(
        "doc_id", "text_key", "n_words", "found", reduce(lambda a, b: a + b, (F.col(f"n{i}") for i in n)).alias("n_base"),
        F.least(*(F.col(f"first{i}") for i in n)).alias("first_word"), F.greatest(*(F.col(f"last{i}") for i in n)).alias("last_word"), labels.alias("base"),
    )


def index_postings(base: DataFrame) -> list[tuple[int, str, int]]:
    """(template, word, position) of each template's index words; as many rows as the templates have words at most."""
    counted = base.select(F.explode("found").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r["word"]: r["df"] for r in counted.collect()}  # template words only
    rarest = lambda some: sorted(some, key=lambda w: (df[w], -len(w), w))
    postings = []
    for t, (_, template, phrases) in enumerate(TEMPLATES):
        terms = template.split()
        if any(w not in df for p in phrases for w in p.split()):
            continue
        first = {rarest(p.split())[0] for p in phrases}
        chosen = [*rarest(first), *rarest({w for w in terms if w in df} - first)][:INDEX_WORDS]
        postings += [(t, w, p) for p, w in enumerate(terms) if w in chosen]
    return postings


def matches(docs: DataFrame, postings: list[tuple[int, str, int]]) -> DataFrame:
    """Verified template matches: doc_id, text_key, template, label, start, score."""
    spark = docs.sparkSession
    keys = sorted({w for _, w, _ in postings})
    index = spark.createDataFrame(
        [(t, w, p, TEMPLATES[t][0], TEMPLATES[t][1], len(TEMPLATES[t][1].split()), min(AGREE, len({x for u, x, _ in postings if u == t})), [f" {x} " for x in TEMPLATES[t][2]]) for t, w, p in postings],
        "template int, word string, at int, label string, wording string, n int, need int, phrases array<string>",
    )
    likely = docs.where(F.col("text").rlike("(?i)" + "|".join(keys))) if keys else docs.where("false")  # a superset that spares most texts the split
    rows = likely.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), words(F.col("text")).alias("words"))
    hits = rows.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word")).where(F.col("word").isin(keys))
    hits = hits.join(F.broadcast(index), "word").withColumn("start", F.col("pos") - F.col("at"))
    low = F.greatest(F.col("start") - SLACK, F.lit(0))
    window = F.array_join(F.slice("words", low + 1, F.col("start") + F.col("n") + SLACK - low), " ")
    exact = F.array_join(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n")), " ")
    hits = hits.where("start + n > 0").select("doc_id", "text_key", "template", "label", "start", "word", "need", "phrases", "wording", F.concat(F.lit(" "), window, F.lit(" ")).alias("window"), exact.alias("exact"))
    found = hits.groupBy("doc_id", "text_key", "template", "label", "start", "need", "phrases", "wording").agg(F.count_distinct("word").alias("agree"), F.min("window").alias("window"), F.min("exact").alias("exact"))
    found = found.where("agree >= need").where(F.forall("phrases", lambda p: F.contains(F.col("window"), p)))
    same = F.size(F.filter(F.zip_with(F.split("wording", " "), F.split("exact", " "), lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return found.select("doc_id", "text_key", "template", "label", "start", (same / F.greatest(F.size(F.split("wording", " ")), F.size(F.split("exact", " ")))).alias("score"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = materialise(_base(docs), "licenses")
    found = matches(docs, index_postings(base)).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("best", F.lit(0.0)), (F.col("n_base") > 0).cast("double")), 6).alias("score"),
    )
