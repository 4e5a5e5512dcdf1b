"""License scan: a positional rare-token index over licence texts.

The index holds, for each word of the templates below, the postings (template, position).  A place
can only be a template's if all words of its mandatory key phrases stand there, so it is enough to look
up, of each template, the ``rare_words`` mandatory words of the highest inverse document frequency over the whole
table: every pair of a file position and one of their postings votes for the place ``file position - template
position``, and a place that has the votes of all of them is a candidate.  It is verified when every mandatory word
stands at its relative position, and ``MIN_VOTES`` words that aren't common.  Which words are the rarest
depends on the other documents, the result does not.  The score of a place is the share of the template's words
found in position.

Everything is DataFrame expressions: one pass over the texts keeps only licence words of files
that hold a trigger word, and the joins run on those.  The index is a constant of this module
(a few hundred rows), so its size is bounded.

Defined results: a null text counts as empty and has no words; each row is a file of its own,
repeated ids included; a null id is kept as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import ascii_lower, cut_lineage, read_table, row_id

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label of each base phrase.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, licence text or notice, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction",
     ["permission is hereby granted free of charge", "software without restriction"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted", ["permission to use copy modify", "without fee is hereby granted"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3",
     ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2",
     ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License, v. 2.0",
     ["eclipse public license v 2 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc0-1.0", "CC0 1.0 Universal public domain dedication", ["cc0 1 0 universal"]),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ["free and unencumbered software", "public domain"]),
]

# Words of the templates that say nothing about a licence.
COMMON = set("a and any are by for in into is of or over that the this to use with 0 1 2 3 4 v".split())

#: Words that a base phrase can be recognised by.
BASE_TRIGGERS = {"cc", "public", "reserved"}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def index_rows() -> list[tuple[int, str, int, str, bool, bool]]:
    """(template, label, position, word, in a key phrase, looked up) for every word of every template."""
    rows = []
    for tid, (label, text, phrases) in enumerate(TEMPLATES):
        words, needed = words_of(text), set()
        for phrase in phrases:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i:i + len(p)] == p)
            needed |= set(range(at, at + len(p)))
        rows += [(tid, label, i, w, i in needed, w not in COMMON) for i, w in enumerate(words)]
    return rows


INDEX = index_rows()
VOCABULARY = sorted({r[3] for r in INDEX} | {w for p in BASE for w in p.split()})
RARE = sorted({r[3] for r in INDEX if r[5]})
MIN_VOTES = 2


def _index(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("tid", "label", "tpos", "word", "key", "rare"), r)))
            for r in INDEX]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _base_places(w: Column) -> Column:
    """Array of (start, label) of every place where a base phrase's words stand consecutively."""
    at = F.sequence(F.lit(0), F.size(w) - 1)

    def stands(i: Column, phrase: str) -> Column:
        parts = phrase.split()
        cond = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            cond = cond & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return cond

    def places(phrase: str, label: str) -> Column:
        return F.transform(F.filter(at, lambda i: stands(i, phrase)),
                           lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    found = [places(p, label) for p, label in BASE.items()]
    return F.concat(*found)


def read_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _row, id, n_words, base places, and the licence words with their positions."""
    triggers = sorted(BASE_TRIGGERS | set(RARE))
    words = docs.select(F.col(id_col).alias("_id"), F.regexp_extract_all(
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("_w"))
    words = words.withColumn("_has", F.exists("_w", lambda x: x.isin(*triggers)))
    w = F.col("_w")
    hits = F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(*VOCABULARY)),
                       lambda i: F.struct(i.alias("pos"), F.get(w, i).alias("word")))
    return row_id(words.select(
        "_id", F.size(w).cast("long").alias("_n_words"),
        F.when(F.col("_has"), _base_places(w)).alias("_places"), F.when(F.col("_has"), hits).alias("_hits")))


def lookups(files: DataFrame, rare_words: int) -> DataFrame:
    """(tid, word, tpos, need): each template's ``rare_words`` mandatory words that the fewest files hold."""
    index = _index(files.sparkSession)
    held = (files.where(F.col("_hits").isNotNull()).select(F.explode(F.array_distinct("_hits.word")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    n = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1))
    # the index is a constant of some 200 rows
    rank = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("idf"), "word", "tpos"))
    return (index.where("key").join(held, "word", "left").withColumn("idf", idf).withColumn("rank", rank)
            .where(F.col("rank") <= rare_words).select("tid", "word", "tpos")
            .withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("tid"))))


def find_licenses(files: DataFrame, rare_words: int = 2) -> DataFrame:
    """Verified placements of templates: _row, label, start, score."""
    index = _index(files.sparkSession)
    hits = files.where(F.col("_hits").isNotNull()).select("_row", F.inline("_hits"))
    places = (hits.join(F.broadcast(lookups(files, rare_words)), "word")
              .groupBy("_row", "tid", "need", (F.col("pos") - F.col("tpos")).alias("start"))
              .agg(F.count(F.lit(1)).alias("votes")).where("votes = need").select("_row", "tid", "start"))
    need = (index.groupBy("tid").agg(F.least(F.lit(MIN_VOTES), F.count_if("rare")).alias("need"),
                                     F.count_if("key").alias("n_key"), F.count(F.lit(1)).alias("n_all")))
    return (places.join(index.select("tid", "label", "tpos", "word", "key", "rare"), "tid")
            .withColumn("pos", F.col("start") + F.col("tpos")).join(hits, ["_row", "pos", "word"])
            .groupBy("_row", "tid", "label", "start")
            .agg(F.count_if("key").alias("k"), F.count_if("rare").alias("votes"), F.count(F.lit(1)).alias("m"))
            .join(need, "tid").where((F.col("k") == F.col("n_key")) & (F.col("votes") >= F.col("need")))
            .select("_row", "label", "start", (F.col("m") / F.col("n_all")).alias("score")))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  rare_words: int = 2) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best verified placement's; 0.5 if only base phrases stand there, else 0.
    """
    files = cut_lineage(read_files(docs, id_col, text_col), "license-files")
    found = (find_licenses(files, rare_words).groupBy("_row")
             .agg(F.collect_set("label").alias("_found"), F.max("score").alias("_score")))
    places = F.coalesce(F.col("_places"), F.array().cast("array<struct<start:int,label:string>>"))
    base = F.array_distinct(places["label"])
    labels = F.array_distinct(F.concat(base, F.coalesce(F.col("_found"), F.array().cast("array<string>"))))
    starts = places["start"]
    return files.join(found, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce("_score", F.when(F.size(places) > 0, 0.5).otherwise(0.0)).alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words, base phrases and verified licences of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
