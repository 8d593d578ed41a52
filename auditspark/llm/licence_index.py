"""Licence scan by a positional rare-token index.

Licence notices are templates; every content word of a template is posted with its position. A file's words are reduced
to those that any template holds, with their positions, in one pass over the text. Document frequencies of these
words over all files give their IDF. A posting moves the file's position back by the template's; words of one notice agree on
where it starts. The places where at least LEAST_SHARE of a template's words agree, two at least, are its candidates. Of each
template only the rarest postings are looked up, one more than a candidate may lack, so every candidate is found by
one of them; its share is then counted from all words of the file around it. A candidate counts if the template's key phrase
stands at its position from there. The base phrases are key phrases as well: they count wherever their words stand in
a row, since all their words are in the index.

Defined cases: null and empty texts have no words, no labels and score 0; every text is scanned whole; repeated rows
repeat (rows are told apart by number, not by doc_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import lower_ascii, text_or_empty
from auditspark.session import cut_lineage

# The contract's words, phrases and labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> (opening words of the public notice, key phrase in it made of content words)
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", "binary forms"),
    "cc": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    "lgpl": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
             "software foundation", "lesser general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "hereby granted"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
}
#: Function words, which aren't posted.
COMMON = frozenset("a an and any are as at by can for if in into is it may not of or that the this to under use v with without you 0 2 4".split())
#: Of a template's content words so many must agree on its start.
LEAST_SHARE = 0.6


def postings(templates: dict[str, tuple[str, str]] | None = None) -> dict[str, list[tuple[str, int]]]:
    found: dict[str, list[tuple[str, int]]] = {}
    for label, (notice, _) in (templates or TEMPLATES).items():
        for at, word in enumerate(notice.split()):
            if word not in COMMON:
                found.setdefault(word, []).append((label, at))
    return found


def hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words and hits: position and word of every word of the vocabulary, in order."""
    words = F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(f"({WORD})"), F.lit(1))
    found = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    return docs.select("doc_id", words.alias("_words")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("_words").cast("long").alias("n_words"), found.alias("hits"))


def places(phrase: str, hit: Column) -> Column:
    """Positions at which the phrase's words stand in a row."""
    words = phrase.split()

    def here(j: Column) -> Column:
        parts = [F.get(hit, j + k) for k in range(len(words))]
        tests = [p["word"] == w for p, w in zip(parts, words)] + [p["at"] == parts[0]["at"] + k for k, p in enumerate(parts) if k]
        return F.coalesce(functools.reduce(operator.and_, tests), F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size(hit) - 1), here)
    return F.when(F.size(hit) >= len(words), F.transform(starts, lambda j: F.get(hit, j)["at"])).otherwise(F.array().cast("array<int>"))


def idf(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Of every word of the vocabulary, over all rows; the table has one row for each word of the templates."""
    n = rows.count()
    words = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["word"]: r["n"] for r in words.collect()}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


def rarest(posted: dict[str, list[tuple[str, int]]], rarity: dict[str, float]) -> dict[str, list[tuple[str, int]]]:
    """Of every template the rarest postings, so many that a start on which none of them agrees lacks too many words."""
    own: dict[str, list[tuple[float, str, int]]] = {}
    for word, places_ in posted.items():
        for label, at in places_:
            own.setdefault(label, []).append((-rarity[word], word, at))
    found: dict[str, list[tuple[str, int]]] = {}
    for label, ps in own.items():
        least = next((v for v in range(2, len(ps) + 1) if v / len(ps) >= LEAST_SHARE), len(ps))
        for _, word, at in sorted(ps)[:len(ps) - least + 1]:
            found.setdefault(word, []).append((label, at))
    return found


def candidates(rows: DataFrame, rarity: dict[str, float], posted: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """row, label, start, share of templates that agree on a start; a start comes once for each rare word that finds it."""
    held: dict[str, dict[int, str]] = {}
    for word, ps in posted.items():
        for label, at in ps:
            held.setdefault(label, {})[at] = word
    post = F.create_map(*[x for w, ps in rarest(posted, rarity).items() for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("label"), F.lit(at).alias("at")) for t, at in ps]))])
    words_of = F.create_map(*[x for t, ws in held.items() for x in (F.lit(t), F.array(*[F.lit(ws.get(i)).cast("string") for i in range(max(ws) + 1)]))])
    most = F.create_map(*[F.lit(x) for t, ws in held.items() for x in (t, len(ws))])
    length = max(max(ws) for ws in held.values()) + 1

    def found(hit: Column, j: Column) -> Column:
        first = F.greatest(j - length, F.lit(0))
        near = F.slice("hits", first + 1, F.lit(2 * length + 1))  # a template's words are no further apart

        def voted(p: Column) -> Column:
            start = hit["at"] - p["at"]
            agree = F.filter(near, lambda h: F.get(F.element_at(words_of, p["label"]), h["at"] - start) == h["word"])
            return F.struct(p["label"].alias("label"), start.alias("start"), F.size(agree).alias("votes"))

        return F.transform(F.coalesce(F.element_at(post, hit["word"]), F.array().cast("array<struct<label:string,at:int>>")), voted)

    votes = rows.where(F.size("hits") >= 2).select("row", F.explode(F.flatten(F.transform("hits", found))).alias("_v"))
    share = F.col("_v.votes") / F.element_at(most, F.col("_v.label"))
    return votes.where((F.col("_v.votes") >= 2) & (share >= LEAST_SHARE)).select("row", "_v.label", "_v.start", share.alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    posted = postings()
    vocabulary = sorted({*posted, *" ".join(BASE).split()} | {w for _, key in TEMPLATES.values() for w in key.split()})
    rows = cut_lineage(hits(docs, vocabulary))  # the text is read once; hits are few
    rarity = idf(rows, vocabulary)

    keys = sorted({key for _, key in TEMPLATES.values()})
    offsets = F.create_map(*[F.lit(x) for t, (notice, key) in TEMPLATES.items() for x in (t, len(f" {notice} "[:f" {notice} ".index(f" {key} ")].split()))])
    key_places = F.create_map(*[x for k in keys for x in (F.lit(k), places(k, F.col("hits")))])
    key_of = F.create_map(*[F.lit(x) for t, (_, key) in TEMPLATES.items() for x in (t, key)])
    near = candidates(rows, rarity, posted).join(rows.select("row", key_places.alias("_keys")), "row")
    stands = F.array_contains(F.element_at("_keys", F.element_at(key_of, F.col("label"))), F.col("start") + F.element_at(offsets, F.col("label")))
    added = near.where(stands).groupBy("row").agg(F.collect_set("label").alias("_added"), F.max("share").alias("_share"))  # a label of each template at most

    base = [(label, places(phrase, F.col("hits"))) for phrase, label in BASE.items()]
    based = rows.select("row", "doc_id", "n_words", *[p.alias(f"_{label}") for label, p in base])
    everywhere = F.concat(*[F.col(f"_{label}") for label in BASE.values()])
    named = F.array_compact(F.array(*[F.when(F.size(f"_{label}") > 0, F.lit(label)) for label in sorted(BASE.values())]))
    joined = based.join(added, "row", "left")
    n_base = F.size(everywhere).cast("long")
    return joined.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(everywhere).cast("long").alias("first_word"), F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_join(named, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(named, F.coalesce("_added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))
