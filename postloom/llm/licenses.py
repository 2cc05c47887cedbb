"""License scan with a positional rare-token index.

A template is a short licence notice. Its words and their positions form postings (word -> template, position): a fixed
table of a few hundred entries. One pass over the texts counts for every template word the files that hold it, hence its
IDF: above 0 however frequent a word is, and that of a single file for a word found in none. The index holds, of each
template, the words of highest IDF that together weigh more than a notice may lack (1 - coverage of the template): a
place that holds enough of a template holds one of them. So the index needs no limit on words, and nothing is lost.

A second pass looks up the rare words of each file: where one stands, the difference of the positions says where a
template would begin. Each such beginning is then compared with the template word by word, weighed by IDF, and a template
is found where its best beginning holds at least COVERAGE of the weight and its mandatory key phrases occur in the file.
The base phrases are found beside it, whatever the templates are.

Only DataFrame functions are used. A file stays one row in both passes, and only counts of words are shuffled, so no
licence, however common, gathers rows of files.

Defined cases: null text counts as empty; no word gives n_words 0 and nulls; repeated rows and ids are files of their own;
an empty table gives an empty result.
"""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import text_of

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
COVERAGE = 0.7
LEAST = 1e-6               # weight of a word, however many files hold it

# Short notices of public licences and the key phrases that must occur; a parameter of the operator.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
            ("permission is hereby granted free of charge", "without restriction")),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "apache": ("licensed under the apache license version 2 0", ("apache license version 2",)),
    "gpl": ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("affero general public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ("permission to use copy modify", "with or without fee")),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by": ("licensed under cc by 4 0", ("cc by 4",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-nd": ("licensed under cc by nd 4 0", ("cc by nd",)),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  ("free and unencumbered software", "public domain")),
    "reserved": ("all rights reserved", ("all rights reserved",)),
}


def lowered(column: str = "text") -> Column:
    """A-Z to lower case. The Kelvin sign is the one other letter whose lower case is ASCII on its own."""
    kelvin, text = F.lit("\u212a"), text_of(column)
    return F.when(F.contains(text, kelvin), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
                  ).otherwise(F.lower(text))


def _words(low: Column) -> Column:
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def word_weights(docs: DataFrame, templates: dict) -> dict[str, float]:
    """IDF of every template word, from the files that hold it. What reaches the driver is one count a template word."""
    vocabulary = sorted({w for text, _ in templates.values() for w in text.split()})
    # the empty word stands for the file itself
    held = F.array_intersect(F.array(F.lit(""), *map(F.lit, vocabulary)), F.concat(F.array(F.lit("")), _words(lowered())))
    df = {r["word"]: r["df"] for r in
          docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    files = df.get("", 0)
    return {w: max(LEAST, log((files + 1) / df.get(w, 1))) for w in vocabulary}


def rare_words(words: list[str], idf: dict[str, float], coverage: float) -> set[str]:
    """The words of highest IDF without which less than ``coverage`` of the template's weight is left."""
    left, rare = sum(idf[w] for w in words), set()
    enough = coverage * left * (1 - 1e-9)
    for w in sorted(set(words), key=lambda w: (-idf[w], w)):
        if left < enough:
            break
        rare.add(w)
        left -= idf[w] * words.count(w)
    return rare


def _of(t: int):
    return lambda b: b["t"] == t


def _beginnings(rare: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Array of (t, at): the distinct places where a template would begin, by the rare words that stand in the file."""
    entries = [x for w, places in index.items() for x in
               (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in places]))]
    table = F.create_map(*entries)
    met = F.transform(rare, lambda h: F.transform(F.element_at(table, h["w"]), lambda p: F.struct(
        p["t"].alias("t"), (h["at"] - p["i"]).alias("at"))))
    return F.array_distinct(F.flatten(F.filter(met, lambda m: m.isNotNull())))


def scan(docs: DataFrame, templates: dict = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (template, at, score) per file."""
    docs, names = docs.select("doc_id", "text"), sorted(templates)
    idf = word_weights(docs, templates)
    index: dict[str, list[tuple[int, int]]] = {}
    for t, name in enumerate(names):
        words = templates[name][0].split()
        rare = rare_words(words, idf, coverage)
        for i, w in enumerate(words):
            if w in rare:
                index.setdefault(w, []).append((t, i))
    last = {phrase.split()[-1] for phrase in BASE}
    looked_up = sorted({*index, *last})

    # the pattern is a cheap test for files that hold a word worth a look
    edge = SEPARATOR[:-1]
    may = f"(?:^|{edge})(?:{'|'.join(looked_up)})(?:$|{edge})"
    rows = docs.select("doc_id", lowered().alias("low"))
    rows = rows.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
                       F.when(F.col("low").rlike(may), F.col("low")).alias("low"))
    rows = rows.select("doc_id", "n_words", _words(F.col("low")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: h["w"].isin(looked_up))
    rows = rows.select("doc_id", "n_words", "words", hits.alias("hits"),
                       F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))

    def base_starts(phrase: str) -> Column:
        *before, end = phrase.split()
        ends = F.filter("hits", lambda h: (h["w"] == end) & _all(
            F.get("words", h["at"] - k) == w for k, w in enumerate(reversed(before), 1)))
        return F.coalesce(F.transform(ends, lambda h: (h["at"] - len(before)).cast("long")), F.array().cast("array<bigint>"))

    weighed = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for w in templates[n][0].split()]) for n in names])
    whole = F.array(*[F.lit(sum(idf[w] for w in templates[n][0].split())) for n in names])

    def share(b: Column) -> Column:
        held = F.transform(F.get(weighed, b["t"]), lambda x, i: F.when(F.get("words", b["at"] + i) == x["w"], x["idf"]).otherwise(F.lit(0.0)))
        return F.least(F.lit(1.0), F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v) / F.get(whole, b["t"]))

    begun = F.transform(_beginnings(F.col("hits"), index), lambda b: F.struct(b["t"].alias("t"), share(b).alias("score"), (-b["at"]).alias("m")))
    rows = rows.select("doc_id", "n_words", "line", *[base_starts(p).alias(f"base_{label}") for p, label in BASE.items()],
                       F.filter(begun, lambda b: b["score"] >= coverage * (1 - 1e-9)).alias("begun"))
    best = [F.when(_all(F.contains("line", F.lit(f" {p} ")) for p in templates[name][1]),
                   F.array_max(F.filter("begun", _of(t)))) for t, name in enumerate(names)]
    found = F.array(*[F.when(b.isNotNull(), F.struct(F.lit(name).alias("template"), (-b["m"]).cast("long").alias("at"),
                                                     b["score"].alias("score"))) for name, b in zip(names, best, strict=True)])
    rows = rows.select("doc_id", "n_words", *[f"base_{label}" for label in BASE.values()],
                       F.when(F.size("begun") > 0, F.filter(found, lambda f: f.isNotNull())).alias("some"))
    rows = rows.withColumn("found", F.when(F.size("some") > 0, F.col("some")))
    base = {label: F.col(f"base_{label}") for label in BASE.values()}
    starts = F.flatten(F.array(*base.values()))
    labels = F.filter(F.array(*[F.when(F.size(b) > 0, F.lit(n)) for n, b in base.items()]), lambda x: x.isNotNull())
    own = F.coalesce(F.transform("found", lambda f: F.regexp_replace(f["template"], "-notice$", "")), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, own))), ",").alias("labels"),
        F.greatest(F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                   F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))).alias("score"), "found")
