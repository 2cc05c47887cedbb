"""Keywords of a posting: sections, known skills, discovered terms, weights.

A posting is one row and stays one row: all of this runs inside the row, with JVM
array functions and one count in Arrow batches, so extraction needs no shuffle
however long the texts are.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from heapq import nsmallest
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.phrases import PhraseScanner, lookup
from postloom.operators.scale import unnest
from postloom.functions.text import (
    WORD_TOKEN, bind, built_once, normalize_text, run_lengths, segment_pieces, text,
)

SKILL_SCAN = PhraseScanner(lookups.KNOWN_SKILLS)
# noncharacters, which Unicode keeps out of interchanged text: safe as separators
_SWITCH, _SAME = chr(0xFDD0), chr(0xFDD1)


def canonical(term: Column) -> Column:
    """K2 for terms that are lower case and trimmed already."""
    return F.coalesce(lookup(term, lookups.ALIASES), term)


# --- sections -----------------------------------------------------------------

def _switch(segment: Column) -> Column:
    """Which section a segment opens: P, R or C; null when it opens none."""
    def opened(low: Column) -> Column:
        # plain searches; a pattern of all markers is tried at every character
        holds = lambda markers: reduce(or_, [low.contains(m) for m in markers])
        return (F.when(holds(lookups.PREFERRED_MARKERS), "P").when(holds(lookups.REQUIRED_MARKERS), "R")
                .when(segment.endswith(":") & (F.length(segment) <= 70), "C"))

    return bind(F.lower(segment), opened)


def segments(jd: Column) -> Column:
    """K4: array<struct<section, segment>> in text order.

    Lines end at white space that holds a line break, segments also at white space after
    one of ``.;:``: one split, and what it leaves has no white space at its ends.
    A segment inherits the section that was opened last. Joining all segments with
    one separator where a section opens and another where it goes on turns the
    carry-forward into two splits, linear in the text.
    """
    marked = F.transform(F.filter(segment_pieces(jd), lambda s: s != ""), lambda s: F.concat(
        F.coalesce(F.concat(F.lit(_SWITCH), _switch(s)), F.lit(_SAME)), s))
    blocks = F.split(F.concat(F.lit("C"), F.array_join(marked, "")), _SWITCH, -1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.filter(F.split(F.substr(b, F.lit(2)), _SAME, -1), lambda s: s != ""),
        lambda s: F.struct(
            F.when(b.startswith("R"), "required").when(b.startswith("P"), "preferred").otherwise("core").alias("section"),
            s.alias("segment")))))


def section_text(segs: Column, section: str) -> Column:
    """K5: lower-case text of one section."""
    mine = F.filter(segs, lambda s: s["section"] == section)
    return F.array_join(F.transform(mine, lambda s: F.lower(s["segment"])), " ")


# --- known skills ---------------------------------------------------------------

def skill_counts(norm: Column) -> Column:
    """K6: array<struct<value, n>> of known skills in normalised text."""
    return run_lengths(SKILL_SCAN.hits(norm))


def _known(norm: Column, req: Column, pref: Column) -> Column:
    """K7: array<struct<keyword, count, in_req, section>>, one per canonical keyword."""
    def per_skill(req_hits: Column, pref_hits: Column) -> Column:
        return F.transform(skill_counts(norm), lambda k: F.struct(
            canonical(k["value"]).alias("keyword"), k["n"].alias("n"),
            F.array_contains(req_hits, k["value"]).alias("required"),
            F.array_contains(pref_hits, k["value"]).alias("preferred")))

    def rolled_up(skills: Column) -> Column:
        names = F.array_distinct(F.transform(skills, lambda s: s["keyword"]))

        def entry(name: Column) -> Column:
            return bind(F.filter(skills, lambda s: s["keyword"] == name), lambda mine: F.struct(
                name.alias("keyword"),
                F.aggregate(mine, F.lit(0).cast("long"), lambda acc, s: acc + s["n"]).alias("count"),
                F.exists(mine, lambda s: s["required"]).alias("in_req"),
                F.when(F.exists(mine, lambda s: s["required"]), "required")
                .when(F.exists(mine, lambda s: s["preferred"] & ~s["required"]), "preferred")
                .otherwise("core").alias("section")))

        return F.transform(names, entry)

    return bind(SKILL_SCAN.hits(req), lambda rh: bind(SKILL_SCAN.hits(pref), lambda ph: bind(
        per_skill(rh, ph), rolled_up)))


# --- discovered terms -------------------------------------------------------------

def _counter(stop_words: Sequence[str], top: int) -> Callable[[str], list[tuple[str, int]]]:
    """What finds a lower-case text's most frequent n-grams. Made here, so that it travels by value and workers need not import us."""
    token, stops = re.compile(WORD_TOKEN), frozenset(stop_words)

    def best(low: str) -> list[tuple[str, int]]:
        tokens = [w for w in token.findall(low) if w not in stops]
        runs = Counter(tokens)
        runs.update(map(" ".join, zip(tokens, tokens[1:])))
        bar = sorted(runs.values())[-top] if len(runs) > top else 0
        first = sorted([r for r in runs.items() if r[1] > bar], key=lambda r: (-r[1], r[0]))
        return first + [(w, bar) for w in nsmallest(top - len(first), [w for w, n in runs.items() if n == bar])]

    return best


def ngrams(jd: Column, stop_words: Sequence[str], top: int = lookups.NGRAM_CAP) -> Column:
    """K8/K9: the most frequent unigrams and bigrams as array<struct<term, tf>>, tf desc, term asc.

    Stop words go before bigrams form, so a bigram may span a removed word. Counted in Arrow
    batches: sorting a text's own tokens in array functions takes several times as long.
    """
    best = _counter(stop_words, top)

    def counted(texts: pa.Array) -> pa.Array:
        terms, counts, ends, missing = [], [], [0], []
        for t in texts.to_pylist():
            for term, n in best(t or ""):
                terms.append(term)
                counts.append(n)
            ends.append(len(terms))
            missing.append(t is None)
        found = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(counted, "array<struct<term:string,tf:bigint>>")(F.lower(jd))


def _salient(jd: Column, stop_words: Sequence[str]) -> Column:
    """struct<norm, ranked>: the normalised text, and its ranked terms as K10 looks at them.

    ``ranked`` is array<struct<term, words, hits>>: the term bare of marks at its words' ends, these words, and how often
    the text holds the term, scanned from the left. Python's white space is that of ``collapse``.
    """
    best = _counter(stop_words, lookups.SALIENT_CAP)

    def read(texts: pa.Array) -> pa.Array:
        norms, terms, words, hits, ends, word_ends, missing = [], [], [], [], [0], [0], []
        for t in texts.to_pylist():
            norm = " ".join((t or "").split())
            for found, _ in best(t or ""):
                bare = [w for part in found.strip(" .,-#+/").split(" ") if (w := part.strip(".,-"))]
                term = " ".join(bare)
                terms.append(term)
                words += bare
                word_ends.append(len(words))
                hits.append(norm.count(term) if term else 0)
            ends.append(len(terms))
            norms.append(None if t is None else norm)
            missing.append(t is None)
        split = pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), pa.array(words, pa.string()))
        found = pa.StructArray.from_arrays([pa.array(terms, pa.string()), split, pa.array(hits, pa.int64())], ["term", "words", "hits"])
        ranked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(missing, pa.bool_()))
        return pa.StructArray.from_arrays([pa.array(norms, pa.string()), ranked], ["norm", "ranked"])

    return F.arrow_udf(read, "struct<norm:string,ranked:array<struct<term:string,words:array<string>,hits:bigint>>>")(F.lower(jd))


def _soft_candidates(ranked: Column) -> Column:
    """K10, the rules that do not depend on earlier picks, for terms of ``_salient``: array<struct<term, keyword, hits, words, parts>>."""
    def named(r: Column) -> Column:
        return F.struct(r["term"].alias("term"), canonical(r["term"]).alias("keyword"), r["hits"].alias("hits"),
                        r["words"].alias("words"), F.transform(r["words"], canonical).alias("parts"))

    def allowed(c: Column) -> Column:
        # isin looks a word up in a hash set; overlaps with a literal array compare or rebuild all of it for each term
        never = [*lookups.FILLER_WORDS, *lookups.STRUCTURE_WORDS, *lookups.KNOWN_SKILLS]
        return ((c["term"] != "")
                & ~F.exists(c["words"], lambda t: (F.length(t) < 3) | t.isin(never))
                & F.exists(c["words"], lambda t: ~t.isin(list(lookups.SKILL_WORDS)))
                & ~c["keyword"].isin(list(lookups.KNOWN_SKILLS))
                & ~c["term"].rlike(r"\A[0-9]+\z"))

    return F.filter(F.transform(ranked, named), allowed)


def _soft(req: Column, pref: Column, known: Column, ranked: Column) -> Column:
    """Greedy scan. What has been accepted blocks later terms that contain it, hence a fold."""
    seed = F.struct(
        F.transform(known, lambda k: k["keyword"]).alias("found"),
        F.array().cast("array<struct<term:string,keyword:string,hits:bigint>>").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        ok = ((F.size(acc["kept"]) < lookups.SOFT_CAP)
              & ~F.arrays_overlap(c["parts"], acc["found"])
              & ~F.array_contains(acc["found"], c["keyword"]))
        return F.when(ok, F.struct(
            F.concat(acc["found"], F.array(c["keyword"])).alias("found"),
            F.concat(acc["kept"], F.array(F.struct(
                c["term"].alias("term"), c["keyword"].alias("keyword"), c["hits"].alias("hits")))).alias("kept"),
        )).otherwise(acc)

    kept = F.aggregate(_soft_candidates(ranked), seed, step, lambda acc: acc["kept"])
    return F.transform(kept, lambda k: F.struct(
        k["keyword"].alias("keyword"),
        k["hits"].alias("count"),
        req.contains(k["term"]).alias("in_req"),
        F.when(req.contains(k["term"]), "required").when(pref.contains(k["term"]), "preferred")
        .otherwise("core").alias("section")))


def keywords(jd: Column, stop_words: Sequence[str] = lookups.STOP_WORDS) -> Column:
    """array<struct<keyword, count, in_req, section, soft, importance>>."""
    def weighted(found: Column) -> Column:
        top = F.greatest(F.array_max(F.transform(found, lambda k: k["count"])), F.lit(1))

        def weight(k: Column, most: Column) -> Column:
            base = F.lit(0.4) + F.lit(0.6) * (k["count"].cast("double") / most.cast("double"))
            base = F.when(k["soft"], base * F.lit(0.6)).otherwise(base)
            return (F.when(k["section"] == "required", F.least(F.lit(1.0), base + F.lit(0.25)))
                    .when(k["section"] == "preferred", base * F.lit(0.45)).otherwise(base))

        return bind(top, lambda most: F.transform(found, lambda k: F.struct(
            k["keyword"].alias("keyword"), k["count"].alias("count"), k["in_req"].alias("in_req"),
            k["section"].alias("section"), k["soft"].alias("soft"), weight(k, most).alias("importance"))))

    def tagged(entries: Column, soft: bool) -> Column:
        return F.transform(entries, lambda k: F.struct(
            k["keyword"].alias("keyword"), k["count"].alias("count"), k["in_req"].alias("in_req"),
            k["section"].alias("section"), F.lit(soft).alias("soft")))

    def from_sections(s: Column) -> Column:
        return bind(_known(s["norm"], s["req"], s["pref"]), lambda known: bind(
            F.concat(tagged(known, False), tagged(_soft(s["req"], s["pref"], known, s["ranked"]), True)), weighted))

    parts = bind(segments(jd), lambda segs: F.struct(
        section_text(segs, "required").alias("req"), section_text(segs, "preferred").alias("pref")))
    return bind(F.struct(_salient(jd, stop_words).alias("t"), parts.alias("p")),
                lambda s: bind(F.struct(s["t"]["norm"].alias("norm"), s["t"]["ranked"].alias("ranked"), s["p"]["req"].alias("req"),
                                        s["p"]["pref"].alias("pref")), from_sections))


def known_keywords(jd: Column) -> Column:
    """K7 on its own: array<struct<keyword, count, in_req, section>>."""
    parts = bind(segments(jd), lambda segs: F.struct(
        section_text(segs, "required").alias("req"), section_text(segs, "preferred").alias("pref")))
    return bind(normalize_text(jd), lambda norm: bind(parts, lambda s: _known(norm, s["req"], s["pref"])))


def first_sentence(parts: Column, names: Column) -> Column:
    """For each keyword the index of the first sentence that contains it, null when none does.

    An index, so that a long sentence is kept once however many keywords point at it.
    """
    lowered = F.transform(parts, F.lower)
    return bind(lowered, lambda ss: F.transform(names, lambda k: F.array_min(F.filter(
        F.transform(ss, lambda s, i: F.when(s.contains(k), i)), lambda i: i.isNotNull()))))


def keyword_context(parts: Column, k: Column) -> Column:
    """M5: the first sentence that contains the keyword, else the keyword itself."""
    return F.coalesce(F.get(parts, k["sentence"]), k["keyword"])


def jd_keywords(postings: DataFrame, id_column: str = "seq",
                stop_words: Sequence[str] = lookups.STOP_WORDS) -> DataFrame:
    """One row per (posting, keyword)."""
    return unnest(postings, built_once(_keywords_of, "description", tuple(stop_words)), id_column)


def _keywords_of(column: str, stop_words: tuple[str, ...]) -> Column:
    return keywords(text(F.col(column)), stop_words)
