"""Résumé features and tiered keyword matching (M1-M4)."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from postloom import lookups
from postloom.functions.text import bind, lines, normalize_text, sentences, text, word_tokens
from postloom.operators.keywords import SKILL_SCAN, canonical
from postloom.operators.scale import hot_keys, salted_join, unnest
from postloom.session import cut_lineage

GRAMS = (7, 4)       # block lengths for the substring tier, longest first
HOT_GRAM_ROWS = 500_000
LONG_TOKEN = 40      # characters; longer tokens meet on pieces wherever they stand


# --- features -------------------------------------------------------------------

def bullets(resume: Column) -> Column:
    """M1: lines of at least 25 characters; sentences when fewer than three remain."""
    def long_enough(parts: Column) -> Column:
        return F.filter(parts, lambda s: F.length(s) >= 25)

    # fixed value: the characters trimmed from both ends of a résumé line
    by_line = long_enough(F.transform(lines(resume), lambda ln: F.btrim(ln, F.lit(" \t•-*–>"))))
    return bind(by_line, lambda ls: F.when(F.size(ls) >= 3, ls).otherwise(long_enough(sentences(resume))))


def candidate_bullets(candidates: DataFrame) -> DataFrame:
    """M1 as rows ``(candidate_id, bullet_index, bullet)``."""
    indexed = F.transform(bullets(text(F.col("text"))), lambda b, i: F.struct(
        i.cast("long").alias("bullet_index"), b.alias("bullet")))
    return unnest(candidates, indexed, "candidate_id")


def resume_terms(resume: Column) -> Column:
    """M2: canonical known skills present plus the canonical form of every token."""
    return bind(normalize_text(resume), lambda norm: F.array_distinct(
        F.transform(F.concat(SKILL_SCAN.hits(norm), word_tokens(norm)), canonical)))


def candidate_terms(candidates: DataFrame) -> DataFrame:
    """M2 as distinct rows ``(candidate_id, term)``; a résumé is one row, so no shuffle."""
    return unnest(candidates, F.transform(resume_terms(text(F.col("text"))), lambda t: F.struct(t.alias("term"))),
                  "candidate_id")


# --- the four tiers ---------------------------------------------------------------

def _substring_hits(names: DataFrame, candidates: DataFrame, fits: bool) -> DataFrame:
    """Tier 2 without comparing every keyword to every résumé.

    A keyword can only be inside a résumé that contains the keyword's first
    characters, so both meet on that block first and are compared after.
    """
    wide, narrow = GRAMS
    block = F.when(F.length("keyword") >= wide, F.substring("keyword", 1, wide)).otherwise(F.substring("keyword", 1, narrow))
    asked = names.filter(F.length("keyword") >= narrow).select("keyword", block.alias("block"))

    def grams(norm: Column, n: int) -> Column:
        last = F.length(norm) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(norm, i, F.lit(n))))

    norm = normalize_text(text(F.col("text")))
    blocks = bind(norm, lambda t: F.transform(F.array_distinct(F.concat(
        F.coalesce(grams(t, wide), F.array().cast("array<string>")),
        F.coalesce(grams(t, narrow), F.array().cast("array<string>")))), lambda g: F.struct(g.alias("block"))))
    held = unnest(candidates, blocks, "candidate_id")
    pairs = salted_join(held, asked, "block", "inner", None if fits else hot_keys(held, "block", HOT_GRAM_ROWS), F.col("candidate_id"))
    texts = candidates.select("candidate_id", norm.alias("_norm"))
    # a block equal to the whole keyword needs no second look
    sure = pairs.filter(F.length("keyword") == F.length("block")).select("candidate_id", "keyword")
    checked = (pairs.filter(F.length("keyword") > F.length("block")).join(texts, "candidate_id")
               .filter(F.contains("_norm", "keyword")).select("candidate_id", "keyword"))
    return sure.unionByName(checked)


def _boundary_hits(names: DataFrame, candidates: DataFrame, fits: bool) -> DataFrame:
    """Tier 3: single tokens on boundaries; both sides meet on the first alphanumeric run."""
    asked = (names.filter(~F.contains("keyword", F.lit(" ")))
             .withColumn("core", F.regexp_extract("keyword", "[a-z0-9]+", 0)).filter("core <> ''"))
    norm = normalize_text(text(F.col("text")))
    cores = bind(norm, lambda t: F.transform(
        F.array_distinct(F.split(t, "[^a-z0-9]+", -1)), lambda c: F.struct(c.alias("core"))))
    held = unnest(candidates, cores, "candidate_id").filter("core <> ''")
    texts = candidates.select("candidate_id", norm.alias("_norm"))
    pairs = salted_join(held, asked, "core", "inner", None if fits else hot_keys(held, "core", HOT_GRAM_ROWS), F.col("candidate_id"))
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("keyword"), F.lit(r"\E(?![a-z0-9])"))
    plain = pairs.filter(F.col("keyword") == F.col("core")).select("candidate_id", "keyword")
    checked = (pairs.filter(F.col("keyword") != F.col("core")).join(texts, "candidate_id")
               .filter(F.rlike(F.col("_norm"), bounded)).select("candidate_id", "keyword"))
    return plain.unionByName(checked)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a table row as the bits of one number (Hyyrö 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b)], dtype="int32")


def _near_hits(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Tier 4: normalised indel similarity of at least 90 %, both at least 5 long.

    That means at most (la + lb) / 10 insertions and deletions. A keyword cut into one
    more piece than the operations it may suffer keeps one piece whole, shifted by no
    more than that number. So keywords meet distinct résumé terms on (length, piece
    number, piece) and only the few that share a piece are compared. Terms are cut only
    for the lengths that keywords have. Beyond LONG_TOKEN characters pieces meet at
    whatever place, so a term has one row a character and not one a piece and shift.
    """
    most = "cast((la + (11 * la) div 9) div 10 as int)"
    starts = "(j * (la div (k + 1)) + greatest(0, j - (k + 1 - la % (k + 1))))"
    width = "(la div (k + 1) + case when j >= k + 1 - la % (k + 1) then 1 else 0 end)"
    key = f"concat_ws('|', la, case when la <= {LONG_TOKEN} then cast(j as string) else 'any' end, {{piece}}) as piece"

    asked = (names.filter(F.length("keyword") >= 5)
             .withColumn("la", F.length("keyword")).withColumn("k", F.expr(most))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
             .selectExpr("keyword", key.format(piece=f"substr(keyword, cast({starts} + 1 as int), cast({width} as int))")).distinct())
    lengths = names.filter(F.length("keyword") >= 5).select(F.length("keyword").alias("la")).distinct()
    vocabulary = terms.filter(F.length("term") >= 5).select("term").distinct()
    sized = (vocabulary.withColumn("lb", F.length("term"))
             .withColumn("la", F.explode(F.expr("sequence(greatest(5, (9 * lb + 10) div 11), (11 * lb) div 9)")))
             .join(lengths, "la").withColumn("k", F.expr(most)))
    placed = (sized.filter(F.col("la") <= LONG_TOKEN).withColumn("d", F.expr("cast((la + lb) div 10 as int)"))
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
              .withColumn("s", F.expr(starts)).withColumn("w", F.expr(width))
              .withColumn("at", F.explode(F.expr("sequence(s - d, s + d)")))
              .filter("at >= 0 and at + w <= lb"))
    anywhere = (sized.filter(F.col("la") > LONG_TOKEN).withColumn("j", F.lit(0))
                .withColumn("w", F.explode(F.expr("array_distinct(array(la div (k + 1), la div (k + 1) + sign(la % (k + 1))))").cast("array<int>")))
                .withColumn("at", F.explode(F.expr("sequence(0, greatest(lb - w, 0))"))))
    cut = key.format(piece="substr(term, cast(at + 1 as int), cast(w as int))")
    held = placed.selectExpr("term", cut).unionByName(anywhere.selectExpr("term", cut)).distinct()
    pairs = (salted_join(held, asked, "piece", "inner", hot_keys(held, "piece", HOT_GRAM_ROWS), F.col("term"))
             .select("keyword", "term").distinct())
    # written, or the comparison would be pushed below and be made once for every piece that two tokens share
    pairs = cut_lineage(pairs, "near-pairs")
    allowed = (F.length("keyword") + F.length("term"))
    close = pairs.filter(F.levenshtein("keyword", "term") * 10 <= allowed)
    indel = allowed - 2 * lcs_length("keyword", "term")
    near = close.filter(indel * (100 // (100 - lookups.FUZZY_RATIO)) <= allowed)
    return salted_join(terms, near, "term", "inner", hot_keys(terms, "term", HOT_GRAM_ROWS), F.col("candidate_id")).select("candidate_id", "keyword")


def keyword_hits(names: DataFrame, candidates: DataFrame, fits: bool = False) -> DataFrame:
    """M3: ``(candidate_id, keyword, match_tier)`` for every distinct keyword a candidate has.

    Whether a candidate has a keyword does not depend on the posting, so this works on
    distinct keywords, and only hits appear: nothing is compared to everything. The
    lowest tier counts.
    """
    terms = candidate_terms(candidates)
    exact = terms.withColumnRenamed("term", "keyword")
    same = (names.join(F.broadcast(exact), "keyword") if fits else
            salted_join(exact, names, "keyword", "inner", hot_keys(exact, "keyword", HOT_GRAM_ROWS), F.col("candidate_id")))
    tiers = [
        same.select("candidate_id", "keyword"),
        _substring_hits(names, candidates, fits),
        _boundary_hits(names, candidates, fits),
        _near_hits(names, terms),
    ]
    found = None
    for i, hits in enumerate(tiers, start=1):
        part = hits.withColumn("match_tier", F.lit(i))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("candidate_id", "keyword").agg(F.min("match_tier").alias("match_tier"))
