"""Candidates against postings: coverage, similarity, score, gaps, spots."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.text import bind, built_once, counted_tokens, plain_tokens, run_lengths, sentences, strip, text, without, word_tokens
from postloom.operators.batches import BLOCK, EVERY, GAPS, MATCHED, MISSING, SPOTS, Field, Meeting, meet
from postloom.operators.keywords import first_sentence, keyword_context, keywords
from postloom.operators.matching import bullets, keyword_hits
from postloom.operators.scale import fits_broadcast, hot_keys, maybe_broadcast, salted_join, unnest
from postloom.session import cut_lineage

PAIR = ("posting_id", "candidate_id")
# weight of a word that only one of two documents has, squared (the shared ones weigh 1)
LONE = "pow(1 + ln(1.5D), 2)"
HITS_BROADCAST_ROWS = 1_000_000
COVERAGE_POINTS, SIMILARITY_POINTS = 80.0, 20.0     # of the 100 points of a score


def posting_features(postings: DataFrame, stop_words: Sequence[str] = lookups.STOP_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """Everything the analysis reads from a posting, computed inside its row.

    Input needs ``posting_id``, ``profiles`` and ``description``. The result is written
    once; each later step reads only the columns it needs. ``keep`` columns go along.
    """
    stops = tuple(stop_words)
    return postings.select("posting_id", "profiles",
                           built_once(_keywords_with_sentence, "description", stops).alias("keywords"),
                           sentences(text(F.col("description"))).alias("sentences"),
                           built_once(_words, "description", stops).alias("words"), *keep)


def _words(column: str, stop_words: tuple[str, ...]) -> Column:
    return counted_tokens(plain_tokens(F.lower(text(F.col(column)))), stop_words)


def _keywords_with_sentence(column: str, stop_words: tuple[str, ...]) -> Column:
    jd = text(F.col(column))

    def located(found: Column) -> Column:
        names = F.transform(found, lambda k: k["keyword"])
        return bind(first_sentence(sentences(jd), names), lambda at: F.transform(found, lambda k, i: F.struct(
            k["keyword"].alias("keyword"), k["count"].alias("count"), k["in_req"].alias("in_req"),
            k["section"].alias("section"), k["soft"].alias("soft"), k["importance"].alias("importance"),
            F.get(at, i).alias("sentence"))))

    return bind(keywords(jd, stop_words), located)


@dataclass
class Analysis:
    """The inputs all pair results share. Each is materialised once, and only when asked for."""

    postings: DataFrame       # posting_id, profiles, keywords, sentences, words; title, company and description for documents
    candidates: DataFrame     # candidate_id, profile_id, text
    fits: bool                # candidate text is small enough to broadcast what derives from it
    stop_words: Sequence[str]
    hit_rows: int = HITS_BROADCAST_ROWS

    @cached_property
    def hits(self) -> DataFrame:
        """M3: candidate_id, profile_id, keyword, match_tier."""
        named = F.transform("keywords", lambda k: F.struct(k["keyword"].alias("keyword")))
        names = cut_lineage(unnest(self.postings, named, "posting_id").select("keyword").distinct(), "keywords")
        owner = self.candidates.select("candidate_id", "profile_id")
        return cut_lineage(keyword_hits(names, self.candidates, self.fits).join(owner, "candidate_id"), "hits")

    @cached_property
    def in_batches(self) -> bool:
        """Whether pairs are formed where the posting is: few candidates, and ids that name one row each."""
        def single(df: DataFrame, key: str) -> bool:
            return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).isEmpty()

        return self.fits and self.hits_fit and single(self.candidates, "candidate_id") and single(self.postings, "posting_id")

    @cached_property
    def members(self) -> DataFrame:
        """Blocks of candidates of one profile: candidate_id, profile_id, text, candidate_sq, block, slot."""
        words = built_once(_words, "text", tuple(self.stop_words))
        own = self.candidates.select("candidate_id", "profile_id", "text", F.aggregate(
            words, F.lit(0).cast("long"), lambda acc, w: acc + w["n"] * w["n"]).alias("candidate_sq"))
        nth = own.withColumn("nth", F.row_number().over(W.partitionBy("profile_id").orderBy("candidate_id")) - 1)
        blocks = F.dense_rank().over(W.orderBy("profile_id", F.expr(f"nth div {BLOCK}"))) - 1
        return cut_lineage(nth.withColumn("block", blocks).withColumn("slot", F.col("nth") % BLOCK).drop("nth"), "members")

    def met(self, *fields: Field, best: tuple[int, float] | None = None, keep: Sequence[Column] = (), of_member: Sequence[Column] = ()) -> DataFrame:
        """One row per pair with all its sums and the ``fields`` made of its keywords, each where the posting is.

        ``keep`` columns come from the posting, ``of_member`` ones from the candidate. Without fields, ``best`` (k, slack)
        gives the pairs that may be among their candidate's k best.
        """
        spots = any(f.spots for f in fields)
        told = [self.postings.select(c).columns[0] for c in keep]
        place = self.members.select("candidate_id", "block", "slot")
        words = unnest(self.members, built_once(_words, "text", tuple(self.stop_words)), "block", "slot")
        hits = self.hits.select("candidate_id", "keyword", "match_tier").join(place, "candidate_id").drop("candidate_id")
        vectors = bullet_vectors(self.candidates, self.stop_words).join(place, "candidate_id").select(
            "block", "slot", "token", "bullet_index", "idf", "weight").toArrow() if spots else None
        own = self.members.select("block", "slot", F.posexplode(bullets(text(F.col("text")))).alias("bullet_index", "bullet")).toArrow() if spots else None
        found = F.col("keywords")
        ordered = self.postings.select(
            "posting_id", "profiles", F.size(found).cast("long").alias("total"),
            F.aggregate(found, F.lit(0.0), lambda acc, k: acc + k["importance"]).alias("total_weight"),
            F.size(F.filter(found, lambda k: k["section"] == "required")).cast("long").alias("required_total"),
            F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + w["n"] * w["n"]).alias("posting_sq"),
            _gap_order(found, "sentence").alias("keywords"), "words",
            *([F.transform("sentences", F.lower).alias("lowered")] if spots else []), *keep)
        wanted = ordered.withColumn("profile_id", F.explode("profiles")).drop("profiles")
        rows = wanted.join(F.broadcast(self.members.select("profile_id", "block").distinct()), "profile_id")
        kept = ["posting_id", "profile_id", "total", "total_weight", "required_total", "posting_sq", *told, "block"]
        meeting = Meeting(kept, self.members.select("block", "slot", "candidate_sq").toArrow(), words.toArrow(), hits.toArrow(), vectors,
                          own, fields, best, _score_of)
        pairs = unnest(meet(rows, meeting), F.col("pairs"), *kept)
        members = self.members.select("candidate_id", "candidate_sq", "block", F.col("slot").cast("int").alias("nth"), *of_member)
        return pairs.join(F.broadcast(members), ["block", "nth"])

    @cached_property
    def hits_fit(self) -> bool:
        return self.hits.count() <= self.hit_rows

    @classmethod
    def prepare(cls, postings: DataFrame, candidates: DataFrame,
                stop_words: Sequence[str] = lookups.STOP_WORDS, keep: Sequence[str] = ()) -> "Analysis":
        """``postings``: posting_id, description and ``profiles``, the filter profiles it passes; ``keep`` columns stay beside them.

        A candidate is analysed against the postings that pass the candidate's own
        profile, as one installation does for its one résumé.
        """
        features = cut_lineage(posting_features(postings, stop_words, keep), "features")
        return cls(features, candidates, fits_broadcast(candidates, "text"), stop_words)


def posting_keywords(a: Analysis) -> DataFrame:
    """(posting, keyword) rows with the profiles that want the posting."""
    return unnest(a.postings, F.col("keywords"), "posting_id", "profiles").drop("sentence")


def _meet(left: DataFrame, right: DataFrame, key: str, small: bool) -> DataFrame:
    """Equi-join on the profile and ``key``: only postings that the candidate's profile wants meet the candidate.

    A checked small candidate side is broadcast. Otherwise hot keys are salted.
    """
    left = left.withColumn("profile_id", F.explode("profiles")).drop("profiles")
    both = ["profile_id", key]
    if small:
        return left.join(F.broadcast(right), both)
    return salted_join(left, right, both, "inner", hot_keys(left, both), F.col("posting_id"))


def _meet_wanted(a: Analysis, left: DataFrame, right: DataFrame, key: str, wanted: DataFrame, small: bool) -> DataFrame:
    """``left`` and ``right`` on ``key`` for the ``wanted`` pairs alone: rows of other pairs are never formed."""
    rows = wanted.select(*PAIR).join(left.drop("profiles"), "posting_id")
    both = ["candidate_id", key]
    if small:
        return rows.join(F.broadcast(right), both)
    return salted_join(rows, right, both, "inner", hot_keys(rows, both), F.col("posting_id"))


def pairs(a: Analysis, wanted: DataFrame | None = None) -> DataFrame:
    """(posting, candidate) pairs to analyse, all or the ``wanted`` ones, with the posting's totals."""
    found = F.col("keywords")
    posting = a.postings.select(
        "posting_id", F.explode("profiles").alias("profile_id"),
        F.size(found).cast("long").alias("total"),
        F.aggregate(found, F.lit(0.0), lambda acc, k: acc + k["importance"]).alias("total_weight"),
        F.size(F.filter(found, lambda k: k["section"] == "required")).cast("long").alias("required_total"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + w["n"] * w["n"]).alias("posting_sq"))
    words = built_once(_words, "text", tuple(a.stop_words))
    candidate = a.candidates.select("candidate_id", "profile_id", F.aggregate(
        words, F.lit(0).cast("long"), lambda acc, w: acc + w["n"] * w["n"]).alias("candidate_sq"))
    if wanted is not None:
        candidate = wanted.select(*PAIR).join(maybe_broadcast(candidate, a.fits), "candidate_id")
        return posting.join(candidate, ["posting_id", "profile_id"])
    if a.fits:
        return posting.join(F.broadcast(candidate), "profile_id")
    return salted_join(posting, candidate, "profile_id", "inner", hot_keys(posting, "profile_id"), F.col("posting_id"))


def matched_keywords(a: Analysis, wanted: DataFrame | None = None) -> DataFrame:
    """(posting, candidate, keyword) for keywords the candidate has; of the ``wanted`` pairs only, if given."""
    if wanted is not None:
        return _meet_wanted(a, posting_keywords(a), a.hits.drop("profile_id"), "keyword", wanted, a.hits_fit)
    return _meet(posting_keywords(a), a.hits, "keyword", a.hits_fit)


def matched_missing(a: Analysis, lists: bool = False) -> DataFrame:
    """M4 as rows: every keyword of a pair with its tier, null when missing.

    With ``lists`` a pair that has keywords is one row, and they stand in ``every``; in batches nothing is then shuffled for it.
    """
    if a.in_batches:
        met = a.met(EVERY).select(*PAIR, "every")
        return met.filter(F.size("every") > 0) if lists else unnest(met, F.col("every"), *PAIR)
    wanted = pairs(a).select(*PAIR)
    all_rows = wanted.join(posting_keywords(a).drop("profiles"), "posting_id")
    found = a.hits.select("candidate_id", "keyword", "match_tier")
    rows = all_rows.join(maybe_broadcast(found, a.hits_fit), ["candidate_id", "keyword"], "left")
    return rows.groupBy(*PAIR).agg(F.collect_list(F.struct("keyword", "section", "match_tier")).alias("every")) if lists else rows


def shared_words(a: Analysis, wanted: DataFrame | None = None) -> DataFrame:
    """R3's sums per pair over the words both texts have; combined before the shuffle."""
    left = unnest(a.postings, F.col("words"), "posting_id", "profiles").withColumnRenamed("n", "tf")
    words = built_once(_words, "text", tuple(a.stop_words))
    right = unnest(a.candidates, words, "candidate_id", "profile_id").withColumnRenamed("n", "ctf")
    met = (_meet(left, right, "value", a.fits) if wanted is None
           else _meet_wanted(a, left, right.drop("profile_id"), "value", wanted, a.fits))
    return met.groupBy(*PAIR).agg(
        F.sum(F.col("tf") * F.col("ctf")).alias("dot"),
        F.sum(F.col("tf") * F.col("tf")).alias("posting_shared"),
        F.sum(F.col("ctf") * F.col("ctf")).alias("candidate_shared"))


def pair_similarity(a: Analysis, wanted: DataFrame | None = None) -> DataFrame:
    """R3 per pair, for all pairs or the ``wanted`` ones.

    With two documents a shared word has idf 1 and a lone word one fixed idf, so the
    cosine follows from sums over shared words and two totals; no vectors are built.
    """
    if wanted is None and a.in_batches:
        return _with_similarity(a.met())
    base = pairs(a, wanted).join(shared_words(a, wanted), list(PAIR), "left").na.fill(0, ["dot", "posting_shared", "candidate_shared"])
    return _with_similarity(base)


def _with_similarity(base: DataFrame) -> DataFrame:
    length = "({lone} * {all} - ({lone} - 1) * {shared})"
    a2 = length.format(lone=LONE, all="posting_sq", shared="posting_shared")
    b2 = length.format(lone=LONE, all="candidate_sq", shared="candidate_shared")
    return base.withColumn("similarity", F.expr(f"case when dot = 0 then 0D else dot / sqrt({a2} * {b2}) end"))


def keyword_credit(a: Analysis) -> DataFrame:
    """Per pair with a keyword in common: the importance and number of the matched ones."""
    if a.in_batches:
        return a.met().filter("matched > 0").select(*PAIR, "matched_weight", "matched", "required_matched")
    return matched_keywords(a).groupBy(*PAIR).agg(
        F.sum("importance").alias("matched_weight"), F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("section") == "required").alias("required_matched"))


def pair_scores(a: Analysis, wanted: DataFrame | None = None, credit: DataFrame | None = None) -> DataFrame:
    """One row per pair with coverage, match rate, similarity and score.

    ``wanted`` limits the work to the given pairs; ``credit`` is a written :func:`keyword_credit`.
    """
    if a.in_batches and credit is None:
        every = _scored(_with_similarity(a.met()))
        return every if wanted is None else every.join(wanted.select(*PAIR), list(PAIR))
    return _scored(pair_similarity(a, wanted).join(keyword_credit(a) if credit is None else credit, list(PAIR), "left"))


SCORES = ("coverage", "match_rate", "similarity", "ats_score", "total", "matched", "required_total", "required_matched")


def _scored(base: DataFrame, *more: str) -> DataFrame:
    return (base.na.fill(0, ["matched_weight", "matched", "required_matched"])
            .withColumn("coverage", F.expr("matched_weight / case when total_weight = 0 then 1D else total_weight end"))
            .withColumn("match_rate", F.expr("100D * matched / greatest(total, 1)"))
            .withColumn("ats_score", F.expr("greatest(0D, least(100D, 100D * (0.8D * coverage + 0.2D * similarity)))"))
            .select(*PAIR, "profile_id", *SCORES, *more))


def _score_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """The scores of :func:`_scored` from a pair's sums, in batches."""
    lone = (1 + np.log(1.5)) ** 2
    sq = ((lone * p[f"{who}_sq"] - (lone - 1) * p[f"{who}_shared"]) for who in ("posting", "candidate"))
    near = p["dot"] / np.sqrt(np.where(p["dot"] == 0, 1.0, next(sq) * next(sq)))
    held = p["matched_weight"] / np.where(p["total_weight"] == 0, 1.0, p["total_weight"])
    return np.clip(COVERAGE_POINTS * held + SIMILARITY_POINTS * near, 0.0, 100.0)


def contenders(a: Analysis, k: int, credit: DataFrame, slack: float = 1e-4) -> DataFrame:
    """The pairs that may be among the ``k`` best of their candidate; every other pair certainly is not.

    Keywords in common, found through the keyword index, give a pair's coverage and so bound its score: from below with
    no similarity, from above with all of it. The ``k`` pairs with the best lower bounds are scored, and the least of
    their scores is the candidate's bar. Only pairs whose upper bound reaches the bar can still be among the best; pairs
    without a common keyword only where the bar is within the points of similarity, or where fewer than ``k`` pairs
    have one. ``slack`` covers scores that are ranked after rounding.
    """
    weight = a.postings.select("posting_id", F.aggregate("keywords", F.lit(0.0), lambda acc, w: acc + w["importance"]).alias("total_weight"))
    least = cut_lineage(credit.join(weight, "posting_id").select(
        *PAIR, F.expr(f"{COVERAGE_POINTS}D * matched_weight / case when total_weight = 0 then 1D else total_weight end").alias("least")), "bounds")
    order = W.partitionBy("candidate_id").orderBy(F.col("least").desc(), "posting_id")
    first = cut_lineage(least.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select(*PAIR), "first")
    scored = pair_scores(a, first, credit).groupBy("candidate_id").agg(F.min("ats_score").alias("bar"), F.count(F.lit(1)).alias("n"))
    bar = cut_lineage(scored.filter(F.col("n") >= k).select("candidate_id", (F.col("bar") - slack).alias("bar")), "bars")
    reach = (least.join(bar, "candidate_id", "left")
             .filter(F.coalesce(F.col("least") + SIMILARITY_POINTS >= F.col("bar"), F.lit(True))).select(*PAIR))
    open_to_all = a.candidates.join(bar.filter(F.col("bar") > SIMILARITY_POINTS), "candidate_id", "left_anti")
    rest = pairs(Analysis(a.postings, open_to_all, a.fits, a.stop_words, a.hit_rows)).select(*PAIR)
    return cut_lineage(reach.union(rest).distinct(), "contenders")


def top_scores(a: Analysis, k: int) -> DataFrame:
    """:func:`pair_scores` of the pairs that may be among the best; the ``k`` best of these per candidate are those of all.

    In batches every pair is scored where its posting is, and a task lets go of what ``k`` of its own pairs beat; the
    margin covers scores that are ranked after rounding. Elsewhere :func:`contenders` finds the pairs.
    """
    if a.in_batches:
        return cut_lineage(_scored(_with_similarity(a.met(best=(k, 2e-4)))), "best")
    credit = cut_lineage(keyword_credit(a), "credit")
    return pair_scores(a, contenders(a, k, credit), credit)


# --- spots ------------------------------------------------------------------------

def bullet_vectors(candidates: DataFrame, stop_words: Sequence[str] = lookups.STOP_WORDS) -> DataFrame:
    """M6: (candidate, token) rows with idf and the token's weight in each bullet that has it."""
    def counted(bs: Column) -> Column:
        return F.flatten(F.transform(bs, lambda b, i: F.transform(
            run_lengths(without(word_tokens(F.lower(b)), stop_words)),
            lambda r: F.struct(r["value"].alias("token"), i.alias("bullet_index"), r["n"].alias("tf"),
                               F.size(bs).alias("n_bullets")))))

    rows = unnest(candidates, bind(bullets(text(F.col("text"))), counted), "candidate_id", "profile_id")
    per_token = rows.groupBy("candidate_id", "profile_id", "token").agg(
        F.expr("ln((1 + first(n_bullets)) / (1 + count(1))) + 1").alias("idf"),
        F.collect_list(F.struct("bullet_index", "tf")).alias("uses"))
    flat = per_token.select("candidate_id", "profile_id", "token", "idf", F.inline("uses"))
    norms = flat.groupBy("candidate_id", "bullet_index").agg(F.sqrt(F.sum(F.expr("pow(tf * idf, 2)"))).alias("norm"))
    return flat.join(norms, ["candidate_id", "bullet_index"]).withColumn("weight", F.expr("tf * idf / norm"))


def find_spots(a: Analysis, k: int = lookups.SPOT_CAP) -> DataFrame:
    """M7: the bullets nearest to each missing keyword: (posting, candidate, keyword, rank, bullet_index, similarity).

    Query tokens meet candidate tokens on the token, so only shared tokens make rows.
    Tokens outside the candidate's vocabulary have no weight there and drop out.
    """
    if a.in_batches and k == lookups.SPOT_CAP:
        return unnest(a.met(SPOTS), F.col("spots"), *PAIR)

    def query(k: Column) -> Column:
        tokens = without(word_tokens(F.lower(F.concat(k["keyword"], F.lit(" "), keyword_context(F.col("sentences"), k)))), a.stop_words)
        return F.transform(run_lengths(tokens), lambda r: F.struct(
            k["keyword"].alias("keyword"), r["value"].alias("token"), r["n"].alias("tf")))

    asked = unnest(a.postings, F.flatten(F.transform("keywords", query)), "posting_id", "profiles").withColumnRenamed("tf", "qtf")
    vectors = bullet_vectors(a.candidates, a.stop_words).groupBy("candidate_id", "profile_id", "token").agg(
        F.first("idf").alias("idf"), F.collect_list(F.struct("bullet_index", "weight")).alias("uses"))
    met = _meet(asked, vectors, "token", a.fits)
    missing = met.join(maybe_broadcast(a.hits.select("candidate_id", "keyword"), a.hits_fit),
                       ["candidate_id", "keyword"], "left_anti")
    # one entry per bullet plus a reserved one (-1) that collects the query's own length
    entries = F.concat(F.array(F.struct(F.lit(-1).alias("bullet_index"), F.col("q").alias("weight"))), F.col("uses"))
    parts = (missing.withColumn("q", F.expr("qtf * idf")).select(*PAIR, "keyword", "q", F.explode(entries).alias("e"))
             .groupBy(*PAIR, "keyword", F.col("e.bullet_index").alias("bullet_index"))
             .agg(F.sum(F.col("q") * F.col("e.weight")).alias("dot")))
    per_keyword = parts.groupBy(*PAIR, "keyword").agg(
        F.max(F.when(F.col("bullet_index") == -1, F.sqrt("dot"))).alias("norm"),
        F.collect_list(F.when(F.col("bullet_index") >= 0, F.struct("bullet_index", "dot"))).alias("dots"))
    # nearest first; of equally near bullets the later one, compared at 9 decimals
    ranked = F.transform(
        F.slice(F.sort_array(F.transform("dots", lambda d: F.struct(
            (-F.round(d["dot"] / F.col("norm"), 9)).alias("neg"), (-d["bullet_index"]).alias("last"),
            (d["dot"] / F.col("norm")).alias("similarity")))), 1, k),
        lambda d: F.struct((-d["last"]).alias("bullet_index"), d["similarity"].alias("similarity")))
    return per_keyword.select(*PAIR, "keyword", F.filter(
        ranked, lambda d: d["similarity"] > lookups.SPOT_FLOOR).alias("spots")).filter(F.size("spots") > 0)


# --- assembly -----------------------------------------------------------------------

def _gap_order(found: Column, *more: str) -> Column:
    rank = lambda k: F.when(k["section"] == "required", 0).when(k["section"] == "preferred", 2).otherwise(1)
    return F.sort_array(F.transform(found, lambda k: F.struct(
        rank(k).alias("rank"), (-k["importance"]).alias("neg"), k["keyword"].alias("keyword"),
        k["in_req"].alias("in_requirements"), k["section"].alias("section"), *[k[c].alias(c) for c in more], k["importance"].alias("importance"),
        F.round(k["importance"], 3).alias("rounded"))))


def pair_gaps(a: Analysis, wanted: DataFrame | None = None) -> DataFrame:
    """M4 + R5 per pair: sorted matched keywords, and missing ones in gap order.

    ``wanted`` limits the work to the given pairs, for reports on a few per candidate.
    """
    if wanted is None and a.in_batches:
        return a.met(MATCHED, GAPS).select(*PAIR, "matched_keywords", "gaps")
    asked = pairs(a).select(*PAIR) if wanted is None else wanted.select(*PAIR)
    held = matched_keywords(a, wanted).groupBy(*PAIR).agg(F.sort_array(F.collect_list("keyword")).alias("matched_keywords"))
    rows = asked.join(held, list(PAIR), "left").withColumn(
        "matched_keywords", F.coalesce("matched_keywords", F.array().cast("array<string>")))
    with_all = rows.join(a.postings.select("posting_id", "keywords"), "posting_id")
    gaps = _gap_order(F.filter("keywords", lambda k: ~F.array_contains("matched_keywords", k["keyword"])))
    return with_all.select(*PAIR, "matched_keywords", F.transform(gaps, lambda g: F.struct(
        g["keyword"].alias("keyword"), (-g["neg"]).alias("importance"), g["in_requirements"].alias("in_requirements"),
        g["section"].alias("section"))).alias("gaps"))


def assemble_analysis(a: Analysis, labels: DataFrame | None = None, texts: tuple[Field, ...] = ()) -> DataFrame:
    """The nested analysis per pair. ``labels`` (posting_id, jd_source) say what text each posting was judged by.

    ``texts`` are what a document needs of the keywords (:mod:`postloom.operators.prompts`). In batches they are written where
    the pair is, and come in place of the nested columns, with the posting's title, company and ``body`` if it has them and
    the ``resume``.
    """
    if a.in_batches and texts:
        told = [F.col("title"), F.col("company"), strip(text(F.col("description"))).alias("body")] if "description" in a.postings.columns else []
        met = a.met(*texts, keep=told, of_member=[strip(text(F.col("text"))).alias("resume")])
        joined = _scored(_with_similarity(met), *(f.name for f in texts), *(["title", "company", "body"] if told else []), "resume")
        return joined.withColumn("score", F.round("ats_score", 1))
    if a.in_batches:
        joined = _scored(_with_similarity(a.met(MATCHED, MISSING, of_member=[bullets(text(F.col("text"))).alias("resume_bullets")])),
                         "matched_keywords", "missing_keywords", "resume_bullets")
        return _assembled(joined, labels)
    scores = pair_scores(a)
    spots = find_spots(a).groupBy(*PAIR).agg(
        F.map_from_entries(F.collect_list(F.struct("keyword", "spots"))).alias("by_keyword"))
    lines = a.candidates.select("candidate_id", bullets(text(F.col("text"))).alias("resume_bullets"))
    joined = (pair_gaps(a).join(scores, list(PAIR)).join(spots, list(PAIR), "left")
              .join(maybe_broadcast(lines, a.fits), "candidate_id"))

    def spot(s: Column) -> Column:
        return F.struct(s["bullet_index"].cast("long").alias("bullet_index"),
                        F.get("resume_bullets", s["bullet_index"]).alias("bullet"),
                        F.round(s["similarity"], 3).alias("similarity"))

    none = F.array().cast("array<struct<bullet_index:bigint,bullet:string,similarity:double>>")
    missing = F.transform("gaps", lambda g: F.struct(
        g["keyword"].alias("keyword"), F.round(g["importance"], 3).alias("importance"),
        g["in_requirements"].alias("in_requirements"), g["section"].alias("section"),
        F.coalesce(F.transform(F.element_at("by_keyword", g["keyword"]), spot), none).alias("spots")))
    return _assembled(joined.withColumn("missing_keywords", missing), labels)


def _assembled(out: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is not None:
        out = out.join(labels.select("posting_id", "jd_source"), "posting_id")
    tail = ["jd_source"] if labels is not None else []
    return out.select(
        *PAIR, "profile_id", F.col("ats_score"), F.round("ats_score", 1).alias("score"),
        F.round("match_rate", 1).alias("match_rate"), "required_total", "required_matched", *tail,
        "matched_keywords", "missing_keywords", "resume_bullets")


def analysis_json() -> Column:
    """The stored text form of an assembled analysis with its ``jd_source``."""
    return F.to_json(F.struct("score", "match_rate", "required_total", "required_matched", "jd_source",
                              "matched_keywords", "missing_keywords", "resume_bullets"))
