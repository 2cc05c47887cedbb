"""Filter profiles as a table (F7 at scale).

Profiles are rows, so their number is data and not the size of a plan. All terms of all profiles form one index of distinct
terms; each is looked for once in a posting, however many profiles hold it: texts and terms meet on a whole alphanumeric run
(single words) or on the characters around a space (phrases), and only what meets is verified. A short list of terms is
looked for by one scan where the text is. Texts are read once; what follows works on the terms found, never on texts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.phrases import PhraseScanner
from postloom.functions.text import bind, strip, text
from postloom.operators.filters import FilterProfile, with_filter_inputs
from postloom.operators.scale import hot_keys, salted_join, unnest
from postloom.session import cut_lineage

SCHEMA = ("profile_id string, role_keywords array<string>, title_only boolean, exclude_title_terms array<string>, "
          "require_entry_level boolean, entry_signals array<string>, blocked_types array<string>, remote_ok boolean, "
          "allowed_countries array<string>, blocked_countries array<string>, allowed_locations array<string>, "
          "allow_unknown_locations boolean, earliest_start string")
SCAN_TERMS = 200             # up to so many terms make one pattern; more meet the texts by an index
BROADCAST_TERMS = 200_000
BROADCAST_PROFILES = 20_000
SLIM = ("_country", "_remote", "_loc", "location", "start_year")


def profile_table(spark: SparkSession, profiles: Sequence[FilterProfile]) -> DataFrame:
    """Profiles as rows. Null lists of signals and types stand for the built-in defaults."""
    listed = lambda v: None if v is None else list(v)
    return spark.createDataFrame([(
        p.profile_id, listed(p.role_keywords), p.title_only, listed(p.exclude_title_terms), p.require_entry_level, listed(p.entry_signals),
        listed(p.blocked_types), p.remote_ok, listed(p.allowed_countries), listed(p.blocked_countries), listed(p.allowed_locations),
        p.allow_unknown_locations, p.earliest_start) for p in profiles], SCHEMA)


def _cleaned(terms: Column) -> Column:
    return F.filter(F.transform(terms, lambda t: strip(F.lower(t))), lambda t: t != "")


def settled(profiles: DataFrame) -> DataFrame:
    """Profiles with defaults filled in and terms as they are looked for: one row a profile, a few short arrays."""
    none = F.array().cast("array<string>")
    given = lambda c: F.filter(F.coalesce(c, none), lambda t: t != "")
    default = lambda c, values: F.coalesce(c, F.array(*[F.lit(v) for v in values]))
    lower = lambda c: F.transform(F.coalesce(c, none), F.lower)
    head = F.substring("earliest_start", 1, 4)
    floor = F.when(head.rlike(r"^\s*[+-]?\d+\s*$"), strip(head).cast("int"))
    return profiles.select(
        "profile_id", (F.size(given("role_keywords")) > 0).alias("has_roles"), _cleaned(given("role_keywords")).alias("roles"),
        F.coalesce("title_only", F.lit(True)).alias("title_only"), _cleaned(given("exclude_title_terms")).alias("excluded"),
        F.coalesce("require_entry_level", F.lit(False)).alias("need_signal"),
        _cleaned(default(F.col("entry_signals"), lookups.DEFAULT_ENTRY_SIGNALS)).alias("signals"),
        _cleaned(default(F.col("blocked_types"), lookups.DEFAULT_BLOCKED_TYPES)).alias("types"),
        F.coalesce("remote_ok", F.lit(True)).alias("remote_ok"), lower("allowed_countries").alias("allowed"),
        lower("blocked_countries").alias("blocked"), lower("allowed_locations").alias("places"),
        F.coalesce("allow_unknown_locations", F.lit(True)).alias("unknown_ok"), floor.alias("floor"), head.alias("floor_text"))


def term_index(profiles: DataFrame) -> DataFrame:
    """(term, key): the distinct terms of ``settled`` profiles and where a text must meet them."""
    terms = profiles.select(F.explode(F.array_distinct(F.concat("roles", "excluded", "signals", "types"))).alias("term")).distinct()
    space = F.locate(" ", F.col("term"))
    phrase = F.concat(F.lit("p"), F.substr("term", F.greatest(space - 2, F.lit(1)), F.least(space - 1, F.lit(2))), F.lit(" "),
                      F.substr("term", space + 1, F.lit(1)))
    word = F.concat(F.lit("w"), F.regexp_extract("term", "[a-z0-9]+", 0))
    return terms.select("term", F.when(space > 0, phrase).otherwise(word).alias("key"))


def _keys(body: Column) -> Column:
    """All keys under which a term can meet a text; the empty word is that of terms without letters and digits."""
    words = F.transform(F.split(body, "[^a-z0-9]+", -1), lambda w: F.concat(F.lit("w"), w))

    def around(parts: Column) -> Column:
        def pair(part: Column, i: Column) -> Column:
            after = F.concat(F.lit(" "), F.coalesce(F.nullif(F.substring(F.get(parts, i + 1), 1, 1), F.lit("")), F.lit(" ")))
            return F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.concat(F.lit("p"), F.substr(part, F.length(part) - n + 1, n), after))
        return F.flatten(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), pair))

    return F.array_distinct(F.concat(words, bind(F.split(body, " ", -1), around), F.array(F.lit("w"))))


def _hit(body: Column, term: Column) -> Column:
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))
    return F.when(F.contains(term, F.lit(" ")), F.contains(body, term)).otherwise(F.rlike(body, bounded))


def found_terms(postings: DataFrame, terms: DataFrame, id_column: str) -> DataFrame:
    """(id, term, in_title): the indexed terms that each posting's title, or title and description, holds."""
    both = F.concat("_title", F.lit(" "), "_desc")
    small = terms.count() <= BROADCAST_TERMS
    exploded = postings.select(id_column, F.explode(_keys(both)).alias("key"), *(["_title", "_desc"] if small else []))
    if small:       # joined where the text is, before anything is copied
        met = exploded.join(F.broadcast(terms), "key").drop("key")
    else:
        met = salted_join(exploded, terms, "key", "inner", hot_keys(exploded, "key"), F.col(id_column)).drop("key")
        met = met.join(postings.select(id_column, "_title", "_desc"), id_column)
    return met.filter(_hit(both, F.col("term"))).select(id_column, "term", _hit(F.col("_title"), F.col("term")).alias("in_title")).distinct()


def _scan(body: Column, terms: Sequence[str]) -> Column:
    """The terms of a short list that ``body`` holds, as ``_hit`` finds them: one scan for all words, a search a phrase."""
    words, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    found = PhraseScanner(words).hits(body) if words else F.array().cast("array<string>")
    return F.array_distinct(F.concat(found, F.array_compact(F.array(
        F.lit(None).cast("string"), *[F.when(F.contains(body, F.lit(p)), F.lit(p)) for p in phrases]))))


def _looked_up(postings: DataFrame, rules: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(id, the columns of SLIM) and (id, term, in_title) of all postings, both written, so that no later step reads a text."""
    prepared, terms = with_filter_inputs(postings), term_index(rules)
    most = min(SCAN_TERMS, BROADCAST_TERMS)
    few = sorted(r["term"] for r in terms.select("term").limit(most + 1).collect())
    if len(few) > most:
        found = cut_lineage(found_terms(prepared, terms, id_column), "found-terms")
        return cut_lineage(prepared.select(id_column, *SLIM), "slim-postings"), found
    both = F.concat("_title", F.lit(" "), "_desc")
    read = cut_lineage(prepared.select(id_column, *SLIM, _scan(both, few).alias("_held"), _scan(F.col("_title"), few).alias("_titled")), "slim-postings")
    held = F.transform("_held", lambda t: F.struct(t.alias("term"), F.array_contains("_titled", t).alias("in_title")))
    return read.select(id_column, *SLIM), unnest(read, held, id_column).distinct()


def _location_reason() -> Column:
    """F5 of a posting's slim columns and a settled profile's."""
    known = F.lower("_country")
    hit = (F.coalesce(F.array_contains("allowed", known), F.lit(False)) | F.exists("places", lambda p: F.contains("_loc", p))
           | (F.col("unknown_ok") & F.col("_country").isNull()))
    shown = F.coalesce(F.col("_country"), F.nullif(text(F.col("location")), F.lit("")), F.lit("unknown"))
    verdict = F.when((F.size("allowed") > 0) & ~hit, F.concat(F.lit("country not allowed: "), shown))
    verdict = F.when(F.coalesce(F.array_contains("blocked", known), F.lit(False)), F.concat(F.lit("blocked country: "), "_country")).otherwise(verdict)
    return F.when(~(F.col("_remote") & F.col("remote_ok")), verdict)


def _year_reason() -> Column:
    late = (F.col("start_year") != 0) & (F.col("start_year") < F.col("floor"))
    return F.when(late, F.concat(F.lit("starts "), F.col("start_year").cast("string"), F.lit(" (before "), "floor_text", F.lit(")")))


def filter_profile_table(postings: DataFrame, profiles: DataFrame, id_column: str) -> DataFrame:
    """F7 in full: one row per (profile, posting) with the reason. The result has that many rows; see ``passing_pairs``.

    Each posting carries its found terms into the pairs, so a pair costs a few look-ups in short arrays.
    """
    rules = settled(profiles)
    read, met = _looked_up(postings, rules, id_column)
    found = met.groupBy(id_column).agg(
        F.collect_list("term").alias("in_both"), F.collect_list(F.when(F.col("in_title"), F.col("term"))).alias("in_title"))
    none = F.array().cast("array<string>")
    slim = read.join(found, id_column, "left").withColumns(
        {c: F.coalesce(c, none) for c in ("in_both", "in_title")})
    rules = F.broadcast(rules) if profiles.count() <= BROADCAST_PROFILES else rules
    has = lambda terms, found: F.arrays_overlap(F.col(terms), F.col(found))
    role = F.when(F.col("title_only"), has("roles", "in_title")).otherwise(has("roles", "in_both"))
    reason = F.coalesce(
        F.when(F.col("has_roles") & ~role, "no role keyword in title"),
        F.when(has("excluded", "in_title"), "excluded seniority term in title"),
        F.when(F.col("need_signal") & ~has("signals", "in_both"), "no entry-level signal"),
        F.when(has("types", "in_title"), "blocked job type in title"), _location_reason(), _year_reason())
    return slim.join(rules, F.lit(True)).select("profile_id", id_column, reason.alias("reject_reason"))


def passing_pairs(postings: DataFrame, profiles: DataFrame, id_column: str) -> DataFrame:
    """(profile_id, id) of the postings that pass each profile, by equi-joins and one count, without forming other pairs.

    A pair is put forward by its most telling condition: a role term, or for profiles without roles the place. Terms that
    speak against it, and signals, are counted for it from the same index; place and year are looked up at the end.
    """
    rules = settled(profiles)
    read, found = _looked_up(postings, rules, id_column)
    kinds = {"roles": ~F.col("title_only") | F.col("in_title"), "excluded": F.col("in_title"), "signals": F.lit(True), "types": F.col("in_title")}
    holders = None
    for kind in kinds:
        part = rules.select("profile_id", "title_only", F.lit(kind).alias("kind"), F.explode(F.array_distinct(kind)).alias("term"))
        holders = part if holders is None else holders.unionByName(part)
    counts = F.when(F.col("kind") == "roles", kinds["roles"]).when(F.col("kind") == "signals", F.lit(True)).otherwise(F.col("in_title"))
    met = salted_join(found, holders, "term", "inner", hot_keys(found, "term"), F.col(id_column)).filter(counts)
    told = met.groupBy(id_column, "profile_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])

    # places: a posting's country, or its being unknown or remote, meets the profiles that admit it
    known = F.coalesce(F.lower("_country"), F.lit("?"))
    at = read.select(id_column, F.explode(F.array_distinct(F.array_compact(F.array(
        known, F.when(F.col("_remote"), F.lit("~remote")), F.lit("~any"))))).alias("place"))
    admits = rules.filter(~F.col("has_roles")).select("profile_id", F.explode(F.when(F.size("allowed") == 0, F.array(F.lit("~any"))).when(
        F.size("places") > 0, F.array(F.lit("~any"))).otherwise(F.array_compact(F.concat("allowed", F.array(
            F.when(F.col("unknown_ok"), F.lit("?")), F.when(F.col("remote_ok"), F.lit("~remote"))))))).alias("place"))
    open_ = salted_join(at, admits, "place", "inner", hot_keys(at, "place"), F.col(id_column)).select(id_column, "profile_id").distinct()
    forward = open_.unionByName(told.join(rules.filter("has_roles").select("profile_id"), "profile_id", "left_semi")
                                .filter("n_roles > 0").select(id_column, "profile_id"))
    judged = (forward.join(told, [id_column, "profile_id"], "left").na.fill(0, [f"n_{k}" for k in kinds])
              .join(rules.drop(*kinds), "profile_id").join(read, id_column))
    good = ((F.col("n_excluded") == 0) & (~F.col("need_signal") | (F.col("n_signals") > 0)) & (F.col("n_types") == 0)
            & _location_reason().isNull() & _year_reason().isNull())
    return judged.filter(good).select("profile_id", id_column)
