"""Section filters with a readable reason (F1-F8)."""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.infer import content_key, dedup_key, infer_country, is_remote
from postloom.functions.text import has_any_term, text

PROFILES_PER_PASS = 32


@dataclass(frozen=True)
class FilterProfile:
    """One user's filter settings. ``None`` for a list means the built-in default."""

    profile_id: str
    role_keywords: Sequence[str] = ()
    title_only: bool = True
    exclude_title_terms: Sequence[str] = ()
    require_entry_level: bool = False
    entry_signals: Sequence[str] | None = None
    blocked_types: Sequence[str] | None = None
    remote_ok: bool = True
    allowed_countries: Sequence[str] = ()
    blocked_countries: Sequence[str] = ()
    allowed_locations: Sequence[str] = ()
    allow_unknown_locations: bool = True
    earliest_start: str | None = None

    @classmethod
    def from_config(cls, profile_id: str, config: dict) -> "FilterProfile":
        """Read the nested settings form, older flat names included."""
        def first(*names: str) -> list:
            for n in names:
                if config.get(n) not in (None, ""):
                    return config[n]
            return []

        level, kind, place = (config.get(k) or {} for k in ("job_level", "job_type", "location"))
        return cls(
            profile_id,
            role_keywords=[k for k in first("role_keywords", "keywords") if k],
            title_only=config.get("title_only", True),
            exclude_title_terms=[k for k in first("exclude_title_terms", "exclude_titles") if k],
            require_entry_level=bool(level.get("require_entry_level")),
            entry_signals=level.get("entry_signals"),
            blocked_types=kind.get("blocked"),
            remote_ok=place.get("remote_ok", config.get("remote_ok", True)),
            allowed_countries=place.get("allowed_countries", []),
            blocked_countries=place.get("blocked_countries", []),
            allowed_locations=[a for a in place.get("allowed_locations", config.get("locations", [])) if a],
            allow_unknown_locations=place.get("allow_unknown_locations", True),
            earliest_start=config.get("earliest_start"),
        )


def with_filter_inputs(postings: DataFrame) -> DataFrame:
    """Derive once what every profile reads: lower-case texts, country, remote."""
    return postings.withColumns({
        "_title": F.lower(text(F.col("title"))),
        "_desc": F.lower(text(F.col("description"))),
        "_loc": F.lower(text(F.col("location"))),
        "_country": infer_country(F.col("location")),
        "_remote": is_remote(F.col("location"), F.col("remote")),
    })


def without_filter_inputs(df: DataFrame) -> DataFrame:
    return df.drop("_title", "_desc", "_loc", "_country", "_remote")


def reject_reason(p: FilterProfile) -> Column:
    """First failing section of the profile, or null. Cheap title checks come first."""
    title, desc = F.col("_title"), F.col("_desc")
    both = F.concat(title, F.lit(" "), desc)
    roles = [t for t in p.role_keywords if t]
    excluded = [t for t in p.exclude_title_terms if t]
    signals = lookups.DEFAULT_ENTRY_SIGNALS if p.entry_signals is None else p.entry_signals
    types = lookups.DEFAULT_BLOCKED_TYPES if p.blocked_types is None else p.blocked_types

    reasons: list[Column] = []
    if roles:
        hay = title if p.title_only else both
        reasons.append(F.when(~has_any_term(hay, roles), "no role keyword in title"))
    if excluded:
        reasons.append(F.when(has_any_term(title, excluded), "excluded seniority term in title"))
    if p.require_entry_level:
        reasons.append(F.when(~has_any_term(both, signals), "no entry-level signal"))
    if types:
        reasons.append(F.when(has_any_term(title, types), "blocked job type in title"))
    reasons.append(_location_reason(p))
    floor = _year_floor(p.earliest_start)
    if floor is not None:
        year = F.col("start_year")
        reasons.append(F.when(
            (year != 0) & (year < floor[0]),
            F.concat(F.lit("starts "), year.cast("string"), F.lit(f" (before {floor[1]})"))))
    return F.coalesce(*reasons)


def _year_floor(earliest: object) -> tuple[int, str] | None:
    head = str(earliest)[:4] if earliest else ""
    return (int(head), head) if re.fullmatch(r"\s*[+-]?\d+\s*", head) else None


def _location_reason(p: FilterProfile) -> Column:
    country, low = F.col("_country"), F.col("_loc")
    known = F.lower(country)
    verdict = F.lit(None).cast("string")
    if p.allowed_countries:
        hit = F.coalesce(known.isin([c.lower() for c in p.allowed_countries]), F.lit(False))
        for place in p.allowed_locations:
            hit = hit | low.contains(place.lower())
        if p.allow_unknown_locations:
            hit = hit | country.isNull()
        shown = F.coalesce(country, F.nullif(text(F.col("location")), F.lit("")), F.lit("unknown"))
        verdict = F.when(~hit, F.concat(F.lit("country not allowed: "), shown))
    if p.blocked_countries:
        blocked = known.isin([c.lower() for c in p.blocked_countries])
        verdict = F.when(blocked, F.concat(F.lit("blocked country: "), country)).otherwise(verdict)
    return F.when(~F.col("_remote"), verdict) if p.remote_ok else verdict


def filter_reasons(postings: DataFrame, profile: FilterProfile) -> DataFrame:
    """Add ``reject_reason``; null means the posting passes."""
    return without_filter_inputs(
        with_filter_inputs(postings).withColumn("reject_reason", reject_reason(profile)))


def passing_profiles(postings: DataFrame, profiles: Sequence[FilterProfile]) -> DataFrame:
    """Add ``profiles``, the ids of all profiles the posting passes. Narrow: no join."""
    found = F.array_compact(F.array(*[
        F.when(reject_reason(p).isNull(), F.lit(p.profile_id)) for p in profiles]))
    return without_filter_inputs(with_filter_inputs(postings).withColumn("profiles", found))


def filter_multi_profile(postings: DataFrame, profiles: Sequence[FilterProfile], id_column: str) -> DataFrame:
    """one row per (profile, posting) with the reason.

    Profiles are settings known when the job is planned, so each becomes an
    expression and the postings are read once for up to ``PROFILES_PER_PASS`` of
    them. More profiles take more passes; none are left out.
    """
    prepared = with_filter_inputs(postings)
    out: DataFrame | None = None
    for at in range(0, len(profiles), PROFILES_PER_PASS):
        verdicts = F.array(*[
            F.struct(F.lit(p.profile_id).alias("profile_id"), reject_reason(p).alias("reject_reason"))
            for p in profiles[at:at + PROFILES_PER_PASS]])
        part = prepared.select(id_column, F.inline(verdicts)).select("profile_id", id_column, "reject_reason")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one profile is needed")
    return out


def prune(state: DataFrame, profile: FilterProfile, at: Column) -> tuple[DataFrame, DataFrame]:
    """F8: (survivors, new tombstones) after the profile has changed."""
    judged = filter_reasons(state, profile)
    survivors = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    gone = judged.filter(F.col("reject_reason").isNotNull()).select(
        dedup_key(F.col("source"), F.col("source_job_id")).alias("dedup_key"),
        content_key(F.col("company"), F.col("title"), F.col("location")).alias("content_key"),
        at.alias("dismissed_at"), "title", "company", "seq",
    )
    return survivors, gone
