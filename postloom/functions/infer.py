"""Start dates, countries and keys inferred from posting text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.phrases import PhraseScanner, lookup
from postloom.functions.text import bind, literal_strings, strip, text

_COUNTRY_SCAN = PhraseScanner(list(lookups.COUNTRIES), letters="a-z")
_COUNTRY_ORDER = {name: i for i, name in enumerate(lookups.COUNTRIES)}
_COUNTRY_NAMES = list(lookups.COUNTRIES.values())


def _pattern(words: dict[str, int]) -> str:
    return r"(?U)(" + "|".join(words) + r")\s+(20\d{2})"


def infer_start(title: Column, description: Column, start_year: Column, start_date: Column) -> Column:
    """N1 + N2 as struct<start_year, start_date>; the first rule that matches anywhere wins."""
    body = F.lower(F.concat(text(title), F.lit("\n"), text(description)))

    def year_of(t: Column, pattern: str) -> Column:
        return F.regexp_extract(t, pattern, 2).try_cast("int")

    def dated(t: Column, words: dict[str, int]) -> Column:
        pattern = _pattern(words)
        year = year_of(t, pattern)
        month = lookup(F.regexp_extract(t, pattern, 1), words)
        return F.when(year.isNotNull(), F.struct(
            year.alias("start_year"), F.format_string("%04d-%02d-01", year, month).alias("start_date")))

    def undated(t: Column, pattern: str) -> Column:
        year = year_of(t, pattern)
        return F.when(year.isNotNull(), F.struct(
            year.alias("start_year"), F.format_string("%04d-01-01", year).alias("start_date")))

    given = F.when(
        start_year.isNotNull() & (start_year != 0),
        F.struct(
            start_year.cast("int").alias("start_year"),
            F.coalesce(F.nullif(start_date, F.lit("")), F.format_string("%d-01-01", start_year)).alias("start_date"),
        ),
    )
    nothing = F.struct(start_year.cast("int").alias("start_year"), start_date.alias("start_date"))
    # the first two rules can only match a word right before a year; looking for those
    # words once leaves a short text for the long month and season patterns
    def near_years(t: Column) -> Column:
        return F.array_join(F.regexp_extract_all(t, F.lit(r"(?U)(?<![a-z])[a-z]++\s++20\d{2}"), 0), "; ")

    return F.coalesce(given, bind(body, lambda t: F.coalesce(
        bind(near_years(t), lambda near: F.coalesce(dated(near, lookups.MONTHS), dated(near, lookups.SEASONS))),
        undated(t, r"(?U)(start|begin|commenc)\w*[^.\n]{0,30}?(20\d{2})"),
        undated(t, r"(?U)(class of|graduat\w+ in|grad(?:uating)? )\s*(20\d{2})"),
    )), nothing)


def infer_country(location: Column) -> Column:
    """First country of the ordered list, else state or province code, else Remote."""
    trimmed = strip(text(location))
    low = F.lower(trimmed)
    # position in the ordered list: the earliest listed country wins, wherever it stands
    first = F.array_min(F.transform(_COUNTRY_SCAN.hits(low), lambda h: lookup(h, _COUNTRY_ORDER)))
    named = F.get(literal_strings(_COUNTRY_NAMES), first)
    codes = F.transform(
        F.regexp_extract_all(trimmed, F.lit(r"(?U),\s*([A-Za-z]{2})(?:\s|,|$|\))"), 1), lambda c: F.upper(c))
    coded = bind(codes, lambda cs: (
        F.when(F.exists(cs, lambda c: c.isin(lookups.US_STATES)), "United States")
        .when(F.exists(cs, lambda c: c.isin(lookups.CA_PROVINCES)), "Canada")))
    return F.coalesce(named, coded, F.when(low.contains("remote"), "Remote"))


def is_remote(location: Column, flag: Column) -> Column:
    """N4."""
    return F.coalesce(flag, F.lit(False)) | F.lower(text(location)).contains("remote")


def _key(*parts: Column) -> Column:
    return F.sha1(strip(F.lower(F.concat_ws("::", *[text(p) for p in parts]))))


def dedup_key(source: Column, source_job_id: Column) -> Column:
    """Identity of a posting within its source."""
    return _key(source, F.coalesce(source_job_id, F.lit("None")))


def content_key(company: Column, title: Column, location: Column) -> Column:
    """Identity of a role across sources."""
    return _key(company, title, location)
