"""Profiles as a table give the verdicts of profiles as expressions."""
import random
import time

import pytest
from pyspark.sql import functions as F

from postloom.operators import filters, profiles
from postloom.plans import overlay
from postloom.sources import feeds

TERMS = ["analyst", "finance", "engineer", "senior", "lead", "ii", "part-time", "new grad", "data analyst", "ata ana", " Junior ", "(contract)", "c++", ".net", "r",
         "CRM tooling", "", "  ", "++", "a", "s e", "grad (", "engineering manager"]
COUNTRIES = ["Canada", "India", "United Kingdom", "united states", "Poland", "Remote", "Mexico"]


def drawn(n, seed=1):
    rng = random.Random(seed)
    some = lambda values, most: [rng.choice(values) for _ in range(rng.randrange(0, most))]
    return [filters.FilterProfile(
        f"p{i}", role_keywords=some(TERMS, 4), title_only=rng.random() < 0.6, exclude_title_terms=some(TERMS, 3), require_entry_level=rng.random() < 0.4,
        entry_signals=rng.choice([None, [], ["new grad", "junior", "associate"], some(TERMS, 4)]), blocked_types=rng.choice([None, [], some(TERMS, 3)]),
        remote_ok=rng.random() < 0.5, allowed_countries=some(COUNTRIES, 4), blocked_countries=some(COUNTRIES, 3), allowed_locations=some(["toronto", "Austin", "new", ""], 3),
        allow_unknown_locations=rng.random() < 0.5, earliest_start=rng.choice([None, "2027-05-01", "2028", "soon", " 27", "2026-01-01"])) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def posts(spark, sf):
    made = feeds.with_start(overlay.postings(spark, sf)).filter("seq < 90")
    odd = made.filter("seq < 6").withColumns({"seq": F.col("seq") + 1000, "title": F.when(F.col("seq") > 2, F.lit("C++ R&D  new  grad (CONTRACT) .NET ++")), "description": F.lit(None).cast("string"),
                                              "location": F.when(F.col("seq") > 3, F.lit("")), "start_year": F.lit(0)})
    return made.unionByName(odd).cache()


def test_table_equals_expressions(spark, posts):
    drew = drawn(40)
    want = rows(filters.filter_multi_profile(posts, drew, "seq"))
    table = profiles.profile_table(spark, drew)
    assert rows(profiles.filter_profile_table(posts, table, "seq")) == want
    assert rows(profiles.passing_pairs(posts, table, "seq")) == [r[:2] for r in want if r[2] is None] != []


def test_without_broadcasts(spark, posts, monkeypatch):
    drew = drawn(12, 2)
    table = profiles.profile_table(spark, drew)
    want = rows(profiles.filter_profile_table(posts, table, "seq"))
    monkeypatch.setattr(profiles, "BROADCAST_TERMS", 0)
    assert rows(profiles.filter_profile_table(posts, table, "seq")) == want
    assert rows(profiles.passing_pairs(posts, table, "seq")) == [r[:2] for r in want if r[2] is None]


def test_thousands_of_profiles_are_planned_in_seconds(spark, posts):
    table = profiles.profile_table(spark, drawn(5000, 3))
    start = time.time()
    made = profiles.passing_pairs(posts, table, "seq")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 60 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert profiles.term_index(profiles.settled(table)).count() < 60
    assert profiles.filter_profile_table(posts.limit(2), table, "seq").count() == 10_000


def test_no_profiles_and_no_postings(spark, posts):
    none = profiles.profile_table(spark, drawn(2)).limit(0)
    assert profiles.passing_pairs(posts, none, "seq").count() == profiles.filter_profile_table(posts, none, "seq").count() == 0
    assert profiles.passing_pairs(posts.limit(0), profiles.profile_table(spark, drawn(3)), "seq").count() == 0


def test_texts_are_read_once_by_scan_and_by_index(spark, posts, monkeypatch):
    drew = drawn(30, 4)
    table = profiles.profile_table(spark, drew)
    want = rows(filters.filter_multi_profile(posts, drew, "seq"))
    for most in (profiles.SCAN_TERMS, 3):
        monkeypatch.setattr(profiles, "SCAN_TERMS", most)
        made, every = profiles.passing_pairs(posts, table, "seq"), profiles.filter_profile_table(posts, table, "seq")
        assert rows(every) == want and rows(made) == [r[:2] for r in want if r[2] is None]
        for df in (made, every):
            assert "description" not in df._jdf.queryExecution().optimizedPlan().toString()
