"""Hand-computed cases for text, inference, filters and keywords."""
import html

import pytest
from pyspark.sql import functions as F

from postloom.functions import infer, text
from postloom.operators import keywords as kw
from postloom.operators import matching
from postloom.operators.filters import FilterProfile, filter_reasons


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("hay, term, expected", [
    ("leading analyst", "lead", False), ("engineering manager", "engineering manager", True),
    ("graduate", "grad ", False), ("new grad role", "grad ", True), ("c++ developer", "c++", True),
    ("anything", "  ", False), ("austin", "us", False),
])
def test_term_in(spark, hay, term, expected):
    assert one(spark, hay, lambda v: text.term_in(v, F.lit(term))) is expected
    assert one(spark, hay, lambda v: text.has_any_term(v, [term])) is expected


@pytest.mark.parametrize("body, year, date", [
    ("dismay 2027", 2027, "2027-05-01"), ("may 2027", 2027, "2027-05-01"),
    ("Summer 2026, later Sept 2028", 2028, "2028-09-01"), ("autumn 2026", 2026, "2026-09-01"),
    ("commencing early in 2029", 2029, "2029-01-01"), ("start soon. 2029", None, None),
    ("graduated in 2025", 2025, "2025-01-01"), ("the year 2029", None, None),
])
def test_infer_start(spark, body, year, date):
    got = one(spark, body, lambda v: infer.infer_start(F.lit("x"), v, F.lit(None).cast("int"), F.lit(None).cast("string")))
    assert (got["start_year"], got["start_date"]) == (year, date)


def test_given_year_is_kept(spark):
    got = one(spark, "May 2030", lambda v: infer.infer_start(F.lit(""), v, F.lit(2027), F.lit(None).cast("string")))
    assert (got["start_year"], got["start_date"]) == (2027, "2027-01-01")


@pytest.mark.parametrize("place, country", [
    ("Austin", None), ("New Mexico", "Mexico"), ("Latin America", "United States"), ("Bangalore, IN", "United States"),
    ("Berlin, DE", "United States"), ("Toronto, ON", "Canada"), ("Seoul, South Korea", "South Korea"),
    ("Canada or USA", "United States"), ("U.S. only", "United States"), ("fully remote", "Remote"), ("", None),
    ("Ukraine", "Ukraine"), ("Boston, MA)", "United States"),
])
def test_country(spark, place, country):
    assert one(spark, place, infer.infer_country) == country


def test_keys_strip_only_the_outside(spark):
    got = one(spark, " ACME ", lambda v: infer.content_key(v, F.lit("T"), F.lit(" here ")))
    import hashlib
    assert got == hashlib.sha1("acme ::t:: here".encode()).hexdigest()


def test_markup_variants(spark):
    assert one(spark, "&amp;lt;b&amp;gt; x", text.strip_markup_board) == "<b> x"
    assert one(spark, "<p>a</p>&amp;<br>b", text.strip_markup_plain) == "a &amp; b"
    page = "<STYLE>x</style><script a>var t='</p>';</SCRIPT><p>caf&eacute; &amp;lt; &#8212;</p>"
    assert one(spark, page, text.strip_markup_page) == html.unescape("caf&eacute; &amp;lt; &#8212;")


def test_sentences_and_lines(spark):
    assert one(spark, "One. Two;\n\n Three\nfour", text.sentences) == ["One.", "Two;", "Three", "four"]
    assert one(spark, "a\r\nb\x0bc d\x1ee", text.lines) == ["a", "b", "c", "d", "e"]


def test_run_lengths_and_counts(spark):
    got = one(spark, "b a b c b", lambda v: text.run_lengths(F.split(v, " ")))
    assert [(r["value"], r["n"]) for r in got] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, "aaaa", lambda v: text.count_substring(v, F.lit("aa"))) == 2


def sections(spark, jd):
    return [(r["section"], r["segment"]) for r in one(spark, jd, kw.segments)]


def test_sections(spark):
    assert sections(spark, "Preferred requirements:\nx")[1] == ("preferred", "x")
    long_header = "y" * 70 + ":"
    assert sections(spark, f"Requirements:\n{long_header}\nz")[-1] == ("required", "z")
    assert sections(spark, "Requirements:\nshort:\nz")[-1] == ("core", "z")
    assert sections(spark, "Requirements: X. Nice to have: Y.") == [
        ("required", "Requirements:"), ("required", "X."), ("preferred", "Nice to have:"), ("preferred", "Y.")]
    assert sections(spark, "") == []


def skills(spark, jd):
    return {r["value"]: r["n"] for r in one(spark, jd, lambda v: kw.skill_counts(text.normalize_text(v)))}


def test_skills(spark):
    assert skills(spark, "REST API, asp.net, R&D, algorithms") == {"rest": 1, "rest api": 1, "asp.net": 1, "r": 1, "algorithms": 1}
    assert skills(spark, "go go  go; C++/C# react natives") == {"go": 3, "c++": 1, "c#": 1, "react": 1}
    assert skills(spark, "ruby on rails vue.js k8s") == {"ruby": 1, "ruby on rails": 1, "rails": 1, "vue": 1, "vue.js": 1, "k8s": 1}


def found(spark, jd):
    return {r["keyword"]: r for r in one(spark, jd, lambda v: kw.keywords(v))}


def test_keywords(spark):
    got = found(spark, "Requirements: REST API and rest api.\nNice to have: Kafka.")
    assert got["rest api"]["count"] == 4 and got["rest api"]["section"] == "required"
    assert got["rest api"]["importance"] == 1.0
    assert got["kafka"]["section"] == "preferred" and got["kafka"]["importance"] == pytest.approx(0.45 * (0.4 + 0.6 / 4))
    spread = found(spark, "Requirements: spring  boot")
    assert spread["spring"]["section"] == "required"      # the single word; the pair is split by two spaces
    assert found(spark, "") == {}


def test_soft_terms_block_in_order(spark):
    # the bigram "ledger tooling" comes after both of its words, which block it
    got = found(spark, "ledger tooling ledger tooling")
    assert {"ledger", "tooling"} <= set(got) and "ledger tooling" not in got
    # a bigram seen first does not block its word: "zeta alpha" < "zeta" never, so force by count
    first = found(spark, "alpha beta; alpha gamma")
    assert "alpha" in first and "alpha beta" not in first
    assert first["alpha"]["importance"] == pytest.approx(0.6 * 1.0)


def test_bullets_fall_back_to_sentences(spark):
    prose = "This is the first full sentence here. And this is the second full sentence."
    assert one(spark, prose, matching.bullets) == ["This is the first full sentence here.", "And this is the second full sentence."]
    three = "\n".join(f"• - {c * 25} –" for c in "abc")
    assert one(spark, three, matching.bullets) == [c * 25 for c in "abc"]


def test_terms_keep_a_trailing_dot(spark):
    assert set(one(spark, "Uses k8s and pandas.", matching.resume_terms)) == {"kubernetes", "pandas", "uses", "and", "pandas."}


def reasons(spark, profile, rows):
    df = spark.createDataFrame(rows, "title string, description string, location string, remote boolean, start_year int")
    return [r["reject_reason"] for r in filter_reasons(df, profile).collect()]


def test_filter_order_and_quirks(spark):
    p = FilterProfile.from_config("p", {
        "role_keywords": ["analyst"], "exclude_title_terms": ["lead"], "job_type": {"blocked": []},
        "location": {"allowed_countries": ["Canada", "United Kingdom"], "blocked_countries": ["United Kingdom"], "remote_ok": False},
        "earliest_start": "2027-05-01"})
    got = reasons(spark, p, [
        ("Clerk", "analyst", "Canada", False, None), ("Lead Analyst", "", "Canada", False, None),
        ("Leading Analyst", "", "Canada", False, None), ("Analyst", "", "London, UK", False, None),
        ("Analyst", "", "Remote", False, None), ("Analyst", "", "Paris", False, None), ("Analyst", "", "Canada", False, 2026),
        ("Analyst", "", "Canada", False, 2027), ("Analyst", "", None, True, None)])
    assert got == ["no role keyword in title", "excluded seniority term in title", None, "blocked country: United Kingdom",
                   "country not allowed: Remote", None, "starts 2026 (before 2027)", None, None]


def test_title_and_description(spark):
    p = FilterProfile("p", role_keywords=["finance"], title_only=False)
    assert reasons(spark, p, [("Clerk", "in Finance", "", False, None), ("Intern", "finance", "", False, None)]) == [
        None, "blocked job type in title"]


def test_legacy_names():
    p = FilterProfile.from_config("p", {"keywords": ["a"], "exclude_titles": ["b"], "remote_ok": False, "locations": ["c"]})
    assert (p.role_keywords, p.exclude_title_terms, p.remote_ok, p.allowed_locations) == (["a"], ["b"], False, ["c"])
    assert p.blocked_types is None
