"""De-duplication, matching, scores and scale paths against brute force."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from postloom import lookups
from postloom.operators import analysis, components, dedup, filters, matching, scale, state
from postloom.plans import catalog, overlay
from postloom.session import cut_lineage
from postloom.sources import feeds


def greedy(rows, dks=(), cks=()):
    dks, cks, out = set(dks), set(cks), []
    for seq, d, c in sorted(rows):
        if d not in dks and c not in cks:
            dks.add(d), cks.add(c), out.append(seq)
    return out


def keyed(spark, rows):
    return spark.createDataFrame(rows, "seq long, dedup_key string, content_key string")


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_dedup_equals_sequential(spark, hot_rows):
    rng = random.Random(7)
    rows = [(i, f"d{rng.randrange(90)}", f"c{rng.choice([0, 0, rng.randrange(120)])}") for i in range(300)]
    known = keyed(spark, [(0, "d1", "c1"), (1, "d2", "x")])
    dead = spark.createDataFrame([("d3", None), (None, "c4")], "dedup_key string, content_key string")
    got = dedup.accepted_keys(keyed(spark, rows).repartition(5), known, dead, hot_rows).select("seq").collect()
    assert sorted(r.seq for r in got) == greedy(rows, {"d1", "d2", "d3"}, {"c1", "x", "c4"})


def test_refused_rows_claim_no_keys(spark):
    rows = [(1, "d1", "c1"), (2, "d1", "c2"), (3, "d3", "c2")]
    assert sorted(r.seq for r in dedup.accepted_keys(keyed(spark, rows)).collect()) == [1, 3]


@pytest.mark.parametrize("most", [8, 10**6])
def test_dedup_by_components(spark, most):
    """Small, mixed and no large components give the rows of an insertion one by one."""
    rng = random.Random(11)
    rows = [(i, f"d{rng.randrange(160)}", f"c{rng.randrange(150)}") for i in range(260)]
    rows += [(1000 + i, f"e{(i + 1) // 2}", f"f{i // 2}") for i in range(30)]
    rng.shuffle(rows)
    got = dedup.accepted_keys(keyed(spark, rows).repartition(5), rounds=1, component_rows=most)
    assert sorted(r.seq for r in got.collect()) == greedy(rows)


def test_long_chain_in_bounded_steps(spark, monkeypatch):
    """10,000 rows that share keys in turn: the tables written don't grow with the chain."""
    chain = [(i, f"d{(i + 1) // 2}", f"c{i // 2}") for i in range(10_000)]
    written = []
    for module in (dedup, components):
        monkeypatch.setattr(module, "cut_lineage", lambda df, label: written.append(label) or cut_lineage(df, label))
    got = dedup.accepted_keys(keyed(spark, chain))
    assert sorted(r.seq for r in got.collect()) == greedy(chain)
    assert len(written) < 80, len(written)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(-1, i) for i in range(0, 400, 3)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[top(a)] = top(b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert set(got) == linked
    assert len({(top(n), got[n]) for n in linked}) == len({top(n) for n in linked}) == len(set(got.values()))


def test_dedup_chain_and_empty(spark):
    chain = [(i, f"d{(i + 1) // 2}", f"c{i // 2}") for i in range(12)]
    assert sorted(r.seq for r in dedup.accepted_keys(keyed(spark, chain)).collect()) == greedy(chain)
    assert dedup.accepted_keys(keyed(spark, chain).limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def test_near_matches_lose_nothing(spark):
    """The piece-wise blocking finds exactly what comparing all pairs finds."""
    rng = random.Random(3)
    base = ["kubernetes", "python", "postgresql", "spring", "distributed systems", "elasticsearch engineers", "node.js"]
    words = set(base)
    for w in base:
        for _ in range(25):
            chars = list(w)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(chars))
                if rng.random() < 0.5 and len(chars) > 5:
                    chars.pop(at)
                else:
                    chars.insert(at, rng.choice("aeknpst"))
            words.add("".join(chars))
    words = sorted(words)
    names = spark.createDataFrame([(w,) for w in words], "keyword string")
    terms = spark.createDataFrame([(1, w) for w in words], "candidate_id int, term string")
    pairs = matching._near_hits(names, terms.withColumn("candidate_id", F.col("term")))
    got = {(r["keyword"], r["candidate_id"]) for r in pairs.collect()}
    want = {(a, b) for a, b in itertools.product(words, words)
            if len(a) >= 5 and len(b) >= 5 and 200 * lcs(a, b) >= lookups.FUZZY_RATIO * (len(a) + len(b))}
    assert got == want
    assert ("kubernetes", "kubernetes") in got and ("python", "pythom") not in got


def test_near_matches_of_long_tokens(spark):
    """Tokens around and beyond the length where pieces meet at any place, some of thousands of characters."""
    rng = random.Random(4)

    def changed(word, n):
        chars = list(word)
        for _ in range(n):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                chars.pop(at)
            else:
                chars.insert(at, rng.choice("abcdefgh"))
        return "".join(chars)

    words = set()
    for size in (36, 39, 41, 44, 60, 130):
        base = "".join(rng.choice("abcdefgh") for _ in range(size))
        words |= {base, *(changed(base, rng.randrange(1, size // 6)) for _ in range(6))}
    giant = "".join(rng.choice("abcdefgh") for _ in range(5000))
    giants = {giant, changed(giant, 300), changed(giant, 900), changed(giant, 2500)}
    names = spark.createDataFrame([(w,) for w in sorted(words | giants)], "keyword string")
    terms = spark.createDataFrame([(w, w) for w in sorted(words | giants)], "candidate_id string, term string")
    got = {(r["keyword"], r["candidate_id"]) for r in matching._near_hits(names, terms).collect()}
    same = lambda a, b: matching.common_subsequence(a, b)
    assert all(same(a, b) == lcs(a, b) for a, b in itertools.combinations(sorted(words)[:12], 2))
    want = {(a, b) for a, b in itertools.product(words | giants, repeat=2) if abs(len(a) - len(b)) * 9 < len(a) + len(b)
            and 200 * same(a, b) >= lookups.FUZZY_RATIO * (len(a) + len(b))}
    assert got == want and len([p for p in got if p[0] in giants and p[0] != p[1]]) > 0


def test_tiers_equal_brute_force(spark, sf):
    names = cut_lineage(catalog._keyword_rows(spark, sf).select("keyword").distinct())
    cands = overlay.candidates(spark, sf)
    small = {tuple(r) for r in matching.keyword_hits(names, cands, True).collect()}
    large = {tuple(r) for r in matching.keyword_hits(names, cands, False).collect()}
    assert small == large and {t for _, _, t in small} == {1, 2, 3, 4}


def test_shuffle_and_broadcast_paths_agree(spark, sf, monkeypatch):
    """Everything small is broadcast; with the size check failing the salted joins give the same scores."""
    def scores(a):
        cols = [F.round(c, 9) if c in ("coverage", "match_rate", "similarity", "ats_score") else F.col(c) for c in analysis.pair_scores(a).columns]
        return sorted(tuple(r) for r in analysis.pair_scores(a).select(*cols).collect())

    a = catalog._analysis(spark, sf)
    wide = analysis.Analysis(a.postings, a.candidates, False, a.stop_words, hit_rows=0)
    monkeypatch.setattr(scale.hot_keys, "__defaults__", (50,))
    assert scores(a) == scores(wide)
    spots = lambda x: {(r.posting_id, r.candidate_id, r.keyword, tuple(s.bullet_index for s in r.spots)) for r in analysis.find_spots(x).collect()}
    assert spots(a) == spots(wide)


def test_scores_hold_their_bounds(spark, sf):
    a = catalog._analysis(spark, sf)
    s = analysis.pair_scores(a)
    assert s.filter("ats_score < 0 or ats_score > 100 or matched > total or required_matched > required_total").count() == 0
    rows = analysis.pair_gaps(a).join(s, list(analysis.PAIR)).filter(F.size("gaps") + F.size("matched_keywords") != F.col("total"))
    assert rows.count() == 0
    assert s.count() == analysis.pairs(a).count() == s.select(*analysis.PAIR).distinct().count()


def test_empty_texts_score_zero(spark):
    posts = spark.createDataFrame([(1, "", ["p"]), (2, "python", ["p"])], "posting_id long, description string, profiles array<string>")
    cands = spark.createDataFrame([(1, "p", "")], "candidate_id long, profile_id string, text string")
    got = {r.posting_id: r for r in analysis.pair_scores(analysis.Analysis.prepare(posts, cands)).collect()}
    assert (got[1].coverage, got[1].match_rate, got[1].ats_score, got[1].total) == (0.0, 0.0, 0.0, 0)
    assert got[2].total == 1 and got[2].ats_score == 0.0


def test_every_branch_is_reached(spark, sf):
    judged = catalog.QUERIES["filter_reason_counts"](spark, sf).collect()
    heads = {r.reason.split(":")[0].split(" 20")[0] for r in judged}
    assert heads == {"passes", "no role keyword in title", "excluded seniority term in title", "no entry-level signal",
                     "blocked job type in title", "blocked country", "country not allowed", "starts"}
    kinds = {(r.section, r.soft) for r in catalog._keyword_rows(spark, sf).select("section", "soft").distinct().collect()}
    assert {("required", False), ("preferred", False), ("core", True), ("required", True)} <= kinds
    assert {r.label for r in catalog.QUERIES["extract_posting_text"](spark, sf).select("label").distinct().collect()} >= {"json-ld", "html"}


def test_listing_and_bands(spark):
    rows = spark.createDataFrame([("a", 50.0, 1, "x"), ("b", None, 9, "x"), ("c", 50.0, 2, "x"), ("d", 61.0, 0, "y")],
                                 "id string, ats_score double, created_at int, status string")
    assert [r.id for r in state.list_postings(rows).collect()] == ["d", "c", "a", "b"]
    assert [r.id for r in state.list_postings(rows, "x", "newest").collect()] == ["b", "c", "a"]
    bands = {r.id: r.b for r in rows.select("id", state.score_band(F.col("ats_score")).alias("b")).collect()}
    assert bands == {"a": "borderline", "b": "unscored", "c": "borderline", "d": "likely passes"}


def test_changes_take_the_last_valid_value(spark):
    stored = spark.createDataFrame([("a", "to_apply", "old"), ("b", "to_apply", "old")], "id string, status string, description string")
    log = spark.createDataFrame([("a", 1, 5, "status", "offer"), ("a", 2, 5, "status", "applied"), ("a", 3, 9, "status", "bogus"),
                                 ("b", 4, 1, "description", "  new "), ("z", 5, 1, "status", "offer")],
                                "id string, change_seq int, ts int, field string, value string")
    new, bad = state.apply_changes(stored, log)
    assert {tuple(r) for r in new.collect()} == {("a", "applied", "old"), ("b", "to_apply", "new")}
    assert [r.value for r in bad.collect()] == ["bogus"]


def test_alerts(spark):
    rows = spark.createDataFrame([("1", "T", "C", "", True, None, None, "u", False), ("2", "T", "C", "X", False, 2027, None, "u", True)],
                                 "id string, title string, company string, location string, remote boolean, start_year int, start_date string, url string, notified boolean")
    out, after = state.alert_outbox(rows, "slack", "http://d")
    assert [r.message for r in out.collect()] == ["🆕 T — C\n📍 Remote   🗓 start: n/a\n🔗 u\nid: 1\nopen: http://d/#/job/1"]
    assert state.alert_outbox(rows, "none")[0].count() == 0 and after.filter("not notified").count() == 0


def test_more_profiles_than_one_pass(spark, sf):
    many = [filters.FilterProfile(f"p{i}", role_keywords=["analyst"] if i % 2 else []) for i in range(filters.PROFILES_PER_PASS + 3)]
    rows = filters.filter_multi_profile(feeds.with_start(overlay.postings(spark, sf)), many, "seq")
    assert rows.select("profile_id").distinct().count() == len(many) and rows.count() == len(many) * 200


# --- plans -------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    a = catalog._analysis(spark, sf)
    for df in (analysis.pair_scores(a), analysis.find_spots(a), analysis.pair_gaps(a), analysis.matched_missing(a)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "EvalPython" not in text
        assert "BroadcastHashJoin" in text
    wide = analysis.Analysis(a.postings, a.candidates, False, a.stop_words, hit_rows=0)
    text = plan(analysis.pair_scores(wide))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "_salt" in text
    narrow = plan(catalog.QUERIES["infer_country_remote"](spark, sf))
    assert "Exchange" not in narrow and "ReadSchema: struct<doc_id:bigint>" in narrow
    for name in ("filter_reasons", "filter_multi_profile", "posting_keys", "candidate_terms"):
        # at most the one exchange that spreads a small input file over the cores
        assert plan(catalog.QUERIES[name](spark, sf)).count("Exchange") <= 1
    assert "WindowGroupLimit" in plan(state.top_k_postings(
        analysis.pair_scores(a).selectExpr("*", "posting_id as id", "posting_id as created_at"), 10, "candidate_id"))


def test_best_pairs_without_scoring_all(spark, sf):
    """Few pairs are scored, and the best of each candidate are those of scoring all; likewise through shuffles."""
    a = catalog._analysis(spark, sf)
    every = sorted((r.candidate_id, -round(r.ats_score, 6), r.posting_id) for r in analysis.pair_scores(a).collect())
    best = lambda rows, k: [r for _, rs in itertools.groupby(rows, lambda r: r[0]) for r in itertools.islice(rs, k)]
    credit = analysis.keyword_credit(a)
    for k in (1, 3):
        few = analysis.contenders(a, k, credit)
        got = sorted((r.candidate_id, -round(r.ats_score, 6), r.posting_id) for r in analysis.pair_scores(a, few).collect())
        assert best(got, k) == best(every, k) and len(got) == few.count() < len(every) / 2, (len(got), len(every))
    # more asked for than there are: all pairs, those without a common keyword too
    assert analysis.contenders(a, len(every) + 1, credit).count() == len(every)
    wide = analysis.Analysis(a.postings, a.candidates, False, a.stop_words, 0)
    got = sorted((r.candidate_id, -round(r.ats_score, 6), r.posting_id) for r in analysis.top_scores(wide, 3).collect())
    assert best(got, 3) == best(every, 3)
    gaps = {(r.posting_id, r.candidate_id): r for r in analysis.pair_gaps(a).collect()}
    some = analysis.contenders(a, 2, credit)
    assert all(gaps[r.posting_id, r.candidate_id] == r for r in analysis.pair_gaps(wide, some).collect())
