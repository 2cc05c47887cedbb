"""Keyword extraction and pairs where the posting is: same rows as the joins, and no shuffle of pairs."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.text import SPACES, count_substring, counted_tokens, normalize_text, run_lengths, without
from postloom.operators import analysis, batches, keywords, prompts

WORDS = "python kafka spark docker billing ledger reports sql linux airflow metrics invoices payroll kubernetes".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_counted_in_batches(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([*WORDS, "the", "of"], k=rng.randrange(60))) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", keywords.ngrams(F.col("t"), lookups.STOP_WORDS, 5).alias("n"))
    assert "ArrowEvalPython" in plan(df)
    for r in df.collect():
        if texts[r.i] is None:
            assert r.n is None
            continue
        kept = [w for w in texts[r.i].split() if w not in lookups.STOP_WORDS]
        runs = Counter(kept) + Counter(f"{a} {b}" for a, b in zip(kept, kept[1:]))
        assert [(g.term, g.tf) for g in r.n] == sorted(runs.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_salient_terms_are_cleaned_and_counted_with_the_text(spark):
    """The normalised text and a term's places are those of the column expressions, for every kind of white space."""
    texts = ["".join(f"Kafka{s}C++-, data.{s}{s}kafka" for s in SPACES), "aa aa aa", " \u200bx\u180ey z9. ", "", None, "İstanbul ΣΑΣ Ÿ"]
    assert set(SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select(
        "i", keywords._salient(F.col("t"), lookups.STOP_WORDS).alias("s"), normalize_text(F.col("t")).alias("norm")).select(
        "*", F.transform("s.ranked", lambda r: count_substring(F.col("norm"), r["term"])).alias("hits"))
    for r in df.collect():
        assert r.s.norm == r.norm and (r.hits is None if texts[r.i] is None else [t.hits for t in r.s.ranked] == r.hits)
        assert all(" ".join(t.words) == t.term for t in r.s.ranked or [])


def test_tokens_counted_in_batches(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices([*WORDS, "the", "of", "é", "\U0001f600", "\uffff"], k=rng.randrange(40))) for i in range(40)] + [(40, []), (41, None)]
    df = spark.createDataFrame(rows, "i long, t array<string>").coalesce(1).select(
        "i", counted_tokens(F.col("t"), ["the", "of"]).alias("got"), run_lengths(without(F.col("t"), ["the", "of"])).alias("want"))
    assert "ArrowEvalPython" in plan(df)
    for r in df.collect():
        assert r.got == r.want


def test_segments_at_every_white_space(spark):
    gaps = [a + b for a in [*SPACES, ""] for b in ("\n", " ", "\xa0", "")]
    texts = [f"{g}need to have:{g}a b.{g}c;{g}d{g}e{g}" for g in gaps]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", keywords.segments(F.col("t")).alias("s"))
    for r in df.collect():
        cut = [p.strip(SPACES) for line in re.split("[\n\r\x0b\x0c\x1c-\x1e\x85  ]", texts[r.i])
               for p in re.split(f"(?<=[.;:])[{re.escape(SPACES)}]+", line.strip(SPACES))]
        assert [s.segment for s in r.s] == [p for p in cut if p]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choices(WORDS, k=7)).capitalize() + "."
    posts = spark.createDataFrame([(i, [["A"], ["A", "B"], []][i % 3], "Requirements:\n" + "\n".join(line() for _ in range(4)) if i else None)
                                   for i in range(20)], "posting_id long, profiles array<string>, description string")
    cands = spark.createDataFrame([(i, "AB"[i % 2], "\n".join("- " + line() for _ in range(4)) if i != 6 else None) for i in range(150)],
                                  "candidate_id long, profile_id string, text string")
    return analysis.Analysis.prepare(posts, cands)


def test_batches_equal_joins(prepared):
    """Three blocks of candidates; every result of the joins comes out."""
    a = prepared
    wide = analysis.Analysis(a.postings, a.candidates, False, a.stop_words)
    assert a.in_batches and not wide.in_batches
    rounded = lambda v: round(v, 6) if isinstance(v, float) else [rounded(x) for x in v] if isinstance(v, (list, tuple)) else v
    for made in (analysis.pair_scores, analysis.pair_gaps, analysis.find_spots, analysis.matched_missing, analysis.keyword_credit,
                 analysis.assemble_analysis):
        columns = made(a).columns if made is not analysis.matched_missing else [*analysis.PAIR, "keyword", "section", "match_tier"]
        got, want = (sorted(map(repr, map(rounded, made(x).select(*columns).collect()))) for x in (a, wide))
        assert got == want and got, made.__name__


def test_bars_of_earlier_batches_count():
    rng = np.random.default_rng(2)
    best, seen, kept = batches.Best(3, 0.1, 4), [], []
    for _ in range(20):
        who, score = rng.integers(0, 4, 30), rng.random(30) * 10
        keep = best.keep(who, score)
        seen += zip(who, score)
        kept += zip(who[keep], score[keep])
    for c in range(4):
        mine = sorted((s for w, s in seen if w == c), reverse=True)
        held = sorted((s for w, s in kept if w == c), reverse=True)
        n = sum(s >= mine[2] - 0.1 for s in mine)
        assert held[:n] == mine[:n] and len(held) < len(mine) / 2


def test_best_pairs_are_kept_in_batches(prepared):
    """One pass, no join of texts: the best of what is kept are the best of all, ties after rounding included."""
    a = analysis.Analysis(prepared.postings.coalesce(1), prepared.candidates, prepared.fits, prepared.stop_words)
    every = analysis.pair_scores(a).collect()
    for k in (1, 3):
        df = analysis.top_scores(a, k)
        got = {(r.candidate_id, r.posting_id): r for r in df.collect()}
        assert len(got) < len(every)
        for c in {r.candidate_id for r in every}:
            mine = sorted((r for r in every if r.candidate_id == c), key=lambda r: -r.ats_score)
            for r in mine:
                if round(r.ats_score, 4) >= round(mine[min(k, len(mine)) - 1].ats_score, 4):
                    assert got[c, r.posting_id] == r
    assert analysis.top_scores(a, 1000).count() == len(every)
    assert "credit" not in plan(df) and "missing" not in plan(analysis.pair_scores(a))


def test_pairs_are_not_shuffled(prepared):
    for df in (analysis.assemble_analysis(prepared), analysis.pair_scores(prepared), analysis.find_spots(prepared)):
        text = plan(df)
        assert "MapInArrow" in text and "Exchange hashpartitioning(posting_id" not in text


def test_repeated_ids_take_the_joins(spark, prepared):
    twice = analysis.Analysis(prepared.postings.union(prepared.postings), prepared.candidates, True, prepared.stop_words)
    assert not twice.in_batches


@pytest.fixture(scope="module")
def told(spark):
    """Postings with their texts, candidates with long bullets of many kinds of characters."""
    rng = random.Random(6)
    line = lambda n=7: " ".join(rng.choices([*WORDS, "é", "\U0001f600"], k=n)).capitalize() + "."
    rows = [(i, ["A"] if i % 4 else ["A", "B"], f" T{i}" if i != 3 else None, "C at", " \nRequirements:\n" + "\n".join(line(9) for _ in range(8)) + "\n" if i else None)
            for i in range(12)]
    posts = spark.createDataFrame(rows, "posting_id long, profiles array<string>, title string, company string, description string")
    cands = spark.createDataFrame([(i, "AB"[i % 2], "\n".join("- " + line(20) for _ in range(5)) if i != 3 else None) for i in range(9)],
                                  "candidate_id long, profile_id string, text string")
    a = analysis.Analysis.prepare(posts, cands, keep=("title", "company", "description"))
    return posts, cands, a, analysis.Analysis(a.postings, cands, False, a.stop_words)


def all_rows(df):
    return sorted(map(repr, df.collect()))


def test_documents_written_in_batches(told):
    """the same texts as from the joins, without a shuffle of pairs or a function over each pair's keywords."""
    posts, cands, a, wide = told
    assert a.in_batches and not wide.in_batches
    for make, texts in ((lambda x: prompts.gap_block(x), prompts.GAP_BLOCK), (lambda x: prompts.gap_requests(x, posts, cands), prompts.REQUEST),
                        (lambda x: prompts.tailoring_prompts(x, posts, cands), prompts.TAILORING),
                        (lambda x: prompts.tailoring_prompts(x, posts), prompts.TAILORING)):
        made = make(analysis.assemble_analysis(a, texts=texts))
        assert all_rows(made) == all_rows(make(analysis.assemble_analysis(wide, texts=texts))) == all_rows(make(analysis.assemble_analysis(a)))
        text = plan(made)
        assert "Exchange hashpartitioning(posting_id" not in text and "lambdafunction" not in text.split("MapInArrow")[0]
    blocks = [r.gap_block for r in prompts.gap_block(analysis.assemble_analysis(a, texts=prompts.GAP_BLOCK)).collect()]
    assert prompts.NO_MATCH in blocks and any("; " in b and "\U0001f600" in b for b in blocks)


def test_analyses_are_assembled_in_batches(told):
    """the nested columns leave the batches as they are."""
    _, _, a, wide = told
    made = analysis.assemble_analysis(a)
    assert made.columns == analysis.assemble_analysis(wide).columns and all_rows(made.drop("ats_score")) == all_rows(analysis.assemble_analysis(wide).drop("ats_score"))
    assert "lambdafunction" not in plan(made).split("MapInArrow")[0]


def test_keywords_of_a_pair_in_one_row(told):
    """no row for each keyword, and no shuffle to bring them together."""
    _, _, a, wide = told
    made = analysis.matched_missing(a, lists=True)
    listed = lambda df: {(r.posting_id, r.candidate_id): sorted(map(repr, r.every)) for r in df.collect()}
    assert listed(made) == listed(analysis.matched_missing(wide, lists=True)) and listed(made)
    above = plan(made).split("MapInArrow")[0]
    assert above.count("Generate ") == 1 and "hashpartitioning(posting_id" not in above and "hashpartitioning(candidate_id" not in above


def test_rounded_as_spark_does(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.random(2000), np.arange(2001) / 2000, np.nextafter(np.arange(2001) / 2000, 2), np.nextafter(np.arange(2001) / 2000, -1), [1.0, 0.0]])
    want = [r.r for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(F.round("v", 3).alias("r")).collect()]
    assert batches.rounded(x).tolist() == want
