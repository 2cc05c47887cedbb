"""The training-text operators on odd inputs, and against brute force."""
import re
import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from postloom.llm import components, exact_dedup, html_text, licenses, mixing, outliers, packing, phrases, quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string, score string, kept string, fp string"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    """(doc_id, text[, source]) with columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "a b c "), (None, None), (5, "word " * 3000),
       (6, "é ü — ⚙  x"), (7, "abc"), (8, "a  bc\n"), (9, "MIT License and the Apache License, General Public License"), (10, "x" * 5000)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 0, 0), (None, 1, 1), (7, None, 5)], LABELS)


OPERATORS = {
    "dedup": lambda s, d: exact_dedup.exact_groups(exact_dedup.located(d)),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "phrases": lambda s, d: phrases.remove_repeats(d),
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "simhash": lambda s, d: simhash.near_components(d),
    "rules": lambda s, d: outliers.rule_verdicts(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    out = OPERATORS[name](spark, docs(spark, ODD))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage, monkeypatch):
    work = dict(corpus_pipeline.STAGES)[stage]
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: labels(spark))
    for rows in (ODD, []):
        given = docs(spark, rows)
        out = work(spark, given, "")
        assert stage == "packing" or out.columns == given.columns
        n = out.count()
        # the classifier of five labelled rows may reject all; every other stage keeps some of what it is given
        assert n <= len(rows) if stage == "quality" else (n > 0) == (len(rows) > 0)


ANY_NAMES = ["_metadata", "_file", "_at", "a`b", "x.y", "x3", "Text", "SOURCE", "counts", "_row", "_hash", "fp"]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_any_column_names(spark, stage, monkeypatch, tmp_path):
    work = dict(corpus_pipeline.STAGES)[stage]
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: labels(spark))
    base = docs(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    plain = work(spark, base, "")
    odd = base.select("*", *[F.lit(i) for i in range(len(ANY_NAMES))]).toDF(*base.columns, *ANY_NAMES)
    out = work(spark, odd, "")
    assert stage == "packing" or out.columns == odd.columns
    same = plain.columns
    got = out.toDF(*same, *[f"z{i}" for i in range(len(out.columns) - len(same))]).select(*same)
    assert rows_of(got, *[c for c in same if c != "sequence_id"]) == rows_of(plain, *[c for c in same if c != "sequence_id"])
    if stage == "exact dedup":      # read from files that have such a column
        base.withColumn("_metadata", F.lit(1)).write.parquet(str(tmp_path / "t"))
        assert exact_dedup.keep_first(spark.read.parquet(str(tmp_path / "t"))).count() == plain.count()


def test_locating_reports_other_errors(spark):
    with pytest.raises(Exception, match="text|doc_id"):
        exact_dedup.exact_groups(exact_dedup.located(spark.range(3).withColumnRenamed("id", "other")))


def test_pipeline_as_a_whole(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer
    from postloom.llm.common import table
    held, given = {}, table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, sf)
        path = corpus_pipeline.scratch_path(spark, "test-stage")
        made.write.parquet(path)
        given = spark.read.parquet(path)
        held[name] = given.toPandas()
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert set(held["quality"].doc_id) == {i for i, s in scores.items() if s >= quality.THRESHOLD} and len(held["quality"])
    norm = lambda t: "".join((t or "").split())
    first = held["exact dedup"]
    assert set(first.text.map(norm)) == set(held["quality"].text.map(norm)) and first.text.map(norm).is_unique
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in zip(first.doc_id, first.text, strict=True)}
    near = {i: {j for j, q in prints.items() if (p ^ q).bit_count() <= 2} for i, p in prints.items()}
    reach = lambda i, seen: [reach(j, seen) for j in near[i] - seen if not seen.add(j)] and seen or seen
    assert set(held["near dedup"].doc_id) == {min(reach(i, {i})) for i in prints}
    mixed = held["mixing"]
    words = held["near dedup"].assign(n=held["near dedup"].text.fillna("").map(lambda t: len(t.split()))).groupby("doc_id").n.sum()
    taken = mixed.assign(n=mixed.text.map(lambda t: len(t.split()))).groupby("doc_id").n.sum()
    assert (taken <= 2 * words[taken.index]).all() and taken.sum() > 0
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter((i, n) for i, x in zip(mixed.doc_id, mixed.text, strict=True)
                   for _, n in packing.pieces_of(len(t.encode(x, add_special_tokens=False).ids) + 1))
    assert Counter(zip(held["packing"].doc_id, held["packing"].length, strict=True)) == want
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert Counter(zip(whole.doc_id, whole.length, strict=True)) == want


def test_exact_dedup_rules(spark):
    got = {(r["_at"], r["_file"]): r for r in exact_dedup.exact_groups(exact_dedup.located(docs(spark, ODD))).collect()}
    by = rows_of(exact_dedup.exact_groups(exact_dedup.located(docs(spark, ODD))), "doc_id", "keep_id", "group_size", "kept")
    assert len(got) == len(ODD)
    # "abc" without white space: ids 1, 1, null, 7, 8; the null id and 8 have six characters, and an id comes first
    assert [x for x in by if x[0] == 7] == [(7, 8, 5, False)]
    assert sum(x[3] for x in by) == len({(r[1] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for r in ODD})
    assert [x[1:3] for x in by if x[0] == 2] == [(4, 4)]
    kept = exact_dedup.keep_first(docs(spark, ODD))
    assert kept.count() == sum(x[3] for x in by) and kept.columns == docs(spark, []).columns


def test_exact_dedup_checks_bytes_on_collisions(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "a a", "ccc", "b b", "ab"])]
    weak = F.unhex(F.sha2(F.length(exact_dedup.normalised()).cast("string"), 256))
    out = exact_dedup.exact_groups(exact_dedup.located(docs(spark, rows)), weak)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "kept") == [
        (0, 2, 2, False), (1, 4, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 2, True), (5, 5, 1, True)]


def test_state_goes_on_from_its_folder(spark, tmp_path):
    index, state = str(tmp_path / "index"), str(tmp_path / "state")
    kind = exact_dedup.INDEX.format(id="bigint")
    spark.createDataFrame([(b"a", 5, 3, "f", 0), (b"b", 1, 3, "f", 1)], kind).write.parquet(index)
    assert exact_dedup.advance_state(spark, index, state).count() == 2
    spark.createDataFrame([(b"a", 4, 3, "g", 0), (b"a", 9, 8, "g", 1)], kind).write.mode("append").parquet(index)
    assert rows_of(exact_dedup.advance_state(spark, index, state).select("digest", "best.doc_id", "members"), "doc_id", "members") == [(1, 1), (9, 3)]


def removed(rows, window=phrases.WINDOW):
    """Brute force over (doc_id, text)."""
    first, words = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (d, s):
                gone |= set(range(s, s + window))
        out.append((d, len(w), len(gone), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared, rows = [text(rng.choice([19, 20, 25, 60, 200]), 500) for _ in range(6)], []
    for i in range(60):
        parts = [text(rng.randrange(0, 40), 500)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, max(1, len(p) - 10))
            parts += [p[a:a + rng.randrange(5, 120)], text(rng.randrange(0, 15), 500)]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(" ", "\n")), (102, "a " * 90), (103, "a b " * 50), (104, "a " * 19), (105, "a " * 20), (106, None)]
    rng.shuffle(rows)
    got = rows_of(phrases.remove_repeats(docs(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(removed(rows), key=repr)


def test_simhash_links_and_components(spark):
    rng = np.random.default_rng(3)
    fp = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 150)]
    flip = lambda v, bits: int(np.int64(np.uint64(v & (2**64 - 1)) ^ np.uint64(sum(1 << int(b) for b in bits))))
    fp += [flip(v, rng.choice(64, n, replace=False)) for v in fp[:60] for n in (1, 2, 2, 3)]
    fp += [flip(fp[-1], [b]) for b in range(64)]
    fp = sorted(set(fp))
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in fp], "fp long")).collect()}
    bits = np.array(fp, np.int64).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
    assert got == {(fp[i], fp[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    assert rows_of(components.components(chain), "node", "root") == sorted([(i, 0) for i in range(41)] + [(90, 90), (95, 90), (100, 90)], key=repr)


def shuffled(df, n):
    assert df.count() == n and df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in text and "Broadcast" not in text


def test_reaches_are_not_broadcast(spark):
    """Spark takes the anchors that fingerprints reach for a table as small as the fingerprints."""
    assert shuffled(simhash.links(spark.createDataFrame([(v,) for v in (0, 1, 3, 255)], "fp long")), 3)


def test_drawn_blocks_are_not_broadcast(spark):
    """Nor is a file of blocks, which is compressed."""
    placed = spark.createDataFrame([("a", 0, 5, 1), (None, 3, 9, 2)], "source string, _start long, size long, doc_id long")
    drawn = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), (None, 2, 1)], "source string, block long, times long")
    assert shuffled(mixing._taken(placed, drawn, 4), 3)


def test_fingerprint():
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A  b") == xxh64_intdigest(b"a b", 42)
    hashes = [xxh64_intdigest(x, 42) for x in (b"a b c", b"b c \xc3\x89", b"c \xc3\x89 a")]
    assert simhash.fingerprint("A B C É a".encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(n))


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(0, 90))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(200)]
    out = mixing.mix(docs(spark, rows), block=4).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all() and (mixing.mix(docs(spark, rows), block=4).toPandas().sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist())
    by = out.groupby(out["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    size, weight = by["size"].to_dict(), dict(zip(sorted(by.index), (3, 1, 2, 3), strict=False))
    full, left = set(), 1.5 * sum(size.values())
    while True:
        rate = (left - sum(2 * size[s] for s in full)) / sum(weight[s] for s in weight if s not in full)
        new = {s for s in weight if s not in full and rate * weight[s] > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in weight:
        assert by.target[s] == pytest.approx(2 * size[s] if s in full else rate * weight[s])
        assert abs(by.taken[s] - by.target[s]) <= 8
    mixed = mixing.mixed_documents(docs(spark, rows), block=4).toPandas()
    assert mixed.text.map(lambda t: len(t.split())).groupby(mixed.doc_id).sum().to_dict() == {i: t for i, t in zip(out.doc_id, out.taken, strict=True) if t}
    assert (mixed.n_chars == mixed.text.str.len()).all()


def test_mixing_fills_shards(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(0, 90))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(120)]
    given = docs(spark, rows)
    quota = mixing.quotas(mixing.targets(mixing.sized(given)), 4)
    counts = mixing.shard_counts(mixing.slots(quota, 2, 64)).toPandas()
    want = {r["first"]: r["draws"] for r in quota.collect()}
    assert counts.groupby("first").n.sum().to_dict() == want
    full, rest = divmod(sum(want.values()), 64)
    assert counts.groupby("shard").n.sum().to_dict() == {k: 64 for k in range(full)} | ({full: rest} if rest else {})
    out = mixing.sharded(given, 4, 64).toPandas().sort_values(["shard", "slot", "at"])
    by = out.groupby(["shard", "slot"])
    assert len(by) == sum(want.values()) and (by.source.nunique() <= 1).all()
    got = out.assign(source=out.source.fillna("~")).drop_duplicates(["shard", "slot"]).groupby(["shard", "source"]).size().to_dict()
    assert got == counts.assign(source=counts.source.fillna("~")).set_index(["shard", "source"]).n.to_dict()
    texts = by.text.agg(" ".join)
    assert texts.map(lambda t: len(t.split())).max() == 4 and texts.value_counts().max() <= 2
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(given, 4).collect() if r["taken"]}
    assert out.text.map(lambda t: len(t.split())).groupby(out.doc_id).sum().to_dict() == taken


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    assert packing.pieces_of(4096 + 7) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 2), (4102, 1)] and packing.pieces_of(0) == []
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = ODD + [(20, "It's 3 o'clock, isn't it?! naïve Σίσυφος ΟΔΟΣ. 東京 á ABC... <|EndOfText|> x<b>y 10%%% don't!!")]
    out = packing.pack(docs(spark, rows)).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all() and all(n & (n - 1) == 0 and n <= 2048 for n in out.length)
    for i, text in ((20, rows[-1][1]), (6, ODD[8][1]), (5, ODD[7][1]), (2, "")):
        part = out[out.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(part.ids), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError, match="lower the case"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    crc = packing.digests(packing.pack(docs(spark, [(1, "a b")]))).first()
    assert crc["ids_crc32"] == zlib.crc32(np.array(t.encode("a b", add_special_tokens=False).ids + [1], "<u4")[:2].tobytes())


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header>Top</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use the cookies of this site and that is all that we have to say about it to the reader.</div>
<article><header><h1>Head &amp; more</h1></header><p>Short.<p>Long text of the day that is in the paper and was read by all of us at home, <a href=y>link</a> too.
<div class="ad">Buy now</div><ul class="related"><li><a href=z>Other</a></li></ul><script>var a="</p>";</script><p>End&nbsp;here.</p>
<section id="comments"><p>I liked this text and that is all there is to say of it to the others.</p></section></article>
<aside>Side</aside><form><input>Name</form><footer>&copy; X</footer></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    (PAGE, "Head & more\nShort.\nLong text of the day that is in the paper and was read by all of us at home, link too.\nEnd here."),
    ("", ""), ("plain", ""), ("<article>a < b &lt;c&gt;<br>d</article>", "a < b <c> d"), ("<article><p>x</p><!-- y", "x"),
    ("<article><p>x<a href='", "x"), ("<p>" + "the text of it is for all and " * 4 + "</p><p>short</p><nav>n</nav>", ("the text of it is for all and " * 4).strip() + "\nshort"),
    ("<article><p>x</p></article><script>" + "<a " * 50_000, "x"), ("<a \"" * 50_000, "")])
def test_html(html, text):
    assert html_text.main_text(html) == text


LONG = "Long text of the day that is in the paper and was read by all of us at home."


@pytest.mark.parametrize(("html", "text"), [
    (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='page has-sidebar'><main><p>{LONG}<div class='related'><p>{LONG} Other</div></main></div>", LONG),
    (f"<article class='post no-comments'><p>{LONG}</article>", LONG), (f"<main><article id='ad-1'><p>{LONG}</article></main>", LONG),
    (f"<article class='post'><p>{LONG}</article><div id='comments'><article class='x'><p>{LONG} Me too.</article></div>", LONG),
    (f"<div class='sidebar'><aside><article><p>{LONG}</article></aside></div>", ""), (f"<nav class='menu'><main><p>{LONG}</main></nav>", ""),
    (f"<div class='share' hidden><article><p>{LONG}</article></div>", ""), (f"<article hidden><p>{LONG}</article>", ""),
    (f"<div role='search'><div class='has-sidebar'><article><p>{LONG}</article></div></div>", ""), (f"<div class='sidebar'><p>{LONG}</div>", "")])
def test_html_names_are_hints(html, text):
    assert html_text.main_text(html) == text


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    want = "Head & more\nShort.\nLong text of the day that is in the paper and was read by all of us at home, link too.\nEnd here."
    assert rows_of(html_text.extract_text(pages), "page_id", "url", "text", "n_chars") == sorted(
        [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_licenses(spark):
    rows = [(1, "x MIT  License, mit-license. apache LICENSE"), (2, "the general public\nlicense"), (3, "Licensed under CC BY-NC 4.0."), (4, "a license"),
            (5, "All rights reserved."), (6, None)] + [(i, "plain words") for i in range(10, 60)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert pick(1) == (7, 3, 1, 5, "apache,mit", "apache,mit") and pick(2)[1:5] == (1, 1, 1, "gpl")
    assert got[3]["labels"] == "cc-by-nc" and got[5]["labels"] == "reserved" and got[4]["labels"] == "" and pick(6) == (0, 0, None, None, "", "")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_licenses_side_by_side(spark):
    notice = {n: t for n, (t, _) in licenses.TEMPLATES.items()}
    names = [("bsd", "isc"), ("mit", "bsd"), ("isc", "mpl", "unlicense"), ("mit", "bsd", "isc")]
    rows = [(i, "\n\n".join(f"Notice {k}. {notice[n].capitalize()}: end." for k, n in enumerate(ns))) for i, ns in enumerate(names)]
    more = ("Rights to modify or distribute the software and documentation files are subject to conditions. Provided that a person "
            "obtaining a copy is permitted, the purpose of redistribution, its source, binary forms and associated fee charge is "
            "encumbered under version 2 of the affero, lesser, mozilla, gnu or apache terms, cc, public domain, sa, nc, nd. ")
    rows += [(10, f"{more} {notice['bsd']} {more}"), (11, f"{more} {more} {notice['mit']}"), (12, more)]
    rows += [(i, "plain words") for i in range(100, 400)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, ns in enumerate(names):
        assert got[i]["labels"] == ",".join(sorted(ns)) and got[i]["score"] == pytest.approx(1.0)
    assert [got[i]["labels"] for i in (10, 11, 12)] == ["bsd", "mit", ""]


def test_licenses_however_frequent(spark):
    bsd, mpl = licenses.TEMPLATES["bsd"][0], licenses.TEMPLATES["mpl"][0]
    many = [(i, f"Note {i}. {bsd if i < 20 else mpl}: end." if i % 3 == 0 else "plain words") for i in range(60)]
    three = [(1, f"x {bsd}"), (2, f"y {bsd} {mpl}"), (3, "plain words")]
    for rows in (many, three, three[:1], [(i, t) for i, t in many if i % 3 == 0]):
        want = {i: ",".join(n for n, t in (("bsd", bsd), ("mpl", mpl)) if t in text) for i, text in rows}
        assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs(spark, rows)).collect()} == want
    # words that no file holds count against a template as well
    assert licenses.scan(docs(spark, [(1, "redistribution and use in source and binary forms. conditions are met"), (2, "b")])).first()["labels"] == ""


def licences_one_by_one(rows, templates, coverage):
    """Every template at every place of every file, and every place of every base phrase."""
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    files = [re.findall(licenses.WORD, t) for t in low]
    df = Counter(w for ws in files for w in set(ws))
    idf = lambda w: max(licenses.LEAST, math.log((len(files) + 1) / df.get(w, 1)))
    out = {}
    for (i, _), ws in zip(rows, files, strict=True):
        line, own, base = f" {' '.join(ws)} ", set(), []
        for name, (notice, keys) in templates.items():
            words = notice.split()
            held = max(sum(idf(w) for k, w in enumerate(words) if 0 <= at + k < len(ws) and ws[at + k] == w)
                       for at in range(-len(words), len(ws) + 1))
            if held >= coverage * sum(map(idf, words)) and all(f" {k} " in line for k in keys):
                own.add(name)
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            base += [(at, label) for at in range(len(ws)) if ws[at:at + len(p)] == p]
        out[i] = (len(ws), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                  ",".join(sorted({n for _, n in base})), tuple(sorted(own)))
    return out


def test_licenses_equal_all_places(spark):
    rng = random.Random(12)
    words = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()})
    notices = [t for t, _ in licenses.TEMPLATES.values()]

    def text():
        parts = []
        for _ in range(rng.randrange(4)):
            part = [w for w in rng.choice(notices).split() if rng.random() > 0.04]
            part = [rng.choice(words) if rng.random() < 0.08 else w.upper() if rng.random() < 0.2 else w for w in part]
            parts += [rng.choice(words) for _ in range(rng.randrange(9))] + part[rng.choice([0, 0, 3]):]
        parts += rng.choice([["MIT", "License"], ["general", "public", "license"], ["plain"], []])
        return rng.choice([" ", ", ", "\n"]).join(parts)

    rows = [(i, text()) for i in range(250)] + [(900, None), (901, "caf\u00e9 mit license\u00e9"), (902, "license " * 3000)]
    bare = {n: v for n, v in licenses.TEMPLATES.items() if "license" not in v[0].split()}
    for templates, coverage in ((licenses.TEMPLATES, licenses.COVERAGE), (licenses.TEMPLATES, 0.4), (bare, 0.9)):
        got = {r["doc_id"]: (*(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")),
                             tuple(f["template"] for f in r["found"] or ()))
               for r in licenses.scan(docs(spark, rows), templates, coverage).collect()}
        assert got == licences_one_by_one(rows, templates, coverage)
        assert sum(bool(v[5]) for v in got.values()) > 30 and any(v[1] for v in got.values())


def test_rare_words_leave_too_little_for_a_notice():
    idf = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 1e-6}
    for words in (["a", "b", "c", "d"], ["d", "d", "c"], ["b", "b", "c", "a"]):
        rare = licenses.rare_words(words, idf, 0.7)
        assert sum(idf[w] for w in words if w not in rare) < 0.7 * sum(idf[w] for w in words) and rare < set(words)


def test_pairing_lowers_the_weight_of_identity_terms(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(["sun", "tree", "road", "lamp", "book"]) for _ in range(8))
    rows, known = [], []
    for i in range(400):
        bad = i % 4 == 0
        group = "muslims" if rng.random() < (0.9 if bad else 0.1) else ""
        rows.append((i, f"{filler()} {group} {'idiot' if bad and rng.random() < 0.7 else ''} {filler()}."))
        known.append((i, 1, int(bad)))
    table = spark.createDataFrame(known, LABELS)
    free, paired = (toxicity.train(docs(spark, rows), table, pairing=p) for p in (0.0, 10.0))
    gap = lambda m: abs(np.diff(m.logits(["we met muslims today", "we met christians today"], {}))[0])
    assert gap(paired) < 0.5 * gap(free) and paired.logits(["an idiot"], {})[0] > paired.logits(["a lamp"], {})[0] + 1


def test_discriminant():
    rng = np.random.default_rng(6)
    d = 4
    x = [rng.normal(size=(500, d)), rng.normal(size=(500, d)) * 0.2 + 2]
    model = quality.fit_discriminant(np.array([500.0, 500.0]), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0)
    got = model.score(np.vstack(x))
    log = [-0.5 * (np.linalg.slogdet(np.cov(v.T, bias=True))[1] + np.einsum("ij,jk,ik->i", np.vstack(x) - v.mean(0), np.linalg.inv(np.cov(v.T, bias=True)), np.vstack(x) - v.mean(0))) for v in x]
    assert np.allclose(got, 1 / (1 + np.exp(log[0] - log[1])), atol=1e-3) and ((got > 0.5) == np.repeat([False, True], 500)).mean() > 0.98


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(7)
    clean = [(i, ". ".join(" ".join(rng.choice(["lamp", "road", "sun", "tree", "book", "water", f"n{rng.randrange(900)}x"]) for _ in range(9)) for _ in range(rng.randrange(10, 40)))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###$$$" for w in clean[i][1].split())) for i in range(30)]
    got = {r["doc_id"]: r for r in outliers.rule_verdicts(docs(spark, clean + junk)).collect()}
    assert not any(got[i]["kept"] for i, _ in junk) and all(got[i]["kept"] or got[i]["base_failed"] for i, _ in clean)


def test_rules_judge_sources_of_any_size(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda: [rng.choice(["lamp", "road", "sun", "tree", "book", "water", f"n{rng.randrange(900)}x"]) for _ in range(9)]
    clean = lambda: ". ".join(" ".join(words()) for _ in range(rng.randrange(10, 40)))
    junk = lambda: " ".join(w + "###$$$" for w in clean().split())
    rows = [(i, clean(), "large") for i in range(400)] + [(1000 + i, junk() if i % 10 == 0 else clean(), "rare") for i in range(50)]
    rows += [(2000 + i, junk() if i % 5 == 0 else clean(), "other") for i in range(20)] + [(3000, junk(), "one"), (3001, clean(), "two")]
    table = docs(spark, rows).withColumn("lang", F.when(F.col("source") == "other", "xx").otherwise(F.col("lang")))
    got = {r["doc_id"]: r for r in outliers.rule_verdicts(table).collect()}
    bad = {i for i, t, _ in rows if "###" in t}
    assert len(bad) == 10 and all(r["distance"] is not None for r in got.values())
    assert not any(got[i]["kept"] for i in bad) and all(r["kept"] or r["base_failed"] for i, r in got.items() if i not in bad)
    monkeypatch.setattr(outliers, "BROADCAST_POOLS", 0)                # the same by salted shuffles
    again = {r["doc_id"]: r for r in outliers.rule_verdicts(table).collect()}
    assert all(again[i]["kept"] == r["kept"] and again[i]["distance"] == pytest.approx(r["distance"], rel=1e-6) for i, r in got.items())
    monkeypatch.undo()
    # few rows of one source, under any number that an estimate could need
    few = {r["doc_id"]: r for r in outliers.rule_verdicts(docs(spark, [(i, clean()) for i in range(30)] + [(99, junk())])).collect()}
    assert not few[99]["kept"] and all(r["kept"] or r["base_failed"] for i, r in few.items() if i != 99)


def test_rule_estimates_are_the_least_determinants_of_brute_force(spark):
    """One group: the same estimate from numpy, with exact quantiles, and no start of other subsets ends lower."""
    rng = np.random.default_rng(5)
    n, d = 400, outliers.STATISTICS
    x = rng.normal(size=(n, d)) @ (np.eye(d) + 0.3 * rng.normal(size=(d, d))) * 3
    x[:40] += 25
    schema = ", ".join(["doc_id long", "pool string", "parent string", "top string", *(f"{c} double" for c in outliers.X)])
    usable = spark.createDataFrame([(i, "*", None, None, *map(float, r)) for i, r in enumerate(x)], schema)
    hot, scale = None, outliers._consistency(outliers.H)
    params = outliers._starts(usable, hot)
    both = spark.createDataFrame([(i, s + "*", None, None, *map(float, r)) for i, r in enumerate(x) for s in outliers.STARTS], schema)
    for _ in range(outliers.FIRST):
        params = outliers._step(both, params, hot, outliers.H, scale, outliers.PRIOR)
    assert params.count() == 2
    least = min(r["log_det"] for r in params.collect())
    params = outliers._better(params)
    assert [r["log_det"] for r in params.collect()] == [least]
    for _ in range(outliers.STEPS):
        before, params = params, outliers._step(usable, params, hot, outliers.H, scale, outliers.PRIOR)
        if not outliers._moved(before, params):
            break
    got = params.first()

    def concentrate(inner):
        for _ in range(50):
            mean, cov = x[inner].mean(0), np.cov(x[inner].T, bias=True) * scale
            factor = np.array(outliers._whiten(cov)).reshape(d, d)
            far = np.sqrt((((x - mean) @ factor.T) ** 2).sum(1))
            inner = np.argsort(far, kind="stable")[:int(np.ceil(outliers.H * n))]
        return mean, -2 * np.log(np.diag(factor)).sum(), far

    mean, log_det, far = concentrate(np.argsort(np.abs(x - np.median(x, 0)).max(1))[:n // 2])
    assert got["log_det"] == pytest.approx(log_det, abs=0.05) and np.allclose(got["mean"], mean, atol=0.3) and far[:40].min() > far[40:].max()
    ends = [concentrate(rng.choice(n, n // 2, replace=False))[1] for _ in range(20)]
    assert got["log_det"] <= min(ends) + 0.05


def test_cutoff_is_a_chi_square_quantile():
    t = outliers.cutoff_at(1e-3) ** 2
    # the upper tail of an even number of degrees is a Poisson sum
    poisson = sum(np.exp(-t / 2) * (t / 2) ** k / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(outliers.STATISTICS // 2))
    assert poisson == pytest.approx(1e-3, rel=0.01)


def test_words_of_one_core_share_an_entry():
    import public_tokenizers

    from postloom.llm.packing import VOCABULARY, WordIds

    ids = WordIds(public_tokenizers.path(VOCABULARY))
    texts = ["Abc abc, ABC. abc?! a.b ... 3.5. it's. don't, café. CAFÉ İx straße 7:30 x!!", "H̱abc W̊ <|endoftext|> <|ENDOFTEXT|> Abc.",
             "áb. e.́ ﬁn Ω ΣΣ. 中文, กำ. \U0001d504b!"]
    cut = [ids.words(t.encode()) for t in texts]
    assert cut[0].count(b"abc") == 4        # one entry, whatever the case and what follows
    table = ids.learn(set().union(*cut))
    for text, words in zip(texts, cut, strict=True):
        whole = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(table[w] for w in words), "<u4").tolist() == whole


def test_toxicity_counts_features_in_the_task():
    import pyarrow as pa

    from postloom.llm.toxicity import feature_counts, features_of, words_of

    rows = [(i % 2, "you idiot fool" if i % 2 else f"a calm sunny day {'abcdefgh'[i % 8] * 3}") for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([t for _, t in rows])], names=["_y", "text"])
    want = {y: Counter(f for v, t in rows if v == y for f in features_of(words_of(t))) for y in (0, 1)}
    for most, sends in ((100_000, 1), (3, None)):       # one batch, or many that add up to the same
        out = list(feature_counts([batch], most))
        assert sends is None or len(out) == sends
        got = {0: Counter(), 1: Counter()}
        for r in pa.Table.from_batches(out).to_pylist():
            got[1][r["feature"]] += r["a"]
            got[0][r["feature"]] += r["b"]
        assert {y: +c for y, c in got.items()} == want
