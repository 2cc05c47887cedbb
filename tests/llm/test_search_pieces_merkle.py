"""Ranked search, piece encoding and the Merkle manifest: against brute force, the library and a plain tree."""
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from postloom.llm import lexical, merkle, pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, df string, chunk int, `group` string, place long, ids string"


def docs(spark, rows):
    """(doc_id, text, lang, source, n_chars) and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, "z") for r in rows], DOCS)


def plain(spark, texts):
    return docs(spark, [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts])


ODD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (None, "b c"), (None, None), (5, "word " * 3000), (6, "é ü — ⚙  x"), (7, "x" * 5000)]


# --- ranked search ------------------------------------------------------------------

def ranked(rows, items, top):
    """Brute force over (doc_id, text) and (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(words(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in Counter(words(text)).items() if c[t])
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        out += [(item, k, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("chunk", "bundle", "top"), [(7, 3, 2), (16, 256, 5), (4096, 2, 20)])
def test_search_against_brute_force(spark, chunk, bundle, top):
    rng = random.Random(chunk)
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda n: " ".join(rng.choices([f"W{k}" if k % 5 else f"é{k}-x" for k in range(60)], weights, k=n))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(200 + i, "W3, w3; W9.") for i in range(40)] + ODD
    rng.shuffle(rows)
    items = [(i, text(rng.randrange(1, 12))) for i in range(9)] + [(20, None), (21, ""), (22, "absent"), (23, "w3 W3"), (24, "A word")]
    given = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert found(lexical.search(plain(spark, rows), given, top, chunk, bundle)) == ranked(rows, items, top)


def test_search_leaves_accumulators_behind(spark):
    """A document that cannot come in is not carried on, and the result is the same."""
    rows = [(i, "common " * 3 + ("rare" if i < 5 else "other")) for i in range(64)]
    blocks = lexical.item_terms(spark.createDataFrame([(1, "rare common")], "item_id long, text string"))
    assert {r["term"] for r in blocks.collect()} == {"rare", "common"}
    visit = lexical._visit({"N": 64, "L": 256}, 1, 2, False)
    import pandas as pd
    ids = np.arange(4, dtype="<i8")
    left = pd.DataFrame({"chunk": [0], "bundle": [0], "ids": [ids.tobytes()], "lengths": [np.full(4, 4, "<i8").tobytes()],
                         "held": [None], "slots": [np.array([0])], "later": [np.array([5])]})
    right = pd.DataFrame({"places": [np.array([0, 1, 2], "<i4").tobytes()], "counts": [np.array([9, 9, 1], "<i4").tobytes()],
                          "weight": [100], "slots": [[0]], "times": [[1]]})
    item, place, score = lexical._unpack(visit((0, 0), left, right)["held"][0])
    assert place.tolist() == [0, 1] and score[0] == score[1]
    assert found(lexical.search(plain(spark, rows), spark.createDataFrame([(1, "rare common")], "item_id long, text string"), 7, 16, 4)) == ranked(rows, [(1, "rare common")], 7)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(plain(spark, []), items).collect() == []
    assert lexical.search(plain(spark, ODD), items.limit(0)).collect() == []
    assert lexical.search(plain(spark, [(1, None), (2, "?")]), items).collect() == []


# --- pieces -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def odd_texts(n):
    rng = random.Random(n)
    parts = [*"abcdefghijk ETA  ▁\n\t.,;()'\"²é—»ß東京😀\x00\r-=", "  ", "    ", "ing", "tion", " the", "«", ".»", "----", "�", " "]
    return (["".join(rng.choice(parts) for _ in range(rng.randrange(0, 70))) for _ in range(n)]
            + [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)] + ["x" * 5000, "ab" * 3000, "=-" * 300, "ing" * 500])


def test_pieces_equal_the_library(library):
    texts = odd_texts(4000)
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    want = library.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want
    assert [model.decode(np.array(x, "<u4").tobytes()).decode() for x in want] == library.decode(want)


@pytest.mark.parametrize("cut", pieces.CUTS[1:])
def test_pieces_with_plainer_cuts(library, cut):
    texts = odd_texts(300)
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    model.cut = re.compile(cut)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == library.encode(texts)


def test_pieces_tables_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_CHARS", 50)
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 5)
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    for t in odd_texts(200):
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == library.encode(t)
    assert len(model.pairs) <= 5 and len(model.young) + len(model.old) < 500


def test_walk_goes_back(library):
    """Texts where the longest piece is not the first one of the encoding."""
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    rng = random.Random(5)
    back = 0
    for _ in range(3000):
        t = "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 30)))
        greedy = next(model.automaton.iter_long(t))[1]
        got = model.walk(t)
        assert model.name[got[0]] and "".join(model.name[i] for i in got) == t and got == library.encode("\n" + t)[2:]
        back += got[0] != greedy
    assert back > 100


def test_decoding_of_any_ids(library):
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(0, 262), rng.randrange(259, 400)]) for _ in range(rng.randrange(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids)


def test_pieces_of_rows(spark, library):
    rows = ODD + list(enumerate(odd_texts(30), 100))
    given = plain(spark, rows)
    want = sorted(((d, t or "") for d, t in rows), key=repr)
    encoded = pieces.encode(given)
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect()), key=repr) == sorted(
        ((d, library.encode(t)) for d, t in want), key=repr)
    texts = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect()), key=repr)
    assert texts == sorted(((d, library.decode(library.encode(t))) for d, t in want), key=repr)
    sums = lambda t: (len(library.encode(t)), sha256(",".join(map(str, library.encode(t))).encode()).hexdigest(),
                      sha256(library.decode(library.encode(t)).encode()).hexdigest())
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(given).collect()), key=repr)
    assert got == sorted(((d, *sums(t)) for d, t in want), key=repr)
    assert pieces.digests(plain(spark, [])).collect() == [] and pieces.encode(plain(spark, [])).collect() == []


def test_other_normalisers_are_refused(tmp_path, monkeypatch):
    class Other:
        def __init__(self, model_file):
            pass

        def normalize(self, text):
            return text.strip()

    monkeypatch.setattr(pieces, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="identity"):
        pieces.Pieces("x")


# --- the manifest -------------------------------------------------------------------

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and each node's siblings and the way they are folded, level by level."""
    paths, level = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 2):
            run = level[k:k + 2]
            for at, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append((at, run[1 - at][0] if len(run) == 2 else None))
            up.append((h(*[n for n, _ in run]), sum((b for _, b in run), [])))
        level = up
    return level[0][0], paths


def manifest(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*map(shown, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    made, roots = [], []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[2] == lang)
        mine = [r for _, r in mine]
        root, paths = tree([leaf(r) for r in mine])
        roots.append(root)
        made += [(r, lang, p) for r, p in zip(mine, paths, strict=True)]
    root, above = tree(roots)
    out = []
    for r, lang, p in made:
        k = langs.index(lang)
        whole = p + above[k]
        crc = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
        at = leaf(r, 1) if crc % 7 == 0 else leaf(r)
        for side, other in whole:
            at = h(at) if other is None else h(other, at) if side else h(at, other)
        out.append((r[0], leaf(r), roots[k], root, h(*[o for _, o in whole if o]), at, at == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("n", "block"), [(1, 4), (2, 2), (37, 4), (300, 8), (300, 1024)])
def test_manifest_against_a_plain_tree(spark, n, block):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice([None, "", "té xt", f"text {i}"]), rng.choice([None, "de", "en", "en", "en", "en", "ü"][:1 + n]), rng.choice(["s", None]),
             rng.choice([None, i])) for i in range(n)]
    rows += rows[:n // 10] + [(None, "t", "en", "s", 1), (None, None, None, None, None)][:n - 1]
    rng.shuffle(rows)
    out = merkle.manifest(docs(spark, rows), block)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr) == manifest(rows)
    # a witness leads from the leaf to the root, and from nothing else
    for r in out.limit(20).collect():
        assert merkle.folded(r["leaf"], r["steps"], r["siblings"]) == r["root"]
        assert merkle.folded(h(r["leaf"]), r["steps"], r["siblings"]) != r["root"]


def test_manifest_tells_every_change(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(200)]
    got = {r["doc_id"]: r for r in merkle.manifest(docs(spark, rows), 16, witness=False).collect()}
    assert {i for i, r in got.items() if not r["verified"]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}
    other = merkle.manifest(docs(spark, [(i, t + ("!" if i == 77 else ""), *r) for i, t, *r in rows]), 16).first()
    assert other["root"] != got[0]["root"]


def test_manifest_of_nothing(spark):
    assert merkle.manifest(docs(spark, [])).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        merkle.manifest(docs(spark, []), 6)


def test_open_tree_extends_witnesses():
    tree_ = merkle.OpenTree()
    for d in "abcde":
        tree_.append(d)
    assert [x[0] for x in tree_.open] == [2, 0] and [len(w) for w in tree_.witness] == [2, 2, 2, 2, 0]
    assert tree_.close() == tree(list("abcde"))[0] and [len(w) for w in tree_.witness] == [3] * 5


def test_places_are_gapless(spark):
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("group"), F.xxhash64("id").alias("k"))
    got = {}
    for r in merkle.numbered(rows, "k").collect():
        got.setdefault(r["group"], []).append((r["k"], r["place"], r["total"]))
    for v in got.values():
        assert [p for _, p, _ in sorted(v)] == list(range(len(v))) and {t for *_, t in v} == {len(v)}
