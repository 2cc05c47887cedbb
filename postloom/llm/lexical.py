"""Ranked lexical search by pipelined term partitioning.

Documents are read once, in chunks of at most CHUNK rows. A chunk yields its documents' lengths and, for every term that
some item asks for, one posting block: the places of its documents in the chunk and their frequencies. Which terms are
asked for is told by a fixed table of FILTER_SLOTS bits, so what each task is sent has one size whatever the items are;
the few terms that pass it by accident find no item later.

Terms have owners, by the share of documents that hold them: the first owns the rarest terms, which weigh most. An item
bundle is BUNDLE items together with one chunk. It starts at the first owner with the chunk's documents and no
accumulators, meets there, by cogroup, the posting blocks of the owner's terms, adds their integer contributions, and goes on to the
next owner with its accumulators as sparse triples (item, document, score). After the last owner it selects each item's
best documents of the chunk, and of those the best of all are selected.

Between owners an accumulator is left behind only if it cannot matter: the item's TOP best scores of the chunk exceed it
even if the document got the most that all later owners can add. Contributions are never negative, so those scores only
grow, and what is left behind can neither be selected nor shift a tie. Nothing else is dropped.

A task holds one bundle: its accumulators (CHUNK x BUNDLE numbers at most) and its posting blocks. Hot terms are spread over
all chunks, and each chunk is one row a term, however many rows the term is in.

Defined cases: null and empty texts have no term; they count in neither N nor L and are never found; an item without terms,
or whose terms no document holds, has no rows; every row of ``items`` is an item of its own, so a repeated row gives its
results again; repeated documents are ranked one by one, those of equal score and doc_id in any order; a null doc_id comes
after all others of its score.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import fields, text_of
from postloom.session import cut_lineage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
CHUNK = 4096                     # documents
CHUNK_POSTINGS = 2_000_000       # a chunk is closed early when it holds as many postings
BUNDLE = 256                     # items
FILTER_SLOTS = 1 << 20
OWNERS = (1 / 64, 1 / 8)         # share of documents up to which a term belongs to the first, second owner; the rest: last
NO_ID = np.iinfo(np.int64).max   # stands for a null doc_id
# fixed values of the ranking
SCALE, MOST = 1_000_000_000, 1000
BLOCKS = "chunk long, term string, places binary, counts binary, df long, most long, ids binary, lengths binary, n_docs long, n_terms long"
# lower case A-Z; everything in ASCII that is no letter or digit becomes a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _slot(term: bytes) -> int:
    return zlib.crc32(term) & (FILTER_SLOTS - 1)


def item_terms(items: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """bundle, slot, item_id, term, times: what each row of ``items`` asks for; ``bundle`` and ``slot`` name the row."""
    lowered = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = cut_lineage(fields(items, "item_id", "text").select("item_id", F.regexp_extract_all(lowered, F.lit(TERM), 0).alias("terms")), "search-items")
    at = F.monotonically_increasing_id()
    rows = rows.select(at.alias("_at"), "item_id", "terms").select(
        F.floor(F.col("_at") / bundle).cast("long").alias("bundle"), F.pmod("_at", F.lit(bundle)).cast("int").alias("slot"),
        "item_id", F.explode("terms").alias("term"))
    return cut_lineage(rows.groupBy("bundle", "slot", "item_id", "term").agg(F.count(F.lit(1)).alias("times")), "search-terms")


def _filter_bits(asked: DataFrame) -> bytes:
    """One byte a slot: whether a term of ``asked`` falls into it. At most FILTER_SLOTS numbers come to the driver."""
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(FILTER_SLOTS - 1))
    bits = bytearray(FILTER_SLOTS)
    for r in asked.select(slot.alias("s")).distinct().toLocalIterator():
        bits[r["s"]] = 1
    return bytes(bits)


class _Chunk:
    """Documents of one chunk and the posting blocks of the terms that pass the filter."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.places: dict[bytes, list[int]] = {}
        self.counts: dict[bytes, list[int]] = {}
        self.postings = 0

    def add(self, doc_id: int | None, raw: bytes, bits: bytes) -> None:
        terms = terms_of(raw)
        if not terms:
            return
        place = len(self.ids)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(terms))
        for term, n in Counter(terms).items():
            if bits[zlib.crc32(term) & (FILTER_SLOTS - 1)]:
                if term in self.places:
                    self.places[term].append(place)
                    self.counts[term].append(n)
                else:
                    self.places[term], self.counts[term] = [place], [n]
                self.postings += 1

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        head = [[chunk], [None], [None], [None], [None], [None], [np.array(self.ids, "<i8").tobytes()],
                [np.array(self.lengths, "<i8").tobytes()], [len(self.ids)], [sum(self.lengths)]]
        terms = list(self.places)
        none = [None] * len(terms)
        body = [[chunk] * len(terms), [t.decode("utf-8", "replace") for t in terms], [np.array(self.places[t], "<i4").tobytes() for t in terms],
                [np.array(self.counts[t], "<i4").tobytes() for t in terms], [len(self.places[t]) for t in terms],
                [max(self.counts[t]) for t in terms], none, none, none, none]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in BLOCKS.split(", ")]
        for made in (head, body):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)


def posting_blocks(docs: DataFrame, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks of ``docs``: one row with its documents (``term`` is null), and one a term."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(asked))

    def run(batches):
        numbers = TaskContext.get().partitionId() << 32
        made = _Chunk()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for i, doc_id in enumerate(ids):
                made.add(doc_id, texts[i].as_py() or b"", bits.value)
                if len(made.ids) >= chunk or made.postings >= CHUNK_POSTINGS:
                    yield from made.rows(numbers)
                    numbers, made = numbers + 1, _Chunk()
        if made.ids:
            yield from made.rows(numbers)

    plain = fields(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(plain.mapInArrow(run, BLOCKS), "search-postings")


def _weighed(blocks: DataFrame, asked: DataFrame, size: dict[str, int]) -> DataFrame:
    """term, weight, owner, bound: the terms that items ask for and documents hold; no contribution exceeds ``bound``."""
    found = blocks.filter(F.col("term").isNotNull()).join(asked.select("term").distinct(), "term", "left_semi")
    known = found.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * size["N"] + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    share = F.col("df") / F.lit(float(max(1, size["N"])))
    owner = F.lit(0)
    for limit in OWNERS:
        owner = owner + (share > limit).cast("int")
    # 75 is the least that the length norm can be
    bound = weight * F.floor(F.lit(SCALE) * F.col("most") / (MOST * F.col("most") + 12 * 75)).cast("long")
    return cut_lineage(known.select("term", weight.alias("weight"), owner.alias("owner"), bound.alias("bound")), "search-weights")


def _pack(item: np.ndarray, place: np.ndarray, score: np.ndarray) -> bytes:
    return item.astype("<i4").tobytes() + place.astype("<i4").tobytes() + score.astype("<i8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i4", n, 4 * n), np.frombuffer(raw, "<i8", n, 8 * n)


def _visit(size: dict[str, int], bundle: int, top: int, last: bool):
    """What an owner does with a bundle: add its terms' contributions, then drop what cannot matter or select the best."""
    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in (("bundle", "slot", "doc_id", "score") if last else left.columns)})
        row = left.iloc[0]
        ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        norm = 12 * (MOST // 10 - 25 + (25 * lengths * size["N"]) // max(1, size["L"]))
        score = np.zeros((bundle, len(ids)), np.int64)
        if row["held"]:
            item, place, had = _unpack(row["held"])
            score[item, place] = had
        for places, counts, weight, slots, times in zip(*(right[c] for c in ("places", "counts", "weight", "slots", "times"))):
            at, tf = np.frombuffer(places, "<i4"), np.frombuffer(counts, "<i4").astype(np.int64)
            gain = weight * ((SCALE * tf) // (MOST * tf + norm[at]))
            for s, t in zip(slots, times):
                score[s, at] += int(t) * gain
        if last:
            out = [_best(score[s], ids, top) for s in range(bundle)]
            n = [len(d) for d, _ in out]
            return pd.DataFrame({"bundle": key[1], "slot": np.repeat(np.arange(bundle), n), "doc_id": np.concatenate([d for d, _ in out]),
                                 "score": np.concatenate([v for _, v in out])})
        keep = score > 0
        if score.shape[1] > top:
            least = np.partition(score, -top, axis=1)[:, -top]
            later = np.zeros(bundle, np.int64)
            later[np.asarray(row["slots"], int)] = row["later"]
            keep &= score + later[:, None] >= least[:, None]
        item, place = np.nonzero(keep)
        return pd.DataFrame({**{c: [row[c]] for c in left.columns}, "held": [_pack(item, place, score[item, place])]})

    return work


def _best(score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``top`` of one item: highest score above 0 first, then smallest id."""
    found = np.flatnonzero(score)
    if len(found) > top:
        found = found[score[found] >= np.partition(score[found], -top)[-top]]
    found = found[np.lexsort((ids[found], -score[found]))][:top]
    return ids[found], score[found]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, chunk: int = CHUNK, bundle: int = BUNDLE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents (doc_id, text) of every row of ``items`` (item_id, text)."""
    asked = item_terms(items, bundle)
    blocks = posting_blocks(docs, asked, chunk)
    sums = blocks.agg(F.sum("n_docs").alias("N"), F.sum("n_terms").alias("L")).first()
    size = {"N": sums["N"] or 0, "L": sums["L"] or 0}
    weights = _weighed(blocks, asked, size)
    wanted = cut_lineage(asked.join(weights, "term").groupBy("bundle", "owner", "term", "weight").agg(
        F.sort_array(F.collect_list(F.struct("slot", "times"))).alias("by"), F.first("bound").alias("bound")), "search-wanted")
    rest = asked.join(weights, "term").groupBy("bundle", "slot", "owner").agg(F.sum(F.col("times") * F.col("bound")).alias("bound"))
    postings = blocks.filter(F.col("term").isNotNull()).select("chunk", "term", "places", "counts")
    met = postings.select("chunk", "term").join(wanted.select("bundle", "term"), "term").select("chunk", "bundle").distinct()
    bundles = (blocks.filter(F.col("term").isNull()).select("chunk", "ids", "lengths").join(met, "chunk")
               .withColumn("held", F.lit(None).cast("binary")))
    for owner in range(len(OWNERS) + 1):
        final = owner == len(OWNERS)
        later = rest.filter(F.col("owner") > owner).groupBy("bundle", "slot").agg(F.sum("bound").alias("more"))
        later = later.groupBy("bundle").agg(F.collect_list(F.struct("slot", "more")).alias("later"))
        carried = bundles.select("chunk", "bundle", "ids", "lengths", "held").join(later, "bundle", "left").select(
            "chunk", "bundle", "ids", "lengths", "held", F.coalesce("later.slot", F.array().cast("array<int>")).alias("slots"),
            F.coalesce("later.more", F.array().cast("array<bigint>")).alias("later"))
        mine = postings.join(wanted.filter(F.col("owner") == owner), "term").select(
            F.col("chunk").alias("_chunk"), F.col("bundle").alias("_bundle"), "places", "counts", "weight", F.col("by.slot").alias("slots"), F.col("by.times").alias("times"))
        visits = carried.groupBy("chunk", "bundle").cogroup(mine.groupBy("_chunk", "_bundle"))
        schema = "bundle long, slot int, doc_id long, score long" if final else (
            "chunk long, bundle long, ids binary, lengths binary, held binary, slots array<int>, later array<bigint>")
        bundles = cut_lineage(visits.applyInPandas(_visit(size, bundle, top, final), schema), "search-bundles")
    return _ranked(bundles, asked, top, items.schema["item_id"].dataType.simpleString())


def _ranked(found: DataFrame, asked: DataFrame, top: int, key: str) -> DataFrame:
    order = Window.partitionBy("bundle", "slot").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = asked.select("bundle", "slot", F.col("item_id").cast(key)).distinct()
    doc_id: Column = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return best.join(names, ["bundle", "slot"]).select("item_id", "rank", doc_id.alias("doc_id"), "score")
