"""Substring de-duplication with repeated-phrase automata.

A window is WINDOW consecutive words. A word is removed if a window covers it whose words also start earlier: in a document
with a smaller id, or earlier in the same one.

1. Seeds. In each window the SEED-word phrase of the smallest hash is marked (the minimiser of winnowing, Schleimer et al.
   2003). Equal windows mark equal phrases, so a window can only recur if its seed does; one position in seven is a seed.
   Counting them costs one shuffle of hashes.
2. Confirm. Windows around recurring seeds are hashed whole (96 bits); their first places come from a minimum that is
   combined before the shuffle. A later window needs the passage around its first place: CHUNK window starts of that
   document form one passage.
3. Automata. Documents with later windows are dealt into shards of bounded text. A shard receives each passage that its
   documents need once, however many of them share it, compiles the passages' aligned BLOCK-word phrases into an
   Aho-Corasick automaton over word numbers and streams its documents through it. Every window holds a whole aligned
   phrase, so no occurrence is missed; from each hit the match is extended word by word, so every removal rests on equal
   text and not on a hash.

Work and shuffled data follow the input: seeds, candidate windows, and the texts of documents that share a passage. A hot
passage costs each shard one row. Documents whose words are all equal to an earlier document's are removed whole before
all this.

Defined cases: null text has no words; documents under WINDOW words lose nothing; rows with one id count as the same
document, so the place of a window is (doc_id, start) and equal places don't remove each other; a null id comes first.
"""
from __future__ import annotations

import sys
from hashlib import sha256
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import BATCH_ROWS, map_texts
from postloom.session import cut_lineage

WINDOW, SEED, BLOCK, CHUNK = 20, 8, 10, 64
SHARD_WORDS = 400_000                  # words of a shard's documents, about
BROADCAST_KEYS = 1_000_000             # keys of 16 bytes
PART_BYTES = 1 << 18                   # bytes hashed at once, about; a longer word is hashed whole
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EMPTY = sha256(b"").hexdigest()
KEPT = bytes([1, 0]) + bytes(254)     # 0 for a word that is gone, 1 for one that stays


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(odd: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(odd), n, 1 << 64))


def _rolled(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """One hash for each run of ``n`` word hashes, put together from runs of 1, 2, 4 and more."""
    out, have, run, width = h[:0], 0, h, 1
    while True:
        if n & width:
            k = len(h) - have - width + 1
            out = run[:k] * _power(odd, have) + out[width:width + k] if have else run[:k]
            have += width
        if have == n:
            return _mixed(out)
        run = run[:-width] * _power(odd, width) + run[width:]
        width *= 2


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0xFF51AFD7ED558CCD)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(which: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the step, or of its inverse; the tables grow with the longest part that was hashed."""
    if len(_powers[which]) < n:
        odd = _STEP if which == "up" else np.uint64(pow(int(_STEP), -1, 1 << 64))
        made = np.full(max(n, 2 * PART_BYTES), odd, np.uint64)
        made[0] = 1
        _powers[which] = np.cumprod(made)
    return _powers[which]


def word_hashes(line: bytes) -> np.ndarray:
    """A hash for each word of ``line``, whose words are joined by one space: differences of running sums over its bytes."""
    parts, at = [], 0
    while at < len(line):
        end = line.find(b" ", at + PART_BYTES)
        end = len(line) if end < 0 else end
        x = np.frombuffer(line, np.uint8, end - at, at)
        gaps = np.flatnonzero(x == 32)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * _table("up", len(x))[:len(x)], out=sums[1:])
        starts = np.concatenate([[0], gaps + 1])
        parts.append(_mixed((sums[np.concatenate([gaps, [len(x)]])] - sums[starts]) * _table("down", len(x))[starts]))
        at = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def normal_lines(raw: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """For each text its number of words, and its words joined by one space."""
    n, lines = np.zeros(len(raw), np.int64), []
    for i, text in enumerate(raw):
        words = text.split()
        n[i] = len(words)
        lines.append(b" ".join(words))
    return n, lines


def grouped(lines: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of consecutive lines of about PART_BYTES, which are hashed at once."""
    out, begin, held = [], 0, 0
    for i, line in enumerate(lines):
        held += len(line)
        if held >= PART_BYTES:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    return out + [(begin, len(lines))] * (begin < len(lines))


def seed_places(h: np.ndarray, n_words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """For documents laid end to end: the windows that lie in one document, their seeds' places, and the phrases' hashes.

    The seed is the first phrase of the smallest hash; both kinds of places count words from the first document on.
    """
    phrase = _rolled(h, seed, _ODD[0])
    low, place, width = phrase, np.arange(len(phrase)), 1
    while width < window - seed + 1:
        step = min(width, window - seed + 1 - width)
        place = np.where(low[step:] < low[:-step], place[step:], place[:-step])
        low = np.minimum(low[:-step], low[step:])
        width += step
    ends = np.repeat(np.cumsum(n_words), n_words)[:len(place)]
    inside = np.flatnonzero(np.arange(window, window + len(place)) <= ends)
    return inside, place[inside], phrase


def _notes(docs: DataFrame) -> DataFrame:
    """Per row: id, hash of the text, words, digest of its words, and its seeds (hash, position)."""
    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        n, lines = normal_lines(raw)
        seeds, at, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [0]
        for a, b in grouped(lines):
            if n[a:b].sum() >= WINDOW:
                _, place, phrase = seed_places(word_hashes(b" ".join(filter(None, lines[a:b]))), n[a:b])
                place = place[np.diff(place, prepend=-1) > 0]
                begins = np.cumsum(n[a:b]) - n[a:b]
                row = np.repeat(np.arange(b - a), n[a:b])[place]
                seeds.append(phrase[place].view(np.int64))
                at.append((place - begins[row]).astype(np.int32))
                held += np.bincount(row, minlength=b - a).tolist()
            else:
                held += [0] * (b - a)
        ends = pa.array(np.cumsum(held).astype(np.int32))
        nested = lambda parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))
        return {"n_words": pa.array(n), "sha": pa.array([sha256(x).hexdigest() for x in lines], pa.string()),
                "seeds": nested(seeds), "at": nested(at)}

    made = map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("th")),
                     "n_words long, sha string, seeds array<long>, at array<int>", work, keep=("doc_id", "th"))
    return made.withColumn("rid", F.monotonically_increasing_id())


def _windows(texts: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, rid, start) of the windows whose seed recurs. ``texts``: rid, doc_id, text, hits."""
    key = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS // 4):
                part = batch.slice(begin, BATCH_ROWS // 4)
                n, lines = normal_lines(part.column("text").cast(pa.binary()).to_pylist())
                for a, b in grouped(lines):
                    h, begins = word_hashes(b" ".join(lines[a:b])), np.cumsum(n[a:b]) - n[a:b]
                    inside, place, _ = seed_places(h, n[a:b])
                    wanted = np.zeros(len(h), bool)
                    for i in range(a, b):
                        wanted[part.column("hits")[i].values.to_numpy(zero_copy_only=False) + begins[i - a]] = True
                    at = inside[wanted[place]]
                    row = np.repeat(np.arange(b - a), n[a:b])[at]
                    w1, w2 = (_rolled(h, WINDOW, odd)[at] for odd in _ODD)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                         part.column("doc_id").take(pa.array(row + a)), part.column("rid").take(pa.array(row + a)),
                         pa.array((at - begins[row]).astype(np.int32))],
                        names=["w1", "w2", "doc_id", "rid", "start"])

    return texts.select("rid", "doc_id", "text", "hits").mapInArrow(run, f"w1 long, w2 int, doc_id {key}, rid long, start int")


def _passages(texts: DataFrame) -> DataFrame:
    """(_source, doc_id, _chunk, text): the wanted passages of each text. ``texts``: rid, doc_id, text, chunks."""
    key = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS // 4):
                part = batch.slice(begin, BATCH_ROWS // 4)
                row, chunk, made = [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = text.split()
                    for c in part.column("chunks")[i].as_py():
                        row.append(i)
                        chunk.append(c)
                        made.append(b" ".join(words[c * CHUNK:c * CHUNK + CHUNK + WINDOW - 1]))
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid").take(row), part.column("doc_id").take(row), pa.array(chunk, pa.int32()),
                     pa.array(made, pa.binary()).cast(pa.string())], names=["_source", "doc_id", "_chunk", "text"])

    return texts.select("rid", "doc_id", "text", "chunks").mapInArrow(run, f"_source long, doc_id {key}, _chunk int, text string")


class Automaton:
    """Passages compiled for exact look-up. A passage is (place, first word's number, words); places compare.

    A word becomes one character, so that a text is a string of its word numbers; with more words than there are
    characters it is a tuple of numbers, which gives the same matches more slowly.
    """
    def __init__(self, passages: list[tuple[tuple, int, list[bytes]]]):
        self.number: dict[bytes, int | str] = {}
        for _, _, words in passages:
            for w in words:
                if w not in self.number:
                    self.number[w] = len(self.number) + 1
        short = len(self.number) <= sys.maxunicode and ahocorasick.unicode
        if short:
            self.number = {w: chr(n) for w, n in self.number.items()}
        self.join, self.other = ("".join, chr(0)) if short else (tuple, 0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING if short else ahocorasick.KEY_SEQUENCE)
        self.passages = []
        blocks: dict[str | tuple[int, ...], list[tuple[int, int]]] = {}
        for place, first, words in passages:
            ids = self.join(map(self.number.__getitem__, words))
            for at in range(0, len(ids) - BLOCK + 1, BLOCK):
                blocks.setdefault(ids[at:at + BLOCK], []).append((len(self.passages), at))
            self.passages.append((place, first, ids))
        for block, where in blocks.items():
            self.machine.add_word(block, where)
        if blocks:
            self.machine.make_automaton()
        self.empty = not blocks

    def covered(self, place: tuple, words: list[bytes]) -> bytearray:
        """1 for each word of a document at ``place`` that lies in a window found earlier."""
        ids, out = self.join(map(self.number.get, words, repeat(self.other))), bytearray(len(words))
        if self.empty or len(words) < WINDOW:
            return out
        reach: dict[tuple[int, int], int] = {}     # how far a passage was followed at a shift
        for end, where in self.machine.iter(ids):
            p = end - BLOCK + 1
            for index, at in where:
                other, first, passage = self.passages[index]
                shift = p - at                     # passage position + shift = document position
                if other > place or (other == place and first + at >= p) or reach.get((index, shift), 0) > p:
                    continue
                low, high = max(0, shift), min(len(ids), shift + len(passage))
                if out.find(0, low, high) < 0:
                    continue                       # all that this passage can reach is covered
                if ids[low:high] != passage[low - shift:high - shift]:
                    a, b = p, end + 1
                    while a - BLOCK >= low and ids[a - BLOCK:a] == passage[a - BLOCK - shift:a - shift]:
                        a -= BLOCK
                    while a > low and ids[a - 1] == passage[a - 1 - shift]:
                        a -= 1
                    while b + BLOCK <= high and ids[b:b + BLOCK] == passage[b - shift:b + BLOCK - shift]:
                        b += BLOCK
                    while b < high and ids[b] == passage[b - shift]:
                        b += 1
                    low, high = a, b
                reach[index, shift] = high
                if high - low >= WINDOW:
                    out[low:high] = b"\1" * (high - low)
        return out


def _order(doc_id) -> tuple:
    return (0,) if doc_id is None or doc_id is pd.NA or doc_id != doc_id else (1, doc_id)


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard: rows of passages (chunk >= 0) and of documents (chunk -1)."""
    passages = [(_order(r.doc_id), r.chunk * CHUNK, r.text.encode("utf-8").split(b" ")) for r in frame[frame["chunk"] >= 0].itertuples()]
    machine = Automaton(passages)
    out = {"rid": [], "n_removed": [], "kept_sha256": []}
    for r in frame[frame["chunk"] < 0].drop_duplicates("rid").itertuples():
        words = r.text.encode("utf-8").split()
        gone = machine.covered(_order(r.doc_id), words)
        kept = b" ".join(compress(words, gone.translate(KEPT)))
        out["rid"].append(r.rid)
        out["n_removed"].append(sum(gone))
        out["kept_sha256"].append(sha256(kept).hexdigest())
    return pd.DataFrame(out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    notes = cut_lineage(_notes(docs), "phrase-notes")
    # equal word sequences: the first document stands for all
    groups = cut_lineage(notes.filter(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
                         .select(F.col("sha").alias("_sha"), F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rep")),
                         "phrase-copies")
    reps = notes.join(groups.select("rep"), F.col("rid") == F.col("rep"), "left_semi")
    seeds = reps.select("rid", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(
        F.col("s.seeds").alias("seed"), "rid", F.col("s.at").alias("at"))
    # written, so that the joins have shuffles of their own, whose hot keys adaptive execution splits
    recurring = cut_lineage(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                            .select(F.col("seed").alias("_seed")), "phrase-recurring")
    hits = cut_lineage(seeds.join(recurring, F.col("seed") == F.col("_seed"), "left_semi").groupBy("rid")
                       .agg(F.collect_list("at").alias("hits")), "phrase-hits")
    found = cut_lineage(notes.select("rid", "doc_id", "th").join(hits, "rid")
                        .select("rid", F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "hits"), "phrase-places")
    keys = found.select("_id", "_th")
    keyed = docs.withColumn("th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    if keys.count() <= BROADCAST_KEYS:
        keyed = keyed.join(F.broadcast(keys), same, "left_semi")
    texts = cut_lineage(keyed.join(found, same).select("rid", "doc_id", "text", "hits"), "phrase-texts")

    windows = cut_lineage(_windows(texts), "phrase-windows")
    firsts = cut_lineage(windows.groupBy(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"))
                         .agg(F.min(F.struct("doc_id", "start", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").drop("n"), "phrase-firsts")
    later = windows.join(firsts, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")) & (
        F.struct("doc_id", "start") > F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"))))
    needs = cut_lineage(later.select("rid", F.col("first.rid").alias("source"), F.floor(F.col("first.start") / CHUNK).cast("int")
                                     .alias("chunk")).distinct(), "phrase-needs")
    whose = needs.select("rid").distinct()
    total = notes.join(whose, "rid", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")

    wanted = needs.groupBy(F.col("source").alias("_source")).agg(F.collect_set("chunk").alias("chunks"))
    passages = _passages(texts.join(wanted, F.col("rid") == F.col("_source")).dropDuplicates(["rid"]))
    sent = (needs.select(shard.alias("shard"), "source", "chunk").distinct()
            .join(passages, (F.col("source") == F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
            .select("shard", "chunk", F.lit(None).cast("long").alias("rid"), "doc_id", "text"))
    streamed = texts.join(whose, "rid", "left_semi").select(shard.alias("shard"), F.lit(-1).alias("chunk"), "rid", "doc_id", "text")
    result = cut_lineage(sent.union(streamed).groupBy("shard").applyInPandas(_shard, "rid long, n_removed long, kept_sha256 string"),
                         "phrase-result").withColumnRenamed("rid", "_rid")
    whole = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("rep").isNotNull()
    return (notes.select("doc_id", "n_words", "sha").join(groups, F.col("sha") == F.col("_sha"), "left")
            .join(result, F.col("rep") == F.col("_rid"), "left")
            .select("doc_id", "n_words",
                    F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))
