"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code of length 64: two binary Golay codes of length 23 side by side, with the last
18 bits free (an anchor stands for all of their values). A Golay code is perfect with covering radius 3, so each half lies
within 3 bits of exactly one code word, the fingerprint's home. Two fingerprints that differ in at most 2 bits differ in
t1 + t2 <= 2 bits of the two halves, so the second lies within 3 + t1 and 3 + t2 bits of the first one's home. Every
fingerprint is therefore sent to all anchors whose halves exceed radius 3 by at most 2 bits together - 61 on average,
found in a table of error patterns by syndrome - and compared there with the fingerprints that live at that anchor. No
link is lost, and each is found once, at the home of the smaller fingerprint.

Equal fingerprints are one class before anything is compared, so large groups of copies cost one row; a fingerprint has at
most 2,080 others within two bits, so links grow in proportion to distinct fingerprints. The join on the anchor is a
sort-merge join that adaptive execution may split; a hint asks for it, since Spark takes the reaches for a table as small as
the fingerprints they come from and would broadcast all 61 rows of each. Links go to ``components``.

Defined cases: null text counts as empty; no word gives fingerprint zero, linked like any other; repeated rows and repeated
ids share a class; a null doc_id gets the component of its class, which is null only if no row of the component has an id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from postloom.llm.common import map_texts, plainly
from postloom.llm.components import components
from postloom.session import cut_lineage

SHINGLE, SEED, DISTANCE = 3, 42, 2
GOLAY_BITS, GOLAY_PARITY, GOLAY_RADIUS = 23, 11, 3
GOLAY_POLYNOMIAL = 0b110001110101       # x^11+x^10+x^6+x^5+x^4+x^2+1, which generates the code
_CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = raw.lower().split()          # bytes.lower() touches A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes = [xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at:at + _CHUNK], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp``, the 64 bits as a signed long."""
    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(x) for x in raw], np.uint64).view(np.int64))}

    return map_texts(docs, "fp long", work, keep=keep)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.uint32)
    for bit in range(GOLAY_BITS - 1, GOLAY_PARITY - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GOLAY_POLYNOMIAL << (bit - GOLAY_PARITY)), rest)
    return rest


def error_patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of weight up to ``most``, sorted by syndrome; their weights; where each syndrome's words begin."""
    words = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    words = words[np.bitwise_count(words) <= most]
    at = _syndromes(words)
    order = np.lexsort((np.bitwise_count(words), at))
    words, at = words[order], at[order]
    return words, np.bitwise_count(words).astype(np.int64), np.searchsorted(at, np.arange((1 << GOLAY_PARITY) + 1))


class Anchors:
    """Home and reach of fingerprints; built once in each Python worker."""
    _made: Anchors | None = None

    def __init__(self, distance: int = DISTANCE):
        self.distance = distance
        self.words, self.weights, self.begin = error_patterns(GOLAY_RADIUS + distance)

    @classmethod
    def get(cls) -> Anchors:
        cls._made = cls._made or cls()
        return cls._made

    def _near(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code word, bits beyond the radius) of all code words in reach of each half."""
        s = _syndromes(half)
        first, count = self.begin[s], self.begin[s + 1] - self.begin[s]
        row = np.repeat(np.arange(len(half)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return row, half[row] ^ self.words[at], np.maximum(0, self.weights[at] - GOLAY_RADIUS)

    def home(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for half, shift in zip(self._halves(fp), (GOLAY_BITS, 0), strict=True):
            pattern = self.words[self.begin[_syndromes(half)]]     # the lightest pattern is the coset leader
            out |= (half ^ pattern).astype(np.int64) << shift
        return out

    def reach(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of every anchor in reach."""
        (r1, c1, e1), (r2, c2, e2) = map(self._near, self._halves(fp))
        n2 = np.bincount(r2, minlength=len(fp))
        begin2 = np.cumsum(n2) - n2
        times = n2[r1]
        i = np.repeat(np.arange(len(r1)), times)
        j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin2[r1], times)
        keep = e1[i] + e2[j] <= self.distance
        i, j = i[keep], j[keep]
        return r1[i], c1[i].astype(np.int64) << GOLAY_BITS | c2[j].astype(np.int64)

    @staticmethod
    def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, mask = fp.view(np.uint64), np.uint64((1 << GOLAY_BITS) - 1)
        return (bits & mask).astype(np.uint32), (bits >> np.uint64(GOLAY_BITS) & mask).astype(np.uint32)


def links(classes: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of the distinct ``fp`` of ``classes`` that differ in 1 or 2 bits."""
    def homes(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(Anchors.get().home(fp)), pa.array(fp)], names=["anchor", "a"])

    def reaches(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), 1024):
                fp = whole[at:at + 1024]
                row, anchor = Anchors.get().reach(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], names=["at", "b"])

    fps = classes.select("fp")
    return (fps.mapInArrow(homes, "anchor long, a long")
            .join(fps.mapInArrow(reaches, "at long, b long").hint("merge"),
                  (F.col("anchor") == F.col("at")) & (F.col("a") < F.col("b"))
                  & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
            .select("a", "b"))


def named_classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each distinct ``fp`` of ``prints`` (doc_id, fp)."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(links(classes))
    placed = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    prints = cut_lineage(with_fingerprints(docs), "fingerprints")
    named = named_classes(prints).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: the smallest doc_id (null last), then the smallest hash of the text."""
    return plainly(docs, _keep_one_each)


def _keep_one_each(docs: DataFrame) -> DataFrame:
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = row.select("_row", F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.text").alias("_hash"),
                     F.length(F.col("_row.text").cast("string")).alias("_chars"))
    key = ("doc_id", "_hash", "_chars")
    prints = cut_lineage(with_fingerprints(row.select(*key, F.col("_row.text").alias("text")), key), "fingerprints")
    named = named_classes(prints).select(F.col("fp").alias("_fp"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *[F.col(c) for c in key])
    kept = (prints.join(named, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min(order).alias("k"))
            .select(*[F.col(f"k.{c}").alias(f"k{c}") for c in key]))
    alike = Window.partitionBy(*key).orderBy(F.lit(1))
    return (row.join(kept, F.col("doc_id").eqNullSafe(F.col("kdoc_id")) & F.col("_hash").eqNullSafe(F.col("k_hash"))
                     & F.col("_chars").eqNullSafe(F.col("k_chars")), "left_semi")
            .withColumn("_rank", F.row_number().over(alike)).filter("_rank = 1").select("_row.*"))
