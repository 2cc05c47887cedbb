"""Toxicity: a logistic model with counterfactual regularisation.

Features are the presence of words and of word beginnings. For every training sentence with an identity term, the term is
swapped for another of its group, and the squared change of the model's logit is penalised (counterfactual logit pairing,
Garg et al. 2019), so that a mention of a group as such doesn't raise the score.

The model is fitted on a bounded sample, MAX_PER_LABEL rows of each label with the smallest hashes of their id; the bound
is a parameter and also bounds what is broadcast and what reaches the driver. Class weights restore the true shares.
Everything else works on all rows: a text is scored alone, without a shuffle.

Defined cases: a null or empty text has no feature and scores the model's intercept; labels that are null or not 0 or 1 are
left out; a null doc_id joins no label; if one label is missing, every score is the smoothed share of label 1.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import BATCH_ROWS, fold_of, map_texts
from postloom.session import cut_lineage

FOLDS, HELD_OUT = 5, 0
MAX_PER_LABEL = 6_000
VOCABULARY = 3_000          # features kept, those most associated with label 1
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
L2, PAIRING = 1e-3, 1.0
STEPS = 400
THRESHOLD = 0.5
KNOWN_WORDS = 100_000       # words a worker remembers, or features that it counts before it sends them on
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")

# Terms that name groups of people, by kind; a term is swapped for the next of its line. A parameter of the operator.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"), ("immigrant", "refugee", "foreigner", "local"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """A word of three letters or more, and its beginnings (marked by a final hyphen)."""
    out = {w for w in words if len(w) >= 3}
    return out | {w[:n] + "-" for w in words for n in PREFIXES if len(w) >= n}


def counterfactuals(text: str, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[set[str], set[str]]]:
    """(words, words after the swap) of each sentence that has an identity term."""
    swap = {t: line[(i + 1) % len(line)] for line in identity for i, t in enumerate(line)}
    out = []
    for sentence in _SENTENCE.split(text):
        words = words_of(sentence)
        if not words.isdisjoint(swap):
            out.append((words, {swap.get(w, w) for w in words}))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float

    def logits(self, texts: list[str], memory: dict[str, tuple[str, ...]]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in words_of(text):
                known = memory.get(w)
                if known is None:
                    if len(memory) >= KNOWN_WORDS:
                        memory.clear()
                    known = memory[w] = tuple(f for f in features_of({w}) if f in self.weights)
                if known:
                    found.update(known)
            out[i] += sum(self.weights[f] for f in sorted(found))
        return out


def _sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of the sample, and the number of labelled training rows of each label."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
             .filter("_y in (0, 1) and _id is not null").filter(fold_of(FOLDS, "_id") != HELD_OUT))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most 2 * per_label ids
    return rows.select("_y", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), n


def feature_counts(batches: Iterable[pa.RecordBatch], most: int = KNOWN_WORDS) -> Iterator[pa.RecordBatch]:
    """Rows of each label (a: 1, b: 0) that have a feature, added up in the task, so that few rows and batches leave it."""
    of: dict[str, list[int]] = {}
    sent = lambda: pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), *(
        pa.array([n[y] for n in of.values()], pa.int64()) for y in (1, 0))], names=["feature", "a", "b"])
    for batch in batches:
        for y, text in zip(batch.column("_y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for f in features_of(words_of(text)):
                of.setdefault(f, [0, 0])[y] += 1
            if len(of) >= most:
                yield sent()
                of.clear()
    if of:
        yield sent()


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], size: int, share: dict[int, float],
        l2: float = L2, pairing: float = PAIRING, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted log loss, ridge and pairing penalty. Rows and pairs hold feature numbers."""
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([f for r in rows for f in r[1]], np.int64)
    got = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    importance = np.where(y == 1, share[1] / got[1], share[0] / got[0])
    p_row, p_col, p_sign = [], [], []
    for i, (a, b) in enumerate(pairs):
        for f in set(a) ^ set(b):
            p_row.append(i)
            p_col.append(f)
            p_sign.append(1.0 if f in set(a) else -1.0)
    p_row, p_col, p_sign = np.array(p_row, np.int64), np.array(p_col, np.int64), np.array(p_sign)
    w = np.zeros(size + 1)                        # the last is the intercept
    w[size] = np.log(share[1] / share[0])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logit = np.bincount(row, w[col], len(rows)) + w[size]
        error = importance * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)
        grad = np.concatenate([np.bincount(col, error[row], size), [error.sum()]])
        grad[:size] += l2 * w[:size]
        if len(pairs):
            change = np.bincount(p_row, p_sign * w[p_col], len(pairs))
            grad[:size] += 2 * pairing / len(pairs) * np.bincount(p_col, p_sign * change[p_row], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = MAX_PER_LABEL,
          identity: tuple[tuple[str, ...], ...] = IDENTITY, pairing: float = PAIRING) -> Model:
    sample, n = _sample(docs, labels, label, per_label)
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model({}, float(np.log(p / (1 - p))))
    sample = cut_lineage(sample, "toxicity-sample")

    taken = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t0, t1 = taken.get(0, 0), taken.get(1, 0)
    if not t0 or not t1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model({}, float(np.log(p / (1 - p))))
    seen = sample.mapInArrow(feature_counts, "feature string, a long, b long").groupBy("feature").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate = (F.col("a") + F.col("b")) / (t0 + t1)
    z = (F.col("a") / t1 - F.col("b") / t0) / F.sqrt(rate * (1 - rate) * (1 / t0 + 1 / t1) + 1e-12)
    chosen = (seen.filter(F.col("a") >= MIN_DOCS).withColumn("z", z).filter("z > 3")
              .orderBy(F.desc("z"), "feature").limit(VOCABULARY).select("feature").collect())
    terms = {t for line in identity for t in line}
    names = sorted({r["feature"] for r in chosen} | features_of(terms))
    number = {f: i for i, f in enumerate(names)}

    def index(batches):
        of = lambda words: sorted(number[f] for f in features_of(words) if f in number)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = part.column("text").to_pylist()
                swaps = [[(of(a), of(b)) for a, b in counterfactuals(t, identity)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_y"), pa.array([of(words_of(t)) for t in texts], pa.list_(pa.int32())),
                     *(pa.array([[pair[side] for pair in s] for s in swaps], pa.list_(pa.list_(pa.int32()))) for side in (0, 1))],
                    names=["y", "x", "a", "b"])

    rows, pairs = [], []
    for r in sample.mapInArrow(index, "y int, x array<int>, a array<array<int>>, b array<array<int>>").toLocalIterator():
        rows.append((r["y"], r["x"]))
        pairs.extend(zip(r["a"], r["b"], strict=True))
    total = n0 + n1
    w, b = fit(rows, pairs, len(names), {0: n0 / total, 1: n1 / total}, pairing=pairing)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model, memory = train(docs, labels), {}

    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        logit = model.logits([x.decode("utf-8", "replace") for x in raw], memory)
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))), pa.float64())}

    return map_texts(docs, "score double", work, keep=("doc_id",)).select(
        "doc_id", (fold_of(FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
