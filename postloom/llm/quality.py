"""Quality classifier: regularised quadratic discriminant analysis over statistics of the text.

Every labelled training row takes part: one aggregation adds up counts, sums and products per class, so the fit itself
works on two 12 x 12 matrices, whatever the size of the corpus. Each class covariance is shrunk towards the pooled one
and then towards a multiple of the identity (Friedman's regularised discriminant analysis); its Cholesky factor is
computed once and shipped with the scoring function.

Defined cases: a null or empty text is scored like any other text (all counts zero); labels that are null or not 0 or 1
are left out; a document labelled twice counts twice; a null doc_id is in the training fold but joins no label; without
both classes the score is the smoothed share of label 1 everywhere.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import COUNTS, STATISTICS, counts_of, fold_of, plainly, statistics, with_counts
from postloom.session import cut_lineage

FOLDS, HELD_OUT = 4, 2
TO_POOLED, TO_IDENTITY = 0.1, 0.02
THRESHOLD = 0.7


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians; ``factors`` are inverses of the Cholesky factors."""
    prior: tuple[float, float]
    means: np.ndarray | None
    factors: np.ndarray | None
    log_dets: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.means is None:
            return np.full(len(x), self.prior[1])
        log = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            log.append(np.log(self.prior[k]) - 0.5 * self.log_dets[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED,
                     to_identity: float = TO_IDENTITY) -> Discriminant:
    """From counts (2), sums (2 x d) and sums of products (2 x d x d) per class."""
    prior = (n + 1) / (n.sum() + 2)
    if n.min() < 2:
        return Discriminant((prior[0], prior[1]), None, None, None)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.sqrt(np.diag(pooled) + 1e-6)        # shrink in units of the pooled spread
    unit = np.outer(scale, scale)
    factors, log_dets = [], []
    for k in (0, 1):
        s = (1 - to_pooled) * scatter[k] / n[k] / unit + to_pooled * pooled / unit
        s = (1 - to_identity) * s + to_identity * np.trace(s) / len(s) * np.eye(len(s)) + 1e-6 * np.eye(len(s))
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower) / scale)
        log_dets.append(2 * np.log(np.diag(lower)).sum() + 2 * np.log(scale).sum())
    return Discriminant((prior[0], prior[1]), means, np.array(factors), np.array(log_dets))


def train(counts: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS,
          held_out: int = HELD_OUT) -> Discriminant:
    """Fit on the labelled rows outside the held-out fold. ``counts`` comes from ``with_counts``."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)")
    rows = counts.filter(fold_of(folds) != held_out).join(known, F.col("doc_id") == F.col("_id")).select("_y", *COUNTS)

    def moments(batches):
        for batch in batches:
            x = statistics({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("_y"), *map(pa.array, x.T)],
                                             names=["_y", *(f"x{i}" for i in range(STATISTICS))])

    d = STATISTICS
    made = rows.mapInArrow(moments, "_y int, " + ", ".join(f"x{i} double" for i in range(d)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    total = made.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"x{i}") for i in range(d)]).alias("s"),
                                   F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("p"))
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in total.collect():                      # two rows at most
        n[r["_y"]], sums[r["_y"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["p"], strict=True):
            products[r["_y"], i, j] = products[r["_y"], j, i] = v
    return fit_discriminant(n, sums, products)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. The texts are read once; their counts are written down."""
    counts = cut_lineage(with_counts(docs, ("doc_id",)), "quality-counts")
    model = train(counts, labels)
    key = counts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = statistics({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())],
                                             names=["doc_id", "score"])

    return counts.mapInArrow(run, f"doc_id {key}, score double").select(
        "doc_id", (fold_of(FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns unchanged.

    Texts are counted once: the rows are written with their counts, from which the model is fitted and then applied.
    """
    return plainly(docs, lambda d: _keep_good(d, labels, threshold))


def _keep_good(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of((t or "").encode("utf-8", "replace")) for t in texts], columns=list(COUNTS), dtype="int64")

    counted = cut_lineage(docs.withColumn("counts", count(F.col("text").cast("string"))), "quality-counted")
    model = train(counted.select("doc_id", "counts.*"), labels)

    @F.pandas_udf("double")
    def score(counts: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(statistics({c: counts[c].to_numpy() for c in COUNTS})))

    return counted.filter(score("counts") >= threshold).drop("counts")
