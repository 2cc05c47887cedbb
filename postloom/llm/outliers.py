"""Quality rules: robust multivariate outliers per language and source.

Location and scatter of each (language, source) are minimum-covariance-determinant estimates, after the deterministic
variant of Hubert, Rousseeuw and Verdonck (2012). Two starts are taken: medians and quartile spreads without correlations,
and the same spreads with the correlations of spatial signs. From each, two concentration steps are made: keep the share H
of rows with the smallest Mahalanobis distances, estimate anew. The start with the smaller determinant goes on, until the
edge of the kept share stands still in every group, in at most STEPS steps. A step is two aggregations over the written
statistics - a quantile sketch of the distances and sums of products - so a group of any size is combined before it is
shuffled, and a task only ever holds the parameters of groups, never their rows.

Groups of any size are judged alike. A group's estimate is drawn towards that of its language, and that towards the estimate
of all rows, each of n rows with the weight n / (n + PRIOR): a large group is judged by itself, one of a few rows nearly by its
language, and nothing switches in between. The edge of the kept share is drawn likewise, so that a few rows that are outliers
all together don't stand for their source. Each row takes part in these three estimates. A null language or source is a
group value like any other.

A row is rejected beyond the distance that a normal sample passes with the probability TAIL (chi-square with one degree a
statistic). FLOOR holds the least spread of each statistic, a choice of policy: differences of that size are never taken for
differences of quality, however uniform a source is.

Defined cases: a null text counts as empty (all counts zero, base_failed true); repeated rows are judged alike; a row whose
language and source hold only rows that fail the base rules has no distance.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import COUNTS, STATISTICS, statistics, with_counts
from postloom.operators.scale import hot_keys, hot_share, salted_join
from postloom.session import cut_lineage

PRIOR = 5.0 * STATISTICS   # rows that the wider estimate counts for: five a statistic
H = 0.75             # share of rows that a concentration step keeps
FIRST, STEPS = 2, 6  # steps from each start, and at most from the better one
STILL = 0.01         # an edge that moves by less than this share stands still
SHRINK = 0.3         # of correlations
TAIL = 1e-9          # of a normal sample that would be rejected
BROADCAST_POOLS = 2_000     # estimates of 1.3 KB each that are sent to all tasks; more are joined by salted shuffles
STARTS, ALL = ("0", "1"), "*"
FLOOR = np.array([1.0, 0.12, 0.35, 0.5, 0.5, 0.3, 1.5, 0.2, 1.0, 1.0, 0.8, 0.6])   # least spread of each statistic
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
X = [f"x{i}" for i in range(STATISTICS)]
POOL = ["pool", "parent", "top"]
PARAMETERS = "pool string, parent string, top string, edge double, mean array<double>, factor array<double>, log_det double"
PAIRS = [(i, j) for i in range(STATISTICS) for j in range(i, STATISTICS)]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _statistics(counts: DataFrame, keep: list[str]) -> DataFrame:
    kinds = {c: counts.schema[c].dataType.simpleString() for c in keep}

    def run(batches):
        for batch in batches:
            x = statistics({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, x.T)], names=[*keep, *X])

    return counts.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{x} double" for x in X)]))


def _group() -> Column:
    """Language and source as one key that is never null: a null is a field left out."""
    return F.to_json(F.struct("lang", "source"))


def _pools(start: str = "") -> Column:
    """pool, parent, top: the three estimates that a row takes part in, each with the wider ones that it is drawn towards."""
    source, language, every = (F.concat(F.lit(start), c) for c in (F.col("pool"), F.concat(F.lit("l"), F.to_json(F.struct("lang"))), F.lit(ALL)))
    none = F.lit(None).cast("string")
    return F.array(*(F.struct(p.alias("pool"), q.alias("parent"), t.alias("top"))
                     for p, q, t in ((source, language, every), (language, every, none), (every, none, none))))


def _by_pool(rows: DataFrame, right: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join on the pool. ``hot`` is None where the pools were counted and are few; else rows of a hot pool are spread over salts."""
    if hot is None:
        return rows.join(F.broadcast(right), "pool", how)
    by = [c for c in ("doc_id", *X) if c in rows.columns]
    return salted_join(rows, right, "pool", how, hot, F.xxhash64(*by))


def _levels(table: DataFrame, own: Column) -> DataFrame:
    """Adds ``levels``: of each pool what ``own`` holds of the estimate of all rows, of the language's, and of its own."""
    wider = table.filter(F.col("top").isNull())
    language = wider.filter(F.col("parent").isNotNull()).select(F.col("pool").alias("parent"), own.alias("up"))
    # one row for each start
    every = F.broadcast(wider.filter(F.col("parent").isNull()).select(F.col("pool").alias("_all"), own.alias("all")))
    levels = (F.when(F.col("parent").isNull(), F.array("all")).when(F.col("top").isNull(), F.array(F.col("all"), own))
              .otherwise(F.array(F.col("all"), F.col("up"), own)))
    return (table.join(language, "parent", "left").join(every, F.coalesce("top", "parent", "pool") == F.col("_all"))
            .withColumn("levels", levels).drop("up", "all", "_all"))


def _whiten(cov: np.ndarray) -> list[float]:
    """Row by row the inverse Cholesky factor of a regularised covariance.

    Spreads have floors, and correlations are drawn towards zero by SHRINK (the minimum regularised covariance
    determinant of Boudt et al. 2020): clean text has no symbols at all, so some statistics move together exactly.
    """
    spread = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), FLOOR)
    r = (1 - SHRINK) * cov / np.outer(spread, spread)
    np.fill_diagonal(r, 1.0)
    return [float(v) for v in (np.linalg.inv(np.linalg.cholesky(r)) / spread).ravel()]


def _distance(data: DataFrame, params: DataFrame, hot: DataFrame | None, keep: list[str], how: str = "inner") -> DataFrame:
    """Adds ``d``: the Mahalanobis distance to the row's pool. Parameters: one row a pool, with mean and factor."""
    d = STATISTICS
    joined = _by_pool(data, params.select("pool", "mean", "factor"), hot, how)
    z = [sum(((F.col(X[j]) - F.col("mean")[j]) * F.col("factor")[i * d + j] for j in range(i + 1)), F.lit(0.0))
         for i in range(d)]
    return joined.select(*keep, F.sqrt(sum((v * v for v in z), F.lit(0.0))).alias("d"))


def _sums(rows: DataFrame, inside: Column) -> DataFrame:
    """Of each pool the rows that are ``inside``, and the sums and products of their statistics."""
    rows = rows.select(*POOL, inside.cast("double").alias("n"), "edge", *[F.when(inside, F.col(x)).otherwise(0.0).alias(x) for x in X])
    return rows.groupBy(*POOL).agg(
        F.sum("n").alias("n"), F.max("edge").alias("edge"), F.array(*[F.sum(x) for x in X]).alias("s"),
        F.array(*[F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS]).alias("p"))


def _covariance(n: float, s: list[float], p: list[float]) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = np.asarray(s, float) / n, np.zeros((STATISTICS, STATISTICS))
    for (i, j), v in zip(PAIRS, p, strict=True):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    return mean, cov


def _estimate(sums: DataFrame, scale: float, prior: float) -> DataFrame:
    """Mean, whitening factor and logarithm of the determinant of each pool, drawn towards its wider pools."""
    def solve(frames):
        for f in frames:
            means, factors, logs = [], [], []
            for levels in f["levels"]:
                mean, cov = np.zeros(STATISTICS), np.zeros((STATISTICS, STATISTICS))
                for i, level in enumerate(levels):
                    if not level["n"]:
                        continue
                    m, c = _covariance(level["n"], level["s"], level["p"])
                    w = level["n"] / (level["n"] + prior) if i else 1.0
                    mean, cov = w * m + (1 - w) * mean, w * scale * c + (1 - w) * cov
                factor = _whiten(cov)
                means.append([float(v) for v in mean])
                factors.append(factor)
                logs.append(-2 * float(np.log(factor[::STATISTICS + 1]).sum()))
            yield pd.DataFrame({**{c: f[c] for c in POOL}, "edge": f["edge"], "mean": means, "factor": factors, "log_det": logs})

    return _levels(sums, F.struct("n", "s", "p")).select(*POOL, "edge", "levels").mapInPandas(solve, PARAMETERS)


def _starts(data: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Both starts: medians and spreads from quartiles, without correlations and with those of spatial signs."""
    cut = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = data.groupBy(*POOL).agg(*[F.percentile_approx(x, cut, 1000).alias(x) for x in X])

    def plain(frames):
        for f in frames:
            means, factors = [], []
            for _, r in f.iterrows():
                low, mid, high = (np.array([float(r[x][k]) for x in X]) for k in range(3))
                means.append([float(v) for v in mid])
                factors.append(_whiten(np.diag(((high - low) / 1.349) ** 2)))
            yield pd.DataFrame({**{c: f[c] for c in POOL}, "edge": 0.0, "mean": means, "factor": factors, "log_det": 0.0})

    first = cut_lineage(q.mapInPandas(plain, PARAMETERS), "rule-start")
    near = _by_pool(data, first.select("pool", "mean", "factor"), hot)
    z = [(F.col(x) - F.col("mean")[i]) * F.col("factor")[i * (STATISTICS + 1)] for i, x in enumerate(X)]
    size = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    signs = near.select(*POOL, F.lit(0.0).alias("edge"), *(F.when(size > 0, v / size).otherwise(0.0).alias(x) for v, x in zip(z, X, strict=True)))
    turned = _sums(signs, F.lit(True)).join(first.select("pool", "mean", "factor"), "pool")

    def correlated(frames):
        for f in frames:
            factors = []
            for n, p, plain_factor in zip(f["n"], f["p"], f["factor"], strict=True):
                spread = 1 / np.asarray(plain_factor)[::STATISTICS + 1]
                product = _covariance(n, [0.0] * STATISTICS, p)[1]
                size = np.sqrt(np.maximum(np.diag(product), 1e-12))
                factors.append(_whiten(product * np.outer(spread / size, spread / size)))
            yield pd.DataFrame({**{c: f[c] for c in POOL}, "edge": 0.0, "mean": f["mean"], "factor": factors, "log_det": 0.0})

    def of(start: str, params: DataFrame) -> DataFrame:
        return params.select(*(F.concat(F.lit(start), c).alias(c) for c in POOL), *[c for c in params.columns if c not in POOL])

    return cut_lineage(of(STARTS[0], first).union(of(STARTS[1], turned.mapInPandas(correlated, PARAMETERS))), "rule-starts")


def _step(usable: DataFrame, params: DataFrame, hot: DataFrame | None, h: float, scale: float, prior: float) -> DataFrame:
    """A concentration step of every pool."""
    near = _distance(usable, params, hot, [*POOL, *X])
    own = cut_lineage(near.groupBy(*POOL).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", h, 2000).alias("own")), "rule-edges")
    weight = lambda x: x["n"] / (x["n"] + prior)
    edge = _levels(own, F.struct("n", "own")).select("pool", F.aggregate(
        F.slice("levels", 2, 2), F.get("levels", F.lit(0))["own"], lambda e, x: weight(x) * x["own"] + (1 - weight(x)) * e).alias("edge"))
    sums = cut_lineage(_sums(_by_pool(near, edge, hot), F.expr("d <= edge")), "rule-sums")
    return cut_lineage(_estimate(sums, scale, prior), "rule-step")


def _better(params: DataFrame) -> DataFrame:
    """Of each pool the start with the least determinant, without its mark."""
    rest = [c for c in params.columns if c not in POOL]
    bare = [F.expr(f"substr({c}, 2)").alias(c) for c in POOL]
    least = params.select(*bare, F.struct("log_det", F.col("pool").alias("by"), *[c for c in rest if c != "log_det"]).alias("x"))
    return least.groupBy(*POOL).agg(F.min("x").alias("x")).select(*POOL, *[F.col(f"x.{c}").alias(c) for c in rest])


def _moved(before: DataFrame, after: DataFrame) -> bool:
    """Whether the edge of any pool still moves."""
    then = before.select("pool", F.col("edge").alias("then"))
    return not after.join(then, "pool").filter(F.abs(F.col("edge") - F.col("then")) > STILL * F.col("then")).isEmpty()


def _chi_square() -> tuple[np.ndarray, np.ndarray]:
    """Places and mass of the chi-square distribution with a degree for each statistic, by quadrature."""
    t = np.linspace(1e-6, 240, 400_001)
    mass = t ** (STATISTICS / 2 - 1) * np.exp(-t / 2)
    return t, mass / mass.sum()


def _consistency(h: float) -> float:
    """Scatter of the nearest share ``h`` of a normal sample is too small by this factor."""
    t, mass = _chi_square()
    inside = np.cumsum(mass) <= h
    return float(h / ((t * mass)[inside].sum() / STATISTICS))


def cutoff_at(tail: float) -> float:
    """The distance that the share ``tail`` of a normal sample passes."""
    t, mass = _chi_square()
    beyond = np.cumsum(mass[::-1])[::-1]
    return float(np.sqrt(t[np.searchsorted(-beyond, -tail)]))


def rule_verdicts(docs: DataFrame, prior: float = PRIOR, tail: float = TAIL, h: float = H, steps: int = STEPS) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, kept, distance (null where no estimate applies)."""
    counts = with_counts(docs.select("doc_id", "lang", "source", "text"), ("doc_id", "lang", "source"))
    spark, keep = docs.sparkSession, ["doc_id", *COUNTS[:5]]
    data = cut_lineage(_statistics(counts.withColumn("pool", F.concat(F.lit("s"), _group())), [*keep, "lang", "pool"]), "rule-statistics")
    limit, scale = hot_share(spark, data.count()), _consistency(h)
    # only plausible rows take part in an estimate: those with the words that the base rule asks for
    plausible = data.filter(~base_failed())
    usable = plausible.select("doc_id", F.inline(_pools()), *X)
    hot = hot_starts = None
    if usable.select("pool").distinct().count() > BROADCAST_POOLS:
        hot = cut_lineage(hot_keys(usable.select("pool"), "pool", limit), "rule-hot-pools")
        hot_starts = hot.select(F.explode(F.array(*(F.concat(F.lit(s), "pool") for s in STARTS))).alias("pool"))
    by_start = plausible.select("doc_id", F.inline(F.concat(*map(_pools, STARTS))), *X)
    params = _starts(usable, hot)
    for _ in range(FIRST):
        params = _step(by_start, params, hot_starts, h, scale, prior)
    params = cut_lineage(_better(params), "rule-better")
    for _ in range(steps):
        before, params = params, _step(usable, params, hot, h, scale, prior)
        if not _moved(before, params):
            break
    judged = _distance(data, params, hot, keep, "left")
    failed = base_failed()
    return judged.select("doc_id", *COUNTS[:5], failed.alias("base_failed"),
                         (~failed & (F.coalesce(F.col("d"), F.lit(0.0)) <= cutoff_at(tail))).alias("kept"),
                         F.col("d").alias("distance"))
