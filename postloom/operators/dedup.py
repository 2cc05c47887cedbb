"""Two-key, first-wins insertion with tombstones."""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom.functions.infer import content_key, dedup_key
from postloom.operators.components import components
from postloom.operators.scale import HOT_ROWS, hot_keys, salted_join
from postloom.session import cut_lineage

KEYS = ("dedup_key", "content_key")
ROUNDS = 6                   # rounds over all open rows before what is left is taken apart into components
COMPONENT_ROWS = 200_000     # a component up to this size is decided in one task, a larger one by further rounds


def with_keys(postings: DataFrame) -> DataFrame:
    """Both keys of a posting."""
    return postings.withColumns({
        "dedup_key": dedup_key(F.col("source"), F.col("source_job_id")),
        "content_key": content_key(F.col("company"), F.col("title"), F.col("location")),
    })


def _without(rows: DataFrame, known: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    return salted_join(rows, known.select(key).filter(F.col(key).isNotNull()), key, "left_anti", hot, F.col("seq"))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one component that enter when they arrive one after the other."""
    rows = rows.sort_values(["seq", *KEYS])
    held: dict[str, set] = {key: set() for key in KEYS}
    enters = []
    for keys in zip(*(rows[key] for key in KEYS), strict=True):
        new = all(k not in held[key] for key, k in zip(KEYS, keys, strict=True))
        if new:
            for key, k in zip(KEYS, keys, strict=True):
                held[key].add(k)
        enters.append(new)
    return rows.loc[enters, [*KEYS, "seq"]]


def _by_component(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(accepted rows of the components of at most ``most`` rows, all rows of the larger ones).

    Keys are the nodes and rows the edges. Nodes are hashes: two keys that share one can only join two components into
    one, and the rows of a joined component enter as they would apart.
    """
    node = {k: F.xxhash64(F.lit(k), F.col(k)) for k in KEYS}
    roots = components(rows.select(node["dedup_key"].alias("a"), node["content_key"].alias("b")))
    placed = (rows.withColumn("node", node["dedup_key"]).join(roots, "node", "left")
              .select(*KEYS, "seq", F.coalesce("root", "node").alias("root")))
    placed = cut_lineage(placed, "dedup-placed")
    large = cut_lineage(hot_keys(placed, "root", most + 1), "dedup-large")
    # at most one component in ``most`` rows is large
    small = cut_lineage(placed.join(F.broadcast(large), "root", "left_anti").groupBy("root")
                        .applyInPandas(_in_order, f"{KEYS[0]} string, {KEYS[1]} string, seq long"), "dedup-won")
    return small, cut_lineage(placed.join(F.broadcast(large), "root", "left_semi").drop("root"), "dedup-open")


def accepted_keys(batch: DataFrame, state: DataFrame | None = None, tombstones: DataFrame | None = None,
                  hot_rows: int = HOT_ROWS, rounds: int = ROUNDS, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """``(dedup_key, content_key, seq)`` of the rows of ``batch`` that get inserted.

    Rows arrive in ``seq`` order. A row is refused if either key is tombstoned or
    held by a stored row; a refused row claims no key. This is the first maximal
    independent set of "shares a key" in arrival order, which plain de-duplication
    does not give.

    Each round accepts every undecided row that comes first under both its keys and
    removes all rows that share a key with one. The minima are map-side combined,
    and their join is on ``(content_key, seq)`` with ``seq`` unique, so a key that
    holds a third of all rows is no hot spot. Only the removal joins rows on a key
    alone; those are salted.

    A chain of rows that share keys in turn loses only its head in a round. So after
    ``rounds`` of them the open rows are taken apart into connected components, which
    takes a number of steps that grows with the logarithm of the longest chain, and
    each component of at most ``component_rows`` is decided in arrival order in one
    task. Only larger ones go through further rounds, which also break them up; each
    time, twice as many rounds pass until the next look at components.
    """
    # copies under both keys stand or fall with their first row
    rows = batch.groupBy(*KEYS).agg(F.min("seq").alias("seq"))
    rows = cut_lineage(rows, "dedup-keys")
    small = rows.count() < hot_rows      # too few rows for any key to be hot
    hot = {k: None if small else cut_lineage(hot_keys(rows, k, hot_rows), "dedup-hot") for k in KEYS}
    for known in (tombstones, state):
        if known is not None:
            for key in KEYS:
                rows = _without(rows, known, key, hot[key])
    undecided = cut_lineage(rows, "dedup-open") if (state is not None or tombstones is not None) else rows

    taken: list[DataFrame] = []
    due = rounds
    while not undecided.isEmpty():
        if len(taken) == due:
            won, undecided = _by_component(undecided, component_rows)
            taken.append(won)
            due = 2 * len(taken) + rounds
            continue
        first_native = (undecided.groupBy("dedup_key")
                        .agg(F.min(F.struct("seq", "content_key")).alias("m"))
                        .select("dedup_key", "m.seq", "m.content_key"))
        first_content = undecided.groupBy("content_key").agg(F.min("seq").alias("seq"))
        won = cut_lineage(first_native.join(first_content, ["content_key", "seq"])
                          .select("dedup_key", "content_key", "seq"), "dedup-won")
        taken.append(won)
        left = _without(undecided, won, "dedup_key", hot["dedup_key"])
        left = _without(left, won, "content_key", hot["content_key"])
        undecided = cut_lineage(left, "dedup-open")
    if not taken:
        return rows.limit(0).select("dedup_key", "content_key", "seq")
    return reduce(DataFrame.unionByName, taken)


def dedup_insert(batch: DataFrame, state: DataFrame | None = None, tombstones: DataFrame | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inserted rows of ``batch`` in full, as new state rows."""
    keyed = batch if set(KEYS) <= set(batch.columns) else with_keys(batch)
    won = accepted_keys(keyed, state, tombstones, hot_rows)
    # a payload that landed twice has rows of equal keys and arrival: one of them enters
    twins = W.partitionBy("dedup_key").orderBy(*(c for c in ("file",) if c in keyed.columns), F.xxhash64(*keyed.columns))
    once = keyed.join(won, ["seq", *KEYS], "left_semi").withColumn("_twin", F.row_number().over(twins)).filter("_twin = 1")
    return once.select(*keyed.columns).withColumn("status", F.lit("to_apply"))
