"""Guards for size and skew, used wherever a key or a side may grow with the data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000      # a key with this many rows is split over salts
SALTS = 64
BROADCAST_CHARS = 4_000_000   # total text that a broadcast side may be derived from


Key = str | list[str]


def hot_share(spark: SparkSession, total: int) -> int:
    """Rows from which a key counts as hot among ``total``: an eighth of a shuffle partition's share.

    At most eight keys a shuffle partition can be that large, whatever the size of the input.
    """
    return max(1, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hot_keys(df: DataFrame, key: Key, rows: int = HOT_ROWS) -> DataFrame:
    """Keys (a column or several) with at least ``rows`` rows: at most ``count(df) / rows`` of them."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= rows).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, key: Key, how: str, hot: DataFrame | None,
                spread: Column, salts: int = SALTS) -> DataFrame:
    """Equi-join on ``key`` (a column or several) that spreads the left rows of hot keys over ``salts`` tasks.

    ``hot`` comes from :func:`hot_keys`, so it is small by construction and may be
    broadcast. The right rows of a hot key are repeated once per salt, all others
    stay single. The result is that of the plain join. ``hot`` is None when the input
    is known to be too small to hold a hot key.
    """
    keys = [key] if isinstance(key, str) else key
    if hot is None:
        return left.join(right, keys, how)
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    spread_left = left.join(flag, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    repeated = right.join(flag, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread_left.join(repeated, [*keys, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame, text_column: str, limit: int = BROADCAST_CHARS) -> bool:
    """Whether all text of ``df`` is small enough for anything derived from it to be broadcast."""
    total = df.agg(F.sum(F.length(text_column)).alias("chars")).first()["chars"]
    return (total or 0) <= limit


def maybe_broadcast(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast a side whose size has been checked; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if fits else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a scan with fewer splits than cores; large inputs stay as they are.

    For a table just read. Asking a plan that holds shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def unnest(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per struct of ``array``, its fields as columns; rows without any vanish.

    The outer form keeps the optimiser from adding a ``size(array) > 0`` filter, which
    would compute an expensive array twice.
    """
    held = df.select(*keep, array.alias("_items")).select(*keep, F.explode_outer("_items").alias("_item"))
    return held.filter(F.col("_item").isNotNull()).select(*keep, "_item.*")
