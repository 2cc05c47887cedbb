"""The keys of stored and tombstoned postings, kept so that a small batch need not shuffle them."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.dedup import KEYS
from postloom.streaming.store import Store

SHARDS = 64
BROADCAST_KEYS = 500_000        # keys of a batch, 40 characters each


def shard(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


@dataclass
class KeyIndex:
    """One table a key, in folders by batch and by shard of the key, each sorted by the key."""

    spark: SparkSession
    store: Store
    name: str
    broadcast_keys: int = BROADCAST_KEYS

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """The keys of ``rows`` as those of one batch; appending the batch again replaces them."""
        for key in KEYS:
            held = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("shard", shard(F.col(key)))
            held = held.repartition("shard").sortWithinPartitions("shard", key)
            held.write.mode("overwrite").partitionBy("shard").parquet(self.store.batch_path(f"{self.name}-{key}", batch_id))

    def held(self, asked: DataFrame, key: str, before: int) -> DataFrame | None:
        """Which keys of ``asked`` batches before ``before`` hold: at most as many as were asked for.

        A batch of up to ``broadcast_keys`` keys is sent to the index, whose files are read where they lie and only in the
        shards that are asked for; a larger one meets it in a shuffle.
        """
        stored = self.store.read(f"{self.name}-{key}", before)
        if stored is None:
            return None
        asked = asked.select(key).filter(F.col(key).isNotNull()).distinct()
        asked = asked.withColumn("shard", shard(F.col(key)))
        if asked.count() <= self.broadcast_keys:
            asked = F.broadcast(asked)
        return stored.join(asked, [key, "shard"], "left_semi").select(key).distinct()

    def known_to(self, batch: DataFrame, before: int) -> DataFrame | None:
        """(dedup_key, content_key) rows with the keys of ``batch`` that are held, one key a row."""
        out = None
        for key in KEYS:
            found = self.held(batch, key, before)
            if found is not None:
                rows = found.select(*[F.col(k) if k == key else F.lit(None).cast("string").alias(k) for k in KEYS])
                out = rows if out is None else out.unionByName(rows)
        return out
