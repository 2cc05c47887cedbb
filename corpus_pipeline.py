"""From raw documents to packed training sequences: five stages, each a table that the next one reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm import exact_dedup, mixing, packing, quality, simhash
from postloom.llm.common import table
from postloom.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this stage's input, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-equal texts: the smallest doc_id."""
    return simhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every run of words taken of a document is a row, once for each time it is taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their token ids."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources),
          ("packing", pack_sequences)]
ORACLE_SQL = None       # the classifier, the permutations and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
