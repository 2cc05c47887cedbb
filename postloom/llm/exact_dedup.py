"""Exact de-duplication as a stateful stream.

Each row becomes a small index row: the SHA-256 digest of its normalised text, its id and a content locator (file and row
in that file). The index is landed as files, and a Structured Streaming query folds them into keyed state without expiry:
per digest the smallest rank - longest original text, then smallest id, then locator - and the number of rows. The state
lives in RocksDB on the executors' disks, with its checkpoint in the shared folder, so a lost executor restores it there
and a later run with the same folder goes on from it. Counts and minima are combined before the shuffle, so a digest that
a third of all rows share reaches its state as one row per task.

Full bytes are checked on hits: of digests seen more than once, the distinct (digest, text) pairs are formed by a hash
aggregate that collapses copies before the shuffle. A digest with more than one text is a collision; its rows are then
grouped by the text itself. Texts that occur once are never shuffled for this as long as the repeated digests are few
enough to be broadcast (BROADCAST_DIGESTS, counted first); beyond that the join shuffles.

Only DataFrame functions run on the executors.

Defined cases: null text counts as empty; texts of white space only equal the empty text; repeated rows and repeated ids:
exactly one row of a group is kept, told apart by the locator; a null doc_id ranks after all ids, and keep_id is null only
if no row of the best length has an id.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import text_of
from postloom.session import cut_lineage, scratch_path

BROADCAST_DIGESTS = 500_000          # 32 bytes each
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INDEX = "digest binary, doc_id {id}, n long, file string, row long"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` as they are, the other columns named by their place, and ``_file`` and ``_at``: where each
    row's content lies. Tables without a place - not of files, or with a column ``_metadata`` - are landed first, once.

    A table of files must be as read, row by row: rows made several times of one have one place. Write such a table first.
    """
    plain = docs.toDF(*[n if n in ("doc_id", "text") else f"x{i}" for i, n in enumerate(docs.columns)])
    try:
        return _with_place(plain)
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "INVALID_EXTRACT")):
            raise
    return _with_place(cut_lineage(plain, "landed"))


def _with_place(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.unloadOnCommit": "true",          # frees the executors' disks
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no megabytes set aside per partition
              "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
              "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128"}
    before = {k: spark.conf.get(k) if spark.conf.get(k, None) is not None else None for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def advance_state(spark: SparkSession, index_dir: str, state_dir: str, id_type: str = "bigint") -> DataFrame:
    """Fold all index files not seen yet into the state; the state of all digests: digest, best, members.

    ``best`` holds rank, doc_id, file and row of the row that stays.
    """
    rank = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"),
                    F.col("file"), F.col("row"))
    with _state_on_disk(spark):
        stream = (spark.readStream.schema(INDEX.format(id=id_type)).parquet(index_dir)
                  .groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("members")))
        query = (stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        names = ["best", "members"]
        state = spark.read.format("statestore").load(state_dir)
        value = [f.name for f in state.schema["value"].dataType.fields]
        return state.select(F.col("key.digest").alias("digest"),
                            *[F.col(f"value.`{v}`").alias(n) for v, n in zip(value, names, strict=True)])


def _verified(rows: DataFrame, digest: Column, repeated: DataFrame) -> DataFrame:
    """Digests among ``repeated`` that stand for more than one text."""
    texts = rows.select(digest.alias("digest"), normalised().alias("norm"))
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    pairs = texts.join(repeated, "digest", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")


def exact_groups(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """_file, _at, doc_id, digest, keep_id, group_size, kept for every row of ``docs``; ``docs`` comes from ``located``.

    ``digest`` replaces the SHA-256 digest, for tests of collisions.
    """
    spark, digest = docs.sparkSession, digest if digest is not None else digest_of(normalised())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "_file", "_at")
    index_dir = scratch_path(spark, "digest-index")
    rows.select(digest.alias("digest"), "doc_id", F.length(text_of()).cast("long").alias("n"), F.col("_file").alias("file"),
                F.col("_at").alias("row")).write.parquet(index_dir)
    index = spark.read.schema(INDEX.format(id=kind)).parquet(index_dir)
    state = cut_lineage(advance_state(spark, index_dir, scratch_path(spark, "digest-state"), kind), "digest-groups")
    repeated = state.filter("members > 1").select("digest")
    collided = cut_lineage(_verified(rows, digest, repeated), "collided-digests")
    named = state.select(F.col("digest").alias("_digest"), "best", "members")
    judged = index.join(named, F.col("digest") == F.col("_digest")).select(
        F.col("file").alias("_file"), F.col("row").alias("_at"), "doc_id", "digest",
        F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"))
    if collided.isEmpty():
        return judged
    texts = rows.select("*", digest.alias("digest"), normalised().alias("norm")).join(collided, "digest", "left_semi")
    rank = F.struct((-F.length(text_of())).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), "_file", "_at")
    groups = (texts.groupBy(F.col("digest").alias("_d"), F.col("norm").alias("_n"))
              .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")))
    exact = texts.join(groups, (F.col("digest") == F.col("_d")) & (F.col("norm") == F.col("_n"))).select(
        "_file", "_at", "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size",
        ((F.col("_file") == F.col("best._file")) & (F.col("_at") == F.col("best._at"))).alias("kept"))
    return judged.join(collided, "digest", "left_anti").select(exact.columns).unionByName(exact)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    packed = located(docs)
    gone = exact_groups(packed).filter(~F.col("kept")).select(F.col("_file").alias("_f"), F.col("_at").alias("_a"))
    return (packed.join(gone, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")), "left_anti")
            .drop("_file", "_at").toDF(*docs.columns))
