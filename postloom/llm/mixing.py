"""Mixing sources to target weights.

1. Targets: every source has a weight; together they share 150 % of all words; a target stops at twice its source's size and
   the excess goes to the others by weight, until none is above.
2. Blocks: the words of a source form one stream, cut into blocks of BLOCK words. Documents lie in the stream in the order
   of a hash bucket and then of their id; bucket totals give each bucket its place, so no source is ever sorted in one task.
3. Counts per output shard: the slots of all shards are numbered 0 .. N-1, and a pseudorandom permutation assigns them to
   the sources' quotas. The counts of a shard are thus multinomial counts, conditioned on the quotas being met exactly
   (plain multinomial totals would miss the targets by their standard deviation, and could pass the limit of two).
4. The counts number the draws: those of a source in the shards before, and then its slots within the shard. Draw number k
   of a source takes block perm(k mod blocks), where perm is a pseudorandom permutation of the source's block indices for
   each pass over them. A source is drawn at most twice its blocks, so no block is taken more than twice.
5. Draws and documents' pieces meet by an equi-join on (source, block): ``sharded`` gives the words of every slot of every
   shard, ``mix`` and ``mixed_documents`` add up how often the same draws take each block.

The permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012), which permute any range 0 .. n-1 without a
lookup table; keys come from xxhash64. Everything is a function of the rows and the seed, so reruns agree. Only DataFrame
functions are used; the sources table (one row a source) is aggregated before it is used and joined, never collected,
except for the few sums that fix the targets.

Defined cases: null text has size 0; a null source is a source of its own, after all others; documents of size 0 are
returned and take 0; an empty table gives an empty result; repeated rows are documents of their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import WORD, plainly, text_of
from postloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK = 128                    # words
SHARD_SLOTS = 8192             # slots of an output shard
ROUNDS = 8                     # of the permutations
SEED = 20_240_607
BUCKET_ROWS = 2_000            # documents of one hash bucket, about
TASK_DRAWS = 200_000            # draws made in one task, about
CHUNK = 4096                   # draws made from one row at once


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The image of ``x``, a number in 0 .. n-1, under the permutation of that range that ``key`` names.

    A fold over the rounds: written out as nested expressions, every round would triple the expression's size.
    """
    def swapped(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, key), n) - at, n)
        swap = F.xxhash64(F.lit(SEED + 1), r, key, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x, swapped)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row a source of ``sizes`` (source, size).

    The excess is reshared in closed form: a source is full if most * size <= t * weight for the final rate t. Sorted by
    size / weight, the full ones come first, and their number follows from running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = by_source.withColumn("_rank", F.row_number().over(order))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(table, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("_w"), "_rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(every)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rate = (total - full) / rest                    # if all before this one are full and this one isn't
    ranked = ranked.withColumn("_rate", rate).withColumn("_full", F.lit(most) * F.col("source_size") <= F.col("_rate") * F.col("_w"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("_w"), F.col("_rank"), F.col("_rate")))).over(every)
    return ranked.withColumn("_level", level["_rate"]).select(
        "source", "source_size",
        F.when(F.col("_full") | F.col("_level").isNull(), F.lit(most) * F.col("source_size"))
        .otherwise(F.col("_level") * F.col("_w")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_bucket``, ``_number`` and ``_start``: the row's key within its source and the place of its first word."""
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    totals = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_bucket").orderBy("doc_id", "size", "_hash")
    docs = (docs.withColumn("_number", F.row_number().over(within))
            .withColumn("_inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    return (docs.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("_start", F.col("_before") + F.col("_inside")).drop("_s", "_b", "_before", "_inside"))


def quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``blocks`` and ``draws`` of each source, and ``first``, the first of its numbers among all draws."""
    blocks = F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a source's last block may be short, so a draw is worth size / blocks words
    return (goals.filter("source_size > 0").withColumn("blocks", blocks)
            .withColumn("draws", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
            .withColumn("first", F.sum("draws").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("draws"))
            .withColumn("all_draws", F.sum("draws").over(every)))


def slots(quota: DataFrame, tasks: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """source, first, blocks, shard, slot: one row for each slot, given to a source by the permutation of all slots."""
    parts = quota.select("source", "blocks", "draws", "first", "all_draws", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / CHUNK).cast("long"))).alias("_chunk")).filter("draws > 0")
    parts = parts.repartition(tasks, "source", "_chunk")     # a number given is kept by adaptive execution
    from_, to = F.col("_chunk") * CHUNK, F.least(F.col("_chunk") * CHUNK + CHUNK, F.col("draws")) - 1
    rows = parts.select("*", F.explode(F.sequence(from_, to)).alias("k")).select(
        "source", "first", "blocks", permuted(F.col("first") + F.col("k"), F.col("all_draws"), F.lit(0).cast("long")).alias("_at"))
    return rows.select("source", "first", "blocks", F.floor(F.col("_at") / shard_slots).cast("long").alias("shard"),
                       F.pmod("_at", F.lit(shard_slots)).alias("slot"))


def shard_counts(given: DataFrame) -> DataFrame:
    """shard, source, first, n: the counts drawn for each output shard."""
    return given.groupBy("shard", "source", "first").agg(F.count(F.lit(1)).alias("n"))


def draws(given: DataFrame) -> DataFrame:
    """source, block, pass, shard, slot: the block that each of the ``slots`` takes."""
    along = Window.partitionBy("first").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # ``first`` tells sources apart and is never null
    before = shard_counts(given).select("first", "shard", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("first", "shard").orderBy("slot")) - 1
    # a shuffle: the counts grow with the data and must not be broadcast
    rows = given.withColumn("_inside", inside).join(before.hint("merge"), ["first", "shard"])
    rows = rows.withColumn("_k", F.col("_before") + F.col("_inside")).withColumn("pass", F.floor(F.col("_k") / F.col("blocks")).cast("long"))
    block = permuted(F.pmod("_k", "blocks"), F.col("blocks"), F.xxhash64("source", "pass"))
    return rows.select("source", block.alias("block"), "pass", "shard", "slot")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Explodes each row of ``placed`` into its share of every block it touches: _block, _from, _words."""
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    rows = rows.filter("size > 0").withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low = F.greatest(F.col("_block") * block - F.col("_start"), F.lit(0))
    high = F.least((F.col("_block") + 1) * block - F.col("_start"), F.col("size"))
    return rows.withColumn("_from", low).withColumn("_words", high - low)


KEY = ["source", "_bucket", "_number"]


def _plan(docs: DataFrame, block: int, shard_slots: int = SHARD_SLOTS):
    """The placed rows, the targets, and the written draws."""
    sizes = cut_lineage(sized(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("_hash")), "sizes")
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    goals = cut_lineage(targets(sizes), "targets")
    rows = cut_lineage(placed(sizes, buckets), "placed")
    quota = quotas(goals, block)
    most = quota.agg(F.max("all_draws")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_DRAWS))
    given = cut_lineage(slots(quota, tasks, shard_slots), "slots")
    return rows, goals, cut_lineage(draws(given), "draws")


def _meet(rows: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """Pieces of the placed rows and the draws of their block."""
    # a shuffle: the draws grow with the data, and a broadcast of them takes ten times as much as their files
    drawn = drawn.withColumnRenamed("source", "_s").hint("merge")
    return pieces(rows, block).join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("block")))


def _taken(rows: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """Pieces and how often their block is taken."""
    return _meet(rows, cut_lineage(drawn.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times")), "taken-blocks"), block)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row."""
    rows, goals, drawn = _plan(docs.select("doc_id", "source", "text"), block)
    words = _taken(rows, drawn, block).groupBy(*[F.col(c).alias(f"k{c}") for c in KEY]).agg(F.sum(F.col("_words") * F.col("times")).alias("taken"))
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"k{c}"))
    goals = goals.withColumnRenamed("source", "_s")
    return (rows.join(words, same, "left").join(goals, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture as documents, in the columns of ``docs``: each run of taken words of a row, once for each time taken.

    A row taken whole keeps its text unchanged; a run is its words joined by one space. ``n_chars``, if there, is that of
    the new text.
    """
    return plainly(docs, lambda d: _mixed_documents(d, block))


def _mixed_documents(docs: DataFrame, block: int) -> DataFrame:
    plain = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    rows, _, drawn = _plan(plain, block)
    met = _taken(rows, drawn, block)
    spans = F.sort_array(F.collect_list(F.struct("_from", "_words", "times")))
    # runs of words taken at least c times, c = 1, 2: [from, to)
    def runs(c: int) -> Column:
        parts = F.filter("_spans", lambda s: s["times"] >= c)
        start = F.array().cast("array<struct<a:bigint,b:bigint>>")
        join = lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == s["_from"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1),
                     F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (s["_from"] + s["_words"]).alias("b"))))
        ).otherwise(F.concat(acc, F.array(F.struct(s["_from"].alias("a"), (s["_from"] + s["_words"]).alias("b")))))
        return F.aggregate(parts, start, join)

    taken = (met.groupBy(*[F.col(c).alias(f"k{c}") for c in [*KEY, "doc_id", "size", "_hash"]]).agg(spans.alias("_spans"))
             .withColumn("_runs", F.concat(runs(1), runs(2))).drop("_spans"))
    out = _texts(docs, taken)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    made = {"text": F.col("_text")}
    if "n_chars" in kinds:
        made["n_chars"] = F.length("_text").cast(kinds["n_chars"])
    return out.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def sharded(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot, at, doc_id, source, text: the words of every slot, as the runs of documents that its block is made of;
    ``at`` is the place of a run's first word in the block."""
    plain = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    rows, _, drawn = _plan(plain, block, shard_slots)
    run = F.struct(F.col("_from").alias("a"), (F.col("_from") + F.col("_words")).alias("b"), "shard", "slot",
                   (F.col("_start") + F.col("_from") - F.col("_block") * block).alias("at"))
    taken = (_meet(rows, drawn, block).groupBy(*[F.col(c).alias(f"k{c}") for c in [*KEY, "doc_id", "size", "_hash"]])
             .agg(F.collect_list(run).alias("_runs")))
    return _texts(plain, taken).select("_run.shard", "_run.slot", "_run.at", "_row.doc_id", "_row.source", F.col("_text").alias("text"))


def _texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """_row, _run, _text: each run of ``taken``, with its row of ``docs`` and its words."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    whole = whole.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").cast("string").alias("source"),
                         F.regexp_count(text_of("_row.text"), F.lit(WORD)).cast("long").alias("size"),
                         F.xxhash64("_row.text").alias("_hash"))
    # rows alike in id, source, size and text are told apart by a number, in either table
    alike = ["source", "doc_id", "size", "_hash"]
    twin = Window.partitionBy(*alike).orderBy(F.lit(1))
    twin_k = Window.partitionBy(*[f"k{c}" for c in alike]).orderBy("k_bucket", "k_number")
    numbered = taken.withColumn("k_twin", F.row_number().over(twin_k))
    same = F.col("_twin") == F.col("k_twin")
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"k{c}"))
    out = (whole.withColumn("_twin", F.row_number().over(twin)).join(numbered, same)
           .select("_row", "size", F.explode("_runs").alias("_run")))
    words = F.filter(F.split(text_of("_row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.when(F.col("_run.b") - F.col("_run.a") == F.col("size"), F.col("_row.text").cast("string")).otherwise(
        F.array_join(F.slice(words, (F.col("_run.a") + 1).cast("int"), (F.col("_run.b") - F.col("_run.a")).cast("int")), " "))
    return out.select("_row", "_run", part.alias("_text"))
