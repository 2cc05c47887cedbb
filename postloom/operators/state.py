"""The stored postings: removal, changes, listing, summaries, alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.text import strip, text


def dismiss(state: DataFrame, ids: DataFrame, tombstones: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(remaining state, tombstones) after removing ``ids``; the latest tombstone per key stays."""
    chosen = ids.select("id").distinct()
    gone = state.join(chosen, "id", "left_semi").select("dedup_key", "content_key", at.alias("dismissed_at"))
    merged = tombstones.select("dedup_key", "content_key", "dismissed_at").unionByName(gone)
    latest = merged.groupBy("dedup_key").agg(
        F.max_by("content_key", F.struct("dismissed_at", "content_key")).alias("content_key"),
        F.max("dismissed_at").alias("dismissed_at"))
    return state.join(chosen, "id", "left_anti"), latest


def _valid(field: Column, value: Column) -> Column:
    return ((field == "status") & value.isin(lookups.STATUSES)) | field.isin("description", "analysis", "ats_score")


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid changes, quarantined changes)."""
    ok = F.coalesce(_valid(F.col("field"), F.col("value")), F.lit(False))
    return changes.filter(ok), changes.filter(~ok)


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row per id with the last value of each field; map-side combined."""
    order = F.struct("ts", "change_seq")

    def last(field: str) -> Column:
        mine = F.col("field") == field
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, order)).alias(f"new_{field}")

    return changes.groupBy("id").agg(*[last(f) for f in ("status", "description", "analysis", "ats_score")])


def apply_changes(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: (state with the last valid change per field, quarantined changes). Unknown ids do nothing."""
    good, bad = split_changes(changes)
    merged = state.join(latest_changes(good), "id", "left")
    patched = merged.withColumns({
        "status": F.coalesce("new_status", "status"),
        "description": F.coalesce(strip(F.col("new_description")), F.col("description")),
    })
    if "analysis" in state.columns:
        patched = patched.withColumn("analysis", F.coalesce("new_analysis", "analysis"))
    if "ats_score" in state.columns:
        patched = patched.withColumn("ats_score", F.coalesce(F.col("new_ats_score").try_cast("double"), F.col("ats_score")))
    return patched.drop("new_status", "new_description", "new_analysis", "new_ats_score"), bad


def listing_order(order: str = "score") -> list[Column]:
    """Sort keys of a listing; ``id`` settles what would otherwise be left open."""
    newest = [F.col("created_at").desc(), F.col("id").asc()]
    return [F.col("ats_score").desc_nulls_last(), *newest] if order == "score" else newest


def list_postings(state: DataFrame, status: str = "all", order: str = "score") -> DataFrame:
    """The list view, without the heavy columns."""
    rows = state if status in ("", "all", None) else state.filter(F.col("status") == status)
    return rows.drop("description", "analysis").orderBy(*listing_order(order))


def top_k_postings(scored: DataFrame, k: int, per: str) -> DataFrame:
    """The head of the listing for each value of ``per``, with its rank.

    Spark cuts each input partition to its own first ``k`` rows per key before the
    shuffle, so a key with a third of all rows ships ``k`` rows per partition.
    """
    ranked = W.partitionBy(per).orderBy(*listing_order())
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def score_band(score: Column) -> Column:
    """D6."""
    return (F.when(score.isNull(), "unscored").when(score < 40, "filtered out")
            .when(score < 60, "borderline").otherwise("likely passes"))


def ingest_summary(judged: DataFrame, inserted: DataFrame, analysed: bool = True) -> DataFrame:
    """Per source, what came in, what the filters dropped, what was inserted."""
    rows = judged.select("source", F.lit(1).alias("fetched"),
                         F.col("reject_reason").isNotNull().cast("int").alias("skipped"), F.lit(0).alias("inserted"))
    rows = rows.unionByName(inserted.select(
        "source", F.lit(0).alias("fetched"), F.lit(0).alias("skipped"), F.lit(1).alias("inserted")))
    out = rows.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("fetched", "skipped", "inserted")])
    return out.withColumns({
        "duplicates": F.col("fetched") - F.col("skipped") - F.col("inserted"),
        "analyzed": F.col("inserted") if analysed else F.lit(0).cast("long"),
    })


def alert_message(dashboard_url: str) -> Column:
    # fixed value: the alert's five-line format
    place = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.when(F.col("remote"), "Remote"), F.lit("—"))
    start = F.coalesce(F.nullif(F.col("start_date"), F.lit("")),
                       F.nullif(F.col("start_year"), F.lit(0)).cast("string"), F.lit("n/a"))
    return F.concat(
        F.lit("🆕 "), F.col("title"), F.lit(" — "), F.col("company"),
        F.lit("\n📍 "), place, F.lit("   🗓 start: "), start,
        F.lit("\n🔗 "), text(F.col("url")),
        F.lit("\nid: "), F.col("id"),
        F.lit(f"\nopen: {dashboard_url}/#/job/"), F.col("id"))


def alert_outbox(state: DataFrame, channel: str = "none",
                 dashboard_url: str = "http://localhost:8000") -> tuple[DataFrame, DataFrame]:
    """(messages to send, state with those rows marked). Channel ``none`` marks all and sends none."""
    waiting = state.filter(~F.coalesce(F.col("notified"), F.lit(False)))
    if channel == "none":
        waiting = waiting.filter(F.lit(False))
    outbox = waiting.select("id", F.lit(channel).alias("channel"), alert_message(dashboard_url).alias("message"))
    return outbox, state.withColumn("notified", F.lit(True))
