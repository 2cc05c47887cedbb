"""Landed board and aggregator payloads -> postings.

A raw row is one landed payload: its text, and the board's slug where the payload
does not name it. Parsing is permissive; what does not parse goes to quarantine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import strip_markup_board, strip_markup_plain, text

POSTING_COLUMNS = ["source", "source_job_id", "title", "company", "location", "remote", "url", "description",
                   "posted_at", "start_date", "start_year", "arrival"]

# fixed values: payload shapes; fields not named here are ignored
GREENHOUSE = ("struct<jobs:array<struct<id:bigint,title:string,location:struct<name:string>,"
              "absolute_url:string,content:string,updated_at:string>>>")
LEVER = ("array<struct<id:string,text:string,categories:struct<location:string,commitment:string>,"
         "descriptionPlain:string,description:string,hostedUrl:string>>")
ASHBY = ("struct<jobs:array<struct<id:string,jobId:string,title:string,location:string,isRemote:boolean,"
         "jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string,publishedAt:string>>>")
ADZUNA = ("struct<results:array<struct<id:string,title:string,company:struct<display_name:string>,"
          "location:struct<display_name:string>,redirect_url:string,description:string,created:string>>>")


def filled(c: Column) -> Column:
    """Null when empty."""
    return F.nullif(c, F.lit(""))


def mentions_remote(c: Column) -> Column:
    return F.lower(c).contains("remote")


def day(c: Column) -> Column:
    """The date part of a timestamp text."""
    return filled(F.substring(text(c), 1, 10))


def landed(raw: DataFrame, *parts: str) -> DataFrame:
    """Adds ``_file``, which orders payloads: the landed file where it is known, then ``parts``."""
    return raw.withColumn("_file", F.concat_ws("|", *(["file"] if "file" in raw.columns else []), *parts))


def listed(raw: DataFrame, schema: str, field: str | None) -> Column:
    """A payload's list: as :func:`parsed_once` has left it, else parsed here. Null where there is none."""
    if "_items" in raw.columns:
        return F.col("_items")
    parsed = F.from_json("payload", schema)
    return parsed[field] if field else parsed


def parsed_once(raw: DataFrame, schema: str, field: str | None) -> DataFrame:
    """``raw`` with ``_items``, the list, and ``_sha``; the payload itself stays only where it holds no readable list."""
    return (raw.withColumns({"_items": listed(raw, schema, field), "_sha": F.sha1("payload")})
            .withColumn("payload", F.when(F.col("_items").isNull(), F.coalesce("payload", F.lit("")))))


def items(raw: DataFrame, schema: str, field: str | None, *keep: str) -> DataFrame:
    """One row per payload item with its position; the payload itself is dropped."""
    return raw.select(*keep, F.posexplode_outer(listed(raw, schema, field)).alias("pos", "j")).filter("j is not null")


def quarantine(raw: DataFrame, schema: str, field: str | None) -> DataFrame:
    """Payloads that hold no readable list. ``feeds.split_sources`` gives them beside the postings, from one parse."""
    return raw.filter(listed(raw, schema, field).isNull())


def arrival(rank: int, file_key: Column, pos: Column) -> Column:
    """Order of arrival: source, then payload, then place in it. It is data, so a rerun repeats it."""
    return F.struct(F.lit(rank).alias("source_rank"), file_key.alias("payload"), pos.alias("pos"))


def finish(df: DataFrame) -> DataFrame:
    for name, kind in (("posted_at", "string"), ("start_date", "string"), ("start_year", "int")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select(*POSTING_COLUMNS)


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    """``(slug, payload)``."""
    place = text(F.col("j.location.name"))
    return finish(items(landed(raw, "slug"), GREENHOUSE, "jobs", "slug", "_file").select(
        F.lit("greenhouse").alias("source"), F.coalesce(F.col("j.id").cast("string"), F.lit("None")).alias("source_job_id"),
        text(F.col("j.title")).alias("title"), F.col("slug").alias("company"), place.alias("location"),
        mentions_remote(place).alias("remote"), text(F.col("j.absolute_url")).alias("url"),
        strip_markup_board(F.col("j.content")).alias("description"), day(F.col("j.updated_at")).alias("posted_at"),
        arrival(0, F.col("_file"), F.col("pos")).alias("arrival")))


def normalize_lever(raw: DataFrame) -> DataFrame:
    """``(slug, payload)``; the payload is a bare array."""
    place = text(F.col("j.categories.location"))
    return finish(items(landed(raw, "slug"), LEVER, None, "slug", "_file").select(
        F.lit("lever").alias("source"), F.coalesce("j.id", F.lit("None")).alias("source_job_id"),
        text(F.col("j.text")).alias("title"), F.col("slug").alias("company"), place.alias("location"),
        mentions_remote(F.concat(place, text(F.col("j.categories.commitment")))).alias("remote"),
        text(F.col("j.hostedUrl")).alias("url"),
        F.coalesce(filled(F.col("j.descriptionPlain")), strip_markup_plain(F.col("j.description"))).alias("description"),
        arrival(1, F.col("_file"), F.col("pos")).alias("arrival")))


def normalize_ashby(raw: DataFrame) -> DataFrame:
    """S3: ``(slug, payload)``."""
    place = text(F.col("j.location"))
    return finish(items(landed(raw, "slug"), ASHBY, "jobs", "slug", "_file").select(
        F.lit("ashby").alias("source"),
        F.coalesce(filled(F.col("j.id")), filled(F.col("j.jobId")), F.col("j.title"), F.lit("None")).alias("source_job_id"),
        text(F.col("j.title")).alias("title"), F.col("slug").alias("company"), place.alias("location"),
        (F.coalesce("j.isRemote", F.lit(False)) | mentions_remote(place)).alias("remote"),
        text(F.coalesce(filled(F.col("j.jobUrl")), F.col("j.applyUrl"))).alias("url"),
        strip_markup_plain(F.coalesce(filled(F.col("j.descriptionHtml")), F.col("j.descriptionPlain"))).alias("description"),
        day(F.col("j.publishedAt")).alias("posted_at"), arrival(2, F.col("_file"), F.col("pos")).alias("arrival")))


def normalize_aggregator(raw: DataFrame) -> DataFrame:
    """``(payload)``; company and place come with each item, texts are plain."""
    place = text(F.col("j.location.display_name"))
    keyed = landed(raw if "_sha" in raw.columns else raw.withColumn("_sha", F.sha1("payload")), "_sha")
    return finish(items(keyed, ADZUNA, "results", "_file").select(
        F.lit("adzuna").alias("source"), F.coalesce("j.id", F.lit("None")).alias("source_job_id"),
        text(F.col("j.title")).alias("title"), text(F.col("j.company.display_name")).alias("company"),
        place.alias("location"), mentions_remote(place).alias("remote"), text(F.col("j.redirect_url")).alias("url"),
        text(F.col("j.description")).alias("description"), day(F.col("j.created")).alias("posted_at"),
        arrival(4, F.col("_file"), F.col("pos")).alias("arrival")))
