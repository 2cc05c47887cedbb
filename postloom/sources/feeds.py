"""Reading landed files, joining sources, manual rows."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.infer import infer_start
from postloom.functions.text import strip, text
from postloom.session import cut_lineage
from postloom.sources import boards, trackers

Normalizer = Callable[[DataFrame], DataFrame]
# source formats by name; register another by adding to this mapping
REGISTRY: dict[str, Normalizer] = {
    "greenhouse": boards.normalize_greenhouse,
    "lever": boards.normalize_lever,
    "ashby": boards.normalize_ashby,
    "tracker_feed": trackers.normalize_tracker_feed,
    "tracker_table": trackers.parse_tracker_table,
    "adzuna": boards.normalize_aggregator,
}


# what a payload of each format holds: the shape of its JSON and the field with the list; other formats are read as they are
SHAPES: dict[str, tuple[str, str | None]] = {
    "greenhouse": (boards.GREENHOUSE, "jobs"), "lever": (boards.LEVER, None), "ashby": (boards.ASHBY, "jobs"),
    "tracker_feed": (trackers.FEED, None), "adzuna": (boards.ADZUNA, "results"),
}


def register(name: str, normalizer: Normalizer, schema: str | None = None, field: str | None = None) -> None:
    REGISTRY[name] = normalizer
    SHAPES.pop(name, None)
    if schema is not None:
        SHAPES[name] = (schema, field)


def read_payloads(spark: SparkSession, path: str, key: str = "slug") -> DataFrame:
    """Landed payload files below ``path``: the folder's name as ``key``, the payload, and ``file``.

    ``file`` orders the pulls of one board by landing time, then by path, and tells their rows apart.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    place = _place()
    landed = F.lpad(F.unix_millis("_metadata.file_modification_time").cast("string"), 15, "0")
    return files.select(F.regexp_extract(place, r"([^/]+)/[^/]+\z", 1).alias(key), F.col("value").alias("payload"),
                        F.concat_ws(" ", landed, place).alias("file"))


def list_in_few_tasks(spark: SparkSession) -> None:
    """Let the session list folders in a few tasks a core. By itself Spark starts a task for each folder, up to 10,000,
    each time files are listed; a stream does that three times a run, and every board has a folder of its own."""
    name, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def _place() -> Column:
    """A file's path; the metadata column holds it as a URI."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def landed_files(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Files below ``root``/pull/source/...: source, ``file`` (the path below ``root``), body and landed_at.

    A folder may be called ``name=value``, which counts as ``value``. ``file`` orders all payloads: pulls are named so that
    they sort by time. With ``stream`` it is a stream of the files as they land.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index(_place(), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(F.regexp_extract(below, r"^[^/]*/([^/=]*=)?([^/]+)/", 2).alias("source"), below.alias("file"),
                        F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("landed_at"))


def of_source(files: DataFrame, source: str) -> DataFrame:
    """The ``landed_files`` of one format, as its normalizer reads them.

    Below the source's folder a board's files lie in a folder named by its slug, a feed's in one named owner/repository, and
    Markdown lists under owner/repository/branch at their own path; one without a further folder is the list's front page.
    """
    below = F.regexp_replace(F.regexp_extract("file", r"^[^/]*/[^/]+/(.+)\z", 1), r"(^|/)[^/=]*=", "$1")
    mine = files.filter(F.col("source") == source)
    folder = F.regexp_extract(below, r"^(.*?)/?[^/]*\z", 1)
    # the value of a name=value folder is escaped as in URLs
    folder = F.when(F.col("file").contains("="), F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(folder)
    if source == "tracker_table":
        part = lambda i: F.regexp_extract(below, r"^([^/]+/[^/]+)/([^/]+)/(.+)\z", i)
        front = F.lower(part(3)).rlike(r"^readme(\.md)?\z")
        return mine.select(part(1).alias("repo"), part(2).alias("branch"), F.when(~front, part(3)).alias("path"),
                           F.col("body").alias("markdown"), "file")
    return mine.select(folder.alias("repo" if source == "tracker_feed" else "slug"), F.col("body").alias("payload"), "file")


def split_sources(raw: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """S9 with its side output: (postings, quarantine). Each payload is parsed once, into a written table that both read.

    Quarantined are payloads without a readable list: source, the payload's ``key`` (slug or repository), ``file`` where it
    is known, and the payload.
    """
    unknown = set(raw) - set(REGISTRY)
    if unknown:
        raise ValueError(f"no normalizer registered for {sorted(unknown)}")
    good, bad = [], []
    for name, df in raw.items():
        body = "payload" if "payload" in df.columns else "markdown"
        if name in SHAPES:
            parsed = cut_lineage(boards.parsed_once(df, *SHAPES[name]), f"parsed-{name}")
            readable = F.col("_items").isNotNull()
        else:
            # a list is read line by line; without any table row it holds nothing
            parsed, readable = df, F.coalesce(F.col(body).rlike(r"(?m)^\s*\|"), F.lit(False))
        good.append(REGISTRY[name](parsed.filter(readable)))
        key = next((F.col(c) for c in ("slug", "repo") if c in df.columns), F.lit(None).cast("string"))
        file = F.col("file") if "file" in df.columns else F.lit(None).cast("string")
        bad.append(parsed.filter(~readable).select(F.lit(name).alias("source"), key.alias("key"), file.alias("file"),
                                                   F.col(body).alias("payload")))
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)


def union_sources(raw: Mapping[str, DataFrame]) -> DataFrame:
    """All enabled sources as one table. A payload that does not parse adds no rows and stops nothing."""
    unknown = set(raw) - set(REGISTRY)
    if unknown:
        raise ValueError(f"no normalizer registered for {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [REGISTRY[name](df) for name, df in raw.items()])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``.txt`` and ``.md`` résumés; bytes that are no UTF-8 are ignored.

    A candidate's id is the file's path below ``path`` without its ending, so that equal names in two folders stay apart.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(
        F.lower("path").rlike(r"\.(txt|md)\z"))
    # invalid bytes become the replacement character, which is then dropped
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit(chr(0xFFFD)), F.lit(""))
    return files.select(F.regexp_replace(F.substring_index("path", path.split(":", 1)[-1].rstrip("/") + "/", -1), r"\.[^./]+\z", "").alias("candidate_id"), decoded.alias("text"))


def with_start(postings: DataFrame) -> DataFrame:
    """N1 + N2 over a postings table."""
    inferred = infer_start(F.col("title"), F.col("description"), F.col("start_year"), F.col("start_date"))
    return (postings.withColumn("_start", inferred)
            .withColumns({"start_year": F.col("_start.start_year"), "start_date": F.col("_start.start_date")}).drop("_start"))


def manual_postings(entries: DataFrame) -> DataFrame:
    """Rows a user typed in. They skip the filters but not de-duplication.

    ``entry_id`` takes the place of a random id, so that a rerun gives the same key.
    """
    trimmed = {c: strip(text(F.col(c))) for c in ("title", "company", "url", "location", "description")}
    rows = entries.withColumns(trimmed).withColumns({
        "source": F.lit("manual"),
        "source_job_id": F.concat(F.lit("manual:"), F.col("entry_id").cast("string")),
        "remote": F.coalesce("remote", F.lit(False)),
        "start_date": F.lit(None).cast("string"),
        "posted_at": F.lit(None).cast("string"),
    })
    return with_start(rows)
