"""Full texts for thin postings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.text import strip, strip_markup_page, text
from postloom.operators.scale import hot_keys, salted_join
from postloom.sources.boards import GREENHOUSE, LEVER, filled, items

# fixed values: link forms of the two known boards, and of embedded posting data
BOARD_LINK = r"(?i)greenhouse\.io/(?:embed/job_app\?for=)?([^/?]+).*?jobs/(\d+)"
BOARD_HOST = r"(?i)(?:^|//)([^./]+)\.greenhouse\.io"
JOB_NUMBER = r"jobs/(\d+)"
OTHER_BOARD_LINK = r"(?i)jobs\.lever\.co/([^/]+)/([0-9a-f\-]{36})"
EMBEDDED = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"


def embedded_description(html: Column) -> Column:
    """First non-empty description of an embedded job posting; blocks that do not parse are skipped."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(EMBEDDED), 1), lambda b: F.try_parse_json(strip(b)))

    def listed(v: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(v))

    def nodes(vs: Column, path: str) -> Column:
        return F.flatten(F.transform(F.filter(vs, lambda v: v.isNotNull()), lambda v: listed(v, path)))

    found = F.transform(nodes(nodes(blocks, "$"), '$["@graph"]'), lambda n: F.when(
        F.to_json(F.try_variant_get(n, '$["@type"]', "variant")).contains("JobPosting"),
        filled(F.try_variant_get(n, "$.description", "string"))))
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def extract_posting_text(pages: DataFrame) -> DataFrame:
    """``(url, html)`` -> adds ``full_text`` and ``label`` (json-ld, html or empty)."""
    texts = pages.withColumn("_data", embedded_description(text(F.col("html")))).withColumns({
        "_data_text": strip_markup_page(F.col("_data")), "_page_text": strip_markup_page(F.col("html"))})
    by_data = F.length("_data_text") > lookups.BOARD_MIN_CHARS
    by_page = F.length("_page_text") > lookups.PAGE_MIN_CHARS
    return texts.withColumns({
        "full_text": F.when(by_data, F.col("_data_text")).when(by_page, F.col("_page_text")).otherwise(""),
        "label": F.when(by_data, "json-ld").when(by_page, "html").otherwise(""),
    }).drop("_data", "_data_text", "_page_text")


def board_url_keys(url: Column) -> Column:
    """struct<kind, board, job_id> of a link to a known board, null for other links."""
    def key(kind: str, board: Column, job: Column) -> Column:
        return F.when((board != "") & (job != ""), F.struct(
            F.lit(kind).alias("kind"), board.alias("board"), job.alias("job_id")))

    first = F.coalesce(
        key("greenhouse", F.regexp_extract(url, BOARD_LINK, 1), F.regexp_extract(url, BOARD_LINK, 2)),
        key("greenhouse", F.regexp_extract(url, BOARD_HOST, 1), F.regexp_extract(url, JOB_NUMBER, 1)))
    other = key("lever", F.regexp_extract(url, OTHER_BOARD_LINK, 1), F.regexp_extract(url, OTHER_BOARD_LINK, 2))
    return F.when(url.startswith("http"), F.coalesce(
        F.when(url.contains("greenhouse.io"), first), F.when(url.contains("lever.co"), other)))


def board_texts(greenhouse: DataFrame, lever: DataFrame) -> DataFrame:
    """``(kind, board, job_id, board_text)`` from landed board payloads, one row per posting."""
    one = items(greenhouse, GREENHOUSE, "jobs", "slug").select(
        F.lit("greenhouse").alias("kind"), F.col("slug").alias("board"), F.col("j.id").cast("string").alias("job_id"),
        strip_markup_page(F.col("j.content")).alias("board_text"))
    two = items(lever, LEVER, None, "slug").select("slug", "j").select(
        F.lit("lever").alias("kind"), F.col("slug").alias("board"), F.col("j.id").alias("job_id"),
        F.coalesce(filled(F.col("j.descriptionPlain")), strip_markup_page(F.col("j.description"))).alias("board_text"))
    return one.unionByName(two).groupBy("kind", "board", "job_id").agg(F.max("board_text").alias("board_text"))


def jd_source_label(description: Column, mode: str, replaced: Column | None = None) -> Column:
    """How good the analysed text is. The two paths judge differently; ``mode`` chooses."""
    if mode == "ingest":
        return F.when(F.length(text(description)) >= lookups.THIN_CHARS, "full posting").otherwise("listing summary")
    if mode == "manual":
        return F.lit("manual paste")
    if mode == "analyze":
        return F.when(replaced, "full posting").otherwise("listing summary")
    raise ValueError(f"unknown mode: {mode}")


def enrich_thin(postings: DataFrame, pages: DataFrame | None = None, boards: DataFrame | None = None) -> DataFrame:
    """Thin postings get a longer landed text where there is one; adds ``jd_source``.

    ``pages`` has ``(url, full_text, label)``, ``boards`` what :func:`board_texts` gives.
    Only thin rows take part in the join, so full ones are not shuffled. Many postings
    may share one link; such links are salted.
    """
    description, url = text(F.col("description")), text(F.col("url"))
    thin = (F.length(description) < lookups.THIN_CHARS) & url.startswith("http")
    poor = postings.filter(thin)
    rest = postings.filter(~thin).withColumn("full_text", F.lit(None).cast("string"))

    if boards is not None:
        key = board_url_keys(F.col("url"))
        keyed = poor.withColumn("_board", F.nullif(F.concat_ws("|", key["kind"], key["board"], key["job_id"]), F.lit("")))
        asked = boards.select(F.concat_ws("|", "kind", "board", "job_id").alias("_board"), "board_text")
        poor = salted_join(keyed, asked, "_board", "left", hot_keys(keyed, "_board"), F.col("seq")).drop("_board")
        poor = poor.withColumn("board_text", F.when(F.length("board_text") > lookups.BOARD_MIN_CHARS, F.col("board_text")))
    else:
        poor = poor.withColumn("board_text", F.lit(None).cast("string"))
    if pages is not None:
        unique = pages.groupBy("url").agg(F.max_by("full_text", F.length("full_text")).alias("page_text"))
        poor = salted_join(poor, unique, "url", "left", hot_keys(poor, "url"), F.col("seq"))
    else:
        poor = poor.withColumn("page_text", F.lit(None).cast("string"))
    poor = poor.withColumn("full_text", F.coalesce("board_text", "page_text")).drop("board_text", "page_text")

    replaced = F.coalesce(F.length("full_text") > F.length(description), F.lit(False))
    both = poor.unionByName(rest)
    return both.withColumns({
        "jd_source": jd_source_label(F.col("description"), "analyze", replaced),
        "description": F.when(replaced, F.col("full_text")).otherwise(F.col("description")),
    }).drop("full_text")
