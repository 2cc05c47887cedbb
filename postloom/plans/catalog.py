"""Every registered query: an operator of the library over the given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.infer import content_key, dedup_key, infer_country, is_remote
from postloom.functions.text import normalize_text, sentences, strip_markup_board, strip_markup_page, strip_markup_plain
from postloom.operators import analysis, dedup, enrich, filters, keywords, matching, profiles, prompts, state
from postloom.operators.scale import fits_broadcast, spread, unnest
from postloom.plans import overlay
from postloom.session import cut_lineage, scratch_path
from postloom.sources import boards, feeds, trackers
from postloom.streaming.ingest import IngestJob, stream_ingest, stream_payloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.postings(spark, sf)


def _started(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.with_start(overlay.postings(spark, sf, all_cores=True))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.with_keys(_started(spark, sf))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.postings(spark, sf, all_cores=True).select("seq", "description")


def _analysis(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> analysis.Analysis:
    wanted = filters.passing_profiles(_started(spark, sf), overlay.PROFILES)
    return analysis.Analysis.prepare(
        wanted.select(F.col("seq").alias("posting_id"), "profiles", *{"description": 0, **dict.fromkeys(keep)}), overlay.candidates(spark, sf), keep=keep)


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """Stored postings with a status, a score and a notification flag, by formula."""
    return _keyed(spark, sf).selectExpr(
        "*", "dedup_key as id",
        f"element_at(array({', '.join(repr(s) for s in lookups.STATUSES)}), cast(seq % 6 as int) + 1) as status",
        "case when seq % 5 <> 0 then (seq * 37 % 1000) / 10D end as ats_score",
        "seq % 4 = 0 as notified")


# --- sources --------------------------------------------------------------------

def _normalized(df: DataFrame) -> DataFrame:
    return df.select("source", "source_job_id", "title", "company", "location", "remote", "url", "description", "posted_at")


@query
def normalize_greenhouse(spark, sf):
    return _normalized(boards.normalize_greenhouse(overlay.greenhouse_payloads(_posts(spark, sf))))


@query
def normalize_lever(spark, sf):
    return _normalized(boards.normalize_lever(overlay.lever_payloads(_posts(spark, sf))))


@query
def normalize_ashby(spark, sf):
    return _normalized(boards.normalize_ashby(overlay.ashby_payloads(_posts(spark, sf))))


@query
def normalize_aggregator(spark, sf):
    return _normalized(boards.normalize_aggregator(overlay.adzuna_payloads(_posts(spark, sf))))


@query
def tracker_feed_topcap(spark, sf):
    return _normalized(trackers.normalize_tracker_feed(overlay.tracker_payloads(_posts(spark, sf))))


@query
def tracker_markdown(spark, sf):
    rows = trackers.parse_tracker_table(overlay.tracker_documents(_posts(spark, sf)))
    return rows.select("source_job_id", "title", "company", "location", "remote", "url", "description",
                       F.col("start_year").cast("string").alias("start_year"), F.col("arrival.pos").cast("long").alias("pos"))


@query
def strip_markup(spark, sf):
    page = spread(overlay.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return page.select("page_id", F.md5(strip_markup_board(F.col("html"))).alias("board_text"),
                       F.md5(strip_markup_plain(F.col("html"))).alias("plain_text"),
                       F.md5(strip_markup_page(F.col("html"))).alias("page_text"))


@query
def union_sources(spark, sf):
    posts = _posts(spark, sf)
    broken = spark.range(1).selectExpr("'board_x' as slug", "'{broken' as payload")
    every = feeds.union_sources({
        "greenhouse": overlay.greenhouse_payloads(posts).unionByName(broken),
        "lever": overlay.lever_payloads(posts), "ashby": overlay.ashby_payloads(posts),
        "adzuna": overlay.adzuna_payloads(posts)})
    return every.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("remote").alias("n_remote"),
        F.countDistinct("source_job_id").alias("n_ids"), F.sum(F.length("description")).alias("chars"))


@query
def manual_postings(spark, sf):
    typed = _posts(spark, sf).selectExpr(
        "seq as entry_id", "concat('  ', title, ' ') as title", "concat(company, '\\n') as company", "url",
        "concat(' ', location) as location", "remote", "concat('\\n', description) as description",
        "case when seq % 10 = 0 then 2030 end as start_year")
    keyed = dedup.with_keys(feeds.manual_postings(typed))
    return keyed.select("source_job_id", "title", "company", "location", "dedup_key", "content_key",
                        F.col("start_year").cast("string").alias("start_year"), "start_date", F.length("description").cast("long").alias("chars"))


# --- inference --------------------------------------------------------------------

@query
def infer_start(spark, sf):
    return _started(spark, sf).select("seq", F.col("start_year").cast("string").alias("start_year"), "start_date")


@query
def infer_country_remote(spark, sf):
    return _posts(spark, sf).select("seq", infer_country(F.col("location")).alias("country"),
                                    is_remote(F.col("location"), F.col("remote")).alias("is_remote"))


@query
def posting_keys(spark, sf):
    return _posts(spark, sf).select("seq", dedup_key(F.col("source"), F.col("source_job_id")).alias("dedup_key"),
                                    content_key(F.col("company"), F.col("title"), F.col("location")).alias("content_key"))


# --- filters ------------------------------------------------------------------------

@query
def filter_reasons(spark, sf):
    return filters.filter_reasons(_started(spark, sf), overlay.PROFILE["A"]).select("seq", "reject_reason")


@query
def filter_reason_counts(spark, sf):
    judged = filters.filter_multi_profile(_started(spark, sf), overlay.PROFILES, "seq")
    return judged.groupBy("profile_id", F.coalesce("reject_reason", F.lit("passes")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def filter_multi_profile(spark, sf):
    return filters.filter_multi_profile(_started(spark, sf), overlay.PROFILES, "seq")


@query
def filter_profile_table(spark, sf):
    """F7 with the profiles as a table."""
    table = profiles.profile_table(spark, overlay.PROFILES)
    return profiles.filter_profile_table(_started(spark, sf), table, "seq")


@query
def passing_pairs(spark, sf):
    """The postings that pass each profile of a table, without forming the other pairs."""
    return profiles.passing_pairs(_started(spark, sf), profiles.profile_table(spark, overlay.PROFILES), "seq")


@query
def prune(spark, sf):
    kept, gone = filters.prune(_started(spark, sf), overlay.PROFILE["A"], F.lit("2026-06-02"))
    return kept.select("seq", F.lit(None).cast("string").alias("tombstone")).unionByName(
        gone.select("seq", F.col("dedup_key").alias("tombstone")))


# --- state -----------------------------------------------------------------------------

@query
def dedup_insert(spark, sf):
    keyed = _keyed(spark, sf)
    half = keyed.agg(F.count(F.lit(1)).alias("n")).first()["n"] // 2
    stored = dedup.dedup_insert(keyed.filter(F.col("seq") < half))
    new = dedup.dedup_insert(keyed.filter(F.col("seq") >= half), stored, overlay.tombstones(keyed))
    return stored.unionByName(new).select("seq", "dedup_key", "content_key", "status")


def _one_per_key(stored: DataFrame) -> DataFrame:
    """The first row of each native key, as an insert would leave it."""
    return stored.join(stored.groupBy("dedup_key").agg(F.min("seq").alias("seq")), ["dedup_key", "seq"], "left_semi")


@query
def tombstone_dismiss(spark, sf):
    stored = _one_per_key(_state(spark, sf))
    old = stored.filter("seq % 3 = 0").select("dedup_key", F.lit("old").alias("content_key"), F.lit("2026-01-01").alias("dismissed_at"))
    rest, tombs = state.dismiss(stored, stored.filter("seq % 5 = 0").select("id"), old, F.lit("2026-06-02"))
    return rest.groupBy(F.lit("state").alias("part"), F.col("dedup_key")).agg(F.lit("").alias("detail")).unionByName(
        tombs.select(F.lit("tombstone").alias("part"), "dedup_key",
                     F.concat_ws("|", F.when(F.col("content_key") == "old", "old").otherwise("new"), "dismissed_at").alias("detail")))


@query
def apply_changes(spark, sf):
    stored = _one_per_key(_state(spark, sf))
    n = stored.sparkSession.read.parquet(f"{sf}/documents.parquet").count()
    log = overlay.changes(spark, sf, n, _keyed(spark, sf))
    patched, refused = state.apply_changes(stored.drop("ats_score"), log)
    return patched.select(F.col("seq").cast("string").alias("posting"), "status", F.md5("description").alias("description")).unionByName(
        refused.agg(F.lit("refused").alias("posting"), F.count(F.lit(1)).cast("string").alias("status"),
                    F.lit(None).cast("string").alias("description")))


@query
def list_by_score(spark, sf):
    listed = state.list_postings(_state(spark, sf), "applied")
    return listed.select("id", "seq", "status", "ats_score", "title", "company")


@query
def top_k_per_candidate(spark, sf):
    a = _analysis(spark, sf)
    order = overlay.postings(spark, sf).select(F.col("seq").alias("posting_id"), "created_at")
    scored = analysis.top_scores(a, 10).withColumn("ats_score", F.round("ats_score", 4)).join(order, "posting_id").withColumn("id", F.col("posting_id"))
    top = state.top_k_postings(scored, 10, "candidate_id")
    return top.select("candidate_id", "posting_id", F.col("rank").cast("long").alias("rank"), "ats_score")


@query
def score_bands(spark, sf):
    return _state(spark, sf).groupBy(state.score_band(F.col("ats_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_summary(spark, sf):
    judged = cut_lineage(filters.filter_reasons(_keyed(spark, sf), overlay.PROFILE["A"]), "judged")
    passing = judged.filter("reject_reason is null").drop("reject_reason")
    return state.ingest_summary(judged, dedup.dedup_insert(passing))


@query
def alert_outbox(spark, sf):
    outbox, _ = state.alert_outbox(_state(spark, sf), "slack")
    return outbox


# --- keywords --------------------------------------------------------------------------

def _numbered(df: DataFrame, array, name: str) -> DataFrame:
    return unnest(df, F.transform(array, lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias(name))), "seq")


@query
def sentences_of(spark, sf):
    return _numbered(_docs(spark, sf), sentences(F.col("description")), "sentence")


@query
def segment_sections(spark, sf):
    return _numbered(_docs(spark, sf), keywords.segments(F.col("description")), "s").select("seq", "pos", "s.section", "s.segment")


@query
def skill_hits(spark, sf):
    return unnest(_docs(spark, sf), keywords.skill_counts(normalize_text(F.col("description"))), "seq").withColumnsRenamed(
        {"value": "skill", "n": "hits"})


@query
def skill_sections(spark, sf):
    return unnest(_docs(spark, sf), keywords.known_keywords(F.col("description")), "seq").withColumnRenamed("count", "hits")


@query
def doc_ngrams(spark, sf):
    return unnest(_docs(spark, sf), keywords.ngrams(F.col("description"), lookups.STOP_WORDS), "seq")


@query
def salient_terms(spark, sf):
    ranked = keywords.ngrams(F.col("description"), lookups.STOP_WORDS, lookups.SALIENT_CAP)
    return _numbered(_docs(spark, sf), ranked, "t").select("seq", (F.col("pos") + 1).alias("rank"), "t.term", "t.tf")


def _keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.jd_keywords(_docs(spark, sf))


@query
def soft_keywords(spark, sf):
    return _keyword_rows(spark, sf).filter("soft").select("seq", "keyword", F.col("count").alias("hits"), "in_req", "section")


@query
def keyword_importance(spark, sf):
    return _keyword_rows(spark, sf).select("seq", "keyword", "section", "soft", F.round("importance", 6).alias("importance"))


# --- résumés and matching ----------------------------------------------------------------

@query
def candidate_bullets(spark, sf):
    return matching.candidate_bullets(overlay.candidates(spark, sf))


@query
def candidate_terms(spark, sf):
    return matching.candidate_terms(overlay.candidates(spark, sf))


@query
def keyword_match(spark, sf):
    names = cut_lineage(_keyword_rows(spark, sf).select("keyword").distinct(), "keywords")
    cands = overlay.candidates(spark, sf)
    hits = matching.keyword_hits(names, cands, fits_broadcast(cands, "text"))
    return hits.withColumn("match_tier", F.col("match_tier").cast("long"))


@query
def matched_missing(spark, sf):
    lists = analysis.matched_missing(_analysis(spark, sf), lists=True)
    count = lambda wanted: F.size(F.filter("every", wanted)).cast("long")
    return lists.select(
        "candidate_id", "posting_id", count(lambda k: k["match_tier"].isNotNull()).alias("n_matched"),
        count(lambda k: k["match_tier"].isNull()).alias("n_missing"),
        count(lambda k: k["match_tier"].isNotNull() & (k["section"] == "required")).alias("required_matched"),
        count(lambda k: k["section"] == "required").alias("required_total"))


@query
def keyword_context(spark, sf):
    docs = _docs(spark, sf).select(F.col("seq").alias("posting_id"), "description", F.array().cast("array<string>").alias("profiles"))
    found = F.transform("keywords", lambda k: F.struct(
        k["keyword"].alias("keyword"), keywords.keyword_context(F.col("sentences"), k).alias("context")))
    return unnest(cut_lineage(analysis.posting_features(docs), "features"), found, "posting_id")


@query
def bullet_tfidf(spark, sf):
    vectors = analysis.bullet_vectors(overlay.candidates(spark, sf))
    return vectors.select("candidate_id", "token", F.col("bullet_index").cast("long").alias("bullet_index"),
                          F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@query
def find_spots(spark, sf):
    spots = analysis.find_spots(_analysis(spark, sf))
    return spots.select("candidate_id", "posting_id", "keyword", F.posexplode("spots").alias("pos", "s")).select(
        "candidate_id", "posting_id", "keyword", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("s.bullet_index").cast("long").alias("bullet_index"), F.round("s.similarity", 4).alias("similarity"))


@query
def analyze_pairs(spark, sf):
    scores = analysis.pair_scores(_analysis(spark, sf))
    return scores.select(
        "candidate_id", "posting_id", "profile_id", F.round("ats_score", 4).alias("ats_score"), F.round("match_rate", 4).alias("match_rate"),
        "total", "matched", "required_total", "required_matched")


@query
def coverage(spark, sf):
    return analysis.pair_scores(_analysis(spark, sf)).select(
        "candidate_id", "posting_id", F.round("coverage", 6).alias("coverage"), F.round("match_rate", 6).alias("match_rate"))


@query
def semantic_similarity(spark, sf):
    return analysis.pair_similarity(_analysis(spark, sf)).select("candidate_id", "posting_id", F.round("similarity", 6).alias("similarity"))


@query
def ats_score(spark, sf):
    scored = analysis.pair_scores(_analysis(spark, sf))
    return scored.groupBy("candidate_id", state.score_band(F.col("ats_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ats_score"), 4).alias("avg_score"), F.round(F.max("ats_score"), 4).alias("best"))


@query
def gap_ranking(spark, sf):
    gaps = analysis.pair_gaps(_analysis(spark, sf))
    return gaps.select("candidate_id", "posting_id", F.posexplode("gaps").alias("pos", "g")).select(
        "candidate_id", "posting_id", (F.col("pos") + 1).cast("long").alias("gap_rank"), "g.keyword", "g.section",
        F.round("g.importance", 6).alias("importance"))


@query
def assemble_analysis(spark, sf):
    return analysis.assemble_analysis(_analysis(spark, sf)).select(
        "candidate_id", "posting_id", "score", "match_rate", "required_total", "required_matched",
        F.to_json("matched_keywords").alias("matched_keywords"), F.to_json("missing_keywords").alias("missing_keywords"),
        F.to_json("resume_bullets").alias("resume_bullets"))


# --- enrichment and documents ---------------------------------------------------------------

def _crawled(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.extract_posting_text(overlay.pages(spark, sf))


@query
def extract_posting_text(spark, sf):
    return _crawled(spark, sf).select("page_id", "label", F.md5("full_text").alias("full_text"), F.length("full_text").cast("long").alias("chars"))


@query
def enrich_thin(spark, sf):
    return enrich.enrich_thin(_posts(spark, sf), _crawled(spark, sf).select("url", "full_text", "label")).select(
        "seq", "jd_source", F.md5("description").alias("description"))


@query
def board_url_keys(spark, sf):
    posts = _posts(spark, sf)
    linked = overlay.board_urls(posts).withColumn("key", enrich.board_url_keys(F.col("url")))
    texts = enrich.board_texts(overlay.greenhouse_payloads(posts), overlay.lever_payloads(posts))
    full = enrich.enrich_thin(linked, boards=texts)
    return full.select("seq", "key.kind", "key.board", "key.job_id", "jd_source", F.length("description").cast("long").alias("chars"))


@query
def jd_source_label(spark, sf):
    return _posts(spark, sf).select("seq", enrich.jd_source_label(F.col("description"), "ingest").alias("at_ingest"),
                                    enrich.jd_source_label(F.col("description"), "manual").alias("at_paste"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.postings(spark, sf).withColumnRenamed("seq", "posting_id")


TOLD = ("title", "company", "description")


@query
def tailoring_prompts(spark, sf):
    a = _analysis(spark, sf, TOLD)
    made = prompts.tailoring_prompts(analysis.assemble_analysis(a, texts=prompts.TAILORING), _documents(spark, sf), a.candidates)
    return made.select("candidate_id", "posting_id", F.md5("prompt").alias("prompt"), F.length("prompt").cast("long").alias("chars"))


@query
def gap_block(spark, sf):
    return prompts.gap_block(analysis.assemble_analysis(_analysis(spark, sf), texts=prompts.GAP_BLOCK))


@query
def gap_requests(spark, sf):
    a = _analysis(spark, sf, TOLD)
    made = prompts.gap_requests(analysis.assemble_analysis(a, texts=prompts.REQUEST), _documents(spark, sf), a.candidates)
    return made.select("candidate_id", "posting_id", F.md5("request").alias("request"), F.length("request").cast("long").alias("chars"))


@query
def top_matches(spark, sf):
    """Flagship: each candidate's ten best postings with band, required coverage and first gaps."""
    a = _analysis(spark, sf)
    listed = overlay.postings(spark, sf).select(F.col("seq").alias("posting_id"), "created_at", "title", "company")
    scored = analysis.top_scores(a, 10).withColumn("ats_score", F.round("ats_score", 4)).join(listed, "posting_id").withColumn("id", F.col("posting_id"))
    top = cut_lineage(state.top_k_postings(scored, 10, "candidate_id"), "top")
    gaps = analysis.pair_gaps(a, top.select(*analysis.PAIR))
    first = F.array_join(F.transform(F.slice("gaps", 1, 3), lambda g: g["keyword"]), ", ")
    return top.join(gaps, list(analysis.PAIR)).select(
        "candidate_id", F.col("rank").cast("long").alias("rank"), "posting_id", "title", "company", "ats_score",
        state.score_band(F.col("ats_score")).alias("band"), "required_matched", "required_total", first.alias("first_gaps"))


# --- streaming ----------------------------------------------------------------------------------

RUNS = 3


def _streamed(spark: SparkSession, sf: str, channel: str, between: Callable[[IngestJob, int], None] | None = None, **settings) -> IngestJob:
    """Land the postings in three parts and let the stream run after each, as a schedule would; ``between`` acts before each run."""
    landed = scratch_path(spark, "landed")
    posts = overlay.postings(spark, sf, all_cores=True)
    last = posts.agg(F.max("batch_id").alias("b")).first()["b"]
    job = IngestJob(spark, scratch_path(spark, "ingest"), overlay.PROFILE["A"], channel=channel, **settings)
    for part in range(RUNS):
        due = F.col("batch_id") * RUNS >= part * (last + 1)
        later = F.col("batch_id") * RUNS >= (part + 1) * (last + 1)
        # a part is a range of ids, so few tasks hold its rows; what lands in few files would be read by as few
        posts.filter(due & ~later).repartition("seq").write.mode("append").parquet(landed)
        if between is not None:
            between(job, part)
        stream_ingest(job, spark.readStream.schema(posts.schema).parquet(landed)).awaitTermination()
    return job


def _streamed_files(spark: SparkSession, sf: str) -> IngestJob:
    """Land the postings as raw payload files in three pulls, with a run of the stream after each."""
    landed = scratch_path(spark, "payloads")
    job = IngestJob(spark, scratch_path(spark, "ingest"), overlay.PROFILE["A"])
    for run in range(RUNS):
        overlay.land(_posts(spark, sf), landed, RUNS, run)
        stream_payloads(job, landed).awaitTermination()
    return job


@query
def stream_payload_files(spark, sf):
    """From payload files to stored postings."""
    return _streamed_files(spark, sf).read("state").select(
        "source", "source_job_id", "title", "company", "location", "dedup_key", "content_key", F.md5("description").alias("description"),
        F.col("start_year").cast("string").alias("start_year"), "status")


@query
def stream_quarantine(spark, sf):
    """Payload files that hold no readable list, from the same parse as the postings."""
    return _streamed_files(spark, sf).read("quarantine").select("source", "key", F.rtrim("payload", F.lit("\n")).alias("payload"))


@query
def split_sources(spark, sf):
    """S9 with both outputs over all formats: readable rows and unreadable payloads of each."""
    posts = _posts(spark, sf)
    raw = {"greenhouse": overlay.greenhouse_payloads(posts), "lever": overlay.lever_payloads(posts), "ashby": overlay.ashby_payloads(posts),
           "adzuna": overlay.adzuna_payloads(posts, keyed=True), "tracker_feed": overlay.tracker_payloads(posts), "tracker_table": overlay.tracker_documents(posts)}
    damaged = {n: df.withColumn(c := "markdown" if n == "tracker_table" else "payload", F.when(
        F.regexp_extract("slug" if "slug" in df.columns else "repo", r"(\d+)\z", 1).cast("long") % 4 == 1, F.substring(c, 1, 5))
        .otherwise(F.col(c))) for n, df in raw.items()}
    good, bad = feeds.split_sources(damaged)
    return good.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("arrival.payload").alias("payloads")).select(
        F.lit("postings").alias("part"), "source", "n", "payloads").unionByName(
        bad.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("quarantine").alias("part"), "source", "n", F.col("n").alias("payloads")))


@query
def stream_scores(spark, sf):
    """The scored state: half of the candidates are there from the first run, the others come before the second."""
    mine = overlay.candidates(spark, sf).filter("profile_id = 'A'")

    def between(job: IngestJob, run: int) -> None:
        if run < 2:
            job.add_candidates(mine.filter(F.col("candidate_id") % 8 == 4 * run), run)

    listed = _streamed(spark, sf, "none", between, details=False).listing()
    return listed.select("candidate_id", "seq", F.round("ats_score", 4).alias("ats_score"), F.round("match_rate", 4).alias("match_rate"),
                         "status", "notified")


@query
def stream_requests(spark, sf):
    """The stored state after what users did between the runs: dismissed postings and changed ones."""
    n = overlay.table(spark, sf, "documents").count()
    log = overlay.changes(spark, sf, n, _keyed(spark, sf))

    def between(job: IngestJob, run: int) -> None:
        if run == 1:
            for _ in range(2):      # a repeated request changes nothing
                job.dismiss(job.read("state").filter("seq % 5 = 0").select("id"), F.lit("2026-06-02"), 0)
                job.change(log, 0)

    job = _streamed(spark, sf, "none", between)
    return job.current().select("seq", "status", F.md5("description").alias("description"))


@query
def stream_ingest_equals_batch(spark, sf):
    return _streamed(spark, sf, "none").read("state").select("seq", "dedup_key", "content_key", "status")


@query
def stream_alerts(spark, sf):
    return _streamed(spark, sf, "slack").read("outbox").select("id", "channel", "message")
