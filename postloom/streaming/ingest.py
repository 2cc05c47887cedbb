"""Recurring ingest as a stream; each micro-batch is one ingest run.

A run takes landed payload files, or postings that are ready, and goes through normalise -> infer -> filter -> insert ->
score -> alert. State is a set of tables of appended batches (``Store``). A run reads what batches before it wrote and
overwrites its own folders, so one that is repeated after a failure gives the same state and the same alerts.

What users do between runs is stored in the same way, under the last batch that has run: it takes effect from the next
batch on, and a repeated request replaces itself.

Scores are kept incrementally: a run scores its new postings against all candidates so far, and its new candidates against
all postings stored before. Nothing is scored twice, and together the increments are the whole.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom import lookups
from postloom.operators import state as stored
from postloom.operators.analysis import Analysis, analysis_json, assemble_analysis, pair_scores, posting_features
from postloom.operators.dedup import KEYS, dedup_insert, with_keys
from postloom.operators.enrich import jd_source_label
from postloom.operators.filters import FilterProfile, filter_reasons, prune
from postloom.operators.scale import fits_broadcast
from postloom.session import cut_lineage
from postloom.sources import feeds
from postloom.streaming.keys import KeyIndex
from postloom.streaming.store import Store

STATE_COLUMNS = ["id", "dedup_key", "content_key", "seq", "source", "source_job_id", "title", "company", "location",
                 "remote", "url", "description", "posted_at", "start_date", "start_year", "status", "created_at", "notified"]


@dataclass
class IngestJob:
    """What an ingest run needs besides the postings."""

    spark: SparkSession
    state_dir: str
    profile: FilterProfile
    candidates: DataFrame | None = None     # candidate_id, text: known before the first batch
    channel: str = "none"
    dashboard_url: str = "http://localhost:8000"
    details: bool = True                    # store the whole analysis of each pair, not its scores only
    store: Store = field(init=False)
    keys: KeyIndex = field(init=False)
    dead_keys: KeyIndex = field(init=False)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.state_dir)
        self.keys = KeyIndex(self.spark, self.store, "keys")
        self.dead_keys = KeyIndex(self.spark, self.store, "dead-keys")

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        return self.store.read(table, before)

    # --- a run -------------------------------------------------------------------------

    def run_files(self, files: DataFrame, batch_id: int) -> None:
        """A run over landed files (``feeds.landed_files``). What cannot be read goes to ``quarantine``."""
        files = cut_lineage(files, "landed-files")
        found = {r["source"] for r in files.filter(F.col("source").isin(list(feeds.REGISTRY))).select("source").distinct().collect()}
        strange = files.filter(~F.col("source").isin(list(feeds.REGISTRY))).select(
            "source", F.lit(None).cast("string").alias("key"), "file", F.col("body").alias("payload"))
        if not found:
            self.store.write(strange, "quarantine", batch_id)
            return
        postings, bad = feeds.split_sources({name: feeds.of_source(files, name) for name in sorted(found)})
        self.store.write(bad.unionByName(strange), "quarantine", batch_id)
        # pulls sort by time, so the order of files is that of arrival, in one batch or in many
        seq = F.struct("arrival.payload", "arrival.source_rank", "arrival.pos")
        landed = files.agg(F.max("landed_at").alias("at")).first()["at"]
        self.run_batch(postings.withColumns({"seq": seq, "created_at": F.lit(landed)}).drop("arrival"), batch_id)

    def run_batch(self, postings: DataFrame, batch_id: int) -> None:
        """A run over normalised postings."""
        judged = cut_lineage(filter_reasons(feeds.with_start(postings), self.profile), "judged")
        passing = with_keys(judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
        new = dedup_insert(passing, self.keys.known_to(passing, batch_id), self.dead_keys.known_to(passing, batch_id))
        # the alerts of a batch are written with it, so its rows are stored as notified
        self.store.write(new.withColumns({"id": F.col("dedup_key"), "notified": F.lit(True)}).select(*STATE_COLUMNS), "state", batch_id)

        added = self.store.read_batch("state", batch_id)
        self.keys.append(added, batch_id)
        outbox, _ = stored.alert_outbox(added.withColumn("notified", F.lit(False)), self.channel, self.dashboard_url)
        self.store.write(outbox, "outbox", batch_id)
        scored = self._score(added, batch_id)
        self.store.write(stored.ingest_summary(judged, added, scored), "summary", batch_id)

    # --- scores ------------------------------------------------------------------------

    def add_candidates(self, candidates: DataFrame, batch_id: int) -> None:
        """Candidates (candidate_id, text) that batch ``batch_id``, which has not run yet, is the first to score."""
        self.store.write(candidates.select("candidate_id", "text"), "candidates", batch_id)

    def _known(self, before: int) -> DataFrame | None:
        """Candidates of the batches before ``before``, under this job's profile."""
        late = self.store.read("candidates", before)
        both = [df.select("candidate_id", "text") for df in (self.candidates, late) if df is not None]
        if not both:
            return None
        return (both[0] if len(both) == 1 else both[0].unionByName(both[1])).withColumn("profile_id", F.lit(self.profile.profile_id))

    def _score(self, added: DataFrame, batch_id: int) -> bool:
        """This batch's share of all (posting, candidate) pairs. Says whether there was any candidate to score."""
        postings = added.select(F.col("id").alias("posting_id"), "description", F.array(F.lit(self.profile.profile_id)).alias("profiles"))
        self.store.write(posting_features(postings), "features", batch_id)
        label = added.select(F.col("id").alias("posting_id"), jd_source_label(F.col("description"), "ingest").alias("jd_source"))
        self.store.write(label, "labels", batch_id)
        everyone = self._known(batch_id + 1)
        if everyone is None:
            return False
        parts = [(self.store.read_batch("features", batch_id), everyone)]
        earlier, late = self.store.read("features", batch_id), self.store.read("candidates")
        fresh = None if late is None else late.filter(F.col("batch") == batch_id).drop("batch")
        if earlier is not None and fresh is not None and not fresh.isEmpty():
            parts.append((self._alive(earlier.drop("batch"), "posting_id", batch_id),
                          fresh.withColumn("profile_id", F.lit(self.profile.profile_id))))
        labels = self.store.read("labels", batch_id + 1)
        scores, whole = None, None
        for features, candidates in parts:
            a = Analysis(features, candidates, fits_broadcast(candidates, "text"), lookups.STOP_WORDS)
            made = pair_scores(a).drop("profile_id")
            scores = made if scores is None else scores.unionByName(made)
            if self.details:
                done = assemble_analysis(a, labels.select("posting_id", "jd_source"))
                whole = done if whole is None else whole.unionByName(done)
        self.store.write(scores, "scores", batch_id)
        if whole is not None:
            self.store.write(whole.withColumn("analysis", analysis_json()), "analysis", batch_id)
        return True

    # --- what users do between runs -------------------------------------------------------

    def _alive(self, rows: DataFrame, key: str, before: int | None = None) -> DataFrame:
        dead = self.store.read("tombstones", before)
        return rows if dead is None else rows.join(dead.select(F.col("dedup_key").alias(key)).distinct(), key, "left_anti")

    def current(self, before: int | None = None) -> DataFrame:
        """The stored postings as users see them: without dismissed ones, changes applied."""
        return self._changed(self._alive(self.store.read("state", before), "dedup_key", before), before)

    def _changed(self, rows: DataFrame, before: int | None) -> DataFrame:
        """Changes apply to postings that were stored when they were made; an id that came later is no reason to wait."""
        changes = self.store.read("changes", before)
        if changes is None:
            return rows.drop("batch")
        born = rows.select("id", F.col("batch").alias("_born"))
        known = changes.join(born, "id").filter(F.col("batch") >= F.col("_born")).select("id", "field", "value", "ts", "change_seq")
        return stored.apply_changes(rows.drop("batch"), known)[0]

    def _bury(self, tombs: DataFrame, batch_id: int, request: str) -> None:
        self.store.write(tombs.select(*KEYS, "dismissed_at"), "tombstones", batch_id, request)
        self.dead_keys.append(self.store.read_batch("tombstones", batch_id), batch_id)

    def dismiss(self, ids: DataFrame, at: Column, batch_id: int, request: str = "dismiss") -> None:
        """The postings ``ids`` leave after batch ``batch_id``, the last one that has run; their keys stay blocked."""
        none = self.spark.createDataFrame([], "dedup_key string, content_key string, dismissed_at string")
        _, tombs = stored.dismiss(self._unless(batch_id, request), ids, none, at.cast("string"))
        self._bury(cut_lineage(tombs, "tombstones"), batch_id, request)

    def prune(self, profile: FilterProfile, at: Column, batch_id: int, request: str = "prune") -> DataFrame:
        """F8: stored postings that fail ``profile`` leave after batch ``batch_id``; which ones: title, company."""
        _, gone = prune(self._unless(batch_id, request), profile, at.cast("string"))
        gone = cut_lineage(gone, "pruned")
        self._bury(gone, batch_id, request)
        return gone.select("title", "company")

    def _unless(self, batch_id: int, request: str) -> DataFrame:
        """The current postings as if ``request`` had not been made yet, so that repeating it gives the same."""
        rows = self.store.read("state", batch_id + 1)
        dead = self.store.read("tombstones", batch_id + 1)
        if dead is not None:
            other = dead.filter(~((F.col("batch") == batch_id) & (F.col("request") == request)))
            rows = rows.join(other.select("dedup_key").distinct(), "dedup_key", "left_anti")
        return self._changed(rows, batch_id + 1)

    def change(self, changes: DataFrame, batch_id: int, request: str = "change") -> None:
        """D3: stores valid changes (id, field, value, ts, change_seq) of after batch ``batch_id``; others go to ``refused``."""
        good, bad = stored.split_changes(changes.select("id", "field", "value", "ts", "change_seq"))
        self.store.write(good, "changes", batch_id, request)
        self.store.write(bad, "refused", batch_id, request)

    def listing(self, status: str = "all", order: str = "score") -> DataFrame:
        """D4 over the scored state: the current postings, once for each candidate they are scored for."""
        scores = self.store.read("scores")
        rows = self.current()
        if scores is None:
            rows = rows.withColumns({"candidate_id": F.lit(None).cast("long"), "ats_score": F.lit(None).cast("double")})
        else:
            rows = rows.join(scores.select(F.col("posting_id").alias("id"), "candidate_id", "ats_score", "match_rate"), "id", "left")
        return stored.list_postings(rows, status, order)


def stream_ingest(job: IngestJob, postings: DataFrame, interval: str | None = None) -> StreamingQuery:
    """T1 over postings that are ready. Without ``interval`` the stream takes all landed data and stops."""
    return _started(job, postings, job.run_batch, interval)


def stream_payloads(job: IngestJob, root: str, interval: str | None = None) -> StreamingQuery:
    """T1 over raw payload files as they land below ``root`` (see ``feeds.landed_files``)."""
    feeds.list_in_few_tasks(job.spark)
    return _started(job, feeds.landed_files(job.spark, root, stream=True), job.run_files, interval)


def _started(job: IngestJob, source: DataFrame, run, interval: str | None) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(lambda df, batch_id: run(df, batch_id)).option(
        "checkpointLocation", f"{job.state_dir}/progress")
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
