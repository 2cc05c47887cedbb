"""The stored state: payload files, key index, increments of scores, requests, replays."""
import pytest
from pyspark.sql import functions as F

from postloom.operators import dedup
from postloom.operators.analysis import Analysis, pair_scores, posting_features
from postloom.operators.filters import FilterProfile
from postloom.operators.scale import fits_broadcast
from postloom import lookups
from postloom.plans import catalog, overlay
from postloom.session import scratch_path
from postloom.sources import feeds
from postloom.streaming.ingest import IngestJob, stream_payloads
from postloom.streaming.keys import KeyIndex
from postloom.streaming.store import Store


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


KEY = ("dedup_key", "content_key", "title", "source")


def test_payload_runs_equal_one_run(spark, sf):
    root = scratch_path(spark, "pulls")
    for run in range(2):
        overlay.land(overlay.postings(spark, sf), root, 2, run)
    many = IngestJob(spark, scratch_path(spark, "many"), overlay.PROFILE["A"])
    files = feeds.landed_files(spark, root)
    for run in range(2):
        many.run_files(files.filter(F.col("file").startswith(f"pull={run}/")), run)
    once = IngestJob(spark, scratch_path(spark, "once"), overlay.PROFILE["A"])
    stream_payloads(once, root).awaitTermination()
    assert rows(many.read("state"), *KEY) == rows(once.read("state"), *KEY) != []
    assert rows(many.read("quarantine"), "source", "key", "payload") == rows(once.read("quarantine"), "source", "key", "payload") != []
    # a repeated run replaces itself
    before = rows(many.read("state"), *KEY, "batch")
    many.run_files(files.filter(F.col("file").startswith("pull=1/")), 1)
    assert rows(many.read("state"), *KEY, "batch") == before


def test_landed_layout(spark, tmp_path):
    for path, body in {"2026-01/greenhouse/acme/a.json": '{"jobs": [{"id": 1, "title": "T"}]}', "2026-01/tracker_table/org/list/main/lists/2027.md": "| Company | Role | Location |\n|---|---|---|\n| A | B | C |",
                       "2026-01/tracker_table/org/list/main/README.md": "prose", "2026-02/tracker_feed/org/feed/x.json": '[{"company_name": "F", "title": "T", "active": true, "is_visible": true}]',
                       "2026-02/unknown/x/y.json": "{}", "2026-02/lever/acme/b.json": "{oops"}.items():
        file = tmp_path / "land" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)
    files = feeds.landed_files(spark, str(tmp_path / "land"))
    assert rows(feeds.of_source(files, "tracker_table"), "repo", "branch", "path") == sorted([("org/list", "main", "lists/2027.md"), ("org/list", "main", None)], key=repr)
    job = IngestJob(spark, scratch_path(spark, "layout"), FilterProfile("all", blocked_types=[]))
    job.run_files(files, 0)
    assert rows(job.read("state"), "source", "title", "company") == [("github_repo", "B", "A"), ("github_repo", "T", "F"), ("greenhouse", "T", "acme")]
    assert [r[0] for r in rows(job.read("quarantine"), "source", "key")] == ["lever", "tracker_table", "unknown"]
    job.run_files(files.filter("source = 'unknown'"), 1)
    assert job.read("quarantine").count() == 4 and job.read("state").count() == 3


def test_split_sources_parses_a_payload_once(spark, sf):
    raw = overlay.greenhouse_payloads(overlay.postings(spark, sf))
    good, bad = feeds.split_sources({"greenhouse": raw.unionByName(spark.createDataFrame([("x", None), ("y", "{"), ("z", "{}")], "slug string, payload string"))})
    plan = good._jdf.queryExecution().optimizedPlan().toString() + bad._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "JsonToStructs" not in plan and "parsed-greenhouse" in "".join(good.inputFiles())
    assert rows(bad, "key", "payload") == [("x", ""), ("y", "{"), ("z", "{}")] and good.count() == raw.count() * 0 + overlay.postings(spark, sf).count()


def test_key_index_meets_a_small_batch_without_a_shuffle_of_the_state(spark):
    store = Store(spark, scratch_path(spark, "index"))
    index = KeyIndex(spark, store, "keys")
    held = spark.range(5000).selectExpr("concat('d', id) as dedup_key", "concat('c', id) as content_key")
    index.append(held.filter("substr(dedup_key, 2) < '3'"), 0)
    index.append(held.filter("substr(dedup_key, 2) >= '3'"), 1)
    index.append(held.filter("substr(dedup_key, 2) >= '3'"), 1)
    batch = spark.createDataFrame([("d7", "x"), ("y", "c2900"), ("d4999", "c1"), ("z", "z"), (None, None)], "dedup_key string, content_key string")
    assert rows(index.known_to(batch, 2), *dedup.KEYS) == sorted([("d7", None), ("d4999", None), (None, "c1"), (None, "c2900")], key=repr)
    assert rows(index.known_to(batch, 1), *dedup.KEYS) == sorted([(None, "c1"), (None, "c2900")], key=repr)
    large = KeyIndex(spark, store, "keys", broadcast_keys=0)
    assert rows(large.known_to(batch, 2), *dedup.KEYS) == rows(index.known_to(batch, 2), *dedup.KEYS)
    plan = index.held(batch, "dedup_key", 2)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "BroadcastHashJoin" in line)
    assert "LeftSemi, BuildRight" in plan[at]
    # the left side goes from its files into the join; above it only the few keys found are shuffled
    depth = plan[at].index("+- BroadcastHashJoin") + 3
    left = [line for line in plan[at + 1:] if line[depth:depth + 1] == ":"]
    assert any("FileScan" in line for line in left) and not any("+- Exchange" in line or ":- Exchange" in line for line in left if "ubquery" not in line)
    assert sum("Exchange" in line for line in plan[:at]) <= 1
    assert KeyIndex(spark, Store(spark, scratch_path(spark, "none")), "keys").known_to(batch, 5) is None


@pytest.fixture(scope="module")
def scored(spark, sf):
    mine = overlay.candidates(spark, sf).filter("profile_id = 'A'")
    job = IngestJob(spark, scratch_path(spark, "scored"), overlay.PROFILE["A"], candidates=mine.filter("candidate_id % 8 = 0"), channel="slack")
    posts = overlay.postings(spark, sf).drop("batch_id")
    job.run_batch(posts.filter("seq < 120"), 0)
    job.add_candidates(mine.filter("candidate_id % 8 = 4"), 1)
    job.run_batch(posts.filter("seq >= 120"), 1)
    return job, posts, mine


def test_increments_equal_a_full_recomputation(spark, scored):
    job, posts, mine = scored
    wanted = job.read("state").select(F.col("id").alias("posting_id"), "description", F.array(F.lit("A")).alias("profiles"))
    whole = pair_scores(Analysis(posting_features(wanted), mine, fits_broadcast(mine, "text"), lookups.STOP_WORDS))
    digits = lambda df: rows(df.withColumn("s", F.round("ats_score", 9)), "posting_id", "candidate_id", "s", "matched")
    assert digits(job.read("scores")) == digits(whole) != []
    made = job.read("analysis")
    assert made.count() == whole.count() and made.filter("get_json_object(analysis, '$.jd_source') in ('full posting', 'listing summary')").count() == whole.count()
    assert job.listing().count() == whole.count() and job.listing().filter("notified").count() == whole.count()
    best = [r["ats_score"] for r in job.listing().collect()]
    assert best == sorted(best, reverse=True)


def test_a_repeated_run_changes_nothing(spark, scored):
    job, posts, _ = scored
    tables = {"state": ("id", "seq", "batch"), "scores": ("posting_id", "candidate_id", "batch"), "outbox": ("id", "batch"), "summary": ("source", "inserted", "batch")}
    before = {t: rows(job.read(t), *c) for t, c in tables.items()}
    job.dismiss(job.read("state").filter("seq < 120").limit(2).select("id"), F.lit("2026-06-02"), 1)
    job.run_batch(posts.filter("seq >= 120"), 1)     # a request made after the run has no part in its repetition
    assert {t: rows(job.read(t), *c) for t, c in tables.items()} == before
    assert job.current().count() == len(before["state"]) - 2
    # what was dismissed does not come back, under either key
    gone = job.read("tombstones")
    again = posts.join(dedup.with_keys(posts).join(gone.select("dedup_key"), "dedup_key", "left_semi").select("seq"), "seq", "left_semi")
    job.run_batch(again.withColumn("company", F.concat("company", F.lit(" x"))), 2)
    assert job.store.read_batch("state", 2).count() == 0


def test_requests_are_stored(spark, sf):
    job = IngestJob(spark, scratch_path(spark, "requests"), overlay.PROFILE["C"], details=False)
    posts = overlay.postings(spark, sf).drop("batch_id")
    job.run_batch(posts.filter("seq < 100"), 0)
    n = job.current().count()
    strict = overlay.PROFILE["A"]
    first = rows(job.prune(strict, F.lit("2026-06-03"), 0), "title", "company")
    assert first and rows(job.prune(strict, F.lit("2026-06-03"), 0), "title", "company") == first and job.current().count() == n - len(first)
    ids = [r["id"] for r in job.current().orderBy("seq").limit(3).collect()]
    log = [(ids[0], "status", "applied", 1, 1), (ids[0], "status", "offer", 2, 2), (ids[1], "status", "nonsense", 3, 3), (ids[2], "description", " new ", 1, 4),
           ("later", "status", "offer", 9, 9)]
    table = spark.createDataFrame(log, "id string, field string, value string, ts long, change_seq long").withColumn("ts", F.timestamp_seconds("ts"))
    for _ in range(2):
        job.change(table, 0)
    got = {r["id"]: r for r in job.current().collect()}
    assert got[ids[0]]["status"] == "offer" and got[ids[1]]["status"] == "to_apply" and got[ids[2]]["description"] == "new"
    assert rows(job.read("refused"), "id", "value") == [(ids[1], "nonsense")]
    # a change made before a posting came does not reach it
    late = dedup.with_keys(posts.filter("seq >= 100")).select("dedup_key").first()["dedup_key"]
    job.change(spark.createDataFrame([(late, "status", "offer", 1, 1)], "id string, field string, value string, ts long, change_seq long").withColumn("ts", F.timestamp_seconds("ts")), 0, "early")
    job.run_batch(posts.filter("seq >= 100"), 1)
    assert {r["status"] for r in job.current().filter(F.col("id") == late).collect()} <= {"to_apply"}
    assert job.listing().filter("ats_score is not null").count() == 0


def test_relanded_rows_settle_the_same_way(spark):
    rows_ = [("greenhouse", "1", "T", "c", "p", 1, d) for d in ("one", "two", "three")]
    names = "source string, source_job_id string, title string, company string, location string, seq long, description string"
    got = {dedup.dedup_insert(spark.createDataFrame(rows_[k:] + rows_[:k], names).repartition(3)).first()["description"] for k in range(3)}
    assert len(got) == 1


def test_listing_takes_a_few_tasks_a_core(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        feeds.list_in_few_tasks(spark)
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
        spark.conf.set(name, "3")       # what a session has set lower stays
        feeds.list_in_few_tasks(spark)
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.set(name, before)
