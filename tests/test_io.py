"""Sources, enrichment, documents and the stream."""
import json

import pytest
from pyspark.sql import functions as F

from postloom.operators import dedup, enrich, prompts
from postloom.plans import catalog, overlay
from postloom.session import scratch_path
from postloom.sources import boards, feeds, trackers
from postloom.streaming.ingest import IngestJob


def payload(spark, body, key="slug", name="acme"):
    return spark.createDataFrame([(name, body if isinstance(body, str) else json.dumps(body))], f"{key} string, payload string")


def test_null_fields_and_bad_payloads(spark):
    raw = payload(spark, {"jobs": [{"id": 5, "title": None, "location": None, "content": None, "extra": 1}]})
    row = boards.normalize_greenhouse(raw).first()
    assert (row.source_job_id, row.title, row.location, row.remote, row.description, row.posted_at) == ("5", "", "", False, "", None)
    bad = raw.unionByName(payload(spark, "{oops", name="x"))
    assert boards.normalize_greenhouse(bad).count() == 1
    assert [r.slug for r in boards.quarantine(bad, boards.GREENHOUSE, "jobs").collect()] == ["x"]


def test_lever_joins_location_and_commitment(spark):
    raw = payload(spark, [{"id": "a", "text": "T", "categories": {"location": "re", "commitment": "Mote"}, "descriptionPlain": "", "description": "<b>x</b>"}])
    row = boards.normalize_lever(raw).first()
    assert row.remote is True and row.description == "x" and row.posted_at is None


def test_ashby_fallbacks(spark):
    raw = payload(spark, {"jobs": [{"id": "", "jobId": None, "title": "T", "jobUrl": "", "applyUrl": "u", "descriptionHtml": "", "descriptionPlain": "a <b>"}]})
    row = boards.normalize_ashby(raw).first()
    assert (row.source_job_id, row.url, row.description) == ("T", "u", "a")


def test_feed_keeps_order_at_the_cap(spark):
    items = [{"company_name": c, "title": "T", "active": True, "is_visible": c != "x", "date_posted": d}
             for c, d in [("a", 5), ("b", 9), ("c", 5), ("x", 99), ("d", 5), ("e", None)]]
    rows = trackers.normalize_tracker_feed(payload(spark, items, "repo", "o/r"), 3).collect()
    assert [r.company for r in rows] == ["b", "a", "c"]
    assert rows[0].source_job_id == "o/r:b:T" and rows[0].url == "https://github.com/o/r" and rows[0].posted_at == "1970-01-01"


MARKDOWN = """# x
| Role | Company | Location |
| ---- | ------- | ---- |
| **Dev** | [Acme](http://a) | NYC<br>LA |

| Company | Role | Link |
| --- | :---: | --- |
| ↳ | Dev 2029 | <a HREF="http://u">go</a> |
|| Ghost | Dev | x |
| Solo | | x |
| » | Ops | [go](http://v) |
not a row
| plain | rows | without header |
"""


def test_markdown_rules(spark):
    raw = spark.createDataFrame([("o/r-2027", None, "main", MARKDOWN)], "repo string, path string, branch string, markdown string")
    rows = trackers.parse_tracker_table(raw).collect()
    got = [(r.company, r.title, r.location, r.url, r.start_year) for r in rows]
    assert got == [
        ("-------", "----", "----", "https://github.com/o/r-2027", 2027),     # a four-dash rule is data
        ("Acme", "Dev", "NYC LA", "http://a", 2027),
        ("Acme", "Dev 2029", "", "http://u", 2029),      # company carried over prose and a new table
        ("Ghost", "Dev", "", "https://github.com/o/r-2027", 2027),
        ("Solo", "Ops", "", "http://v", 2027),           # a row without a role still names the company
    ]
    assert len(trackers.parse_tracker_table(raw, 2).collect()) == 2


def test_candidates_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "b.md").write_text("# b")
    (tmp_path / "c.pdf").write_text("no")
    rows = {r.candidate_id: r.text for r in feeds.read_candidates(spark, str(tmp_path)).collect()}
    assert rows == {"a": "café  ok", "b": "# b"}


def test_payloads_from_files(spark, tmp_path):
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "1.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "T"}]}))
    row = feeds.union_sources({"greenhouse": feeds.read_payloads(spark, str(tmp_path))}).first()
    assert (row.company, row.source_job_id) == ("acme", "1")
    with pytest.raises(ValueError):
        feeds.union_sources({"unknown": row})


def test_arrival_orders_insertion(spark):
    """Sources arrive in a fixed order; the order column may be a struct, so no global numbering is needed."""
    job = {"id": 1, "title": "T", "location": {"name": "X"}}
    raw = {"lever": payload(spark, [{"id": "z", "text": "T", "categories": {"location": "X"}}]),
           "greenhouse": payload(spark, {"jobs": [job, job]})}
    posts = dedup.with_keys(feeds.with_start(feeds.union_sources(raw))).withColumnRenamed("arrival", "seq")
    rows = dedup.dedup_insert(posts).collect()
    assert [(r.source, r.seq.pos) for r in rows] == [("greenhouse", 0)]


@pytest.mark.parametrize("blocks, expected", [
    (["{bad", '{"@type": ["Thing", "JobPosting"], "description": "d1"}'], "d1"),
    (['{"@graph": [{"@type": "Organization", "description": "no"}, {"@type": "JobPosting", "description": "d2"}]}'], "d2"),
    (['[{"@type": "JobPosting", "description": ""}, {"@type": "JobPosting", "description": "d3"}]'], "d3"),
    (['{"@type": "Person", "description": "x"}', "5"], None),
])
def test_embedded_data(spark, blocks, expected):
    page = "<html>" + "".join(f'<SCRIPT type="application/ld+json"> {b} </script>' for b in blocks)
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(enrich.embedded_description(F.col("html")).alias("d")).first().d == expected


@pytest.mark.parametrize("url, key", [
    ("https://boards.greenhouse.io/acme/jobs/12?x=1", ("greenhouse", "acme", "12")),
    ("https://acme.greenhouse.io/jobs/12", ("greenhouse", "acme", "12")),
    ("https://boards-api.greenhouse.io/v1/boards/acme/jobs/12", ("greenhouse", "v1", "12")),
    ("https://boards.greenhouse.io/embed/job_app?for=acme&x=/jobs/7", ("greenhouse", "acme&x=", "7")),
    ("https://jobs.lever.co/acme/0123abcd-0000-4000-8000-000000000000/apply", ("lever", "acme", "0123abcd-0000-4000-8000-000000000000")),
    ("https://example.com/jobs/1", None), ("", None),
])
def test_board_links(spark, url, key):
    got = spark.createDataFrame([(url,)], "u string").select(enrich.board_url_keys(F.col("u")).alias("k")).first().k
    assert (tuple(got) if got else None) == key


def test_prompt_cuts_bullets(spark):
    bullet = "b" * 100
    spots = [(i, bullet, 0.5) for i in range(3)]
    missing = [(f"k{i:02d}", 1.0, i == 0, "required", spots if i == 0 else []) for i in range(25)]
    a = spark.createDataFrame([(1, 1, 42.5, ["x"], missing)],
                              "posting_id int, candidate_id int, score double, matched_keywords array<string>, "
                              "missing_keywords array<struct<keyword:string,importance:double,in_requirements:boolean,section:string,"
                              "spots:array<struct<bullet_index:bigint,bullet:string,similarity:double>>>>")
    posts = spark.createDataFrame([(1, "T", "C", " body ")], "posting_id int, title string, company string, description string")
    text = prompts.tailoring_prompts(a, posts).first().prompt
    near = f'"{bullet[:90]}"; "{bullet[:90]}"'
    assert f"- k00 -> nearest bullets: {near}\n" in text and "ATS match score (my tool): 42%" in text and "MY RESUME" not in text
    block = prompts.gap_block(a).first().gap_block.split("\n")
    assert len(block) == 20 and block[0] == f"- k00 [required]  (nearest bullets: {bullet[:80]}; {bullet[:80]})" and block[1] == "- k01"


def test_stream_equals_one_batch_and_survives_reruns(spark, sf):
    job = catalog._streamed(spark, sf, "slack")
    state = job.read("state")
    got = {r.seq for r in state.collect()}
    one = IngestJob(spark, scratch_path(spark, "one"), overlay.PROFILE["A"])
    one.run_batch(overlay.postings(spark, sf).drop("batch_id"), 0)
    assert got == {r.seq for r in one.read("state").collect()} and got
    assert job.read("outbox").count() == len(got)
    # a second start over the same folder finds nothing new, and a repeated batch changes nothing
    last = max(r.batch for r in state.select("batch").distinct().collect())
    before = {tuple(r) for r in job.read("state", last).collect()}
    job.run_batch(overlay.postings(spark, sf).drop("batch_id"), last + 1)
    assert job.read("state").count() == len(got) and {tuple(r) for r in job.read("state", last).collect()} == before


def test_stream_analyses_new_rows(spark, sf):
    job = IngestJob(spark, scratch_path(spark, "analysed"), overlay.PROFILE["A"], candidates=overlay.candidates(spark, sf).limit(1).drop("profile_id"))
    job.run_batch(overlay.postings(spark, sf).drop("batch_id"), 0)
    done = job.read("analysis")
    assert done.count() == job.read("state").count() and done.filter("jd_source not in ('full posting', 'listing summary')").count() == 0
