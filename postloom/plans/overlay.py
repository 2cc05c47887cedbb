"""Test inputs: turns the given tables into postings, candidates and payloads.

All formulas are arithmetic on ids, so an SQL engine can restate them. Every frame
grows with its table; nothing here is sampled or capped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.filters import FilterProfile
from postloom.operators.scale import spread

TITLES = [
    "Data Analyst", "Finance Associate", "Senior Data Analyst", "Software Engineer", "Finance Intern",
    "Lead Analyst", "Junior Finance Analyst", "Engineering Manager", "Analyst, New Grad",
    "Analyst II (Contract)", "Leading Analyst", "Part-time Finance Clerk",
]
PLACES = [
    "New York, NY", "Toronto, ON", "Remote", "Remote - Canada", "Berlin, DE", "London, UK",
    "Bangalore, India", "Warsaw, Poland", "", "Paris", "Indiana", "Singapore", "Mexico City, Mexico",
    "Austin, TX (Hybrid)",
]
STARTS = [
    "starts on May 2027", "Summer 2026 start", "Start date: early 2028", "class of 2027", "",
    "begins in 2026", "Fall 2027 or January 2028", "graduating in 2026", "the year 2029",
]
SKILLS = [
    "Python", "K8s", "REST API", "Spring Boot", "C++", "C#", ".NET", "Go", "R", "PostgreSQL", "Postgres",
    "CI/CD", "Machine Learning", "React Native", "Node.js", "Ruby on Rails", "AWS", "scikit-learn",
    "Kafka", "SQL",
]
TYPOS = ["kubernets", "postgresq", "pyhon", "sprng", "node.j", "Python"]
SOURCES = ["greenhouse", "lever", "ashby", "github_repo", "adzuna"]
ROWS_PER_PAYLOAD = 100     # postings that share one landed payload file

PROFILES = [
    FilterProfile(
        "A", role_keywords=["analyst", "finance"], exclude_title_terms=["intern", "part-time"],
        blocked_types=[], allowed_countries=["Canada", "India", "United Kingdom", "United States"],
        blocked_countries=["Poland", "Singapore", "United Kingdom"], earliest_start="2027-05-01"),
    FilterProfile(
        "B", role_keywords=["analyst", "finance", "engineer"],
        exclude_title_terms=["senior", "lead", "manager", "ii"], require_entry_level=True,
        entry_signals=["new grad", "graduate", "junior", "associate", "campus"],
        blocked_types=["intern", "contract", "part-time"], remote_ok=False,
        allowed_countries=["United States", "Canada"], blocked_countries=["India"],
        allow_unknown_locations=False, earliest_start="2028-01-01"),
    FilterProfile("C", blocked_types=[], blocked_countries=["Mexico"], earliest_start="soon"),
    FilterProfile(
        "D", role_keywords=["analyst", "finance"], title_only=False, remote_ok=False,
        allowed_countries=["United States"], allowed_locations=["toronto"], earliest_start="2027-05-01"),
]
PROFILE = {p.profile_id: p for p in PROFILES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({quoted}), cast({index} as int) + 1)"


def postings(spark: SparkSession, sf_dir: str, all_cores: bool = False) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = (spread(documents, "doc_id") if all_cores else documents).selectExpr(
        "doc_id as i", "text",
        "case when doc_id % 19 = 18 and doc_id >= 60 then doc_id - 60 else doc_id end as b",
        "case when doc_id % 17 = 16 then doc_id - 5 else doc_id end as native")
    placed = base.withColumn("location", F.expr(_pick(PLACES, "(b div 12) % 14")))
    return placed.selectExpr(
        "i as seq",
        f"{_pick(SOURCES, 'i % 5')} as source",
        "cast(native as string) as source_job_id",
        f"{_pick(TITLES, 'b % 12')} as title",
        "concat('company_', b) as company",
        "case when i % 7 = 0 then '' else concat('https://jobs.example.com/', i) end as url",
        "location",
        "contains(lower(location), 'remote') or i % 23 = 0 as remote",
        f"""concat(text, '\\n',
                   case when i % 4 = 0 then 'CRM tooling and CRM reporting for CRM users.\\n' else '' end,
                   'Requirements:\\n- ', {_pick(SKILLS, 'i % 20')}, ', ', {_pick(SKILLS, '(i * 7 + 3) % 20')}, '.\\n',
                   'Nice to have: ', {_pick(SKILLS, '(i * 3 + 11) % 20')}, '.\\n',
                   'Benefits:\\n', {_pick(STARTS, '(i div 7) % 9')}, '\\n') as description""",
        "date_format(date_add(date'2026-01-01', cast(i % 180 as int)), 'yyyy-MM-dd') as posted_at",
        "cast(null as int) as start_year", "cast(null as string) as start_date",
        "timestamp_seconds(1780272000 + i) as created_at",
        "i div 250 as batch_id",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id as candidate_id",
        f"{_pick([p.profile_id for p in PROFILES], 'item_id % 4')} as profile_id",
        f"""concat('CANDIDATE ', item_id, '\\n\\nSUMMARY\\n', text, '\\n\\nSKILLS\\n',
                   {_pick(SKILLS, 'item_id % 20')}, ', ', {_pick(SKILLS, '(item_id * 3 + 1) % 20')}, ', ',
                   {_pick(SKILLS, '(item_id * 11 + 6) % 20')}, '\\n- Built services with ',
                   {_pick(TYPOS, 'item_id % 6')}, ' for internal platform users.\\n- Wrote ',
                   {_pick(SKILLS, '(item_id * 7 + 2) % 20')}, ' pipelines and reporting jobs over daily logs.\\n',
                   case when item_id % 3 = 0 then '- Owned the migration of a legacy CRM.\\n' else '' end,
                   case when item_id % 4 = 0 then '- Shipped reactive dashboards for finance teams.\\n' else '' end
            ) as text""")


def tombstones(posts: DataFrame) -> DataFrame:
    """Dismissed keys: the native key of some rows, the content key of others."""
    by_native = posts.filter("seq % 41 = 0").selectExpr("dedup_key", "cast(null as string) as content_key")
    by_content = posts.filter("seq % 43 = 0").selectExpr("cast(null as string) as dedup_key", "content_key")
    return by_native.unionByName(by_content)


def changes(spark: SparkSession, sf_dir: str, n_docs: int, posts: DataFrame) -> DataFrame:
    """The event table as a change log on postings, in (ts, event_id) order."""
    log = table(spark, sf_dir, "events").selectExpr(
        "event_id as change_seq", "ts", f"user_id % {n_docs} as seq",
        "case event_type when 'signup' then 'description' else 'status' end as field",
        """case event_type when 'click' then 'applied' when 'view' then 'interviewing'
             when 'purchase' then 'offer' when 'signup' then concat('  patched ', event_id, ' ')
             else 'bogus' end as value""")
    return log.join(posts.select("seq", "dedup_key"), "seq").selectExpr(
        "dedup_key as id", "change_seq", "ts", "field", "value")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages, every third with an embedded structured-data block."""
    raw = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    bare = raw.selectExpr(
        "page_id", "html",
        "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[^A-Za-z0-9.]+', ' ')) as words")
    described = bare.selectExpr(
        "page_id", "html",
        """concat('<p>Research &amp; growth &lt;now&gt; ',
                  words, '</p>') as body""")
    node = "concat('{\"@type\": [\"Thing\", \"JobPosting\"], \"description\": \"', body, '\"}')"
    other = "'{\"@type\": \"Organization\", \"description\": \"not a posting\"}'"
    block = described.selectExpr(
        "page_id", "html",
        f"""case when page_id % 9 = 0 then {node}
                 when page_id % 9 = 3 then concat('{{\"@graph\": [', {other}, ', ', {node}, ']}}')
                 when page_id % 9 = 6 then concat('[', {other}, ', ', {node}, ']') end as block""")
    return block.selectExpr(
        "page_id", "concat('https://jobs.example.com/', page_id) as url",
        """case when block is null then html
                else concat(
                  case when contains(html, '</body>') then substr(html, 1, locate('</body>', html) - 1) else html end,
                  case when page_id % 27 = 0 then '<script type="application/ld+json">{broken</script>' else '' end,
                  '<script type="application/ld+json">', block, '</script>',
                  case when contains(html, '</body>') then substr(html, locate('</body>', html)) else '' end) end as html""")


# --- landed payloads ----------------------------------------------------------

def _payload(posts: DataFrame, key: str, item: str, wrap: str | None) -> DataFrame:
    """One payload row per ``key``; at most ROWS_PER_PAYLOAD postings share one."""
    grouped = posts.selectExpr(f"{key} as key", "seq", f"{item} as item").groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda s: s["item"]).alias("items"))
    body = F.to_json(F.struct(F.col("items").alias(wrap))) if wrap else F.to_json("items")
    return grouped.select("key", body.alias("payload"))


_SLUG = f"concat('board_', seq div {ROWS_PER_PAYLOAD})"
_HTML = "concat('<p>', replace(description, '\\n', '</p><p>'), '</p> R&amp;amp;D &amp;lt;b&amp;gt;&nbsp;it&#39;s')"


def greenhouse_payloads(posts: DataFrame) -> DataFrame:
    return _payload(posts, _SLUG, f"""named_struct(
        'id', cast(source_job_id as bigint), 'title', title,
        'location', case when location = '' then null else named_struct('name', location) end,
        'absolute_url', url, 'content', {_HTML},
        'updated_at', case when seq % 4 = 0 then '' else concat(posted_at, 'T10:00:00-04:00') end)""",
        "jobs").withColumnRenamed("key", "slug")


def lever_payloads(posts: DataFrame) -> DataFrame:
    return _payload(posts, _SLUG, f"""named_struct(
        'id', source_job_id, 'text', title,
        'categories', named_struct('location', location, 'commitment', case when seq % 3 = 0 then 'Remote' else 'Full-time' end),
        'descriptionPlain', case when seq % 2 = 0 then description else '' end,
        'description', {_HTML}, 'hostedUrl', url)""", None).withColumnRenamed("key", "slug")


def ashby_payloads(posts: DataFrame) -> DataFrame:
    return _payload(posts, _SLUG, f"""named_struct(
        'id', case when seq % 3 = 0 then '' else source_job_id end,
        'jobId', case when seq % 3 = 0 and seq % 2 = 0 then concat('job-', source_job_id) end,
        'title', title, 'location', case when location <> '' then location end,
        'isRemote', seq % 23 = 0, 'jobUrl', url, 'applyUrl', concat('https://apply.example.com/', seq),
        'descriptionHtml', case when seq % 2 = 0 then {_HTML} end, 'descriptionPlain', description,
        'publishedAt', concat(posted_at, 'T00:00:00Z'))""", "jobs").withColumnRenamed("key", "slug")


def adzuna_payloads(posts: DataFrame, keyed: bool = False) -> DataFrame:
    made = _payload(posts, _SLUG, """named_struct(
        'id', case when seq % 9 <> 0 then source_job_id end, 'title', title,
        'company', named_struct('display_name', company), 'location', named_struct('display_name', location),
        'redirect_url', url, 'description', description, 'created', concat(posted_at, 'T00:00:00Z'))""",
        "results")
    return made.withColumnRenamed("key", "slug") if keyed else made.select("payload")


def land(posts: DataFrame, root: str, runs: int, run: int) -> None:
    """Write the postings of one of ``runs`` pulls as payload files, each posting in its own source's format.

    Every third board has an unreadable payload beside it. One folder a payload: pull=…/source=…/slug=….
    """
    last = posts.agg(F.max("batch_id").alias("b")).first()["b"]
    due = posts.filter(F.floor(F.col("batch_id") * runs / F.lit(last + 1)) == run)
    shapes = {"greenhouse": greenhouse_payloads, "lever": lever_payloads, "ashby": ashby_payloads,
              "github_repo": lambda p: tracker_payloads(p).withColumnRenamed("repo", "slug"),
              "adzuna": lambda p: adzuna_payloads(p, keyed=True)}
    files = None
    for source, shape in shapes.items():
        body = shape(due.filter(F.col("source") == source)).select(
            F.lit("tracker_feed" if source == "github_repo" else source).alias("source"), "slug", F.col("payload").alias("value"))
        broken = body.filter("cast(substring_index(slug, '_', -1) as int) % 3 = 1").select(
            "source", F.concat(F.lit("broken_"), "slug").alias("slug"), F.concat(F.lit("{broken "), "slug").alias("value"))
        part = body.unionByName(broken)
        files = part if files is None else files.unionByName(part)
    files = files.withColumn("pull", F.lit(run)).repartition("source", "slug")
    # tasks move their own files into place; otherwise the driver moves all of them, one after the other
    files.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
        "pull", "source", "slug").text(root)


def tracker_payloads(posts: DataFrame) -> DataFrame:
    """Feeds of 100 listings each; ties in the posting date are frequent on purpose."""
    return _payload(posts, "concat('org/list_', seq div 100)", """named_struct(
        'id', case when seq % 6 <> 0 then source_job_id end, 'company_name', company, 'title', title,
        'locations', case when location = '' then array() else array(location, 'Hybrid') end,
        'url', url, 'active', seq % 10 <> 3, 'is_visible', seq % 11 <> 4,
        'date_posted', case when seq % 13 <> 0 then 1767225600 + (seq % 8) * 86400 end,
        'category', 'Data', 'sponsorship', 'Other', 'degrees', array('BS', 'MS'))""",
        None).withColumnRenamed("key", "repo")


def tracker_documents(posts: DataFrame) -> DataFrame:
    """Markdown lists of 50 rows each, with the irregularities real lists have."""
    row = """concat(
        case when seq % 25 = 7 then '\\nSome prose between tables.\\n\\n| Role | Company | Date Posted | Application |\\n| --- | --- | --- | --- |\\n' else '' end,
        case when seq % 50 >= 7
             then concat('| ', title, ' | ', case when seq % 4 = 1 then '->' else concat('*', company, '*') end,
                         ' | ', case when seq % 3 = 0 then 'May 2027' else 'Jan 05' end,
                         ' | <a href="', url, '">Apply</a> |')
             else concat('| ', case when seq % 5 = 2 then '↳' when seq % 5 = 3 then concat('[', company, '](https://c.example.com/', seq, ')')
                                    else concat('**', company, '**') end,
                         ' | ', case when seq % 17 = 5 then '' when seq % 9 = 4 then concat(title, ' 2028') else concat('`', title, '`') end,
                         ' | ', location, '<br/>Hybrid | ', case when seq % 6 = 0 then 'closed' else concat('[Apply](https://a.example.com/', seq, ')') end,
                         ' |') end)"""
    grouped = posts.selectExpr("seq div 50 as d", "seq", f"{row} as line").groupBy("d").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n").alias("rows"))
    return grouped.selectExpr(
        "case when d % 2 = 0 then concat('org/grads-2027-', d) else concat('org/grads-', d) end as repo",
        "case when d % 3 = 0 then 'lists/2026.md' when d % 3 = 1 then 'lists/all.md' end as path",
        "'main' as branch",
        "concat('# List\\n\\n| Company | Position | Locations | Link |\\n| --- | ---- | :---: | :--- |\\n', rows, '\\n') as markdown")


def board_urls(posts: DataFrame) -> DataFrame:
    """Postings whose links point at known boards, in the forms those boards use."""
    return posts.withColumn("url", F.expr("""case seq % 5
        when 0 then concat('https://boards.greenhouse.io/board_', seq div 100, '/jobs/', source_job_id, '?gh_src=x')
        when 1 then concat('https://board_', seq div 100, '.greenhouse.io/jobs/', source_job_id)
        when 2 then concat('https://boards-api.greenhouse.io/v1/boards/board_', seq div 100, '/jobs/', source_job_id)
        when 3 then concat('https://jobs.lever.co/board_', seq div 100, '/', lpad(source_job_id, 8, '0'), '-0000-4000-8000-000000000000')
        else url end"""))
