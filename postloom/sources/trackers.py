"""Community tracker lists: JSON feeds and Markdown tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lookups
from postloom.functions.text import bind, lines, strip, text
from postloom.operators.scale import unnest
from postloom.sources.boards import arrival, filled, finish, landed, listed, mentions_remote

# fixed values: feed shape, link patterns, table vocabulary
FEED = ("array<struct<id:string,company_name:string,title:string,locations:array<string>,url:string,active:boolean,"
        "is_visible:boolean,date_posted:double,category:string,sponsorship:string,degrees:array<string>>>")
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
HREF = r'(?i)href="([^"]+)"'
YEAR = r"(?U)20\d{2}"
SAME_COMPANY = ["↳", "->", "»", ""]
RULE_CELLS = ["", "-", "---", "-----", ":---:", ":---"]
HEADER_WORDS = [
    ("company", ["company"]), ("role", ["role", "position", "title", "job"]), ("location", ["location"]),
    ("link", ["link", "application", "apply", "posting"]), ("date", ["date", "age"]),
]
HOST = "https://github.com/"


def normalize_tracker_feed(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """``(repo, payload)``; the active listings of each feed, newest first; only ``cap`` of them if given.

    A feed is one row, so choosing its head is an array sort inside the row. Equal
    dates keep the feed's order.
    """
    raw = landed(raw, "repo")
    parsed = listed(raw, FEED, None)
    indexed = F.transform(parsed, lambda x, i: F.struct((-F.coalesce(x["date_posted"], F.lit(0.0))).alias("neg"), i.alias("pos"), x.alias("x")))
    active = F.filter(indexed, lambda s: F.coalesce(s["x"]["active"] & s["x"]["is_visible"], F.lit(False)))
    slim = F.transform(active, lambda s: F.struct(s["neg"], s["pos"]))
    order = F.sort_array(slim) if cap is None else F.slice(F.sort_array(slim), 1, cap)
    kept = bind(parsed, lambda xs: F.transform(order, lambda s: F.struct(s["pos"].alias("pos"), F.get(xs, s["pos"]).alias("x"))))
    rows = unnest(raw, kept, "repo", "_file")
    company, title = text(F.col("x.company_name")), text(F.col("x.title"))
    place = F.array_join(F.coalesce("x.locations", F.array().cast("array<string>")), ", ")
    degrees = F.array_join(F.coalesce("x.degrees", F.array().cast("array<string>")), ", ")
    none = F.lit("None")
    fallback_id = F.concat_ws(":", F.col("repo"), F.coalesce("x.company_name", none), F.coalesce("x.title", none))
    # fixed value: the summary sentence
    summary = F.concat(title, F.lit(" at "), company, F.lit(". Category: "), text(F.col("x.category")),
                       F.lit(". Locations: "), place, F.lit(". Sponsorship: "), text(F.col("x.sponsorship")),
                       F.lit(". Degrees: "), degrees, F.lit(". Source: "), F.col("repo"), F.lit(" (community tracker)."))
    return finish(rows.select(
        F.lit("github_repo").alias("source"), F.coalesce(filled(F.col("x.id")), fallback_id).alias("source_job_id"),
        title.alias("title"), company.alias("company"), place.alias("location"), mentions_remote(place).alias("remote"),
        F.coalesce(filled(F.col("x.url")), F.concat(F.lit(HOST), "repo")).alias("url"), summary.alias("description"),
        # whole days since the epoch, so that the session time zone plays no part
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("x.date_posted") / 86400).cast("int")).cast("string").alias("posted_at"),
        arrival(3, F.col("_file"), F.col("pos")).alias("arrival")))


def clean_cell(cell: Column) -> Column:
    """A table cell without link targets, emphasis and tags."""
    label = F.coalesce(filled(F.regexp_extract(cell, LINK, 1)), strip(cell))
    out = F.regexp_replace(label, "[*_`]", "")
    out = F.regexp_replace(out, "(?i)</?(details|summary|br)[^>]*>", " ")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return strip(F.btrim(strip(out), F.lit("|")))


def first_url(cell: Column) -> Column:
    return F.coalesce(filled(F.regexp_extract(cell, HREF, 1)), filled(F.regexp_extract(cell, LINK, 2)))


def year_hint(repo: Column, path: Column) -> Column:
    """Default start year of every row of a list."""
    return F.regexp_extract(F.concat_ws(" ", repo, path), YEAR, 0).try_cast("int")


def _header_class(cell: Column) -> Column:
    low, out = F.lower(cell), F.lit(None).cast("string")
    for name, words in reversed(HEADER_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def _line_struct(line: Column) -> Column:
    """What one line says on its own: is it a row, its cells, is it a header or a rule."""
    def of_cells(cells: Column) -> Column:
        def of_clean(clean: Column) -> Column:
            def at(name: str) -> Column:
                return F.array_max(F.filter(F.transform(
                    clean, lambda c, i: F.when(_header_class(c) == name, i)), lambda i: i.isNotNull())).alias(name)
            return F.struct(
                cells.alias("cells"), clean.alias("clean"),
                F.exists(clean, lambda c: F.lower(c).contains("company")).alias("header"),
                F.forall(clean, lambda c: c.isin(RULE_CELLS)).alias("rule"),
                F.struct(*[at(name) for name, _ in HEADER_WORDS]).alias("columns"))
        return bind(F.transform(cells, clean_cell), of_clean)

    return bind(strip(line), lambda t: F.struct(
        t.startswith("|").alias("piped"),
        F.when(t.startswith("|"), bind(F.split(F.btrim(t, F.lit("|")), r"\|", -1), of_cells)).alias("row")))


_COLUMNS = "struct<company:int,role:int,location:int,link:int,date:int>"
_ROW = "struct<company:string,role:string,location:string,url:string,year:int>"


def _step(cap: int | None):
    """Carries header columns and the last company from line to line, as a list is read."""
    def step(acc: Column, line: Column) -> Column:
        row, cols = line["row"], acc["columns"]
        cell = lambda src, name: F.coalesce(F.get(row[src], cols[name]), F.lit(""))
        own = cell("clean", "company")
        company = F.when(own.isin(SAME_COMPANY), acc["last"]).otherwise(own)
        role = cell("clean", "role")
        year = F.regexp_extract(F.concat_ws(" ", role, cell("clean", "date")), YEAR, 0).try_cast("int")
        entry = F.struct(company.alias("company"), role.alias("role"), cell("clean", "location").alias("location"),
                         F.coalesce(first_url(cell("cells", "link")), first_url(cell("cells", "company"))).alias("url"),
                         year.alias("year"))

        def state(columns: Column, last: Column, kept: Column) -> Column:
            return F.struct(columns.alias("columns"), last.alias("last"), kept.alias("kept"))

        return (F.when(F.lit(False) if cap is None else F.size(acc["kept"]) >= cap, acc)
                .when(~line["piped"], state(F.lit(None).cast(_COLUMNS), acc["last"], acc["kept"]))
                .when(F.size(row["cells"]) < 3, acc)
                .when(cols.isNull() & row["header"], state(row["columns"].cast(_COLUMNS), acc["last"], acc["kept"]))
                .when(cols.isNull() | row["rule"], acc)
                .when((role == "") | (company == ""), state(cols, company, acc["kept"]))
                .otherwise(state(cols, company, F.concat(acc["kept"], F.array(entry).cast(f"array<{_ROW}>")))))
    return step


def parse_tracker_table(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """``(repo, path, branch, markdown)`` -> postings; ``path`` is null for a list's front page.

    A document is one row and its scan a fold inside the row; at most ``cap`` of its
    entries are kept if that is given.
    """
    start = F.struct(F.lit(None).cast(_COLUMNS).alias("columns"), F.lit("").alias("last"),
                     F.array().cast(f"array<{_ROW}>").alias("kept"))
    kept = F.aggregate(F.transform(lines(text(F.col("markdown"))), _line_struct), start, _step(cap), lambda acc: acc["kept"])
    indexed = F.transform(kept, lambda r, i: F.struct(r.alias("r"), i.alias("pos")))
    label = F.when(F.col("path").isNull(), F.col("repo")).otherwise(F.concat_ws("/", "repo", "path"))
    page = F.when(F.col("path").isNull(), F.concat(F.lit(HOST), "repo")).otherwise(
        F.concat(F.lit(HOST), "repo", F.lit("/blob/"), "branch", F.lit("/"), "path"))
    named = raw.withColumns({"label": label, "page": page, "hint": year_hint(F.col("repo"), F.col("path"))})
    rows = unnest(landed(named, "label"), indexed, "label", "page", "hint", "_file")
    company, role, place = F.col("r.company"), F.col("r.role"), F.col("r.location")
    return finish(rows.select(
        F.lit("github_repo").alias("source"),
        F.concat_ws(":", "label", company, role, place).alias("source_job_id"),
        role.alias("title"), company.alias("company"), place.alias("location"), mentions_remote(place).alias("remote"),
        F.coalesce(F.col("r.url"), F.col("page")).alias("url"),
        # fixed value: the summary sentence
        F.concat(role, F.lit(" at "), company, F.lit(". Location: "), place, F.lit(". Source: "), "label", F.lit(".")).alias("description"),
        F.coalesce("r.year", "hint").alias("start_year"), arrival(3, F.col("_file"), F.col("pos")).alias("arrival")))
