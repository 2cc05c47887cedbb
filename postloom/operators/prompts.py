"""Text documents made from an analysis.

What they say of a pair's keywords is written from the nested columns of an analysis, or was written in batches (``Field``s here),
where the pair was analysed; then the posting's texts and the résumé stand in the row too, and nothing is joined.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import strip, text
from postloom.operators.batches import Cells, Field

# fixed values: the wording of the tailoring document
RULES = """Hard rules:
- Only surface experience I genuinely have. Never invent skills, tools, employers, dates, or metrics.
- If a required keyword can't be added truthfully, say so explicitly instead of forcing it.
- Keep phrasing ATS-parseable: plain text, standard section names, no tables or graphics.
- Match the job's terminology exactly where it's truthful (e.g. write "CI/CD" if the JD does).
"""
TASK = """For each missing keyword: tell me whether I can add it truthfully, and if so give
me the exact before/after for the specific bullet, plus which resume location.
Flag anything I genuinely lack so I know it's a real gap, not a wording gap."""
OPENING = "You are helping me tailor my resume to pass ATS screening and get an interview."
NO_MATCH = "(none detected)"
NO_GAP = "(none — strong keyword coverage)"
NO_SPOT = "(no close bullets found — may be a genuine gap)"
# fixed values: the wording of the request document
REQUEST_RULES = """Hard rules:
- Only use experience the candidate genuinely has. Never invent skills, tools, employers, dates, or metrics.
- If a required keyword can't be added truthfully, say so plainly and mark it a REAL GAP.
- Keep phrasing ATS-parseable: plain text, standard section names, no tables or graphics.
- Match the job's exact terminology where truthful (e.g. write "CI/CD" if the JD does)."""
REQUEST_TASK = """Produce, in markdown:
1. **Priority edits** — for each high-impact missing keyword that CAN be added truthfully,
   give the exact resume bullet BEFORE and a rewritten AFTER, and name the section it's in.
2. **Real gaps** — keywords the candidate genuinely lacks; do not fake these.
3. **Quick wins** — small wording/format changes that raise ATS parse-ability.
Keep it concise and specific. Prefer editing existing bullets over adding new ones."""
NOTHING = "(none)"
NEAR_CHARS = 90        # bullet characters shown in the tailoring document
GAP_NEAR_CHARS = 80    # ... and in a gap block
GAPS_SHOWN = 20
NEAR_SHOWN = 2


def _tag(m: Column) -> Column:
    return F.when(m["in_requirements"], " [required]").otherwise("")


def _or(block: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(block, F.lit("")), F.lit(fallback))


# --- written in batches -----------------------------------------------------------

def _glued(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _named(c: Cells, cells: np.ndarray) -> pa.Array:
    required = pc.fill_null(pc.struct_field(c.found, "in_requirements"), False)
    heads = _glued("- ", pc.struct_field(c.found, "keyword"), pc.if_else(required, " [required]", ""))
    return heads.take(pa.array(c.keyword[cells]))


def _gap_text(c: Cells) -> pa.Array:
    cells = c.missing(GAPS_SHOWN)
    near, said = c.near_text(pc.utf8_slice_codeunits(c.bullets, 0, GAP_NEAR_CHARS), NEAR_SHOWN)
    at = np.full(len(c.tier), -1)
    at[near] = np.arange(len(near))
    tails = _glued("  (nearest bullets: ", said, ")").take(pa.array(at[cells], mask=at[cells] < 0))
    return pc.binary_join(c.listed(cells, _glued(_named(c, cells), pc.fill_null(tails, ""))), "\n")


def _gaps_text(c: Cells) -> pa.Array:
    cells = c.missing()
    return pc.binary_join(c.listed(cells, _named(c, cells)), "\n")


def _spots_text(c: Cells) -> pa.Array:
    cells, said = c.near_text(_glued('"', pc.utf8_slice_codeunits(c.bullets, 0, NEAR_CHARS), '"'), NEAR_SHOWN)
    return pc.binary_join(c.listed(cells, _glued("- ", c.of("keyword", cells), " -> nearest bullets: ", said)), "\n")


def _held_text(c: Cells) -> pa.Array:
    cells = c.held()
    return pc.binary_join(c.listed(cells, c.of("keyword", cells)), ", ")


GAP_TEXT = Field("gap_text", "string", _gap_text, True)
HELD_TEXT = Field("held_text", "string", _held_text)
GAP_BLOCK, REQUEST = (GAP_TEXT,), (GAP_TEXT, HELD_TEXT)
TAILORING = (HELD_TEXT, Field("gaps_text", "string", _gaps_text), Field("spots_text", "string", _spots_text, True))


# --- documents --------------------------------------------------------------------

def _told(analyses: DataFrame, postings: DataFrame) -> DataFrame:
    """The analyses with title, company and body of their postings."""
    if "body" in analyses.columns:
        return analyses
    told = postings.select("posting_id", "title", "company", strip(text(F.col("description"))).alias("body"))
    return analyses.join(told, "posting_id")


def _with_resume(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    if "resume" in rows.columns:
        return rows
    return rows.join(candidates.select("candidate_id", strip(text(F.col("text"))).alias("resume")), "candidate_id")


def _written(analyses: DataFrame, field: str, otherwise: Column) -> Column:
    return F.col(field) if field in analyses.columns else otherwise


def tailoring_prompts(analyses: DataFrame, postings: DataFrame, candidates: DataFrame | None = None,
                      include_rules: bool = True) -> DataFrame:
    """One document per analysed pair.

    ``postings`` gives posting_id, title, company and description. The résumé is added
    when ``candidates`` is given.
    """
    missing = F.col("missing_keywords")
    gaps = F.array_join(F.transform(missing, lambda m: F.concat(F.lit("- "), m["keyword"], _tag(m))), "\n")
    with_spots = F.filter(missing, lambda m: F.size(m["spots"]) > 0)
    near = lambda m: F.array_join(F.transform(F.slice(m["spots"], 1, NEAR_SHOWN), lambda s: F.concat(
        F.lit('"'), F.substring(s["bullet"], 1, NEAR_CHARS), F.lit('"'))), "; ")
    spots = F.array_join(F.transform(with_spots, lambda m: F.concat(
        F.lit("- "), m["keyword"], F.lit(" -> nearest bullets: "), near(m))), "\n")

    rows = _told(analyses, postings)
    gaps, spots = _written(analyses, "gaps_text", gaps), _written(analyses, "spots_text", spots)
    parts = [F.lit(OPENING), F.lit("")]
    if include_rules:
        parts += [F.lit(RULES), F.lit("")]
    parts += [
        F.concat(F.lit("ROLE: "), text(F.col("title")), F.lit(" at "), text(F.col("company"))),
        F.concat(F.lit("ATS match score (my tool): "), F.bround("score", 0).cast("int").cast("string"), F.lit("%")),
        F.lit(""), F.lit("JOB DESCRIPTION:"), F.col("body"), F.lit(""),
        F.concat(F.lit("ALREADY COVERED (don't re-add): "), _or(_written(analyses, "held_text", F.array_join("matched_keywords", ", ")), NO_MATCH)),
        F.lit(""), F.lit("MISSING KEYWORDS (ranked by importance):"), _or(gaps, NO_GAP), F.lit(""),
        F.lit("LIKELY SPOTS TO UPDATE (my tool's guess — keyword -> nearest existing bullets):"), _or(spots, NO_SPOT), F.lit(""),
    ]
    if candidates is not None:
        rows = _with_resume(rows, candidates)
        parts += [F.when(F.col("resume") != "", F.concat(F.lit("MY RESUME:\n"), "resume", F.lit("\n")))]
    parts += [F.lit(TASK)]
    return rows.select("posting_id", "candidate_id", F.concat_ws("\n", *parts).alias("prompt"))


def _gap_block(analyses: DataFrame) -> Column:
    def line(m: Column) -> Column:
        near = F.array_join(F.transform(F.slice(m["spots"], 1, NEAR_SHOWN), lambda s: F.substring(s["bullet"], 1, GAP_NEAR_CHARS)), "; ")
        return F.concat(F.lit("- "), m["keyword"], _tag(m), F.when(
            near != "", F.concat(F.lit("  (nearest bullets: "), near, F.lit(")"))).otherwise(""))

    shown = F.transform(F.slice(F.col("missing_keywords"), 1, GAPS_SHOWN), line)
    return _or(_written(analyses, "gap_text", F.array_join(shown, "\n")), NO_MATCH)


def gap_block(analyses: DataFrame) -> DataFrame:
    """The ranked gaps of a pair as text, the first twenty with up to two near bullets each."""
    return analyses.select("posting_id", "candidate_id", _gap_block(analyses).alias("gap_block"))


def gap_requests(analyses: DataFrame, postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """The request text that goes with a gap block, one per analysed pair, for an offline batch."""
    rows = _with_resume(_told(analyses, postings), candidates)
    # the three characters of " at" go from both ends, as the role line is built there
    role = F.btrim(F.concat(text(F.col("title")), F.lit(" at "), text(F.col("company"))), F.lit(" at"))
    score = F.bround("score", 0).cast("int").cast("string")
    parts = [
        F.lit(REQUEST_RULES), F.lit(""), F.concat(F.lit("ROLE: "), role),
        F.concat(F.lit("DETERMINISTIC ATS SCORE: "), score, F.lit("%  |  required keywords covered: "),
                 F.col("required_matched").cast("string"), F.lit("/"), F.col("required_total").cast("string")),
        F.lit(""), F.lit("JOB DESCRIPTION:"), F.col("body"), F.lit(""),
        F.concat(F.lit("ALREADY COVERED (don't re-add): "), _or(_written(analyses, "held_text", F.array_join("matched_keywords", ", ")), NOTHING)),
        F.lit(""), F.lit("MISSING KEYWORDS (ranked, from my keyword tool):"), _gap_block(analyses), F.lit(""),
        F.lit("MY RESUME:"), F.col("resume"), F.lit(""), F.lit(REQUEST_TASK)]
    return rows.select("posting_id", "candidate_id", F.concat_ws("\n", *parts).alias("request"))
