"""SQL twins of the registered queries, for an engine other than Spark.

They share the fixed values with the library but none of its logic: where the library
uses blocking, closed forms or folds inside a row, the SQL compares everything with
everything, builds vocabularies, or steps through a recursive query.
"""
from __future__ import annotations

import re

from postloom import lookups
from postloom.operators import prompts
from postloom.operators.filters import FilterProfile
from postloom.plans import overlay
from postloom.sources import trackers

NL = "chr(10)"
STEP = "UNION ALL /*step*/"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({strings(values)})[({index}) + 1]"


def rows(*columns) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in zip(*columns))


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tagless(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def board_strip(x: str) -> str:
    out = tagless(x)
    for a, b in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return squash(out)


def page_strip(x: str) -> str:
    """The data holds only the entities named here; the ampersand's own goes last."""
    out = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    out = tagless(f"regexp_replace({out}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return squash(out)


def term_hit(hay: str, terms) -> str:
    tests = []
    for t in terms:
        t = t.lower().strip()
        if " " in t:
            tests.append(f"contains({hay}, {q(t)})")
        elif t:
            tests.append(f"regexp_matches({hay}, {q('(^|[^a-z0-9])' + re.escape(t) + '([^a-z0-9]|$)')})")
    return "(" + (" OR ".join(tests) or "false") + ")"


def doubled(x: str) -> str:
    return f"regexp_replace({x}, '([^a-z0-9])', '\\1\\1', 'g')"


def bounded_count(hay: str, needle: str) -> str:
    return (f"len(regexp_extract_all({doubled(f''' ' ' || {hay} || ' ' ''')}, "
            f"'[^a-z0-9]' || regexp_escape({doubled(needle)}) || '[^a-z0-9]'))")


def with_canonical(term: str) -> str:
    return f"coalesce(map_extract(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in lookups.ALIASES.items())}}}, {term})[1], {term})"


def reason(p: FilterProfile) -> str:
    cases = []
    both = "(title_l || ' ' || desc_l)"
    if p.role_keywords:
        cases.append((f"NOT {term_hit('title_l' if p.title_only else both, p.role_keywords)}", q("no role keyword in title")))
    if p.exclude_title_terms:
        cases.append((term_hit("title_l", p.exclude_title_terms), q("excluded seniority term in title")))
    if p.require_entry_level:
        cases.append((f"NOT {term_hit(both, p.entry_signals if p.entry_signals is not None else lookups.DEFAULT_ENTRY_SIGNALS)}", q("no entry-level signal")))
    types = lookups.DEFAULT_BLOCKED_TYPES if p.blocked_types is None else p.blocked_types
    if types:
        cases.append((term_hit("title_l", types), q("blocked job type in title")))
    gate = "NOT remote_any AND" if p.remote_ok else ""
    if p.blocked_countries:
        cases.append((f"{gate} coalesce(country IN ({', '.join(map(q, p.blocked_countries))}), false)", "'blocked country: ' || country"))
    if p.allowed_countries:
        ok = [f"coalesce(country IN ({', '.join(map(q, p.allowed_countries))}), false)"]
        ok += [f"contains(lower(location), {q(a)})" for a in p.allowed_locations]
        if p.allow_unknown_locations:
            ok.append("country IS NULL")
        cases.append((f"{gate} NOT ({' OR '.join(ok)})",
                      "'country not allowed: ' || CASE WHEN country IS NOT NULL THEN country WHEN location <> '' THEN location ELSE 'unknown' END"))
    if p.earliest_start and p.earliest_start[:4].isdigit():
        y = p.earliest_start[:4]
        cases.append((f"coalesce(start_year < {y}, false)", f"'starts ' || start_year || ' (before {y})'"))
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in cases) + " END"


# --- building blocks: name -> (SQL, names it reads) -------------------------------------
CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (sql, needs)


def build(sql: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in CTE[n][1]:
                visit(m)
            order.append(n)

    for n in needs:
        visit(n)
    def definition(n: str) -> str:
        sql = CTE[n][0]
        return f"{n} AS {'' if STEP in sql else 'MATERIALIZED '}({sql})"

    head = ",\n".join(map(definition, order))
    own = sql.strip()
    tail = f",\n{own[5:]}" if own.startswith("WITH ") else f"\n{own}"
    return f"WITH RECURSIVE {head}{tail}" if order else own


cte("posts", f"""
SELECT i AS seq, {pick(overlay.SOURCES, 'i % 5')} AS source, CAST(native AS VARCHAR) AS source_job_id,
  {pick(overlay.TITLES, 'b % 12')} AS title, 'company_' || b AS company,
  CASE WHEN i % 7 = 0 THEN '' ELSE 'https://jobs.example.com/' || i END AS url, location,
  contains(lower(location), 'remote') OR i % 23 = 0 AS remote,
  text || {NL}
    || CASE WHEN i % 4 = 0 THEN 'CRM tooling and CRM reporting for CRM users.' || {NL} ELSE '' END
    || 'Requirements:' || {NL} || '- ' || {pick(overlay.SKILLS, 'i % 20')} || ', ' || {pick(overlay.SKILLS, '(i * 7 + 3) % 20')} || '.' || {NL}
    || 'Nice to have: ' || {pick(overlay.SKILLS, '(i * 3 + 11) % 20')} || '.' || {NL}
    || 'Benefits:' || {NL} || {pick(overlay.STARTS, '(i // 7) % 9')} || {NL} AS description,
  CAST(DATE '2026-01-01' + CAST(i % 180 AS INTEGER) AS VARCHAR) AS posted_at, i // 250 AS batch_id
FROM (SELECT *, {pick(overlay.PLACES, '(b // 12) % 14')} AS location FROM (
  SELECT doc_id AS i, text, CASE WHEN doc_id % 19 = 18 AND doc_id >= 60 THEN doc_id - 60 ELSE doc_id END AS b,
    CASE WHEN doc_id % 17 = 16 THEN doc_id - 5 ELSE doc_id END AS native FROM documents))""")

_M = "(" + "|".join(lookups.MONTHS) + ")\\s+(20\\d{2})"
_S = "(" + "|".join(lookups.SEASONS) + ")\\s+(20\\d{2})"
_number = lambda words: "MAP {" + ", ".join(f"{q(k)}: {v}" for k, v in words.items()) + "}"


def start_columns(title: str, description: str) -> str:
    t = f"lower({title} || {NL} || {description})"
    dated = lambda p, words: (
        f"regexp_extract({t}, {q(p)}, 2) || '-' || lpad(CAST(map_extract({_number(words)}, regexp_extract({t}, {q(p)}, 1))[1] AS VARCHAR), 2, '0') || '-01'")
    third, fourth = "(start|begin|commenc)\\w*[^.\\n]{0,30}?(20\\d{2})", "(class of|graduat\\w+ in|grad(?:uating)? )\\s*(20\\d{2})"
    return f"""CASE WHEN regexp_matches({t}, {q(_M)}) THEN {dated(_M, lookups.MONTHS)}
      WHEN regexp_matches({t}, {q(_S)}) THEN {dated(_S, lookups.SEASONS)}
      WHEN regexp_matches({t}, {q(third)}) THEN regexp_extract({t}, {q(third)}, 2) || '-01-01'
      WHEN regexp_matches({t}, {q(fourth)}) THEN regexp_extract({t}, {q(fourth)}, 2) || '-01-01' END"""


_country = " ".join(
    f"WHEN regexp_matches(lower(location), {q('(^|[^a-z])' + re.escape(k) + '([^a-z]|$)')}) THEN {q(v)}" for k, v in lookups.COUNTRIES.items())
_codes = "list_transform(regexp_extract_all(location, ',\\s*([A-Za-z]{2})(?:\\s|,|$|\\))', 1), lambda c: upper(c))"


def started_sql(base: str) -> str:
    return f"""
SELECT *, CAST(substr(start_date, 1, 4) AS BIGINT) AS start_year, lower(title) AS title_l, lower(description) AS desc_l,
  remote OR contains(lower(location), 'remote') AS remote_any,
  sha1(trim(lower(source || '::' || source_job_id))) AS dedup_key,
  sha1(trim(lower(company || '::' || title || '::' || location))) AS content_key,
  CASE {_country} WHEN list_has_any({_codes}, {strings(lookups.US_STATES)}) THEN 'United States'
    WHEN list_has_any({_codes}, {strings(lookups.CA_PROVINCES)}) THEN 'Canada'
    WHEN contains(lower(location), 'remote') THEN 'Remote' END AS country
FROM (SELECT *, {start_columns('title', 'description')} AS start_date FROM {base})"""


cte("started", started_sql("posts"), "posts")
cte("judged", " UNION ALL ".join(
    f"SELECT {q(p.profile_id)} AS profile_id, seq, {reason(p)} AS reject_reason FROM started" for p in overlay.PROFILES), "started")

# first-wins insertion, one row per step
_key = lambda where, tombs: f"SELECT row_number() OVER (ORDER BY seq) AS n, seq, dedup_key, content_key, {tombs} AS dead FROM started WHERE {where}"


def greedy(name: str, source_sql: str, *needs: str) -> None:
    cte(f"{name}_in", source_sql, *needs)
    cte(name, f"""
SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS dks, CAST([] AS VARCHAR[]) AS cks, false AS ok
UNION ALL /*step*/
SELECT k.n, k.seq,
  CASE WHEN NOT k.dead AND NOT list_contains(g.dks, k.dedup_key) AND NOT list_contains(g.cks, k.content_key) THEN list_append(g.dks, k.dedup_key) ELSE g.dks END,
  CASE WHEN NOT k.dead AND NOT list_contains(g.dks, k.dedup_key) AND NOT list_contains(g.cks, k.content_key) THEN list_append(g.cks, k.content_key) ELSE g.cks END,
  NOT k.dead AND NOT list_contains(g.dks, k.dedup_key) AND NOT list_contains(g.cks, k.content_key)
FROM {name} g JOIN {name}_in k ON k.n = g.n + 1""", f"{name}_in")


greedy("inserted", _key("true", """(seq >= (SELECT count(*) // 2 FROM started) AND (
  dedup_key IN (SELECT dedup_key FROM started WHERE seq % 41 = 0) OR content_key IN (SELECT content_key FROM started WHERE seq % 43 = 0)))"""), "started")
greedy("inserted_a", _key("seq IN (SELECT seq FROM judged WHERE profile_id = 'A' AND reject_reason IS NULL)", "false"), "started", "judged")

cte("stored", f"""
SELECT *, dedup_key AS id, {pick(lookups.STATUSES, 'seq % 6')} AS status,
  CASE WHEN seq % 5 <> 0 THEN (seq * 37 % 1000) / 10.0::DOUBLE END AS ats_score, seq % 4 = 0 AS notified FROM started""", "started")

# --- candidates -----------------------------------------------------------------------------
cte("cands", f"""
SELECT item_id AS candidate_id, {pick([p.profile_id for p in overlay.PROFILES], 'item_id % 4')} AS profile_id,
 'CANDIDATE ' || item_id || {NL} || {NL} || 'SUMMARY' || {NL} || text || {NL} || {NL} || 'SKILLS' || {NL}
 || {pick(overlay.SKILLS, 'item_id % 20')} || ', ' || {pick(overlay.SKILLS, '(item_id * 3 + 1) % 20')} || ', ' || {pick(overlay.SKILLS, '(item_id * 11 + 6) % 20')} || {NL}
 || '- Built services with ' || {pick(overlay.TYPOS, 'item_id % 6')} || ' for internal platform users.' || {NL}
 || '- Wrote ' || {pick(overlay.SKILLS, '(item_id * 7 + 2) % 20')} || ' pipelines and reporting jobs over daily logs.' || {NL}
 || CASE WHEN item_id % 3 = 0 THEN '- Owned the migration of a legacy CRM.' || {NL} ELSE '' END
 || CASE WHEN item_id % 4 = 0 THEN '- Shipped reactive dashboards for finance teams.' || {NL} ELSE '' END AS text
FROM benchmark""")


def sentence_list(x: str) -> str:
    split = f"string_split_regex(regexp_replace({x}, '([.!?;\\n])\\s+', '\\1' || chr(1), 'g'), '\\n+|' || chr(1))"
    return f"list_filter(list_transform({split}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


cte("bullets", f"""
SELECT candidate_id, profile_id, generate_subscripts(bs, 1) - 1 AS bullet_index, unnest(bs) AS bullet FROM (
 SELECT candidate_id, profile_id, CASE WHEN len(ls) >= 3 THEN ls ELSE list_filter({sentence_list('text')}, lambda s: length(s) >= 25) END AS bs FROM (
  SELECT *, list_filter(list_transform(string_split(text, {NL}), lambda l: trim(l, ' ' || chr(9) || '•-*–>')), lambda l: length(l) >= 25) AS ls FROM cands))""", "cands")
cte("skills", f"SELECT * FROM (VALUES {rows(lookups.KNOWN_SKILLS, [lookups.canonical(s) for s in lookups.KNOWN_SKILLS])}) t(skill, canon)")
_token = "[a-zA-Z][a-zA-Z0-9+#.\\-]{1,}"
cte("terms", f"""
SELECT DISTINCT candidate_id, term FROM (
 SELECT candidate_id, canon AS term FROM cands, skills WHERE contains({squash('lower(text)')}, skill) AND {bounded_count(squash('lower(text)'), 'skill')} > 0
 UNION ALL SELECT candidate_id, {with_canonical('w')} FROM (SELECT candidate_id, unnest(regexp_extract_all({squash('lower(text)')}, '{_token}')) AS w FROM cands))""",
    "cands", "skills")

# --- keywords of a posting --------------------------------------------------------------------
_pref, _req = "|".join(lookups.PREFERRED_MARKERS), "|".join(lookups.REQUIRED_MARKERS)
cte("segs", f"""
SELECT seq, pos, segment, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING), 'core') AS section FROM (
 SELECT *, CASE WHEN regexp_matches(lower(segment), {q(_pref)}) THEN 'preferred' WHEN regexp_matches(lower(segment), {q(_req)}) THEN 'required'
   WHEN suffix(segment, ':') AND length(segment) <= 70 THEN 'core' END AS mark FROM (
  SELECT seq, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS segment FROM (
   SELECT seq, list_filter(list_transform(flatten(list_transform(string_split(description, {NL}), lambda l: string_split(
     regexp_replace(trim(l), '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s)), lambda s: s <> '') AS ss FROM posts)))""", "posts")
cte("texts", f"""
SELECT p.seq, {squash('lower(description)')} AS norm, coalesce(req, '') AS req, coalesce(pref, '') AS pref FROM posts p LEFT JOIN (
 SELECT seq, string_agg(lower(segment), ' ' ORDER BY pos) FILTER (section = 'required') AS req,
  string_agg(lower(segment), ' ' ORDER BY pos) FILTER (section = 'preferred') AS pref FROM segs GROUP BY seq) USING (seq)""", "posts", "segs")
cte("skill_rows", f"""
SELECT seq, skill, canon, hits, {bounded_count('req', 'skill')} > 0 AS in_req, {bounded_count('pref', 'skill')} > 0 AS in_pref
FROM (SELECT *, {bounded_count('norm', 'skill')} AS hits FROM texts, skills WHERE contains(norm, skill)) WHERE hits > 0""", "texts", "skills")
cte("known", """
SELECT seq, canon AS keyword, CAST(sum(hits) AS BIGINT) AS hits, bool_or(in_req) AS in_req,
 CASE WHEN bool_or(in_req) THEN 'required' WHEN bool_or(in_pref AND NOT in_req) THEN 'preferred' ELSE 'core' END AS section
FROM skill_rows GROUP BY seq, canon""", "skill_rows")
cte("grams", f"""
SELECT *, row_number() OVER (PARTITION BY seq ORDER BY tf DESC, term) AS rank FROM (
 SELECT seq, term, count(*) AS tf FROM (
  WITH toks AS (SELECT seq, generate_subscripts(ts, 1) AS pos, unnest(ts) AS tok FROM (
    SELECT seq, list_filter(regexp_extract_all(lower(description), '{_token}'), lambda t: NOT list_contains({strings(lookups.STOP_WORDS)}, t)) AS ts FROM posts))
  SELECT seq, tok AS term FROM toks
  UNION ALL SELECT seq, two FROM (SELECT seq, tok || ' ' || lead(tok) OVER (PARTITION BY seq ORDER BY pos) AS two FROM toks) WHERE two IS NOT NULL)
 GROUP BY seq, term)""", "posts")
_never = strings(lookups.FILLER_WORDS + lookups.STRUCTURE_WORDS + lookups.KNOWN_SKILLS)
cte("soft_in", f"""
SELECT seq, rank, term, words, {with_canonical('term')} AS keyword, list_transform(words, lambda w: {with_canonical('w')}) AS parts,
 term <> '' AND NOT list_has_any(words, {_never}) AND len(list_filter(words, lambda w: length(w) < 3)) = 0
 AND len(list_filter(words, lambda w: NOT list_contains({strings(lookups.SKILL_WORDS)}, w))) > 0
 AND NOT list_contains({strings(lookups.KNOWN_SKILLS)}, {with_canonical('term')}) AND NOT regexp_full_match(term, '[0-9]+') AS fine
FROM (SELECT seq, rank, words, array_to_string(words, ' ') AS term FROM (
 SELECT seq, rank, list_filter(list_transform(string_split(trim(term, ' .,-#+/'), ' '), lambda w: trim(w, '.,-')), lambda w: w <> '') AS words
 FROM grams WHERE rank <= {lookups.SALIENT_CAP}))""", "grams")
cte("soft_fold", f"""
SELECT p.seq, CAST(0 AS BIGINT) AS rank, coalesce(k.found, CAST([] AS VARCHAR[])) AS found, 0 AS kept, CAST(NULL AS VARCHAR) AS term, CAST(NULL AS VARCHAR) AS keyword
FROM posts p LEFT JOIN (SELECT seq, list(keyword) AS found FROM known GROUP BY seq) k USING (seq)
UNION ALL /*step*/
SELECT f.seq, c.rank, CASE WHEN ok THEN list_append(f.found, c.keyword) ELSE f.found END, CASE WHEN ok THEN f.kept + 1 ELSE f.kept END,
 CASE WHEN ok THEN c.term END, CASE WHEN ok THEN c.keyword END
FROM soft_fold f JOIN soft_in c ON c.seq = f.seq AND c.rank = f.rank + 1,
 LATERAL (SELECT c.fine AND f.kept < {lookups.SOFT_CAP} AND NOT list_has_any(c.parts, f.found) AND NOT list_contains(f.found, c.keyword) AS ok)""",
    "posts", "known", "soft_in")
cte("soft", """
SELECT f.seq, keyword, CAST((length(norm) - length(replace(norm, term, ''))) // length(term) AS BIGINT) AS hits, contains(req, term) AS in_req,
 CASE WHEN contains(req, term) THEN 'required' WHEN contains(pref, term) THEN 'preferred' ELSE 'core' END AS section
FROM soft_fold f JOIN texts USING (seq) WHERE keyword IS NOT NULL""", "soft_fold", "texts")
cte("kw", """
SELECT *, CASE section WHEN 'required' THEN least(1.0::DOUBLE, base + 0.25::DOUBLE) WHEN 'preferred' THEN base * 0.45::DOUBLE ELSE base END AS importance
FROM (SELECT *, (0.4::DOUBLE + 0.6::DOUBLE * (hits::DOUBLE / greatest(max(hits) OVER (PARTITION BY seq), 1)::DOUBLE)) * CASE WHEN soft THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS base
 FROM (SELECT *, false AS soft FROM known UNION ALL SELECT *, true FROM soft))""", "known", "soft")
cte("contexts", f"""
SELECT kw.seq, keyword, coalesce(list_filter(ss, lambda s: contains(lower(s), keyword))[1], keyword) AS context
FROM kw JOIN (SELECT seq, {sentence_list('description')} AS ss FROM posts) USING (seq)""", "kw", "posts")

# --- matching, everything with everything --------------------------------------------------------
cte("names", "SELECT DISTINCT keyword FROM kw", "kw")
cte("near", """
SELECT DISTINCT keyword, term FROM (SELECT *, length(keyword) + length(term) AS both_len FROM names, (SELECT DISTINCT term FROM terms WHERE length(term) >= 5)
 WHERE length(keyword) >= 5 AND 9 * length(term) <= 11 * length(keyword) AND 9 * length(keyword) <= 11 * length(term))
WHERE levenshtein(keyword, term) * 10 <= both_len AND (both_len - 2 * list_reduce(
  list_transform(string_split(keyword, ''), lambda ch: [ch]),
  lambda st, ch: list_reduce(list_transform(range(1, length(term) + 1), lambda j: [CAST(j AS VARCHAR)]),
    lambda acc, j: list_append(acc, CASE WHEN substr(term, CAST(j[1] AS INTEGER), 1) = ch[1] THEN CAST(CAST(st[CAST(j[1] AS INTEGER)] AS INTEGER) + 1 AS VARCHAR)
      ELSE CAST(greatest(CAST(st[CAST(j[1] AS INTEGER) + 1] AS INTEGER), CAST(acc[CAST(j[1] AS INTEGER)] AS INTEGER)) AS VARCHAR) END), ['0']),
  list_transform(range(0, length(term) + 1), lambda x: '0'))[length(term) + 1]::INTEGER) * 10 <= both_len""", "names", "terms")
cte("tiers", f"""
SELECT candidate_id, profile_id, keyword, min(tier) AS match_tier FROM (
 SELECT candidate_id, term AS keyword, 1 AS tier FROM terms JOIN names ON term = keyword
 UNION ALL SELECT candidate_id, keyword, 2 FROM names, cands WHERE (contains(keyword, ' ') OR length(keyword) >= 4) AND contains({squash('lower(text)')}, keyword)
 UNION ALL SELECT candidate_id, keyword, 3 FROM (SELECT candidate_id, keyword, {squash('lower(text)')} AS norm FROM names, cands WHERE NOT contains(keyword, ' ') AND length(keyword) < 4)
   WHERE contains(norm, keyword) AND {bounded_count('norm', 'keyword')} > 0
 UNION ALL SELECT candidate_id, keyword, 4 FROM near JOIN terms USING (term)) JOIN cands USING (candidate_id)
GROUP BY ALL""", "terms", "names", "cands", "near")
cte("pairs", "SELECT candidate_id, profile_id, seq FROM judged JOIN cands USING (profile_id) WHERE reject_reason IS NULL", "judged", "cands")
cte("pair_kw", """
SELECT p.candidate_id, p.profile_id, p.seq, kw.* EXCLUDE (seq), match_tier FROM pairs p JOIN kw USING (seq)
LEFT JOIN tiers t ON t.candidate_id = p.candidate_id AND t.keyword = kw.keyword""", "pairs", "kw", "tiers")
_plain = "list_filter(regexp_extract_all(lower({}), '[\\pL\\pN_]{{2,}}'), lambda t: NOT list_contains(" + strings(lookups.STOP_WORDS) + ", t))"
cte("sims", f"""
WITH a AS (SELECT seq, w, count(*) AS tf FROM (SELECT seq, unnest({_plain.format('description')}) AS w FROM posts) GROUP BY ALL),
 b AS (SELECT candidate_id, w, count(*) AS tf FROM (SELECT candidate_id, unnest({_plain.format('text')}) AS w FROM cands) GROUP BY ALL),
 one AS (SELECT candidate_id, seq, sum(a.tf * b.tf)::DOUBLE AS dot, sum(pow(a.tf * CASE WHEN b.tf IS NULL THEN ln(3.0::DOUBLE / 2) + 1 ELSE 1 END, 2)) AS aa
   FROM pairs JOIN a USING (seq) LEFT JOIN b USING (candidate_id, w) GROUP BY ALL),
 two AS (SELECT candidate_id, seq, sum(pow(b.tf * CASE WHEN a.tf IS NULL THEN ln(3.0::DOUBLE / 2) + 1 ELSE 1 END, 2)) AS bb
   FROM pairs JOIN b USING (candidate_id) LEFT JOIN a USING (seq, w) GROUP BY ALL)
SELECT candidate_id, seq, coalesce(dot / sqrt(aa * bb), 0) AS similarity FROM pairs LEFT JOIN one USING (candidate_id, seq) LEFT JOIN two USING (candidate_id, seq)""",
    "posts", "cands", "pairs")
cte("scores", """
SELECT candidate_id, profile_id, seq, coverage, match_rate, similarity, total, matched, required_total, required_matched,
 greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (0.8::DOUBLE * coverage + 0.2::DOUBLE * similarity))) AS ats_score FROM (
 SELECT p.candidate_id, p.profile_id, p.seq, coalesce(sum(importance) FILTER (match_tier IS NOT NULL), 0) / CASE WHEN coalesce(sum(importance), 0) = 0 THEN 1 ELSE sum(importance) END AS coverage,
  100.0::DOUBLE * count(match_tier) / greatest(count(keyword), 1) AS match_rate, count(keyword) AS total, count(match_tier) AS matched,
  count(*) FILTER (section = 'required') AS required_total, count(match_tier) FILTER (section = 'required') AS required_matched
 FROM pairs p LEFT JOIN pair_kw k USING (candidate_id, seq) GROUP BY 1, 2, 3) JOIN sims USING (candidate_id, seq)""", "pairs", "pair_kw", "sims")
cte("gaps", """
SELECT candidate_id, seq, keyword, section, importance, in_req, row_number() OVER (PARTITION BY candidate_id, seq ORDER BY
 CASE section WHEN 'required' THEN 0 WHEN 'preferred' THEN 2 ELSE 1 END, importance DESC, keyword) AS gap_rank FROM pair_kw WHERE match_tier IS NULL""", "pair_kw")
_words = "list_filter(regexp_extract_all(lower({}), '" + _token.replace("{", "{{").replace("}", "}}") + "'), lambda t: NOT list_contains(" + strings(lookups.STOP_WORDS) + ", t))"
cte("vectors", f"""
WITH tf AS (SELECT candidate_id, bullet_index, token, count(*) AS tf FROM (SELECT candidate_id, bullet_index, unnest({_words.format('bullet')}) AS token FROM bullets) GROUP BY ALL),
 df AS (SELECT candidate_id, token, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf JOIN (SELECT candidate_id, count(*) AS n FROM bullets GROUP BY 1) USING (candidate_id) GROUP BY candidate_id, token, n)
SELECT candidate_id, bullet_index, token, idf, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY candidate_id, bullet_index)) AS weight
FROM tf JOIN df USING (candidate_id, token)""", "bullets")
cte("spots", f"""
WITH qt AS (SELECT seq, keyword, token, count(*) AS tf FROM (SELECT seq, keyword, unnest({_words.format("keyword || ' ' || context")}) AS token FROM contexts) GROUP BY ALL),
 idf AS (SELECT DISTINCT candidate_id, token, idf FROM vectors),
 w AS (SELECT g.candidate_id, g.seq, g.keyword, qt.token, qt.tf * idf.idf AS q FROM gaps g JOIN qt USING (seq, keyword) JOIN idf ON idf.candidate_id = g.candidate_id AND idf.token = qt.token),
 norm AS (SELECT candidate_id, seq, keyword, sqrt(sum(q * q)) AS len FROM w GROUP BY ALL),
 sim AS (SELECT w.candidate_id, w.seq, w.keyword, bullet_index, sum(q * weight) AS dot FROM w JOIN vectors v ON v.candidate_id = w.candidate_id AND v.token = w.token GROUP BY ALL)
SELECT * FROM (SELECT candidate_id, seq, keyword, bullet_index, dot / len AS similarity,
  row_number() OVER (PARTITION BY candidate_id, seq, keyword ORDER BY round(dot / len, 9) DESC, bullet_index DESC) AS rank
 FROM sim JOIN norm USING (candidate_id, seq, keyword)) WHERE rank <= {lookups.SPOT_CAP} AND similarity > {lookups.SPOT_FLOOR}""", "contexts", "vectors", "gaps")

# --- pages ------------------------------------------------------------------------------------------
_node = """'{"@type": ["Thing", "JobPosting"], "description": "' || body || '"}'"""
_other = """'{"@type": "Organization", "description": "not a posting"}'"""
cte("crawl", f"""
SELECT page_id, 'https://jobs.example.com/' || page_id AS url, description, CASE WHEN block IS NULL THEN html ELSE
  CASE WHEN contains(html, '</body>') THEN substr(html, 1, strpos(html, '</body>') - 1) ELSE html END
  || CASE WHEN page_id % 27 = 0 THEN '<script type="application/ld+json">{{broken</script>' ELSE '' END
  || '<script type="application/ld+json">' || block || '</script>' || CASE WHEN contains(html, '</body>') THEN substr(html, strpos(html, '</body>')) ELSE '' END END AS html
FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN body END AS description, CASE WHEN page_id % 9 = 0 THEN {_node}
   WHEN page_id % 9 = 3 THEN '{{"@graph": [' || {_other} || ', ' || {_node} || ']}}' WHEN page_id % 9 = 6 THEN '[' || {_other} || ', ' || {_node} || ']' END AS block
 FROM (SELECT page_id, html, '<p>Research &amp; growth &lt;now&gt; ' || words || '</p>' AS body
  FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9.]+', ' ', 'g')) AS words FROM pages)))""")
cte("crawled", f"""
SELECT page_id, url, CASE WHEN length(d) > {lookups.BOARD_MIN_CHARS} THEN d WHEN length(p) > {lookups.PAGE_MIN_CHARS} THEN p ELSE '' END AS full_text,
 CASE WHEN length(d) > {lookups.BOARD_MIN_CHARS} THEN 'json-ld' WHEN length(p) > {lookups.PAGE_MIN_CHARS} THEN 'html' ELSE '' END AS label
FROM (SELECT page_id, url, {page_strip("coalesce(description, '')")} AS d, {page_strip('html')} AS p FROM crawl)""", "crawl")

# --- the twins -----------------------------------------------------------------------------------------
ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *needs: str) -> None:
    ORACLES[name] = build(sql, *needs)


_html = f"'<p>' || replace(description, {NL}, '</p><p>') || '</p> R&amp;amp;D &amp;lt;b&amp;gt;&nbsp;it&#39;s'"
_board = f"'board_' || seq // {overlay.ROWS_PER_PAYLOAD}"
_greenhouse = f"""SELECT 'greenhouse' AS source, source_job_id, title, {_board} AS company, location, contains(lower(location), 'remote') AS remote, url,
 {board_strip(_html)} AS description, CASE WHEN seq % 4 <> 0 THEN posted_at END AS posted_at FROM posts"""
_lever = f"""SELECT 'lever' AS source, source_job_id, title, {_board} AS company, location, contains(lower(location), 'remote') OR seq % 3 = 0 AS remote, url,
 CASE WHEN seq % 2 = 0 THEN description ELSE {squash(tagless(_html))} END AS description, CAST(NULL AS VARCHAR) AS posted_at FROM posts"""
_ashby = f"""SELECT 'ashby' AS source, CASE WHEN seq % 3 <> 0 THEN source_job_id WHEN seq % 2 = 0 THEN 'job-' || source_job_id ELSE title END AS source_job_id, title, {_board} AS company, location,
 contains(lower(location), 'remote') OR seq % 23 = 0 AS remote, CASE WHEN url <> '' THEN url ELSE 'https://apply.example.com/' || seq END AS url,
 {squash(tagless(f"CASE WHEN seq % 2 = 0 THEN {_html} ELSE description END"))} AS description, posted_at FROM posts"""
_adzuna = """SELECT 'adzuna' AS source, CASE WHEN seq % 9 = 0 THEN 'None' ELSE source_job_id END AS source_job_id, title, company, location,
 contains(lower(location), 'remote') AS remote, url, description, posted_at FROM posts"""
oracle("normalize_greenhouse", _greenhouse, "posts")
oracle("normalize_lever", _lever, "posts")
oracle("normalize_ashby", _ashby, "posts")
oracle("normalize_aggregator", _adzuna, "posts")
oracle("union_sources", f"""SELECT source, count(*) AS n, count(*) FILTER (remote) AS n_remote, count(DISTINCT source_job_id) AS n_ids, CAST(sum(length(description)) AS BIGINT) AS chars
FROM ({_greenhouse} UNION ALL {_lever} UNION ALL {_ashby} UNION ALL {_adzuna}) GROUP BY source""", "posts")
_feed = f"""
SELECT 'github_repo' AS source, CASE WHEN seq % 6 <> 0 THEN source_job_id ELSE repo || ':' || company || ':' || title END AS source_job_id, title, company, place AS location,
 contains(lower(place), 'remote') AS remote, CASE WHEN url <> '' THEN url ELSE {q(trackers.HOST)} || repo END AS url,
 title || ' at ' || company || '. Category: Data. Locations: ' || place || '. Sponsorship: Other. Degrees: BS, MS. Source: ' || repo || ' (community tracker).' AS description,
 CASE WHEN seq % 13 <> 0 THEN CAST(DATE '2026-01-01' + CAST(seq % 8 AS INTEGER) AS VARCHAR) END AS posted_at
FROM (SELECT *, 'org/list_' || seq // 100 AS repo, CASE WHEN location = '' THEN '' ELSE location || ', Hybrid' END AS place
 FROM posts WHERE seq % 10 <> 3 AND seq % 11 <> 4)"""
oracle("tracker_feed_topcap", _feed, "posts")

# payload files: each posting in its own source's format, in three pulls; files arrive in the order of their path
_formats = {"greenhouse": (_greenhouse, 0), "lever": (_lever, 1), "ashby": (_ashby, 2), "tracker_feed": (_feed, 3), "adzuna": (_adzuna, 4)}
_pull = "batch_id * 3 // (SELECT max(batch_id) + 1 FROM posts)"


def in_file(name: str, sql: str, k: int) -> str:
    slug = "'org%2Flist_' || seq // 100" if name == "tracker_feed" else _board
    return (f"SELECT *, 'pull=' || {_pull} || '/source={name}/slug=' || {slug} || '/' AS ord "
            f"FROM (SELECT seq, {sql.strip().removeprefix('SELECT ')}) JOIN (SELECT seq, batch_id FROM posts) USING (seq) WHERE seq % 5 = {k}")


cte("landed_rows", " UNION ALL ".join(in_file(n, *v) for n, v in _formats.items()), "posts")
cte("landed_started", started_sql("landed_rows"), "landed_rows")
cte("landed_judged", f"SELECT *, {reason(overlay.PROFILE['A'])} AS reject_reason FROM landed_started", "landed_started")
greedy("landed_in", "SELECT row_number() OVER (ORDER BY ord, seq) AS n, seq, dedup_key, content_key, false AS dead FROM landed_judged WHERE reject_reason IS NULL",
       "landed_judged")
oracle("stream_payload_files", """
SELECT source, source_job_id, title, company, location, dedup_key, content_key, md5(description) AS description, CAST(start_year AS VARCHAR) AS start_year,
 'to_apply' AS status FROM landed_in JOIN landed_judged USING (seq) WHERE ok""", "landed_in", "landed_judged")
oracle("stream_quarantine", "SELECT source, 'broken_' || slug AS key, '{broken ' || slug AS payload FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS source, {_pull} AS pull, {chr(39) + 'org/list_' + chr(39) + ' || seq // 100' if n == 'tracker_feed' else _board} AS slug, seq // 100 AS board "
    f"FROM posts WHERE seq % 5 = {k}" for n, (_, k) in _formats.items()) + ") WHERE board % 3 = 1", "posts")

# the Markdown lists, restated from the rules rather than parsed: which rows are shown how
cte("list_rows", f"""
SELECT *, CASE WHEN second THEN CASE WHEN seq % 4 = 1 THEN NULL ELSE company END WHEN seq % 5 = 2 THEN NULL ELSE company END AS own,
  CASE WHEN second THEN title WHEN seq % 17 = 5 THEN '' WHEN seq % 9 = 4 THEN title || ' 2028' ELSE title END AS role,
  CASE WHEN second THEN '' ELSE trim(location || ' Hybrid') END AS place,
  CASE WHEN second THEN CASE WHEN url <> '' THEN url END WHEN seq % 6 <> 0 THEN 'https://a.example.com/' || seq WHEN seq % 5 = 3 THEN 'https://c.example.com/' || seq END AS link,
  CASE WHEN second AND seq % 3 = 0 THEN 2027 WHEN NOT second AND seq % 9 = 4 AND seq % 17 <> 5 THEN 2028 END AS own_year
FROM (SELECT * REPLACE (replace(company, '_', '') AS company), seq // 50 AS d, seq % 50 >= 7 AS second FROM posts)""", "posts")
oracle("tracker_markdown", f"""
WITH docs AS (SELECT d, repo || CASE WHEN path IS NULL THEN '' ELSE '/' || path END AS label,
   {q(trackers.HOST)} || repo || CASE WHEN path IS NULL THEN '' ELSE '/blob/main/' || path END AS page,
   CAST(nullif(regexp_extract(repo || coalesce(' ' || path, ''), '20\\d{{2}}'), '') AS BIGINT) AS hint
  FROM (SELECT DISTINCT seq // 50 AS d, CASE WHEN seq // 50 % 2 = 0 THEN 'org/grads-2027-' ELSE 'org/grads-' END || seq // 50 AS repo,
   CASE WHEN seq // 50 % 3 = 0 THEN 'lists/2026.md' WHEN seq // 50 % 3 = 1 THEN 'lists/all.md' END AS path FROM posts)),
 shown AS (SELECT d, -1 AS seq, '----' AS company, '----' AS role, ':---:' AS place, CAST(NULL AS VARCHAR) AS link, CAST(NULL AS INTEGER) AS own_year FROM docs
  UNION ALL SELECT d, seq, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY d ORDER BY seq ROWS UNBOUNDED PRECEDING), '---'), role, place, link, own_year FROM list_rows)
SELECT label || ':' || company || ':' || role || ':' || place AS source_job_id, role AS title, company, place AS location,
 contains(lower(place), 'remote') AS remote, coalesce(link, page) AS url, role || ' at ' || company || '. Location: ' || place || '. Source: ' || label || '.' AS description,
 CAST(coalesce(CAST(own_year AS BIGINT), hint) AS VARCHAR) AS start_year, pos FROM (
 SELECT *, row_number() OVER (PARTITION BY d ORDER BY seq) - 1 AS pos FROM (SELECT d, seq, CASE WHEN seq = -1 THEN '---' ELSE company END AS company, role, place, link, own_year FROM shown WHERE role <> '')
) JOIN docs USING (d)""", "list_rows")
oracle("strip_markup", f"SELECT page_id, md5({board_strip('html')}) AS board_text, md5({squash(tagless('html'))}) AS plain_text, md5({page_strip('html')}) AS page_text FROM pages")
oracle("manual_postings", f"""
SELECT 'manual:' || seq AS source_job_id, title, company, location, sha1('manual::manual:' || seq) AS dedup_key,
 sha1(trim(lower(company || '::' || title || '::' || location))) AS content_key,
 CASE WHEN seq % 10 = 0 THEN '2030' ELSE substr(d, 1, 4) END AS start_year, CASE WHEN seq % 10 = 0 THEN '2030-01-01' ELSE d END AS start_date,
 length(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) AS chars
FROM (SELECT *, {start_columns('title', 'description')} AS d FROM posts)""", "posts")

oracle("infer_start", "SELECT seq, CAST(start_year AS VARCHAR) AS start_year, start_date FROM started", "started")
oracle("infer_country_remote", "SELECT seq, country, remote_any AS is_remote FROM started", "started")
oracle("posting_keys", "SELECT seq, dedup_key, content_key FROM started", "started")
oracle("filter_reasons", "SELECT seq, reject_reason FROM judged WHERE profile_id = 'A'", "judged")
oracle("filter_reason_counts", "SELECT profile_id, coalesce(reject_reason, 'passes') AS reason, count(*) AS n FROM judged GROUP BY ALL", "judged")
oracle("filter_multi_profile", "SELECT * FROM judged", "judged")
oracle("filter_profile_table", "SELECT * FROM judged", "judged")
oracle("passing_pairs", "SELECT profile_id, seq FROM judged WHERE reject_reason IS NULL", "judged")
oracle("prune", "SELECT seq, CASE WHEN reject_reason IS NOT NULL THEN dedup_key END AS tombstone FROM judged JOIN started USING (seq) WHERE profile_id = 'A'", "judged", "started")

oracle("dedup_insert", "SELECT seq, dedup_key, content_key, 'to_apply' AS status FROM inserted JOIN started USING (seq) WHERE ok", "inserted", "started")
oracle("stream_ingest_equals_batch", "SELECT seq, dedup_key, content_key, 'to_apply' AS status FROM inserted_a JOIN started USING (seq) WHERE ok", "inserted_a", "started")
_message = """'🆕 ' || title || ' — ' || company || chr(10) || '📍 ' || CASE WHEN location <> '' THEN location WHEN remote THEN 'Remote' ELSE '—' END
 || '   🗓 start: ' || coalesce(start_date, 'n/a') || chr(10) || '🔗 ' || url || chr(10) || 'id: ' || dedup_key || chr(10) || 'open: http://localhost:8000/#/job/' || dedup_key"""
_numbered = [(n, f"SELECT '{'github_repo' if n == 'tracker_feed' else n}' AS source, seq // 100 AS d FROM (SELECT seq, {sql.strip().removeprefix('SELECT ')})")
             for n, (sql, _) in _formats.items()]
oracle("split_sources", f"""
SELECT 'postings' AS part, source, count(*) AS n, count(DISTINCT file) AS payloads FROM (
 {' UNION ALL '.join(f"SELECT source, '{n}' || d AS file, d FROM ({s})" for n, s in _numbered)}
 UNION ALL SELECT 'github_repo', 'list' || d, d FROM (SELECT CAST(regexp_extract(source_job_id, 'org/grads-(?:2027-)?([0-9]+)', 1) AS BIGINT) AS d FROM ({ORACLES['tracker_markdown']}))
) WHERE d % 4 <> 1 GROUP BY 1, 2
UNION ALL SELECT 'quarantine', format, count(DISTINCT d), count(DISTINCT d) FROM (
 {' UNION ALL '.join(f"SELECT '{n}' AS format, seq // 100 AS d FROM posts" for n in _formats)}
 UNION ALL SELECT 'tracker_table', seq // 50 FROM posts) WHERE d % 4 = 1 GROUP BY 1, 2""", "posts")

_first_run = "seq IN (SELECT seq FROM posts WHERE batch_id * 3 < (SELECT max(batch_id) + 1 FROM posts))"
oracle("stream_scores", """SELECT candidate_id, seq, round(ats_score, 4) AS ats_score, round(match_rate, 4) AS match_rate, 'to_apply' AS status, true AS notified
FROM scores JOIN inserted_a USING (seq) WHERE ok AND profile_id = 'A'""", "scores", "inserted_a")
oracle("stream_requests", f"""
WITH log AS (SELECT dedup_key AS id, event_id, ts, event_type FROM events JOIN started ON seq = user_id % (SELECT count(*) FROM documents)),
 st AS (SELECT id, event_type, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_type IN ('click', 'view', 'purchase')),
 ds AS (SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_type = 'signup'),
 kept AS (SELECT s.*, {_first_run} AS early FROM started s JOIN inserted_a USING (seq) WHERE ok)
SELECT seq, coalesce(CASE WHEN early THEN CASE st.event_type WHEN 'click' THEN 'applied' WHEN 'view' THEN 'interviewing' WHEN 'purchase' THEN 'offer' END END, 'to_apply') AS status,
 md5(coalesce(CASE WHEN early THEN 'patched ' || ds.event_id END, k.description)) AS description
FROM kept k LEFT JOIN st ON st.id = k.dedup_key AND st.rn = 1 LEFT JOIN ds ON ds.id = k.dedup_key AND ds.rn = 1 WHERE NOT (early AND seq % 5 = 0)""",
       "started", "inserted_a", "posts")
oracle("stream_alerts", f"SELECT dedup_key AS id, 'slack' AS channel, {_message} AS message FROM inserted_a JOIN started USING (seq) WHERE ok", "inserted_a", "started")
oracle("alert_outbox", f"SELECT id, 'slack' AS channel, {_message} AS message FROM stored WHERE NOT notified", "stored")
oracle("tombstone_dismiss", """
WITH one AS (SELECT dedup_key, min(seq) AS lo, max(seq) AS hi FROM stored GROUP BY 1), s AS (SELECT dedup_key, lo AS seq FROM one)
SELECT 'state' AS part, dedup_key, '' AS detail FROM s WHERE seq % 5 <> 0
UNION ALL SELECT 'tombstone', dedup_key, CASE WHEN seq % 5 = 0 THEN 'new|2026-06-02' ELSE 'old|2026-01-01' END FROM s WHERE seq % 5 = 0 OR seq % 3 = 0""", "stored")
oracle("apply_changes", """
WITH log AS (SELECT dedup_key AS id, event_id, ts, event_type FROM events JOIN started ON seq = user_id % (SELECT count(*) FROM documents)),
 st AS (SELECT id, event_type, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_type IN ('click', 'view', 'purchase')),
 ds AS (SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_type = 'signup')
SELECT CAST(seq AS VARCHAR) AS posting, coalesce(CASE st.event_type WHEN 'click' THEN 'applied' WHEN 'view' THEN 'interviewing' WHEN 'purchase' THEN 'offer' END, s.status) AS status,
 md5(coalesce('patched ' || ds.event_id, s.description)) AS description
FROM stored s LEFT JOIN st ON st.id = s.id AND st.rn = 1 LEFT JOIN ds ON ds.id = s.id AND ds.rn = 1 WHERE seq IN (SELECT min(seq) FROM stored GROUP BY dedup_key)
UNION ALL SELECT 'refused', CAST(count(*) AS VARCHAR), NULL FROM log WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')""", "stored", "started")
oracle("list_by_score", "SELECT id, seq, status, ats_score, title, company FROM stored WHERE status = 'applied' ORDER BY ats_score DESC NULLS LAST, seq DESC", "stored")
_band = "CASE WHEN {0} IS NULL THEN 'unscored' WHEN {0} < 40 THEN 'filtered out' WHEN {0} < 60 THEN 'borderline' ELSE 'likely passes' END"
oracle("score_bands", f"SELECT {_band.format('ats_score')} AS band, count(*) AS n FROM stored GROUP BY 1", "stored")
oracle("ingest_summary", """
SELECT source, count(*) AS fetched, count(*) FILTER (reject_reason IS NOT NULL) AS skipped, count(*) FILTER (ok) AS inserted,
 count(*) FILTER (reject_reason IS NULL AND NOT coalesce(ok, false)) AS duplicates, count(*) FILTER (ok) AS analyzed
FROM started JOIN judged USING (seq) LEFT JOIN inserted_a USING (seq) WHERE profile_id = 'A' GROUP BY source""", "started", "judged", "inserted_a")

oracle("sentences_of", f"SELECT seq, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM (SELECT seq, {sentence_list('description')} AS ss FROM posts)", "posts")
oracle("segment_sections", "SELECT seq, pos, section, segment FROM segs", "segs")
oracle("skill_hits", "SELECT seq, skill, hits FROM skill_rows", "skill_rows")
oracle("skill_sections", "SELECT seq, keyword, hits, in_req, section FROM known", "known")
oracle("doc_ngrams", f"SELECT seq, term, tf FROM grams WHERE rank <= {lookups.NGRAM_CAP}", "grams")
oracle("salient_terms", f"SELECT seq, rank, term, tf FROM grams WHERE rank <= {lookups.SALIENT_CAP}", "grams")
oracle("soft_keywords", "SELECT seq, keyword, hits, in_req, section FROM soft", "soft")
oracle("keyword_importance", "SELECT seq, keyword, section, soft, round(importance, 6) AS importance FROM kw", "kw")

oracle("candidate_bullets", "SELECT candidate_id, bullet_index, bullet FROM bullets", "bullets")
oracle("candidate_terms", "SELECT candidate_id, term FROM terms", "terms")
oracle("keyword_match", "SELECT candidate_id, keyword, CAST(match_tier AS BIGINT) AS match_tier FROM tiers", "tiers")
oracle("matched_missing", """SELECT candidate_id, seq AS posting_id, count(match_tier) AS n_matched, count(*) - count(match_tier) AS n_missing,
 count(match_tier) FILTER (section = 'required') AS required_matched, count(*) FILTER (section = 'required') AS required_total FROM pair_kw GROUP BY 1, 2""", "pair_kw")
oracle("keyword_context", "SELECT seq AS posting_id, keyword, context FROM contexts", "contexts")
oracle("bullet_tfidf", "SELECT candidate_id, token, bullet_index, round(idf, 6) AS idf, round(weight, 6) AS weight FROM vectors", "vectors")
oracle("find_spots", "SELECT candidate_id, seq AS posting_id, keyword, rank, bullet_index, round(similarity, 4) AS similarity FROM spots", "spots")
oracle("analyze_pairs", """SELECT candidate_id, seq AS posting_id, profile_id, round(ats_score, 4) AS ats_score, round(match_rate, 4) AS match_rate,
 total, matched, required_total, required_matched FROM scores""", "scores")
oracle("coverage", "SELECT candidate_id, seq AS posting_id, round(coverage, 6) AS coverage, round(match_rate, 6) AS match_rate FROM scores", "scores")
oracle("semantic_similarity", "SELECT candidate_id, seq AS posting_id, round(similarity, 6) AS similarity FROM sims", "sims")
oracle("ats_score", f"""SELECT candidate_id, {_band.format('ats_score')} AS band, count(*) AS n, round(avg(ats_score), 4) AS avg_score, round(max(ats_score), 4) AS best
FROM scores GROUP BY 1, 2""", "scores")
oracle("gap_ranking", "SELECT candidate_id, seq AS posting_id, gap_rank, keyword, section, round(importance, 6) AS importance FROM gaps", "gaps")
_top = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(ats_score, 4) DESC, seq DESC) AS rank FROM scores) WHERE rank <= 10)"""
oracle("top_k_per_candidate", f"WITH {_top} SELECT candidate_id, seq AS posting_id, rank, round(ats_score, 4) AS ats_score FROM top", "scores")
oracle("top_matches", f"""WITH {_top}, heads AS (SELECT candidate_id, seq, string_agg(keyword, ', ' ORDER BY gap_rank) AS first_gaps FROM gaps WHERE gap_rank <= 3 GROUP BY 1, 2)
SELECT candidate_id, rank, seq AS posting_id, title, company, round(ats_score, 4) AS ats_score, {_band.format('round(ats_score, 4)')} AS band, required_matched, required_total,
 coalesce(first_gaps, '') AS first_gaps FROM top JOIN posts USING (seq) LEFT JOIN heads USING (candidate_id, seq)""", "scores", "gaps", "posts")

oracle("extract_posting_text", "SELECT page_id, label, md5(full_text) AS full_text, length(full_text) AS chars FROM crawled", "crawled")
oracle("enrich_thin", f"""
SELECT seq, CASE WHEN better THEN 'full posting' ELSE 'listing summary' END AS jd_source, md5(CASE WHEN better THEN full_text ELSE description END) AS description
FROM (SELECT seq, description, full_text, coalesce(length(description) < {lookups.THIN_CHARS} AND p.url <> '' AND length(full_text) > length(description), false) AS better
 FROM posts p LEFT JOIN crawled c ON c.url = p.url)""", "posts", "crawled")
_landed = page_strip(_html.replace('description', 't.description'))
oracle("board_url_keys", f"""
WITH landed AS (SELECT source AS kind, board, job_id, max(body) AS body FROM (
  SELECT 'greenhouse' AS source, 'board_' || t.seq // {overlay.ROWS_PER_PAYLOAD} AS board, t.source_job_id AS job_id, {_landed} AS body FROM posts t
  UNION ALL SELECT 'lever', 'board_' || t.seq // {overlay.ROWS_PER_PAYLOAD}, t.source_job_id, CASE WHEN t.seq % 2 = 0 THEN t.description ELSE {_landed} END
  FROM posts t) GROUP BY ALL),
 keyed AS (SELECT seq, description, CASE seq % 5 WHEN 3 THEN 'lever' WHEN 4 THEN NULL ELSE 'greenhouse' END AS kind,
  CASE seq % 5 WHEN 2 THEN 'v1' WHEN 4 THEN NULL ELSE 'board_' || seq // 100 END AS board,
  CASE seq % 5 WHEN 3 THEN lpad(source_job_id, 8, '0') || '-0000-4000-8000-000000000000' WHEN 4 THEN NULL ELSE source_job_id END AS job_id FROM posts)
SELECT seq, kind, board, job_id, CASE WHEN better THEN 'full posting' ELSE 'listing summary' END AS jd_source, length(CASE WHEN better THEN body ELSE description END) AS chars
FROM (SELECT k.*, body, coalesce(length(description) < {lookups.THIN_CHARS} AND length(body) > {lookups.BOARD_MIN_CHARS} AND length(body) > length(description), false) AS better
 FROM keyed k LEFT JOIN landed USING (kind, board, job_id))""", "posts")
oracle("jd_source_label", f"SELECT seq, CASE WHEN length(description) >= {lookups.THIN_CHARS} THEN 'full posting' ELSE 'listing summary' END AS at_ingest, 'manual paste' AS at_paste FROM posts", "posts")

cte("gap_lines", f"""
SELECT g.candidate_id, g.seq, g.keyword, gap_rank, CASE WHEN in_req THEN ' [required]' ELSE '' END AS tag, near_long, near_short FROM gaps g LEFT JOIN (
 SELECT candidate_id, seq, keyword, string_agg('"' || substr(bullet, 1, {prompts.NEAR_CHARS}) || '"', '; ' ORDER BY rank) AS near_long,
  string_agg(substr(bullet, 1, {prompts.GAP_NEAR_CHARS}), '; ' ORDER BY rank) AS near_short
 FROM spots JOIN bullets USING (candidate_id, bullet_index) WHERE rank <= 2 GROUP BY ALL) USING (candidate_id, seq, keyword)""", "gaps", "spots", "bullets")
cte("gap_blocks", f"""
SELECT candidate_id, seq, coalesce(string_agg('- ' || keyword || tag || CASE WHEN near_short IS NULL THEN '' ELSE '  (nearest bullets: ' || near_short || ')' END, {NL} ORDER BY gap_rank)
 FILTER (gap_rank <= {prompts.GAPS_SHOWN}), {q(prompts.NO_MATCH)}) AS gap_block FROM pairs LEFT JOIN gap_lines USING (candidate_id, seq) GROUP BY 1, 2""", "pairs", "gap_lines")
oracle("gap_block", "SELECT candidate_id, seq AS posting_id, gap_block FROM gap_blocks", "gap_blocks")
oracle("gap_requests", f"""
WITH held AS (SELECT candidate_id, seq, string_agg(keyword, ', ' ORDER BY keyword) AS words FROM pair_kw WHERE match_tier IS NOT NULL GROUP BY 1, 2),
 done AS (SELECT s.candidate_id, s.seq, concat_ws({NL}, {q(prompts.REQUEST_RULES)}, '', 'ROLE: ' || trim(title || ' at ' || company, ' at'),
  'DETERMINISTIC ATS SCORE: ' || CAST(round_even(round(ats_score, 1), 0) AS INTEGER) || '%  |  required keywords covered: ' || required_matched || '/' || required_total,
  '', 'JOB DESCRIPTION:', regexp_replace(description, '^\\s+|\\s+$', '', 'g'), '', 'ALREADY COVERED (don''t re-add): ' || coalesce(words, {q(prompts.NOTHING)}), '',
  'MISSING KEYWORDS (ranked, from my keyword tool):', gap_block, '', 'MY RESUME:', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '', {q(prompts.REQUEST_TASK)}) AS request
 FROM scores s JOIN posts USING (seq) JOIN cands c ON c.candidate_id = s.candidate_id JOIN gap_blocks g ON g.candidate_id = s.candidate_id AND g.seq = s.seq
 LEFT JOIN held h ON h.candidate_id = s.candidate_id AND h.seq = s.seq)
SELECT candidate_id, seq AS posting_id, md5(request) AS request, length(request) AS chars FROM done""", "scores", "posts", "cands", "gap_blocks", "pair_kw")
oracle("tailoring_prompts", f"""
WITH parts AS (SELECT candidate_id, seq, string_agg('- ' || keyword || tag, {NL} ORDER BY gap_rank) AS gaps,
  string_agg('- ' || keyword || ' -> nearest bullets: ' || near_long, {NL} ORDER BY gap_rank) FILTER (near_long IS NOT NULL) AS spots FROM gap_lines GROUP BY 1, 2),
 held AS (SELECT candidate_id, seq, string_agg(keyword, ', ' ORDER BY keyword) AS matched FROM pair_kw WHERE match_tier IS NOT NULL GROUP BY 1, 2),
 done AS (SELECT s.candidate_id, s.seq, concat_ws({NL}, {q(prompts.OPENING)}, '', {q(prompts.RULES)}, '', 'ROLE: ' || title || ' at ' || company,
  'ATS match score (my tool): ' || CAST(round_even(round(ats_score, 1), 0) AS INTEGER) || '%', '', 'JOB DESCRIPTION:', regexp_replace(description, '^\\s+|\\s+$', '', 'g'), '',
  'ALREADY COVERED (don''t re-add): ' || coalesce(h.matched, {q(prompts.NO_MATCH)}), '', 'MISSING KEYWORDS (ranked by importance):', coalesce(gaps, {q(prompts.NO_GAP)}), '',
  'LIKELY SPOTS TO UPDATE (my tool''s guess — keyword -> nearest existing bullets):', coalesce(spots, {q(prompts.NO_SPOT)}), '',
  'MY RESUME:', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '', {q(prompts.TASK)}) AS prompt
 FROM scores s JOIN posts USING (seq) JOIN cands c ON c.candidate_id = s.candidate_id LEFT JOIN parts p ON p.candidate_id = s.candidate_id AND p.seq = s.seq
 LEFT JOIN held h ON h.candidate_id = s.candidate_id AND h.seq = s.seq)
SELECT candidate_id, seq AS posting_id, md5(prompt) AS prompt, length(prompt) AS chars FROM done""", "scores", "posts", "cands", "gap_lines", "pair_kw")
