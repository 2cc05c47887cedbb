"""Word lists, lookup tables and constants of the analysis.

Everything here is data. Each value must be exactly as stated for results to be
right, so the lists are written out plainly and in their natural order.
"""
from __future__ import annotations

# --- fixed values: posting lifecycle -----------------------------------------
STATUSES = ["to_apply", "applied", "interviewing", "offer", "rejected", "archived"]

# --- fixed values: skill taxonomy --------------------------------------------
KNOWN_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "golang",
    "rust", "ruby", "php", "scala", "kotlin", "swift", "r", "matlab", "sql",
    "bash", "shell", "perl", "objective-c", "dart", "elixir", "haskell",
    "react", "react native", "next.js", "vue", "vue.js", "angular", "svelte",
    "redux", "tailwind", "html", "css", "sass", "webpack", "vite", "graphql",
    "rest", "rest api", "restful", "grpc", "websocket",
    "node.js", "express", "django", "flask", "fastapi", "spring", "spring boot",
    ".net", "asp.net", "rails", "ruby on rails", "laravel", "nestjs",
    "machine learning", "deep learning", "nlp", "computer vision", "pytorch",
    "tensorflow", "keras", "scikit-learn", "pandas", "numpy", "spark",
    "hadoop", "airflow", "kafka", "data pipeline", "etl", "data engineering",
    "llm", "transformers", "hugging face", "data analysis", "data science",
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s",
    "terraform", "ansible", "jenkins", "ci/cd", "cicd", "github actions",
    "gitlab", "circleci", "linux", "unix", "nginx", "microservices",
    "serverless", "lambda", "ec2", "s3", "helm", "prometheus", "grafana",
    "postgresql", "postgres", "mysql", "mongodb", "redis", "elasticsearch",
    "dynamodb", "cassandra", "sqlite", "snowflake", "bigquery", "redshift",
    "agile", "scrum", "kanban", "tdd", "oop", "system design", "distributed systems",
    "git", "jira", "unit testing", "integration testing", "object oriented",
    "algorithms", "data structures", "api design", "concurrency",
]

# --- fixed values: term -> canonical term (one hop, not transitive) -----------
ALIASES = {
    "k8s": "kubernetes", "js": "javascript", "ts": "typescript",
    "postgres": "postgresql", "golang": "go", "cicd": "ci/cd",
    "ml": "machine learning", "gcp": "google cloud", "oop": "object oriented",
    "restful": "rest api", "rest": "rest api", "react.js": "react",
    "node": "node.js", "vuejs": "vue", "spring boot": "spring",
    "ruby on rails": "rails", "scikit-learn": "scikit learn",
}

# --- fixed values: words never kept as a discovered term ----------------------
FILLER_WORDS = """
a an the and or but if then else for while of to in on at by with from as is are
was were be been being do does did have has had you your we our they their he she
it its this that these those will would can could should may might must not no yes
about into over under out up down more most some any all each other such than too
very just also team teams work working experience years year role position job
company strong ability able across within including etc via using use used based
who whom which what when where why how our us who’s you’ll we’re
""".split()
STRUCTURE_WORDS = [
    "requirements", "requirement", "responsibilities", "responsibility",
    "qualifications", "qualification", "bonus", "plus", "nice", "preferred",
    "desired", "ideally", "must", "skills", "required", "experience",
    "minimum", "preferences", "role", "about", "overview", "benefits",
]

# --- fixed values: Spark's own English stop list, without the entries that hold
# an apostrophe (no token of ours can contain one) -----------------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now cannot could ought would
""".split()

# --- fixed values: section markers --------------------------------------------
REQUIRED_MARKERS = [
    "requirement", "require", "must have", "must-have", "qualification", "you have",
    "minimum", "responsibilit", "what you", "we're looking", "were looking", "need to have",
]
PREFERRED_MARKERS = [
    "nice to have", "nice-to-have", "preferred", "bonus", "a plus", "is a plus",
    "desired", "good to have", "pluses", "would be great", "ideally",
]

# --- fixed values: start-date vocabulary --------------------------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11,
    "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
SEASONS = {"spring": 4, "summer": 6, "fall": 9, "autumn": 9, "winter": 1}

# --- fixed values: geography; the order of COUNTRIES decides ties --------------
US_STATES = """
AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV
NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC
""".split()
CA_PROVINCES = "ON QC BC AB MB SK NS NB NL PE".split()
COUNTRIES = {
    "united states": "United States", "usa": "United States", "u.s.a": "United States",
    "u.s.": "United States", "america": "United States",
    "canada": "Canada", "united kingdom": "United Kingdom", "u.k.": "United Kingdom",
    "uk": "United Kingdom", "england": "United Kingdom", "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "ireland": "Ireland", "germany": "Germany", "france": "France", "spain": "Spain",
    "portugal": "Portugal", "italy": "Italy", "netherlands": "Netherlands",
    "poland": "Poland", "romania": "Romania", "ukraine": "Ukraine", "sweden": "Sweden",
    "switzerland": "Switzerland", "austria": "Austria", "belgium": "Belgium",
    "india": "India", "pakistan": "Pakistan", "bangladesh": "Bangladesh",
    "vietnam": "Vietnam", "philippines": "Philippines", "indonesia": "Indonesia",
    "malaysia": "Malaysia", "singapore": "Singapore", "thailand": "Thailand",
    "china": "China", "hong kong": "Hong Kong", "taiwan": "Taiwan", "japan": "Japan",
    "south korea": "South Korea", "korea": "South Korea",
    "australia": "Australia", "new zealand": "New Zealand",
    "brazil": "Brazil", "mexico": "Mexico", "argentina": "Argentina", "chile": "Chile",
    "colombia": "Colombia", "nigeria": "Nigeria", "kenya": "Kenya", "egypt": "Egypt",
    "south africa": "South Africa", "israel": "Israel", "turkey": "Turkey",
    "united arab emirates": "United Arab Emirates", "uae": "United Arab Emirates",
    "saudi arabia": "Saudi Arabia",
}

# --- fixed values: filter defaults --------------------------------------------
DEFAULT_BLOCKED_TYPES = [
    "intern", "internship", "co-op", "co op", "coop", "contract", "contractor",
    "part-time", "part time", "temporary", "seasonal", "apprentice",
]
DEFAULT_ENTRY_SIGNALS = [
    "new grad", "new graduate", "graduate", "grad ", "junior", "jr ", "entry level",
    "entry-level", "associate", "university grad", "early career", "campus", "early talent",
]

# --- fixed values: caps and thresholds ----------------------------------------
TRACKER_CAP = 300          # rows kept per tracker list
NGRAM_CAP = 40             # most frequent n-grams of a posting
SALIENT_CAP = 25           # ... of which this many are ranked
SOFT_CAP = 12              # ... of which at most this many become soft keywords
SPOT_CAP = 3               # nearest bullets per missing keyword
SPOT_FLOOR = 0.01          # a bullet at or below this similarity is no spot
THIN_CHARS = 600           # below this a description counts as a summary
BOARD_MIN_CHARS = 200      # accepted board / structured-data text is longer
PAGE_MIN_CHARS = 400       # accepted whole-page text is longer
FUZZY_RATIO = 90           # normalised indel similarity of a near match


def canonical(term: str) -> str:
    """Canonical form of a term that is already lower-case and trimmed."""
    return ALIASES.get(term, term)


# single words found inside multi-word skills: no keywords on their own
SKILL_WORDS = sorted({w for s in KNOWN_SKILLS if " " in s for w in s.split()})
