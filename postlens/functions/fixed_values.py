"""Word lists, lookup tables, weights and patterns.

Everything here is plain data that results depend on.  The order of every tuple
matters wherever a rule says "first hit wins".
"""

# --- fixed values: URLs -----------------------------------------------------

TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gh_src", "gh_jid", "lever-source", "lever-origin", "source", "src", "ref",
    "referrer", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "trk",
    "trackingId", "_ga",
)

MULTI_PART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "co.jp", "co.kr", "co.nz",
    "co.za", "com.au", "com.br", "com.sg", "com.mx", "com.tr",
)

BOARD_HOSTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com")

FILTER_PARAMS = (
    "keywords", "q", "query", "search", "location", "category", "department", "facets",
)

# --- fixed values: dates ----------------------------------------------------

POSTED_PREFIX = r"(?i)^\s*(posted|published|listed|added|created|updated|date)\s*(on|:)?\s*"
TODAY_WORDS = ("today", "just posted", "new", "just now", "now")
RELATIVE_AGE = r"(\d+)\+?\s*(second|minute|hour|day|week|month|year)s?\s*ago"
WITHIN_LAST = r"(in the last|within|past)\s+(\d+)\s+(day|week|month)s?"
UNIT_DAYS = {
    "second": 0.0, "minute": 0.0, "hour": 0.0, "day": 1.0, "week": 7.0,
    "month": 30.44, "year": 365.25,
}
EPOCH_MILLIS_FROM = 100_000_000_000
EPOCH_MIN_DIGITS = 9
MAX_AGE_YEARS = 5

# --- fixed values: locations ------------------------------------------------

REMOTE_WORDS = ("remote", "work from home", "wfh", "telecommute", "anywhere", "virtual")
HYBRID_WORDS = ("hybrid", "flexible", "partially remote", "part remote")
ONSITE_WORDS = ("on site", "onsite", "in office")
HINT_REMOTE_WORDS = ("remote", "telecommute", "anywhere")
HINT_HYBRID_WORDS = ("hybrid",)
HINT_ONSITE_WORDS = ("onsite", "on site", "in office")

PLACEHOLDER_LOCATIONS = (
    "multiple locations", "various", "several locations", "worldwide", "global",
    "any location", "tbd", "not specified",
)

COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States",
    "united states": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "united kingdom": "United Kingdom",
    "great britain": "United Kingdom", "england": "United Kingdom",
    "scotland": "United Kingdom", "wales": "United Kingdom",
    "northern ireland": "United Kingdom",
    "india": "India", "canada": "Canada", "australia": "Australia",
    "germany": "Germany", "deutschland": "Germany", "france": "France",
    "spain": "Spain", "italy": "Italy", "netherlands": "Netherlands",
    "the netherlands": "Netherlands", "ireland": "Ireland", "poland": "Poland",
    "portugal": "Portugal", "sweden": "Sweden", "norway": "Norway",
    "denmark": "Denmark", "finland": "Finland", "switzerland": "Switzerland",
    "austria": "Austria", "belgium": "Belgium", "singapore": "Singapore",
    "japan": "Japan", "china": "China", "brazil": "Brazil", "mexico": "Mexico",
    "israel": "Israel", "uae": "United Arab Emirates",
    "united arab emirates": "United Arab Emirates",
    "south africa": "South Africa", "new zealand": "New Zealand",
}

US_STATE_CODES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il",
    "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt",
    "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri",
    "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
)

LOCATION_SEPARATORS = r"\s*(?:,|\||/|•|;|–|—| - )\s*"

# --- fixed values: salaries -------------------------------------------------

CURRENCY_CODES = (
    "USD", "EUR", "GBP", "INR", "CAD", "AUD", "SGD", "CHF", "SEK", "NOK", "DKK",
    "PLN", "JPY", "CNY", "BRL", "MXN", "ZAR", "AED", "NZD", "ILS",
)
# Two-character symbols come first so that "C$" is not read as "$".
CURRENCY_SYMBOLS = (
    ("C$", "CAD"), ("A$", "AUD"), ("R$", "BRL"), ("$", "USD"), ("£", "GBP"),
    ("€", "EUR"), ("₹", "INR"), ("¥", "JPY"), ("₽", "RUB"), ("₩", "KRW"),
)
SALARY_PERIODS = (
    ("hour", r"\b(per\s+hour|/\s*(hr|hour)|hourly|an hour)\b"),
    ("day", r"\b(per\s+day|/\s*day|daily|a day)\b"),
    ("week", r"\b(per\s+week|/\s*w(k|eek)|weekly)\b"),
    ("month", r"\b(per\s+month|/\s*mo(nth)?|monthly|a month|pm)\b"),
    ("year", r"\b(per\s+(annum|year)|/\s*(yr|year)|annual(ly)?|p\.?a\.?|a year)\b"),
)
SALARY_AMOUNT = r"((?:\d{1,3}(?:[.,\s]\d{2,3})+|\d+(?:\.\d+)?)\s*[kKmM]?)"
MIN_YEARLY_AMOUNT = 1_000
MIN_IMPLIED_YEARLY = 10_000
MAX_AMOUNT = 100_000_000
PERIODS_PER_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}

# --- fixed values: employment, seniority, skills ----------------------------

EMPLOYMENT_WORDS = (
    ("internship", ("intern", "internship", "industrial trainee", "co op", "coop")),
    ("contract", ("contract", "contractor", "freelance", "b2b", "consultant", "fixed term")),
    ("temporary", ("temporary", "temp", "seasonal", "casual")),
    ("part_time", ("part time", "parttime")),
    ("full_time", ("full time", "fulltime", "permanent", "regular")),
)

SENIORITY_WORDS = (
    ("director", ("director", "vp", "vice president", "head of", "chief")),
    ("principal", ("principal", "distinguished", "fellow")),
    ("manager", ("manager", "management", "supervisor")),
    ("staff", ("staff", "senior staff")),
    ("lead", ("lead", "leader", "tech lead", "team lead")),
    ("senior", ("senior", "sr", "snr", "experienced", "iii", "iv")),
    ("intern", ("intern", "internship", "trainee", "apprentice")),
    ("junior", ("junior", "jr", "graduate", "entry level", "associate", "i", "ii")),
)
STAFF_JOB_FAMILIES = ("member of technical staff", "technical staff", "staff nurse")

LADDER_SUFFIX = (
    r"(?iU)(?:engineer|developer|scientist|analyst|designer|sde|mts|swe)\s*[.\-–]?\s*"
    r"(\b[1-6]\b|\b(?:i{1,3}|iv|v)\b)(?![a-z0-9])"
)
LADDER_LEVELS = {
    "1": "junior", "i": "junior", "2": "mid", "ii": "mid", "3": "senior",
    "iii": "senior", "4": "staff", "iv": "staff", "5": "principal",
    "v": "principal", "6": "principal",
}

ROLE_PHRASE = (
    r"(?iU)\b(senior|sr|staff|principal|lead|junior|jr|associate|entry[- ]level)\b"
    r"[\s\w]{0,24}?\b(?:engineer|developer|scientist|architect|analyst|designer|"
    r"manager|programmer|consultant|specialist)\b"
)
LEVEL_WORD = r"(?iu)senior|sr|staff|principal|lead|junior|jr|associate|entry"
PHRASE_LEVELS = {
    "senior": "senior", "sr": "senior", "staff": "staff", "principal": "principal",
    "lead": "lead", "junior": "junior", "jr": "junior", "associate": "junior",
    "entry level": "junior",
}

YEARS_OF_EXPERIENCE = (
    r"(?iU)(\d{1,2})\s*(?:\+|-|–|—|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\s*"
    r"(?:of\s+)?(?:[a-z]+\s+){0,3}?(?:experience|exp)\b"
)
YEARS_MENTIONED = (
    r"(?iU)(\d{1,2})\s*(?:\+|-|–|—|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\b"
    r"(?!\W{0,3}(?:ago|old)\b)"
)
MAX_YEARS_ASKED = 40

SENIORITY_RANK = {
    "intern": 0, "junior": 1, "mid": 2, "unknown": 2, "senior": 3, "lead": 4,
    "staff": 4, "manager": 5, "principal": 5, "director": 6,
}
FREQUENCY_MINUTES = {"hourly": 60, "daily": 1_440, "weekly": 10_080}

SKILLS = (
    "python", "java", "javascript", "typescript", "go", "golang", "rust", "c++",
    "c#", "ruby", "php", "scala", "kotlin", "swift", "sql", "bash", "r",
    "react", "angular", "vue", "svelte", "next.js", "node.js", "express",
    "django", "flask", "fastapi", "spring", "spring boot", "spring mvc",
    "rails", "laravel", ".net", "graphql", "rest api", "grpc",
    "aws", "azure", "gcp", "lambda", "s3", "ec2", "dynamodb", "cloudformation",
    "terraform", "kubernetes", "docker", "jenkins", "ci/cd", "github actions",
    "ansible", "helm", "prometheus", "grafana", "datadog",
    "postgresql", "postgres", "mysql", "mongodb", "redis", "elasticsearch",
    "cassandra", "kafka", "rabbitmq", "snowflake", "bigquery", "spark",
    "hadoop", "airflow", "dbt", "etl",
    "machine learning", "deep learning", "nlp", "pytorch", "tensorflow",
    "scikit-learn", "pandas", "numpy", "llm", "computer vision",
    "microservices", "system design", "distributed systems", "agile", "scrum",
    "tdd", "unit testing", "linux", "git", "oauth", "kubernetes operators",
)

# --- fixed values: posting plausibility -------------------------------------

CHROME_PHRASES = (
    "view all", "see all", "learn more", "read more", "apply now", "sign in",
    "log in", "search jobs", "all jobs", "back to", "see full", "view details",
    "role description", "full description", "next page", "previous", "cookie",
    "privacy policy", "terms of", "home",
)
ROLE_WORDS = (
    "engineer", "developer", "manager", "analyst", "designer", "scientist",
    "specialist", "consultant", "director", "lead", "architect", "administrator",
    "coordinator", "associate", "intern", "officer", "executive", "technician",
    "accountant", "recruiter", "nurse", "teacher", "sales", "marketing",
    "product", "research", "support", "operations", "counsel", "assistant",
)
TITLE_LENGTHS = (3, 160)

# --- fixed values: page flags and platform markers --------------------------

SPA_MARKERS = (
    "__next_data__", 'id="root"', "id='root'", 'id="__nuxt"', "ng-version",
    "data-reactroot",
)
BLOCK_MARKERS = (
    "are you a human", "verify you are human", "cf-browser-verification",
    "checking your browser", "access denied", "request unsuccessful", "incapsula",
    "px-captcha",
)
WEAK_BLOCK_MARKERS = ("captcha", "recaptcha", "bot detection", "unusual traffic")
LOW_TEXT_VOLUME = 2_000
TEXT_COST_PER_TAG = 12

REGISTRY_ORDER = (
    "greenhouse", "lever", "apple", "ashby", "eightfold", "uber", "phenom",
    "workday", "smartrecruiters", "successfactors", "taleo", "custom_react",
    "generic_html",
)
HOST_MARKERS = {
    "greenhouse": ("greenhouse.io",),
    "lever": ("lever.co", "jobs.lever.co"),
    "apple": ("jobs.apple.com",),
    "ashby": ("ashbyhq.com",),
    "eightfold": ("eightfold.ai",),
    "uber": ("jobs.uber.com",),
    "phenom": ("phenompeople.com",),
    "workday": ("myworkdayjobs.com", "myworkdaysite.com"),
    "smartrecruiters": ("smartrecruiters.com",),
    "successfactors": (
        "successfactors.com", "successfactors.eu", "sapsf.com", "sapsf.eu", "jobs.sap.com",
    ),
    "taleo": ("taleo.net", "tbe.taleo.net"),
}
BODY_MARKERS = {
    "greenhouse": ("greenhouse.io/embed/job_board", "boards-api.greenhouse.io", "grnhse_app"),
    "lever": ("api.lever.co", "lever-jobs", 'data-qa="posting"'),
    "apple": ("jobs.apple.com", "apple-jobs"),
    "ashby": ("ashbyhq.com", "_ashby_embed"),
    "eightfold": ("eightfold", "/api/pcsx", "pcsx"),
    "phenom": ("phapp.ddo", "phenompeople", "ph-search-results"),
    "workday": ("myworkdayjobs.com", "wday/cxs", "wd-airbrake"),
    "smartrecruiters": ("smartrecruiters", "sr-jobs"),
    "successfactors": ("successfactors", "sapsf", "jobsearchresultsform"),
    "taleo": ("careersection", "taleo", "oracletaleocwsv2"),
}

BOARD_TOKEN_PATTERNS = {
    "greenhouse": (
        r"""greenhouse\.io/embed/job_board(?:/js)?\?(?:[^"'&]*&)?for=([\w.-]+)""",
        r"api\.greenhouse\.io/v1/boards/([\w.-]+)",
        r"(?:job-)?boards(?:\.[a-z]{2})?\.greenhouse\.io/(?!embed(?:/|\?|$))([\w.-]+)",
    ),
    "lever": (
        r"jobs\.(?:eu\.)?lever\.co/([\w.-]+)",
        r"api\.lever\.co/v0/postings/([\w.-]+)",
    ),
    "ashby": (
        r"jobs\.ashbyhq\.com/([\w.-]+)",
        r"api\.ashbyhq\.com/posting-api/job-board/([\w.-]+)",
    ),
    "smartrecruiters": (
        r"jobs\.smartrecruiters\.com/([\w.-]+)",
        r"careers\.smartrecruiters\.com/([\w.-]+)",
        r"api\.smartrecruiters\.com/v1/companies/([\w.-]+)",
    ),
}

# --- fixed values: listing regions ------------------------------------------

LISTING_TAGS = ("ul", "ol", "div", "section", "table", "tbody", "main")
POSTING_HREF = (
    r"(?i)/(job|jobs|career|careers|position|positions|opening|openings|vacancy|"
    r"vacancies|requisition|posting|details)[/?#-]"
)
LISTING_HINT = r"(?i)job|position|opening|vacancy|posting|career|role|opportunit"
SCREEN_READER_CLASSES = (
    "a11y", "sr-only", "visually-hidden", "screen-reader-text", "visuallyhidden",
)
VALUE_ATTRIBUTES = ("datetime", "content", "title", "aria-label", "value")

# --- fixed values: embedded state -------------------------------------------

STATE_VARIABLES = (
    "__INITIAL_STATE__", "__NUXT__", "__PRELOADED_STATE__", "__APP_STATE__",
)
TITLE_KEYS = ("title", "name", "jobTitle", "text", "positionTitle", "displayName")
URL_KEYS = (
    "url", "absolute_url", "hostedUrl", "applyUrl", "jobUrl", "link", "externalPath",
    "canonicalUrl", "detailUrl", "applyLink",
)
LOCATION_KEYS = (
    "location", "locationName", "locationsText", "city", "office", "primaryLocation",
    "jobLocation",
)
LOCATION_NAME_KEYS = ("name", "text", "displayName", "city", "locationName")
ID_KEYS = (
    "id", "jobId", "requisitionId", "externalId", "uuid", "refNumber", "contestNo", "reqId",
)
DATE_KEYS = (
    "postedAt", "postedOn", "postedDate", "datePosted", "publishedAt", "createdAt",
    "updated_at", "releasedDate", "firstPublished",
)
DESCRIPTION_KEYS = (
    "description", "descriptionPlain", "jobDescription", "content", "descriptionHtml",
    "summary",
)

# --- fixed values: limits, weights and thresholds ---------------------------

TITLE_LIMIT = 512
URL_LIMIT = 2_048
LOCATION_LIMIT = 512
SHORT_TEXT_LIMIT = 255
HASH_VERSION = "1"

MIN_CONFIDENCE = 0.6
MIN_POSTINGS = 1
MATCH_THRESHOLD = 0.6
SHORTLIST_FLOOR = 0.6
SHORTLIST_SIZE = 25
ENRICH_SIZE = 40
RELEARN_AFTER_FAILURES = 3
KEEP_INACTIVE_VERSIONS = 10
MAX_BACKOFF_MINUTES = 10_080
MAX_COMPANY_FAILURES = 10
STALE_AFTER_DAYS = 7
RETRY_ATTEMPTS = 3
RETRY_LIMIT = 100
DUE_LIMIT = 500
BREAKER_FAILURES = 5
BREAKER_COOLDOWN_SECONDS = 300
REQUESTS_PER_MINUTE = 20
DEFAULT_PRICE_IN = 3.00
DEFAULT_PRICE_OUT = 15.00
DURATION_BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 45.0, 90.0, 180.0)
TIER_ORDER = ("api", "embedded_json", "css_selector", "xpath", "llm")

# --- fixed values: selector sets per platform, in the order they are tried ----

def _set(container, title, url=None, **fields):
    return {"container": container, "title": title, "url": url, **fields}


BUILTIN_SELECTORS = {
    "generic_html": [
        _set("li[class*='job'], li[class*='position'], li[class*='vacancy']", "a, h2, h3", "a",
                    location="[class*='location']", posted_at="time, [class*='date']"),
        _set("div[class*='job-list-item'], div[class*='job-card'], div[class*='job-result'], "
                    "div[class*='job-tile'], article[class*='job'], div[class*='opening-item']",
                    "h2 a, h3 a, h4 a, a[class*='title'], h2, h3, a", "h2 a, h3 a, h4 a, a",
                    location="[class*='location-sub'], [class*='location'], [class*='city']",
                    posted_at="[class*='posted'], [class*='date'], time",
                    department="[class*='team'], [class*='department'], [class*='category']"),
        _set("tr[class*='job'], tbody tr:has(a[href*='job'])", "td:first-child a, a", "a",
                    location="td:nth-of-type(2)", posted_at="td:nth-of-type(3)"),
        _set("a[href*='/job/'], a[href*='/jobs/'], a[href*='/careers/'], a[href*='/position'], "
                    "a[href*='/vacancy'], a[href*='/details/'], a[href*='/opening']", "self", "self"),
    ],
    "custom_react": [
        _set("[data-testid*='job'], [data-test*='job'], [class*='job-card']",
                    "[class*='title'], h2, h3, a", "a", location="[class*='location']",
                    posted_at="time, [class*='date']"),
        _set("li[class*='opening'], div[class*='opening'], article[class*='job']", "h2, h3, a", "a",
                    location="[class*='location'], [class*='office']", posted_at="time"),
    ],
    "successfactors": [
        _set("li.jobTitle, div.jobTitle", "a.jobTitle-link, a", "a.jobTitle-link, a",
                    location="span.jobLocation, .jobFacility", posted_at="span.jobDate, .jobDate"),
        _set("tr.data-row", "a.jobTitle-link, td.colTitle a, a", "a.jobTitle-link, td.colTitle a, a",
                    location="span.jobLocation, td.colLocation", posted_at="span.jobDate, td.colDate"),
        _set("div.searchResultItem, li.job-tile", "a[href*='/job/'], h3 a, a", "a[href*='/job/'], h3 a, a",
                    location=".jobLocation, .job-location", posted_at=".jobDate, .job-date"),
    ],
    "taleo": [
        _set("tr.oracletaleocwsv2-accordion-head, #jobList tbody tr",
                    "a.oracletaleocwsv2-head-link, td:nth-of-type(1) a, a",
                    "a.oracletaleocwsv2-head-link, td:nth-of-type(1) a, a",
                    location="td.oracletaleocwsv2-accordion-head-info span, td:nth-of-type(2)",
                    posted_at="td:nth-of-type(3)"),
        _set("li.jobResultItem, div.job-tile", "a.jobtitle, h3 a, a", "a.jobtitle, h3 a, a",
                    location=".joblocation, .job-location", posted_at=".jobdate, .job-date"),
    ],
    "apple": [
        _set("div[class*='job-list-item']", "h3 a, a[class*='link-inline']", "h3 a, a[class*='link-inline']",
                    location="[class*='location-sub'], [class*='job-title-location']",
                    posted_at="[class*='job-posted-date']", department="[class*='team-name']"),
    ],
}

# --- fixed values: what is no part of a listing ---------------------------------

DROPPED_TAGS = (
    "script", "style", "noscript", "svg", "path", "iframe", "canvas",
    "picture", "source", "video", "audio", "link", "meta", "template",
)
DROPPED_ROLES = ("banner", "contentinfo", "navigation", "search", "complementary")
LANDMARKS = ("nav", "footer", "header")     # dropped unless they hold posting links
HINT_ATTRIBUTES = ("data-testid", "data-test", "aria-label")
