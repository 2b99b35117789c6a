"""Fixed values the results depend on."""

# Hosts of the known job boards and the adapter that reads each.
BOARD_HOSTS = {
    "jobs.ashbyhq.com": "ashby",
    "boards.greenhouse.io": "greenhouse",
    "job-boards.greenhouse.io": "greenhouse",
    "jobs.lever.co": "lever",
}
ADAPTERS = ("ashby", "greenhouse", "lever", "jsonld")

# Text that marks a page of a job aggregator, and its platform name.
AGGREGATORS = {"getro.com": "getro", "consider.com": "consider"}

# Sheet section headings and the source category each one opens.
SHEET_SECTIONS = {
    "VC FIRM": "vc_portfolio",
    "JOBS NEWSLETTERS": "newsletter",
    "VC FELLOWSHIPS / TALENT NETWORKS": "talent_network",
    "THE A16Z SPEEDRUN TALENT NETWORK": "talent_network",
}
SHEET_URL_HEADINGS = ("JOB AGGREGATOR URL", "URL")

# Allowed values of the enumerated columns.
CATEGORIES = (
    "vc_portfolio",
    "company_career_page",
    "ats_job_board",
    "newsletter",
    "talent_network",
    "user_added",
)
SOURCE_ADAPTERS = ("auto", "ashby", "greenhouse", "lever", "jsonld", "unsupported")
FREQUENCIES = ("hourly", "every_6_hours", "twice_daily", "daily", "weekly", "manual")
HIDDEN_DECISIONS = ("irrelevant", "archived")

# Query keys whose value is a secret in an error text.
SECRET_KEYS = (
    "access_token",
    "refresh_token",
    "id_token",
    "csrf_token",
    "session_token",
    "auth_token",
    "client_secret",
    "secret_key",
    "private_key",
    "api_key",
    "apikey",
    "token",
    "secret",
    "password",
    "passwd",
    "pwd",
    "auth",
    "key",
    "session",
    "signature",
    "sig",
    "credential",
)

# The page size of a board and what a list call gives unless asked otherwise.
PAGE_SIZE = 100
JOBS_LISTED = 50
RUNS_LISTED = 20
TASKS_LISTED = 200

# Letters whose full case folding reaches ASCII where lower-casing does not.
CASE_FOLDS = {
    "\u00df": "ss",
    "\u1e9e": "ss",
    "\u017f": "s",
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "st",
    "\ufb06": "st",
    "\u0149": "\u02bcn",
    "\u01f0": "j\u030c",
    "\u1e96": "h\u0331",
    "\u1e97": "t\u0308",
    "\u1e98": "w\u030a",
    "\u1e99": "y\u030a",
    "\u1e9a": "a\u02be",
}
