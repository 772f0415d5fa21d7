"""Parameters that the registered queries and their SQL share."""

#: Five days: the test data's events are sparse.
WINDOW_MS = 432_000_000
SLIDE_WINDOW_MS, SLIDE_STEP_MS = 432_000_000, 172_800_000
#: A step of one tenth of the window, for metrics in overlapping epochs.
FINE_STEP_MS = 43_200_000
MIN_CONFIDENCE = 0.5
SINCE_ID = 500
RECENT_ROWS = 50
PROPOSALS = [
    {"name": "search with a query", "pattern": r"/search\?q=", "flags": "i"},
    {"name": "inventory", "pattern": r"/api/inventory", "flags": "i"},
    {"name": "root", "pattern": "^/$", "flags": "", "target": "PATH_THREATS"},
    {"name": "union", "pattern": r"union\s+select", "target": "BODY_THREATS"},
]
#: The network and the campaign type that the catalog's checks name.
KNOWN_ASN = 396982
SIBLING = "rotating-ua-env-sweep"
PAGE_ENDS = ["", "/.ssh/id", "/vendor/phpunit/x", "/security.txt", "/plain"]
