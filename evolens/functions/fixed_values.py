"""Fixed values.

Results depend on these being exactly what they are: thresholds, word lists,
file names, headings and message formats.
"""

# History and feature defaults.
MIN_COMMITS = 5
RECENT_WINDOW = 20
MAX_COMMITS = 500
TOP_K = 10

# Thresholds of the rule labels.
CHURN_THRESHOLDS = (0.3, 0.7)
CC_TREND_THRESHOLD = 0.01
MI_TREND_THRESHOLD = 0.1
IMPORTS_TREND_THRESHOLD = 0.05
VOLATILITY_THRESHOLD = 1.0
RECENT_COMPARISON_THRESHOLD = 0.2

# Label words, from low to high.
CHURN_LABELS = ("low", "moderate", "high")
TREND_LABELS = ("decreasing", "stable", "increasing")
VOLATILITY_LABELS = ("stable", "oscillating")
COMPARISON_LABELS = ("improving", "unchanged", "regressing")

# The parts of a cluster's name, from low to high.
CLUSTER_CHURN = ("low churn", "moderate churn", "high churn")
CLUSTER_COMPLEXITY = ("declining complexity", "stable complexity", "growing complexity")
CLUSTER_VOLATILITY = "high volatility"

# Wording of the anomaly, churn and complexity context.
EXTREME_PERCENT = 5
ATYPICAL_PERCENT = 20
EXTREME_CONTEXT = "Top %d%% most atypical (extreme outlier)"
ATYPICAL_CONTEXT = "Top %d%% most atypical"
PERCENTILE_CONTEXT = "%dth percentile"
CHURN_BANDS = (
    (0.8, "lower than cluster median (more stable)"),
    (1.2, "similar to cluster median"),
    (2.0, "moderately higher than cluster median"),
)
CHURN_ABOVE = "significantly higher than cluster median"
CHURN_CONTEXT = "%s× cluster median (%s)"
MEDIAN_SLOPE_FLOOR = 1e-3
COMPLEXITY_CONTEXT = "%sx %s than cluster median"
COMPLEXITY_PACE = ("slower", "faster")
SLOPE_CONTEXT = "slope %s"
CHURN_SIGNAL = "%sx cluster median"
TREND_SIGNAL = "%s (slope: %s)"
COMPONENT_LINE = "%s/: %d files, avg anomaly %.2f, clusters [%s]"
SIGNAL_LINE = "- **%s**: %s"
SUMMARY_LINE = "**%s**: %s"

# Clustering and anomaly scoring.
K_MIN = 3
K_MAX = 10
RESTARTS = 10
SEED = 42
TREES = 100
TREE_SAMPLE = 256
CONTAMINATION = 0.1

# The 20 features of an entity, in order.
FEATURE_NAMES = (
    "churn_rate",
    "mean_abs_loc_delta",
    "mean_abs_cc_delta",
    "mean_abs_imports_delta",
    "mean_abs_func_delta",
    "std_cc_after",
    "std_imports_after",
    "std_mi_after",
    "cc_trend",
    "mi_trend",
    "imports_trend",
    "mean_cc_after",
    "mean_mi_after",
    "mean_imports_after",
    "mean_func_after",
    "recent_cc_trend",
    "recent_mi_trend",
    "recent_imports_trend",
    "recent_cc_volatility",
    "recent_imports_volatility",
)

# File suffixes.
SOURCE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx")
HEAD_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".java")
PYTHON_SUFFIXES = (".py",)
JS_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")

# File type tests, applied in the order tests, docs, deps, code.
TEST_DIRS = ("tests", "test")
TEST_PREFIX = "test_"
TEST_SUFFIXES = (
    "_test.py",
    ".spec.ts",
    ".spec.tsx",
    ".test.ts",
    ".test.tsx",
    ".test.js",
    ".test.jsx",
)
DOC_DIRS = ("docs",)
DOC_SUFFIXES = (".md", ".rst", ".txt", ".adoc")
DEP_DIRS = ("requirements",)
DEP_FILENAMES = (
    "requirements.txt",
    "requirements.in",
    "package.json",
    "package-lock.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "pyproject.toml",
    "setup.cfg",
    "setup.py",
    "tox.ini",
    "pipfile",
    "pipfile.lock",
    "poetry.lock",
    "cargo.toml",
    "cargo.lock",
    "pom.xml",
    "build.gradle",
)
DEP_SUFFIXES = (".lock", ".toml", ".yaml", ".yml", ".cfg", ".ini")

# Text caps and their markers.
MAX_DIFF_CHARS = 8000
MAX_SNAPSHOT_CHARS = 8000
PROMPT_CONTENT_CHARS = 4000
PROMPT_DIFF_CHARS = 3000
CONTENT_MARKER = "\n\n[... content truncated ...]"
DIFF_MARKER = "\n\n[... diff truncated ...]"
NO_CONTENT = "[Content not available]"
NO_DIFF = "[No diff available]"
NO_DIFFS = "No diffs available for this file."
NO_MESSAGE = "No message"
MIN_DIFF_CHARS = 50
DOC_MESSAGE_CHARS = 200
DOC_DIFF_CHARS = 500
MEANINGFUL_CHARS = 100
FALLBACK_CHARS = 200

# The layout of a change document and of an entity query (%s, %.3f as in printf).
DIFF_DOCUMENT = "Change in %s\nRepository: %s\nCommit: %s\nMessage: %s\nDiff preview:\n%s"
ENTITY_QUERY = (
    "Find code changes related to:\nFile: %s\nRepository: %s\n"
    "Behavior: %s, anomaly score %.3f"
)

# Commit references in text.
HASH_BODY = "[a-f0-9]{7,40}"
HASH_MASK = "[commit]"

# Validation of an explanation.
MAX_WORDS = 250
REQUIRED_SECTIONS = (
    "Why This File Stands Out",
    "Evidence from Metrics",
    "Evidence from Code Changes",
    "What Makes This Unusual",
)
BANNED_PHRASES = (
    "has undergone",
    "has been modified",
    "has experienced",
    "suggests that",
    "appears to",
    "seems to indicate",
    "significant changes",
    "substantial modifications",
    "development focused on",
    "efforts were made",
)
PHRASE_REPLACEMENTS = (
    ("suggests that", "reflects"),
    ("appears to", "shows"),
    ("seems to indicate", "shows"),
    ("may have", "likely"),
    ("has undergone", "experienced"),
    ("has been modified", "changed"),
    ("unusual combination of", "combines"),
    ("unique set of characteristics", "unique behavior"),
    ("interesting patterns", "patterns"),
)
WORD_LIMIT_VIOLATION = "Exceeded word limit: %d words (max 250)"
SECTION_VIOLATION = "Missing required section: '%s'"
PHRASE_VIOLATION = "Contains banned pattern: '%s'"
COMMIT_VIOLATION = "References unknown commit: %s"

# Headings read back from explanations, and their default.
SIGNAL_HEADING = "Why This File Stands Out"
SUMMARY_HEADING = "Change Summary"
NO_SIGNAL = "(No signal extracted)"
ERROR_PREFIX = "Error generating explanation: "

# Modes of the selection study.
MODE_FREQUENCY = "LLM-only"
MODE_ANOMALY = "Hybrid"

# Characters removed when text is stripped, and when a script line is trimmed.
_SPACES = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85" + _SPACES
SCRIPT_WHITESPACE = " \t\n\r\f\x0b\ufeff" + _SPACES
