"""The test tables seen as the library's input tables.

Each adapter is a projection of whole tables, written once for Spark and once as
SQL text (a common table expression of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.session import spread

DIRS = (
    "src/core",
    "src/app",
    "tests/unit",
    "docs",
    "pkg/lib",
    "requirements",
    "Src\\Web",
    "config",
)
SUFFIXES = (".py", ".ts", ".tsx", ".md", ".toml", ".js", ".spec.ts", ".java", "_test.py")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values, key: Column) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.get(choices, (key % len(values)).cast("int"))


def path_of(key: Column) -> Column:
    """A file path made from a number."""
    number = key.cast("string")
    package = F.concat(_pick(DIRS, key), F.lit("/m"), number, F.lit("/package.json"))
    plain = F.concat(
        _pick(DIRS, key),
        F.lit("/m"),
        (key % 10).cast("string"),
        F.lit("/f"),
        number,
        _pick(SUFFIXES, key),
    )
    return F.when(key % 11 == 0, package).otherwise(plain)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def path_sql(key: str) -> str:
    directory = f"({_sql_list(DIRS)})[CAST({key} % {len(DIRS)} AS INTEGER) + 1]"
    suffix = f"({_sql_list(SUFFIXES)})[CAST({key} % {len(SUFFIXES)} AS INTEGER) + 1]"
    number = f"CAST({key} AS VARCHAR)"
    return (
        f"CASE WHEN {key} % 11 = 0 THEN {directory} || '/m' || {number} || '/package.json' "
        f"ELSE {directory} || '/m' || CAST({key} % 10 AS VARCHAR) || '/f' || {number} || {suffix} END"
    )


def _repo(key: str) -> Column:
    return F.concat(F.lit("repo"), (F.col(key) % 3).cast("string"))


def _repo_sql(key: str) -> str:
    return f"'repo' || CAST({key} % 3 AS VARCHAR)"


# --- metric history: events -------------------------------------------------


def history(spark: SparkSession, folder: str) -> DataFrame:
    """metrics with time: one row per event of a user within an event type."""
    user, event = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    unchanged = ((user % 4 == 0) & (event % 5 != 0)) | (event % 3 == 0)
    no_index = (user % 3 == 0) | (k % 7 == 0)
    return table(spark, folder, "events").select(
        F.col("event_type").alias("repo_name"),
        path_of(user).alias("file_path"),
        event.cast("string").alias("commit_hash"),
        F.col("ts").alias("timestamp"),
        (F.floor("value").cast("long") + 50).alias("loc_after"),
        F.when(unchanged, F.lit(0)).otherwise(event % 13 - 6).cast("long").alias("loc_delta"),
        (k / F.lit(10.0)).alias("cc_after"),
        ((event % 9 - 4) / F.lit(4.0)).alias("cc_delta"),
        F.when(no_index, F.lit(None)).otherwise((100 - k).cast("double")).alias("mi_after"),
        (event % 7).alias("imports_after"),
        (event % 3 - 1).alias("imports_delta"),
        (event % 11).alias("func_after"),
        (event % 4 - 1).alias("func_delta"),
    )


HISTORY = f"""history AS (
  SELECT event_type AS repo_name, {path_sql("user_id")} AS file_path,
    CAST(event_id AS VARCHAR) AS commit_hash, ts AS "timestamp",
    CAST(floor(value) AS BIGINT) + 50 AS loc_after,
    CAST(CASE WHEN (user_id % 4 = 0 AND event_id % 5 <> 0) OR event_id % 3 = 0 THEN 0
         ELSE event_id % 13 - 6 END AS BIGINT) AS loc_delta,
    CAST(k AS DOUBLE) / 10 AS cc_after,
    CAST(event_id % 9 - 4 AS DOUBLE) / 4 AS cc_delta,
    CASE WHEN user_id % 3 = 0 OR k % 7 = 0 THEN NULL ELSE CAST(100 - k AS DOUBLE) END AS mi_after,
    event_id % 7 AS imports_after, event_id % 3 - 1 AS imports_delta,
    event_id % 11 AS func_after, event_id % 4 - 1 AS func_delta
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


# --- commit log: orders; changes: lineitem ----------------------------------


def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """A raw log: urgent orders are merges with two parents."""
    key = F.col("o_orderkey")
    parents = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.array(F.md5(key.cast("string")), F.md5((key + 1).cast("string"))),
    ).otherwise(F.array(F.md5(key.cast("string"))))
    return table(spark, folder, "orders").select(
        _repo("o_orderkey").alias("repo_name"),
        key.cast("string").alias("commit_hash"),
        parents.alias("parents"),
        F.concat(F.lit("author "), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").alias("timestamp"),
        F.concat(
            F.lit(" \n"), F.col("o_orderpriority"), F.lit("\nstatus "), F.col("o_orderstatus"), F.lit("\t\n ")
        ).alias("message"),
    )


COMMIT_LOG = f"""commit_log AS (
  SELECT {_repo_sql("o_orderkey")} AS repo_name, CAST(o_orderkey AS VARCHAR) AS commit_hash,
    CASE WHEN o_orderpriority = '1-URGENT'
      THEN [md5(CAST(o_orderkey AS VARCHAR)), md5(CAST(o_orderkey + 1 AS VARCHAR))]
      ELSE [md5(CAST(o_orderkey AS VARCHAR))] END AS parents,
    'author ' || CAST(o_custkey AS VARCHAR) AS author, o_orderdate AS "timestamp",
    o_orderpriority || ' status ' || o_orderstatus AS clean_message
  FROM orders)"""


def single_parent_commits(spark: SparkSession, folder: str) -> DataFrame:
    """The commits table without a cap, for joins."""
    log = commit_log(spark, folder).filter(F.size("parents") == 1)
    return log.select("repo_name", "commit_hash", "author", "timestamp", "message")


def raw_changes(spark: SparkSession, folder: str) -> DataFrame:
    path = path_of(F.col("l_partkey"))
    removed = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").select(
        _repo("l_orderkey").alias("repo_name"),
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        F.when(removed & (F.col("l_linenumber") > 5), F.lit(None)).otherwise(path).alias("a_path"),
        F.when(removed, F.lit("")).otherwise(path).alias("b_path"),
        F.translate("l_returnflag", "NR", "MD").alias("change_type"),
    )


RAW_CHANGES = f"""raw_changes AS (
  SELECT {_repo_sql("l_orderkey")} AS repo_name, CAST(l_orderkey AS VARCHAR) AS commit_hash,
    CASE WHEN l_returnflag = 'R' AND l_linenumber > 5 THEN NULL ELSE {path_sql("l_partkey")} END AS a_path,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE {path_sql("l_partkey")} END AS b_path,
    translate(l_returnflag, 'NR', 'MD') AS change_type
  FROM lineitem)"""


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        _repo("l_orderkey").alias("repo_name"),
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        path_of(F.col("l_partkey")).alias("file_path"),
        F.translate("l_returnflag", "NR", "MD").alias("change_type"),
    )


CHANGES = f"""changes AS (
  SELECT {_repo_sql("l_orderkey")} AS repo_name, CAST(l_orderkey AS VARCHAR) AS commit_hash,
    {path_sql("l_partkey")} AS file_path, translate(l_returnflag, 'NR', 'MD') AS change_type
  FROM lineitem)"""


# --- changes with text: documents -------------------------------------------


def text_changes(spark: SparkSession, folder: str) -> DataFrame:
    """One change per document with its diff and the content after it."""
    doc = F.col("doc_id")
    change_type = (
        F.when(F.col("lang") == "en", "M").when(F.col("lang") == "fr", "A")
        .when(F.col("lang") == "de", "D").otherwise("R")
    )
    return table(spark, folder, "documents").select(
        _repo("doc_id").alias("repo_name"),
        doc.cast("string").alias("commit_hash"),
        path_of(F.floor(doc / 4)).alias("file_path"),
        change_type.alias("change_type"),
        F.when(F.col("n_chars") % 5 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("diff_text"),
        F.col("text").alias("content"),
    )


TEXT_CHANGES = f"""text_changes AS (
  SELECT {_repo_sql("doc_id")} AS repo_name, CAST(doc_id AS VARCHAR) AS commit_hash,
    {path_sql("(doc_id // 4)")} AS file_path,
    CASE lang WHEN 'en' THEN 'M' WHEN 'fr' THEN 'A' WHEN 'de' THEN 'D' ELSE 'R' END AS change_type,
    CASE WHEN n_chars % 5 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS diff_text,
    text AS content
  FROM documents)"""


# --- analysed entities: part ------------------------------------------------

_PART_METRICS = {
    "churn_rate": ("p_size * 37 % 101", 100),
    "mean_abs_loc_delta": ("p_partkey % 97", 8),
    "mean_abs_cc_delta": ("p_partkey % 13", 8),
    "mean_abs_imports_delta": ("p_partkey % 5", 4),
    "mean_abs_func_delta": ("p_partkey % 7", 4),
    "std_cc_after": ("p_size % 30", 16),
    "std_imports_after": ("p_size % 17", 10),
    "std_mi_after": ("p_partkey % 19", 10),
    "cc_trend": ("p_partkey * 7 % 41 - 20", 1000),
    "mi_trend": ("p_partkey % 31 - 15", 50),
    "imports_trend": ("p_partkey % 23 - 11", 100),
    "mean_cc_after": ("p_partkey % 43", 4),
    "mean_mi_after": ("p_partkey % 101", 1),
    "mean_imports_after": ("p_partkey % 29", 2),
    "mean_func_after": ("p_partkey % 37", 2),
    "recent_cc_trend": ("p_partkey * 11 % 41 - 20", 1000),
    "recent_mi_trend": ("p_partkey * 3 % 31 - 15", 50),
    "recent_imports_trend": ("p_partkey * 5 % 23 - 11", 100),
    "recent_cc_volatility": ("p_size * 3 % 30", 16),
    "recent_imports_volatility": ("p_size * 5 % 17", 10),
}


def analysed(spark: SparkSession, folder: str) -> DataFrame:
    """Features, cluster and anomaly score of one entity per part, from its own columns."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return table(spark, folder, "part").select(
        _repo("p_partkey").alias("repo_name"),
        path_of(F.col("p_partkey")).alias("file_path"),
        F.col("p_size").cast("long").alias("n_commits"),
        (F.col("p_size") % 7).cast("int").alias("cluster_id"),
        ((cents % 10001) / F.lit(10000.0)).alias("anomaly_score"),
        *[
            (F.expr(f"CAST({e} AS DOUBLE)") / F.lit(float(d))).alias(n)
            for n, (e, d) in _PART_METRICS.items()
        ],
    )


ANALYSED = f"""analysed AS (
  SELECT {_repo_sql("p_partkey")} AS repo_name, {path_sql("p_partkey")} AS file_path,
    CAST(p_size AS BIGINT) AS n_commits, p_size % 7 AS cluster_id,
    CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 10001 AS DOUBLE) / 10000 AS anomaly_score,
    {", ".join(f"CAST({e} AS DOUBLE) / {d} AS {n}" for n, (e, d) in _PART_METRICS.items())}
  FROM part)"""


def _trend_sql(column: str, threshold: float) -> str:
    return (
        f"CASE WHEN {column} < -CAST({threshold} AS DOUBLE) THEN 'decreasing' "
        f"WHEN {column} > CAST({threshold} AS DOUBLE) THEN 'increasing' ELSE 'stable' END"
    )


def _volatility_sql(column: str) -> str:
    return f"CASE WHEN {column} <= 1 THEN 'stable' ELSE 'oscillating' END"


def _versus_sql(recent: str, past: str) -> str:
    return (
        f"CASE WHEN {past} = 0 THEN (CASE WHEN {recent} = 0 THEN 'unchanged' WHEN {recent} > 0 "
        f"THEN 'regressing' ELSE 'improving' END) "
        f"WHEN abs(({recent} - {past}) / abs({past})) <= CAST(0.2 AS DOUBLE) THEN 'unchanged' "
        f"WHEN {recent} > {past} THEN 'regressing' ELSE 'improving' END"
    )


LABELS = {
    "churn_label": "CASE WHEN churn_rate <= CAST(0.3 AS DOUBLE) THEN 'low' "
    "WHEN churn_rate <= CAST(0.7 AS DOUBLE) THEN 'moderate' ELSE 'high' END",
    "cc_trend_label": _trend_sql("cc_trend", fv.CC_TREND_THRESHOLD),
    "mi_trend_label": _trend_sql("mi_trend", fv.MI_TREND_THRESHOLD),
    "imports_trend_label": _trend_sql("imports_trend", fv.IMPORTS_TREND_THRESHOLD),
    "cc_volatility_label": _volatility_sql("std_cc_after"),
    "imports_volatility_label": _volatility_sql("std_imports_after"),
    "recent_cc_trend_vs_historical": _versus_sql("recent_cc_trend", "cc_trend"),
    "recent_imports_trend_vs_historical": _versus_sql("recent_imports_trend", "imports_trend"),
    "recent_cc_volatility_vs_historical": _versus_sql("recent_cc_volatility", "std_cc_after"),
}

# Needs a table `analysed` (or any table of features) before it.
LABELLED = f"""labelled AS (
  SELECT *, {", ".join(f"{e} AS {n}" for n, e in LABELS.items())} FROM analysed)"""

# Flat analysis rows, named as the flattened record is.
FLAT_COLUMNS = {
    "repo_name": "repo_name",
    "file_path": "file_path",
    "n_commits": "CAST(n_commits AS INTEGER)",
    "cluster_id": "cluster_id",
    "anomaly_score": "round_even(anomaly_score, 4)",
    "churn_label": "churn_label",
    "cc_volatility_label": "cc_volatility_label",
    "imports_volatility_label": "imports_volatility_label",
    **{
        f"raw_{c}": f"round_even({c}, 4)"
        for c in (
            "churn_rate",
            "mean_abs_loc_delta",
            "mean_cc_after",
            "mean_mi_after",
            "mean_imports_after",
            "mean_func_after",
            "std_cc_after",
            "std_imports_after",
        )
    },
    **{f"hist_{m}_value": f"round_even({m}_trend, 6)" for m in ("cc", "mi", "imports")},
    **{f"hist_{m}_label": f"{m}_trend_label" for m in ("cc", "mi", "imports")},
    **{f"recent_{m}_value": f"round_even(recent_{m}_trend, 6)" for m in ("cc", "mi", "imports")},
    "recent_cc_vs_historical": "recent_cc_trend_vs_historical",
    "recent_imports_vs_historical": "recent_imports_trend_vs_historical",
    "volatility_cc": "recent_cc_volatility_vs_historical",
}
FLAT = f"""flat AS (
  SELECT {", ".join(f"{e} AS {n}" for n, e in FLAT_COLUMNS.items())} FROM labelled)"""


# --- explanations: documents ------------------------------------------------


def explanations(spark: SparkSession, folder: str) -> DataFrame:
    """A generated explanation per document with the hashes it was given."""
    doc = F.col("doc_id")

    def digest(offset: int) -> Column:
        return F.md5((doc + offset).cast("string"))

    body = F.concat(
        F.when(doc % 5 == 0, F.lit("Intro\n")).otherwise(
            F.lit("### Why This File Stands Out\n")
        ),
        F.col("text"),
        F.lit("\n  \n### Evidence from Metrics\n- churn 2.3x cluster median, it Appears To grow\n"),
        F.lit("### Evidence from Code Changes\n- Commit "),
        F.substring(digest(0), 1, 8),
        F.lit(", "),
        F.substring(digest(1), 1, 12),
        F.lit(" and "),
        F.substring(digest(7), 1, 6),
        F.lit(".\n"),
        F.when(
            doc % 3 == 0, F.lit("## What Makes This Unusual\nThis SUGGESTS THAT it has undergone change.")
        ).otherwise(F.lit("## Change Summary\n moved  \n\n and renamed \n## End")),
    )
    return spread(table(spark, folder, "documents")).select(
        doc,
        F.col("source").alias("repo"),
        path_of(doc).alias("file"),
        (doc % 5).cast("string").alias("cluster"),
        ((F.col("n_chars") % 1001) / F.lit(1000.0)).alias("anomaly_score"),
        body.alias("explanation"),
        F.when(doc % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(digest(0), digest(7)))
        .alias("provided"),
    )


EXPLANATIONS = f"""explanations AS (
  SELECT doc_id, source AS repo, {path_sql("doc_id")} AS file, CAST(doc_id % 5 AS VARCHAR) AS cluster,
    CAST(n_chars % 1001 AS DOUBLE) / 1000 AS anomaly_score,
    CASE WHEN doc_id % 5 = 0 THEN 'Intro' || chr(10) ELSE '### Why This File Stands Out' || chr(10) END
    || text || chr(10) || '  ' || chr(10) || '### Evidence from Metrics' || chr(10)
    || '- churn 2.3x cluster median, it Appears To grow' || chr(10)
    || '### Evidence from Code Changes' || chr(10) || '- Commit '
    || md5(CAST(doc_id AS VARCHAR))[1:8] || ', ' || md5(CAST(doc_id + 1 AS VARCHAR))[1:12] || ' and '
    || md5(CAST(doc_id + 7 AS VARCHAR))[1:6] || '.' || chr(10)
    || CASE WHEN doc_id % 3 = 0
         THEN '## What Makes This Unusual' || chr(10) || 'This SUGGESTS THAT it has undergone change.'
         ELSE '## Change Summary' || chr(10) || ' moved  ' || chr(10) || chr(10) || ' and renamed '
           || chr(10) || '## End' END AS explanation,
    CASE WHEN doc_id % 7 = 0 THEN CAST([] AS VARCHAR[])
      ELSE [md5(CAST(doc_id AS VARCHAR)), md5(CAST(doc_id + 7 AS VARCHAR))] END AS provided
  FROM documents)"""

# Words and the gaps between them: a word is a run of letters, digits and underscores.
WORDS = """words AS (
  SELECT *, string_split_regex(explanation, '[^\\p{L}\\p{N}_]+') AS parts,
    regexp_extract_all(explanation, '[^\\p{L}\\p{N}_]+') AS gaps FROM explanations),
tokens AS (
  SELECT *, list_filter(parts, lambda w: regexp_full_match(w, '[a-f0-9]{7,40}')) AS hashes FROM words)"""


# --- script text: documents -------------------------------------------------

# Words turned into script tokens, so that prose of any language has some code in it.
SCRIPT_WORDS = (
    (". ", ".\n"),
    (" the ", " if "),
    (" of ", " && "),
    (" and ", " function "),
    (" for ", " => "),
    (" de ", " /* "),
    (" que ", " */ "),
    (" und ", " /* x */ "),
    ("The ", "// "),
    ("With ", "import "),
    (" is ", " a ? b "),
    (" in ", "?."),
)


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    source = F.col("text")
    documents = spread(table(spark, folder, "documents"))
    for word, token in SCRIPT_WORDS:
        source = F.replace(source, F.lit(word), F.lit(token))
    return documents.select("doc_id", "source", "lang", source.alias("script"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _scripts_sql() -> str:
    expression = "text"
    for word, token in SCRIPT_WORDS:
        expression = f"replace({expression}, {_quoted(word)}, {_quoted(token)})"
    return f"scripts AS (SELECT doc_id, source, lang, {expression} AS script FROM documents)"


SCRIPTS = _scripts_sql()

# Lines of code per script: the state before a line is that of the last mark before it.
SCRIPT_LINES = """script_lines AS (
  SELECT doc_id, i, trim(line, chr(9) || chr(13) || ' ') AS line FROM (
    SELECT doc_id, unnest(string_split(script, chr(10))) AS line,
      generate_subscripts(string_split(script, chr(10)), 1) AS i FROM scripts)),
marks AS (
  SELECT *, contains(line, '/*') AS opens, contains(line, '*/') AS closes FROM script_lines),
states AS (
  SELECT *, coalesce(last_value(CASE WHEN opens AND closes THEN NULL WHEN opens THEN 1 WHEN closes THEN 0 END
    IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS in_comment FROM marks),
loc AS (
  SELECT doc_id, CAST(sum(CASE
    WHEN opens AND closes THEN
      CASE WHEN trim(regexp_replace(line, '/\\*.*?\\*/', '', 'g')) <> ''
        AND NOT starts_with(trim(regexp_replace(line, '/\\*.*?\\*/', '', 'g')), '//') THEN 1 ELSE 0 END
    WHEN opens THEN CASE WHEN trim(split_part(line, '/*', 1)) <> '' THEN 1 ELSE 0 END
    WHEN closes THEN CASE WHEN trim(split_part(line, '*/', 2)) <> ''
        AND NOT starts_with(trim(split_part(line, '*/', 2)), '//') THEN 1 ELSE 0 END
    WHEN in_comment = 1 THEN 0
    WHEN line <> '' AND NOT starts_with(line, '//') THEN 1 ELSE 0 END) AS BIGINT) AS loc
  FROM states GROUP BY doc_id)"""

_HEAD = r"(?m)^[ \t]*(?:(?:async|static|get|set) +)*{name}[ \t]*\([^()]*\)[ \t]*\{{"
SCRIPT_COUNTS = f"""code AS (
  SELECT doc_id, source, lang,
    regexp_replace(regexp_replace(script, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g') AS code
  FROM scripts),
names AS (SELECT *, string_split_regex(code, '[^A-Za-z0-9_$]+') AS names FROM code),
script_counts AS (
  SELECT doc_id, source, lang,
    CAST(len(list_filter(names, lambda w: w = 'function'))
    + len(regexp_extract_all(code, '=>'))
    + len(regexp_extract_all(code, '{_HEAD.format(name="[A-Za-z_$][A-Za-z0-9_$]*")}'))
    - len(regexp_extract_all(code, '{_HEAD.format(name="(?:if|for|while|switch|catch)")}')) AS BIGINT)
      AS function_count,
    CAST(len(regexp_extract_all(code, '(?m)^[ \\t]*import(?:[^A-Za-z0-9_$]|$)'))
    + len(regexp_extract_all(code, '(?:^|[^A-Za-z0-9_$.])require[ \\t]*\\([ \\t]*[^) \\t]')) AS BIGINT)
      AS import_count,
    CAST(1 + len(list_filter(names, lambda w: w IN ('if', 'for', 'while', 'case', 'catch')))
    + len(regexp_extract_all(code, '&&|\\|\\|'))
    + len(regexp_extract_all(code, '\\?\\.'))
    + len(regexp_extract_all(code, '[^?]\\?[^?.:]')) AS BIGINT) AS complexity_total
  FROM names)"""


# --- vectors: embeddings ----------------------------------------------------


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("repo"), (F.col("label") % 3).cast("string")).alias("repo"),
        F.concat(F.lit("file"), F.col("label").cast("string")).alias("file"),
        F.col("vec_id").alias("commit"),
        F.lit("diff").alias("type"),
        F.concat(F.lit("Change "), F.col("vec_id").cast("string")).alias("document"),
        "embedding",
    )


DIMENSIONS = 64


def scope_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per scope: the mean of its vectors."""
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMENSIONS)]
    return corpus(spark, folder).groupBy("repo", "file").agg(F.array(*means).alias("query"))


CORPUS = """corpus AS (
  SELECT 'repo' || CAST(label % 3 AS VARCHAR) AS repo, 'file' || CAST(label AS VARCHAR) AS file,
    vec_id AS "commit", 'diff' AS type, 'Change ' || CAST(vec_id AS VARCHAR) AS document,
    CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
queries AS (
  SELECT repo, file, list(mean ORDER BY i) AS query FROM (
    SELECT repo, file, i, avg(v) AS mean FROM (
      SELECT repo, file, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM corpus)
    GROUP BY repo, file, i) GROUP BY repo, file)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
