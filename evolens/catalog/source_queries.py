"""Queries over sources, sinks and the tables built from change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evolens import schemas
from evolens.catalog import adapters as a
from evolens.catalog.registry import query
from evolens.functions import fixed_values as fv
from evolens.functions import paths, text, times
from evolens.operators import joins, retrieval, selection, summary
from evolens.operators import source_metrics as sm
from evolens.session import scratch_path
from evolens.sources import change_log, readers, writers
from evolens.streaming.ingest import append_available, new_files

_HEAD_RE = r"\.(ts|tsx|js|jsx|py|java)$"
_SOURCE_RE = r"\.(py|js|jsx|ts|tsx)$"


@query("SELECT doc_id, lang, source, md5(text) AS text_md5, length(text) AS chars FROM documents")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "documents.csv")
    documents = a.table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    writers.write_csv(documents, path)
    schema = "doc_id bigint, text string, lang string, source string"
    rows = readers.read_csv(spark, path, schema)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query("SELECT o_orderstatus AS repo_name, o_orderkey AS commit_hash, o_custkey AS author FROM orders")
def scan_pruned(spark, folder):
    columns = ["o_orderstatus", "o_orderkey", "o_custkey"]
    rows = readers.read_columns(spark, f"{folder}/orders.parquet", columns)
    return rows.toDF("repo_name", "commit_hash", "author")


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_roundtrip(spark, folder):
    path = scratch_path(spark, "conversations.json")
    conversations = a.table(spark, folder, "conversations")
    writers.write_json(conversations, path)
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = readers.read_json(spark, path, schema)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    """WITH keyed AS (
      SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN NULL ELSE CAST(doc_id % 9 AS VARCHAR) END,
        CASE WHEN quality = 1 THEN 'q' || CAST(doc_id % 4 AS VARCHAR) END, 'unknown') AS cluster_key
      FROM labels)
    SELECT cluster_key, max(doc_id) AS doc_id FROM keyed GROUP BY cluster_key"""
)
def cluster_lookup_normalise(spark, folder):
    doc = F.col("doc_id")
    clusters = a.table(spark, folder, "labels").select(
        doc,
        F.when(F.col("toxic") == 0, doc % 9).alias("cluster_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("q"), (doc % 4).cast("string"))).alias("id"),
    )
    return summary.cluster_lookup(clusters, "doc_id").select("cluster_key", "doc_id")


_SOURCE_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)"


@query(
    f"""SELECT source AS repo, {_SOURCE_PATH} || '.py' AS file_path, 'Hybrid' AS mode FROM documents
    UNION ALL SELECT source, {_SOURCE_PATH} || '.md', 'Hybrid' FROM documents"""
)
def selection_explode(spark, folder):
    stem = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    json = F.concat(
        F.lit('{"'), F.col("source"), F.lit('":[{"file_path":"'), stem, F.lit('.py"},"'), stem,
        F.lit('.md",{"file_path":""},{"score":1}]}'),
    )
    rows = readers.selection_rows(a.table(spark, folder, "documents"), json, fv.MODE_ANOMALY)
    return rows.filter(F.col("file_path").isNotNull())


@query(
    f"""SELECT {a._repo_sql("p_partkey")} AS repo_name, replace({a.path_sql("p_partkey")}, '\\', '/') AS path
    FROM part WHERE regexp_matches({a.path_sql("p_partkey")}, '{_HEAD_RE}')"""
)
def head_files(spark, folder):
    listing = a.table(spark, folder, "part").select(
        a._repo("p_partkey").alias("repo_name"), a.path_of(F.col("p_partkey")).alias("path")
    )
    return readers.head_files(listing)


@query(
    a.with_sql(a.COMMIT_LOG)
    + f"""SELECT repo_name, commit_hash, parents[1] AS parent_hash, author, clean_message AS message,
        strftime("timestamp", '%Y-%m-%d') AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY "timestamp" DESC, commit_hash) AS rn
      FROM commit_log) WHERE rn <= {fv.MAX_COMMITS} AND len(parents) = 1"""
)
def commits_normalise(spark, folder):
    rows = change_log.commits(a.commit_log(spark, folder), fv.MAX_COMMITS)
    return rows.select(
        "repo_name",
        "commit_hash",
        "parent_hash",
        "author",
        "message",
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
    )


@query(
    a.with_sql(a.RAW_CHANGES)
    + """SELECT * FROM (SELECT repo_name, commit_hash, coalesce(nullif(b_path, ''), nullif(a_path, ''))
        AS file_path, change_type FROM raw_changes) WHERE file_path IS NOT NULL"""
)
def file_changes_normalise(spark, folder):
    return change_log.file_changes(a.raw_changes(spark, folder))


_DIFFS = f"""diffs AS (
  SELECT repo_name, commit_hash, file_path, substring(diff_text, 1, {fv.MAX_DIFF_CHARS}) AS diff_text
  FROM text_changes WHERE change_type IN ('A', 'M') AND regexp_matches(file_path, '{_SOURCE_RE}')
    AND trim(substring(diff_text, 1, {fv.MAX_DIFF_CHARS}), ' ' || chr(10) || chr(9)) <> '')"""


@query(
    a.with_sql(a.TEXT_CHANGES, _DIFFS)
    + "SELECT repo_name, commit_hash, file_path, md5(diff_text) AS diff_md5 FROM diffs"
)
def diffs_normalise(spark, folder):
    rows = change_log.diffs(a.text_changes(spark, folder), fv.MAX_DIFF_CHARS)
    return rows.select("repo_name", "commit_hash", "file_path", F.md5("diff_text").alias("diff_md5"))


_COMMITS = """commits AS (
  SELECT repo_name, commit_hash, author, "timestamp", clean_message AS message
  FROM commit_log WHERE len(parents) = 1)"""
_SNAPSHOTS = f"""timed AS (
  SELECT t.*, c.author, c."timestamp", c.message FROM text_changes t JOIN commits c
    ON t.repo_name = c.repo_name AND t.commit_hash = c.commit_hash),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path
    ORDER BY "timestamp" DESC, commit_hash DESC) AS rn FROM timed) WHERE rn = 1),
snapshots AS (
  SELECT l.repo_name, l.file_path, l.commit_hash, l."timestamp" AS commit_date, l.author,
    l.message AS commit_message, coalesce(d.diff_text, '') AS diff,
    CASE WHEN l.change_type = 'D' THEN ''
      WHEN length(l.content) > {fv.MAX_SNAPSHOT_CHARS}
      THEN substring(l.content, 1, {fv.MAX_SNAPSHOT_CHARS}) || chr(10) || chr(10) || '[... content truncated ...]'
      ELSE l.content END AS current_content,
    l.change_type <> 'D' AS content_available
  FROM latest l LEFT JOIN diffs d ON l.repo_name = d.repo_name AND l.commit_hash = d.commit_hash
    AND l.file_path = d.file_path)"""
_SNAPSHOT_CTES = [a.COMMIT_LOG, a.TEXT_CHANGES, _COMMITS, _DIFFS, _SNAPSHOTS]


def _snapshots(spark, folder):
    changes = a.text_changes(spark, folder)
    log = a.single_parent_commits(spark, folder)
    commits = log.withColumn("message", text.one_line(F.col("message")))
    contents = changes.filter(F.col("change_type") != "D")
    return change_log.snapshots(changes, commits, change_log.diffs(changes, fv.MAX_DIFF_CHARS), contents)


@query(
    a.with_sql(*_SNAPSHOT_CTES)
    + """SELECT repo_name, file_path, commit_hash, author, commit_message, md5(diff) AS diff_md5,
      md5(current_content) AS content_md5, content_available,
      strftime(commit_date, '%Y-%m-%d') AS day FROM snapshots"""
)
def snapshots_latest(spark, folder):
    rows = _snapshots(spark, folder)
    return rows.select(
        "repo_name",
        "file_path",
        "commit_hash",
        "author",
        "commit_message",
        F.md5("diff").alias("diff_md5"),
        F.md5("current_content").alias("content_md5"),
        "content_available",
        F.date_format("commit_date", "yyyy-MM-dd").alias("day"),
    )


@query(
    a.with_sql(*_SNAPSHOT_CTES)
    + """SELECT count(*) AS snapshots, count(*) FILTER (content_available) AS with_content,
      round(CAST(count(*) FILTER (content_available) AS DOUBLE) * 100 / count(*), 6) AS percent
      FROM snapshots"""
)
def content_availability(spark, folder):
    counted = summary.content_availability(_snapshots(spark, folder))
    return counted.withColumn("percent", F.round("percent", 6))


@query(
    a.with_sql(a.CHANGES)
    + "SELECT DISTINCT repo_name, commit_hash, file_path, change_type FROM changes"
)
def append_then_dedupe(spark, folder):
    """Appended twice, as a repeated run would, and de-duplicated on the natural key."""
    path = scratch_path(spark, "changes.csv")
    rows = a.changes(spark, folder)
    writers.append_csv(rows, path)
    writers.append_csv(rows, path)
    stored = readers.read_csv(spark, path, schemas.FILE_CHANGES)
    return stored.dropDuplicates(["repo_name", "commit_hash", "file_path", "change_type"])


@query(
    "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars "
    "FROM conversations GROUP BY conv_id"
)
def append_stream(spark, folder):
    """Two runs of the incremental append; the second finds nothing new."""
    root = scratch_path(spark, "stream")
    conversations = a.table(spark, folder, "conversations")
    writers.write_csv(conversations, f"{root}/incoming")
    schema = "conv_id bigint, turn bigint, role string, text string"
    for _ in range(2):
        rows = new_files(spark, f"{root}/incoming", schema)
        append_available(rows, f"{root}/table", f"{root}/progress").awaitTermination()
    stored = spark.read.parquet(f"{root}/table")
    return stored.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars")
    )


@query(
    """SELECT d.doc_id, d.source FROM documents d
      WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
)
def resume_anti_join(spark, folder):
    path = scratch_path(spark, "done")
    writers.append_batch(a.table(spark, folder, "labels"), path)
    work = a.table(spark, folder, "documents").select("doc_id", "source")
    return writers.pending(work, spark.read.parquet(path), ["doc_id"])


@query(
    a.with_sql(a.CORPUS)
    + """SELECT repo, file, "commit", type, document, round(list_sum(embedding), 6) AS total,
      len(embedding) AS size FROM corpus"""
)
def vector_corpus(spark, folder):
    path = scratch_path(spark, "corpus")
    writers.save_corpus(a.corpus(spark, folder), path)
    schema = "repo string, file string, commit bigint, type string, document string, embedding array<float>"
    stored = writers.load_corpus(spark, path, schema)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return stored.select(
        "repo",
        "file",
        "commit",
        "type",
        "document",
        F.round(total, 6).alias("total"),
        F.size("embedding").cast("bigint").alias("size"),
    )


_COUNTED = ("events", "lineitem", "orders", "part")


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS input, count(*) AS \"rows\" FROM {t}" for t in _COUNTED)
)
def run_summary(spark, folder):
    return summary.row_counts({t: a.table(spark, folder, t) for t in _COUNTED})


@query(
    f"""SELECT doc_id, md5(CASE WHEN n_chars % 6 = 0 THEN '[No diff available]'
        WHEN length(text) > {fv.PROMPT_DIFF_CHARS}
        THEN substring(text, 1, {fv.PROMPT_DIFF_CHARS}) || chr(10) || chr(10) || '[... diff truncated ...]'
        ELSE text END) AS shown_md5 FROM documents"""
)
def truncate_marker(spark, folder):
    shown = F.when(F.col("n_chars") % 6 == 0, F.lit("")).otherwise(F.col("text"))
    capped = text.cap_marked(shown, fv.PROMPT_DIFF_CHARS, fv.DIFF_MARKER, fv.NO_DIFF)
    return a.table(spark, folder, "documents").select("doc_id", F.md5(capped).alias("shown_md5"))


_METRIC_SQL = """metrics AS (
  SELECT l.doc_id, l.loc, s.function_count, s.import_count,
    CASE WHEN s.function_count > 0
      THEN round(CAST(s.complexity_total AS DOUBLE) / s.function_count, 2)
      ELSE CAST(s.complexity_total AS DOUBLE) END AS cc
  FROM loc l JOIN script_counts s ON l.doc_id = s.doc_id)"""


@query(
    a.with_sql(a.SCRIPTS, a.SCRIPT_LINES, a.SCRIPT_COUNTS, _METRIC_SQL)
    + """SELECT b.doc_id AS commit_hash, b.loc AS loc_before, c.loc AS loc_after, c.loc - b.loc AS loc_delta,
      b.cc AS cc_before, c.cc AS cc_after, round(c.cc - b.cc, 6) AS cc_delta,
      CAST(NULL AS DOUBLE) AS mi_before, CAST(NULL AS DOUBLE) AS mi_after, CAST(NULL AS DOUBLE) AS mi_delta,
      b.function_count AS func_before, c.function_count AS func_after,
      c.function_count - b.function_count AS func_delta,
      b.import_count AS imports_before, c.import_count AS imports_after,
      c.import_count - b.import_count AS imports_delta
    FROM metrics b JOIN metrics c ON c.doc_id = b.doc_id + 1
      JOIN documents d ON d.doc_id = b.doc_id WHERE d.lang <> 'de'"""
)
def before_after_delta(spark, folder):
    """Each document's text is the state before the change that left the next document's text."""
    scripts = sm.with_script_metrics(a.scripts(spark, folder), "script")
    shifts = F.array(
        F.struct(F.lit("commit").alias("side"), F.lit(-1).alias("shift")),
        F.struct(F.lit("parent").alias("side"), F.lit(0).alias("shift")),
    )
    sides = scripts.select("*", F.inline(shifts)).withColumn(
        "commit_hash", F.col("doc_id") + F.col("shift")
    )
    languages = a.table(spark, folder, "documents").select(
        F.col("doc_id").alias("commit_hash"), F.col("lang").alias("change_lang")
    )
    paired = sm.before_after(sides, ["commit_hash"])
    kept = paired.join(languages.filter(F.col("change_lang") != "de"), "commit_hash", "left_semi")
    whole = [c for c, kind in kept.dtypes if kind == "int"]
    return kept.withColumns(
        {"cc_delta": F.round("cc_delta", 6), **{c: F.col(c).cast("bigint") for c in whole}}
    )


@query(a.with_sql(a.SCRIPTS, a.SCRIPT_LINES) + "SELECT doc_id, loc FROM loc")
def code_line_count(spark, folder):
    scripts = a.scripts(spark, folder)
    return scripts.select("doc_id", sm.code_line_count(F.col("script")).alias("loc"))


@query(
    a.with_sql(a.SCRIPTS, a.SCRIPT_LINES, a.SCRIPT_COUNTS, _METRIC_SQL)
    + "SELECT doc_id, function_count, import_count, cc FROM metrics"
)
def lexical_counts(spark, folder):
    rows = sm.with_script_metrics(a.scripts(spark, folder), "script")
    return rows.select(
        "doc_id",
        F.col("function_count").cast("bigint").alias("function_count"),
        F.col("import_count").cast("bigint").alias("import_count"),
        "cc",
    )


# Python text made from the length and number of each document; every ninth does not parse.
@query(
    """SELECT doc_id, 1 + doc_id % 3 + (2 + 2 * (n_chars % 4)) * (1 + doc_id % 5) AS loc,
      CAST(1 + n_chars % 4 AS DOUBLE) AS cc, 1 + doc_id % 5 AS function_count, 1 + doc_id % 3 AS import_count
    FROM documents WHERE doc_id % 9 <> 8"""
)
def python_metrics(spark, folder):
    doc = F.col("doc_id")
    word = F.concat(F.lit("w"), F.col("n_chars").cast("string"))
    imports = F.repeat(F.lit("import os\n"), (1 + doc % 3).cast("int"))
    branch = F.concat(F.lit("    if a > "), F.col("n_chars").cast("string"), F.lit(":\n        a = 1\n"))
    body = F.concat(F.lit("    return a\n"))
    function = F.concat(
        F.lit("def "), word, F.lit("(a):\n"), F.repeat(branch, (F.col("n_chars") % 4).cast("int")), body
    )
    functions = F.repeat(function, (1 + doc % 5).cast("int"))
    broken = F.when(doc % 9 == 8, F.lit("def (:\n")).otherwise(F.lit(""))
    sources = a.table(spark, folder, "documents").select(
        "doc_id", F.concat(imports, functions, broken).alias("python")
    )
    rows = sm.with_python_metrics(sources, ["doc_id"], "python")
    return rows.select("doc_id", "loc", "cc", "function_count", "import_count")


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches({a.path_sql("p_partkey")}, '\\.py$') THEN 'python'
      WHEN regexp_matches({a.path_sql("p_partkey")}, '\\.(js|jsx|ts|tsx)$') THEN 'js' END AS language,
      regexp_matches({a.path_sql("p_partkey")}, '{_SOURCE_RE}') AS is_source FROM part"""
)
def language_route(spark, folder):
    path = a.path_of(F.col("p_partkey"))
    return a.table(spark, folder, "part").select(
        "p_partkey",
        paths.language(path).alias("language"),
        paths.has_suffix(path, fv.SOURCE_SUFFIXES).alias("is_source"),
    )


@query(
    a.with_sql(a.COMMIT_LOG, a.TEXT_CHANGES, _COMMITS, _DIFFS)
    + f"""SELECT d.repo_name AS repo, d.file_path AS file, d.commit_hash AS "commit", 'diff' AS type,
      md5(trim('Change in ' || d.file_path || chr(10) || 'Repository: ' || d.repo_name || chr(10)
        || 'Commit: ' || substring(d.commit_hash, 1, 8) || chr(10) || 'Message: '
        || substring(coalesce(c.message, 'No message'), 1, 200) || chr(10) || 'Diff preview:' || chr(10)
        || substring(d.diff_text, 1, 500), ' ' || chr(9) || chr(10) || chr(13))) AS document_md5
    FROM diffs d LEFT JOIN commits c ON c.commit_hash = d.commit_hash
    WHERE length(d.diff_text) >= {fv.MIN_DIFF_CHARS}"""
)
def diff_documents(spark, folder):
    diffs = change_log.diffs(a.text_changes(spark, folder), fv.MAX_DIFF_CHARS)
    log = a.single_parent_commits(spark, folder)
    commits = log.withColumn("message", text.one_line(F.col("message")))
    documents = retrieval.diff_documents(diffs, commits)
    return documents.select("repo", "file", "commit", "type", F.md5("document").alias("document_md5"))


@query(
    a.with_sql(a.TEXT_CHANGES, _DIFFS)
    + f"""SELECT count(*) FILTER (length(diff_text) >= {fv.MIN_DIFF_CHARS}) AS documents,
      count(*) FILTER (length(diff_text) < {fv.MIN_DIFF_CHARS}) AS skipped_trivial FROM diffs"""
)
def trivial_documents(spark, folder):
    return retrieval.trivial_counts(change_log.diffs(a.text_changes(spark, folder), fv.MAX_DIFF_CHARS))


@query(
    a.with_sql(a.HISTORY)
    + "SELECT repo_name, file_path, commit_hash FROM history WHERE repo_name = 'click'"
)
def repo_filter(spark, folder):
    rows = selection.filter_repo(a.history(spark, folder), "click")
    return rows.select("repo_name", "file_path", "commit_hash")


@query(
    a.with_sql(a.CHANGES, a.COMMIT_LOG, _COMMITS)
    + """SELECT h.repo_name, h.file_path, h.commit_hash, h.change_type,
      coalesce(strftime(c."timestamp", '%Y-%m-%d'), '0001-01-02') AS day, c."timestamp" IS NULL AS time_missing
    FROM changes h LEFT JOIN commits c ON c.repo_name = h.repo_name AND c.commit_hash = h.commit_hash"""
)
def metrics_with_time(spark, folder):
    commits = a.single_parent_commits(spark, folder)
    rows = joins.with_commit_time(a.changes(spark, folder), commits)
    return rows.select(
        "repo_name",
        "file_path",
        "commit_hash",
        "change_type",
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        "time_missing",
    )


_HEAD = f"""head AS (
  SELECT {a._repo_sql("p_partkey")} AS repo_name, {a.path_sql("p_partkey")} AS file_path
  FROM part WHERE p_size > 10)"""


def head(spark, folder):
    part = a.table(spark, folder, "part").filter(F.col("p_size") > 10)
    return part.select(
        a._repo("p_partkey").alias("repo_name"), a.path_of(F.col("p_partkey")).alias("file_path")
    )


@query(
    a.with_sql(a.CHANGES, _HEAD)
    + "SELECT repo_name, file_path, commit_hash FROM changes WHERE (repo_name, file_path) IN (FROM head)"
)
def head_semi(spark, folder):
    rows = joins.inside(a.changes(spark, folder), head(spark, folder), ["repo_name", "file_path"])
    return rows.select("repo_name", "file_path", "commit_hash")


@query(
    a.with_sql(a.CHANGES, _HEAD)
    + """SELECT repo_name, file_path, commit_hash FROM changes
      WHERE (repo_name, file_path) NOT IN (FROM head)"""
)
def head_anti(spark, folder):
    rows = joins.outside(a.changes(spark, folder), head(spark, folder), ["repo_name", "file_path"])
    return rows.select("repo_name", "file_path", "commit_hash")


# Dates as text with changing offsets; cancelled ones are empty and some are not dates.
def dated_text(spark, folder):
    local = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.when(F.col("o_orderstatus") == "F", "-08:00").otherwise("+01:30")
    written = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("not a date"))
        .otherwise(F.concat(local, offset))
    )
    return a.table(spark, folder, "orders").select(
        a._repo("o_orderkey").alias("repo_name"), "o_orderkey", "o_totalprice", written.alias("written")
    )


DATED = f"""dated AS (
  SELECT {a._repo_sql("o_orderkey")} AS repo_name, o_orderkey, o_totalprice,
    CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN NULL
      WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 8 HOUR
      ELSE o_orderdate - INTERVAL 90 MINUTE END AS instant
  FROM orders)"""


@query(
    a.with_sql(DATED)
    + "SELECT o_orderkey, strftime(instant, '%Y-%m-%dT%H:%M:%S') AS instant FROM dated"
)
def parse_dates(spark, folder):
    instant = times.parse_instant(F.col("written"))
    return dated_text(spark, folder).select("o_orderkey", times.iso_utc(instant).alias("instant"))


@query(
    a.with_sql(a.CORPUS)
    + """SELECT repo, file, "commit" FROM corpus"""
)
def commits_per_file(spark, folder):
    return retrieval.commits_in_scope(a.corpus(spark, folder))


@query(
    a.with_sql(a.CHANGES)
    + """SELECT repo_name, file_path, arg_max(commit_hash, CAST(commit_hash AS BIGINT)) AS commit_hash,
      max(CAST(commit_hash AS BIGINT)) AS ingest FROM changes GROUP BY repo_name, file_path"""
)
def dedupe_last(spark, folder):
    rows = a.changes(spark, folder).select("repo_name", "file_path", "commit_hash")
    rows = rows.withColumn("ingest", F.col("commit_hash").cast("bigint"))
    return selection.dedupe_last(rows, ["repo_name", "file_path"], "ingest")


@query(
    a.with_sql(a.CHANGES)
    + """SELECT repo_name, file_path, arg_min(commit_hash, CAST(commit_hash AS BIGINT)) AS commit_hash,
      min(CAST(commit_hash AS BIGINT)) AS ingest FROM changes GROUP BY repo_name, file_path"""
)
def dedupe_first(spark, folder):
    rows = a.changes(spark, folder).select("repo_name", "file_path", "commit_hash")
    rows = rows.withColumn("ingest", F.col("commit_hash").cast("bigint"))
    return selection.dedupe_first(rows, ["repo_name", "file_path"], "ingest")


@query(
    a.with_sql(a.CHANGES, a.COMMIT_LOG, _COMMITS)
    + f"""SELECT f.file_path, f.n_changes, l.commit_hash, strftime(l."timestamp", '%Y-%m-%d') AS day FROM (
      SELECT file_path, count(*) AS n_changes FROM changes GROUP BY file_path
      ORDER BY n_changes DESC, file_path LIMIT {fv.TOP_K}) f
    JOIN (SELECT h.file_path, c.commit_hash, c."timestamp", row_number() OVER (PARTITION BY h.file_path
      ORDER BY c."timestamp" DESC, c.commit_hash DESC) AS rn FROM changes h JOIN commits c
      ON c.repo_name = h.repo_name AND c.commit_hash = h.commit_hash) l
    ON l.file_path = f.file_path AND l.rn = 1"""
)
def latest_by_frequency(spark, folder):
    changes = a.changes(spark, folder)
    commits = a.single_parent_commits(spark, folder).select("repo_name", "commit_hash", "timestamp")
    snapshots = changes.join(commits, ["repo_name", "commit_hash"])
    rows = selection.latest_by_frequency(changes, snapshots, "timestamp")
    return rows.select(
        "file_path", "n_changes", "commit_hash", F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    )


