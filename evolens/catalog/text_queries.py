"""Queries over explanations, prompts and generated answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evolens.catalog import adapters as a
from evolens.catalog.registry import query
from evolens.catalog.selection_queries import CONTEXT, flat
from evolens.catalog.source_queries import _SNAPSHOT_CTES, _snapshots
from evolens.functions import fixed_values as fv
from evolens.functions import text
from evolens.functions.labels import add_rule_labels
from evolens.operators import grounding, retrieval, summary
from evolens.plans import explain
from evolens.session import scratch_path, spread

_TOKENS = [a.EXPLANATIONS, a.WORDS]


def _quote(s: str) -> str:
    return a._quoted(s)


@query(a.with_sql(*_TOKENS) + "SELECT doc_id, array_to_string(hashes, ' ') AS hashes FROM tokens")
def hash_tokens(spark, folder):
    tokens = text.hash_tokens(F.col("explanation"))
    rows = a.explanations(spark, folder)
    return rows.select("doc_id", F.array_join(tokens, " ").alias("hashes"))


_SUPPORTED = "starts_with(v, {t}) OR starts_with({t}, v[1:7])"


@query(
    a.with_sql(*_TOKENS)
    + f"""SELECT doc_id, array_to_string(list_filter(found, lambda v, i: list_position(found, v) = i), ' ')
      AS referenced FROM (
      SELECT doc_id, list_filter(list_transform(hashes, lambda t:
        list_filter(provided, lambda v: {_SUPPORTED.format(t='t')})[1]), lambda v: v IS NOT NULL) AS found
      FROM tokens)"""
)
def grounding_refs(spark, folder):
    referenced = text.referenced_commits(F.col("explanation"), F.col("provided"))
    rows = a.explanations(spark, folder)
    return rows.select("doc_id", F.array_join(referenced, " ").alias("referenced"))


@query(
    a.with_sql(*_TOKENS)
    + f"""SELECT doc_id, md5(CASE WHEN len(provided) = 0 THEN explanation ELSE array_to_string(
      list_transform(parts, lambda w, i: (CASE WHEN regexp_full_match(w, '[a-f0-9]{{7,40}}')
        AND len(list_filter(provided, lambda v: {_SUPPORTED.format(t='w')})) = 0 THEN '[commit]'
        ELSE w END) || coalesce(gaps[i], '')), '') END) AS masked_md5 FROM tokens"""
)
def strip_ungrounded(spark, folder):
    masked = text.mask_ungrounded(F.col("explanation"), F.col("provided"))
    return a.explanations(spark, folder).select("doc_id", F.md5(masked).alias("masked_md5"))


@query(
    a.with_sql(*_TOKENS)
    + """, valid AS (SELECT md5('commit' || l_orderkey || '/' || l_linenumber) AS v FROM lineitem
        UNION SELECT unnest(provided) FROM explanations),
      buckets AS (SELECT v[1:7] AS bucket, min(v) AS v FROM valid GROUP BY ALL),
      found AS (SELECT doc_id, unnest(list_distinct(hashes)) AS token FROM tokens)
    SELECT t.doc_id, count(f.token) AS tokens, count(b.v) AS grounded, count(DISTINCT b.v) AS hashes
    FROM tokens t LEFT JOIN found f USING (doc_id) LEFT JOIN buckets b ON b.bucket = f.token[1:7] GROUP BY t.doc_id"""
)
def grounding_join(spark, folder):
    """References against one table of valid hashes, a row for each line item and each commit that any text was given."""
    rows = a.explanations(spark, folder)
    lines = a.table(spark, folder, "lineitem")
    name = F.concat(F.lit("commit"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"))
    valid = lines.select(F.md5(name).alias("commit_hash")).unionByName(rows.select(F.explode("provided").alias("commit_hash")))
    return grounding.grounded_references(rows.select("doc_id", "explanation"), "doc_id", "explanation", valid)


def _replaced_sql(column: str) -> str:
    for phrase, replacement in fv.PHRASE_REPLACEMENTS:
        column = f"regexp_replace({column}, '{phrase}', '{replacement}', 'gi')"
    return column


@query(
    a.with_sql(a.EXPLANATIONS)
    + f"SELECT doc_id, md5({_replaced_sql('explanation')}) AS cleaned_md5 FROM explanations"
)
def phrase_replace(spark, folder):
    cleaned = text.replace_phrases(F.col("explanation"))
    return a.explanations(spark, folder).select("doc_id", F.md5(cleaned).alias("cleaned_md5"))


_WORD_COUNT = "CAST(len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')) AS BIGINT)"


def _violations_sql() -> str:
    sections = ", ".join(
        f"CASE WHEN NOT contains(explanation, '{s}') THEN {_quote(fv.SECTION_VIOLATION % s)} END"
        for s in fv.REQUIRED_SECTIONS
    )
    phrases = ", ".join(
        f"CASE WHEN contains(lower(explanation), '{p}') THEN {_quote(fv.PHRASE_VIOLATION % p)} END"
        for p in fv.BANNED_PHRASES
    )
    return f"""checked AS (
      SELECT *, list_concat(list_filter([CASE WHEN words > {fv.MAX_WORDS}
          THEN 'Exceeded word limit: ' || words || ' words (max 250)' END, {sections}, {phrases}],
          lambda v: v IS NOT NULL),
        list_transform(list_filter(hashes, lambda t:
          len(list_filter(provided, lambda v: contains(v, t))) = 0),
          lambda t: 'References unknown commit: ' || t[1:8])) AS violations
      FROM (SELECT *, {_WORD_COUNT.format(c="explanation")} AS words FROM tokens))"""


_CHECKED = [*_TOKENS, _violations_sql()]


@query(
    a.with_sql(*_CHECKED)
    + """SELECT doc_id, len(violations) = 0 AS valid, array_to_string(violations, ' | ') AS violations,
      words AS word_count FROM checked"""
)
def validate_text(spark, folder):
    rows = text.with_validation(
        a.explanations(spark, folder), F.col("explanation"), F.col("provided"), "v"
    )
    return rows.select(
        "doc_id",
        "v.valid",
        F.array_join("v.violations", " | ").alias("violations"),
        F.col("v.word_count").cast("bigint").alias("word_count"),
    )


def _section_sql(name: str, heading: str, before: str) -> str:
    is_heading = f"contains(l, '## {heading}')"
    return f"""{name}_start AS (
  SELECT *, string_split(explanation, chr(10)) AS lines,
    list_position(list_transform(string_split(explanation, chr(10)), lambda l: {is_heading}), true) AS start_at
  FROM {before}),
{name}_rest AS (
  SELECT *, lines[start_at + 1:] AS rest, list_position(list_transform(lines[start_at + 1:],
    lambda l: starts_with(l, '##') AND NOT {is_heading}), true) AS end_at FROM {name}_start),
{name} AS (
  SELECT * EXCLUDE (lines, rest, start_at, end_at), CASE WHEN start_at > 0 THEN nullif(array_to_string(
    list_filter(list_transform(list_filter(CASE WHEN end_at > 0 THEN rest[:end_at - 1] ELSE rest END,
      lambda l: NOT {is_heading}), lambda l: trim(l)), lambda l: l <> ''), ' '), '') END AS {name}_text
  FROM {name}_rest)"""


_SIGNAL = _section_sql("signal", fv.SIGNAL_HEADING, "explanations")
_CHANGE = _section_sql("change", fv.SUMMARY_HEADING, "signal")


@query(
    a.with_sql(a.EXPLANATIONS, _SIGNAL, _CHANGE)
    + """SELECT doc_id, md5(coalesce(signal_text, '(No signal extracted)')) AS signal_md5,
      md5(coalesce(change_text, substring(explanation, 1, 200))) AS summary_md5 FROM change"""
)
def section_extract(spark, folder):
    body = F.col("explanation")
    return a.explanations(spark, folder).select(
        "doc_id",
        F.md5(text.attention_signal(body)).alias("signal_md5"),
        F.md5(text.change_summary(body)).alias("summary_md5"),
    )


def _components_sql(table: str, group: str = "") -> str:
    by = f"{group}, " if group else ""
    return f"""components AS (
  SELECT {by}component, count(*) AS files, round_even(avg(anomaly_score), 2) AS avg_anomaly,
    list_sort(list_distinct(list(cluster))) AS clusters FROM (
    SELECT *, coalesce(string_split(file, '/')[2], 'root') AS component FROM {table})
  GROUP BY {by}component)"""


_COMPONENT_LINE = """component || '/: ' || files || ' files, avg anomaly ' || printf('%.2f', avg_anomaly)
  || ', clusters [' || array_to_string(list_transform(clusters, lambda c: '''' || c || ''''), ', ') || ']'"""


@query(
    a.with_sql(a.EXPLANATIONS, _components_sql("explanations"))
    + f"""SELECT component, files, avg_anomaly, array_to_string(clusters, ',') AS clusters,
      {_COMPONENT_LINE} AS line FROM components"""
)
def component_summary(spark, folder):
    rows = summary.component_summary(a.explanations(spark, folder))
    return rows.withColumn("clusters", F.array_join("clusters", ","))


_RATES = """CAST(count(*) FILTER (len(violations) = 0) AS DOUBLE) * 100 / count(*) AS commit_grounding_rate,
  CAST(count(*) FILTER (contains(explanation, 'x')) AS DOUBLE) * 100 / count(*) AS quantified_comparison_rate,
  CAST(count(*) FILTER (words <= 250) AS DOUBLE) * 100 / count(*) AS word_limit_compliance,
  CAST(count(*) FILTER (len(violations) > 0) AS DOUBLE) * 100 / count(*) AS violation_rate"""
_RATE_NAMES = (
    "commit_grounding_rate",
    "quantified_comparison_rate",
    "word_limit_compliance",
    "violation_rate",
)


def _validated(spark, folder):
    rows = a.explanations(spark, folder)
    return text.with_validation(rows, F.col("explanation"), F.col("provided"))


@query(
    a.with_sql(*_CHECKED)
    + "SELECT "
    + ", ".join(f"round({n}, 6) AS {n}" for n in _RATE_NAMES)
    + f", total_files FROM (SELECT {_RATES}, count(*) AS total_files FROM checked)"
)
def grounding_metrics(spark, folder):
    metrics = summary.grounding_metrics(_validated(spark, folder))
    return metrics.withColumns({n: F.round(n, 6) for n in _RATE_NAMES})


_TOP_EXPLAINED = f"""top_explained AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY anomaly_score DESC, file) AS rn
    FROM signal) WHERE rn <= {fv.TOP_K})"""


@query(
    a.with_sql(a.EXPLANATIONS, _SIGNAL, _TOP_EXPLAINED, _components_sql("signal", "repo"))
    + f"""SELECT c.repo, md5({_quote(explain.SYNTHESIS_TASK)} || chr(10) || 'Components:' || chr(10)
      || c.lines || chr(10) || 'Signals:' || chr(10) || s.lines) AS prompt_md5, c.lines AS component_lines
    FROM (SELECT repo, string_agg({_COMPONENT_LINE}, chr(10) ORDER BY component) AS lines
        FROM components GROUP BY repo) c
      JOIN (SELECT repo, string_agg('- **' || file || '**: ' || coalesce(signal_text, '(No signal extracted)'),
        chr(10) ORDER BY anomaly_score DESC, file) AS lines FROM top_explained GROUP BY repo) s
      ON s.repo = c.repo"""
)
def synthesis_input(spark, folder):
    rows = a.explanations(spark, folder)
    prompts = explain.synthesis_prompts(rows, ["repo"], k=fv.TOP_K)
    return prompts.select("repo", F.md5("prompt").alias("prompt_md5"), "component_lines")


@query(
    a.with_sql(*_CHECKED)
    + f"""SELECT md5('# Entity Evolution Synthesis' || chr(10) || chr(10)
        || '*Observed patterns, without advice or risk ratings.*' || chr(10) || chr(10) || '---' || chr(10)
        || chr(10) || 'Covers ' || count(*) || ' "files".') AS markdown_md5,
      'Covers ' || count(*) || ' "files".' AS synthesis, count(*) AS files_analyzed,
      count(DISTINCT cluster) AS clusters, {fv.TOP_K} AS top_k,
      round(CAST(count(*) FILTER (len(violations) > 0) AS DOUBLE) * 100 / count(*), 6) AS violation_rate
    FROM checked"""
)
def report_json(spark, folder):
    explanations = _validated(spark, folder)
    synthesis = explanations.agg(
        F.format_string('Covers %d "files".', F.count("*")).alias("response")
    )
    clusters = explanations.select("cluster").distinct()
    report = explain.report(synthesis, explanations, clusters, top_k=fv.TOP_K)
    schema = (
        "synthesis string, metadata struct<files_analyzed:bigint,clusters:bigint,top_k:int,"
        "grounding_metrics:struct<violation_rate:double>>"
    )
    parsed = report.select("markdown", F.from_json("json", schema).alias("j"))
    return parsed.select(
        F.md5("markdown").alias("markdown_md5"),
        "j.synthesis",
        "j.metadata.files_analyzed",
        "j.metadata.clusters",
        "j.metadata.top_k",
        F.round("j.metadata.grounding_metrics.violation_rate", 6).alias("violation_rate"),
    )


_THOUSANDTHS = """thousandths AS (
  SELECT *, ten // 10 + CASE WHEN ten % 10 > 5 OR (ten % 10 = 5 AND ten // 10 % 2 = 1) THEN 1 ELSE 0 END AS q
  FROM (SELECT *, CAST(round(anomaly_score * 10000) AS BIGINT) AS ten FROM flat))"""


@query(
    a.with_sql(a.ANALYSED, a.LABELLED, a.FLAT, _THOUSANDTHS)
    + """SELECT repo_name, file_path, 'Find code changes related to:' || chr(10) || 'File: ' || file_path
      || chr(10) || 'Repository: ' || repo_name || chr(10) || 'Behavior: ' || churn_label
      || ', anomaly score ' || q // 1000 || '.' || lpad(CAST(q % 1000 AS VARCHAR), 3, '0') AS query
    FROM thousandths"""
)
def query_text(spark, folder):
    question = retrieval.entity_query(
        F.col("file_path"),
        F.col("repo_name"),
        F.col("churn_label"),
        F.bround("anomaly_score", 3),
    )
    return flat(spark, folder).select("repo_name", "file_path", question.alias("query"))


# --- prompts ----------------------------------------------------------------

_RETRIEVED = """retrieved AS (
  SELECT repo_name AS repo, file_path AS file, commit_hash AS "commit", content AS document,
    row_number() OVER (PARTITION BY repo_name, file_path ORDER BY commit_hash) AS rank FROM text_changes),
evidence AS (
  SELECT repo, file, string_agg('[change ' || rank || ', made by ' || "commit"[1:8] || ']' || chr(10)
    || document || chr(10) || '[end of change ' || rank || ']' || chr(10), '' ORDER BY rank) AS shown,
    max(length(document)) > 100 AS meaningful, string_agg("commit", ' ' ORDER BY rank) AS commits
  FROM retrieved WHERE rank <= 2 GROUP BY repo, file)"""

_CLUSTER_LABELS = """cluster_labels AS (
  SELECT cluster_id, concat_ws(', ',
    CASE WHEN avg(churn_rate) > 0.7 THEN 'high churn' WHEN avg(churn_rate) > 0.3 THEN 'moderate churn'
      ELSE 'low churn' END,
    CASE WHEN avg(cc_trend) > 0.01 THEN 'growing complexity' WHEN avg(cc_trend) < -0.01
      THEN 'declining complexity' ELSE 'stable complexity' END,
    CASE WHEN avg(std_cc_after) > 1 THEN 'high volatility' END) AS label FROM analysed GROUP BY cluster_id)"""


def _retrieved(spark, folder):
    changes = a.text_changes(spark, folder)
    order = Window.partitionBy("repo_name", "file_path").orderBy("commit_hash")
    return changes.select(
        F.col("repo_name").alias("repo"),
        F.col("file_path").alias("file"),
        F.col("commit_hash").alias("commit"),
        F.col("content").alias("document"),
        F.row_number().over(order).alias("rank"),
    ).filter(F.col("rank") <= explain.MAX_SHOWN)


def _prompts(spark, folder):
    labelled = add_rule_labels(a.analysed(spark, folder))
    clusters = summary.cluster_summary(labelled)
    return explain.prompt_table(flat(spark, folder), _retrieved(spark, folder), clusters)


_FILE_PROMPTS = f"""file_prompts AS (
  SELECT c.repo_name AS repo, c.file_path AS file, CAST(c.cluster_id AS VARCHAR) AS cluster,
      anomaly_score, coalesce(e.commits, '') AS provided, concat_ws(chr(10), {_quote(explain.FILE_TASK)},
      'File: ' || c.file_path, 'Repository: ' || c.repo_name, 'Cluster: ' || k.label,
      'Anomaly: ' || anomaly_context, 'Churn: ' || churn_comparison,
      'Complexity: ' || hist_cc_label || ', ' || complexity_comparison,
      'Commits analyzed: ' || n_commits, 'Maintainability: ' || hist_mi_label,
      'Imports: ' || imports_volatility_label,
      'Raw churn rate: ' || printf('%.1f', round_even(raw_churn_rate * 100, 1)) || '%',
      'Diffs:' || chr(10) || coalesce(e.shown, '{fv.NO_DIFFS}'),
      CASE WHEN e.meaningful THEN {_quote(explain.EVIDENCE_RULE)} ELSE {_quote(explain.NO_EVIDENCE_RULE)} END,
      {_quote(explain.FILE_RULES)}) AS prompt
    FROM context c LEFT JOIN evidence e ON e.repo = c.repo_name AND e.file = c.file_path
      LEFT JOIN cluster_labels k ON k.cluster_id = c.cluster_id)"""
_PROMPTS = [*CONTEXT, a.TEXT_CHANGES, _RETRIEVED, _CLUSTER_LABELS, _FILE_PROMPTS]


@query(
    a.with_sql(*_PROMPTS)
    + "SELECT repo, file, cluster, anomaly_score, provided, md5(prompt) AS prompt_md5 FROM file_prompts"
)
def prompt_table(spark, folder):
    rows = _prompts(spark, folder)
    return rows.select(
        "repo",
        "file",
        "cluster",
        "anomaly_score",
        F.array_join("provided_commits", " ").alias("provided"),
        F.md5("prompt").alias("prompt_md5"),
    )


def _capped_sql(column: str, limit: int, marker: str, placeholder: str) -> str:
    return (
        f"CASE WHEN length({column}) > {limit} THEN substring({column}, 1, {limit}) || {_quote(marker)} "
        f"WHEN {column} = '' THEN {_quote(placeholder)} ELSE {column} END"
    )


_SNAPSHOT_PROMPT = f"""concat_ws(chr(10), {_quote(explain.SNAPSHOT_TASK)},
      'File: ' || file_path, 'Date: ' || CAST(commit_date AS VARCHAR), 'Author: ' || author,
      'Message: ' || commit_message,
      'Diff:' || chr(10) || '```' || chr(10)
        || {_capped_sql("diff", fv.PROMPT_DIFF_CHARS, fv.DIFF_MARKER, fv.NO_DIFF)} || chr(10) || '```',
      'Content:' || chr(10) || '```' || chr(10)
        || {_capped_sql("current_content", fv.PROMPT_CONTENT_CHARS, fv.CONTENT_MARKER, fv.NO_CONTENT)}
        || chr(10) || '```',
      {_quote(explain.SNAPSHOT_RULES)})"""


@query(
    a.with_sql(*_SNAPSHOT_CTES)
    + f"SELECT repo_name, file_path, md5({_SNAPSHOT_PROMPT}) AS prompt_md5 FROM snapshots"
)
def snapshot_prompt(spark, folder):
    rows = _snapshots(spark, folder)
    return rows.select("repo_name", "file_path", F.md5(explain.snapshot_prompt()).alias("prompt_md5"))


# --- generation -------------------------------------------------------------


def parrot(prompts: list[str]) -> list[str]:
    """A stand-in generator: repeats the prompt, cut to 200 words where a shorter answer is asked for.

    It refuses prompts whose length divides by 7.
    """
    answers = []
    for prompt in prompts:
        if prompt.endswith(explain.SHORTER_RULE):
            answers.append(" ".join(prompt.split()[:200]))
        elif len(prompt) % 7 == 0:
            raise ValueError("refused")
        else:
            answers.append(prompt)
    return answers


_ANSWERED = (
    f"""WITH prompts AS (SELECT *, trim(text, ' ' || chr(10)) AS stripped FROM documents),
    split AS (SELECT *, list_filter(string_split_regex(stripped, '\\s+'), lambda w: w <> '') AS words FROM prompts),
    answers AS (SELECT *, CASE WHEN length(text) % 7 = 0 THEN NULL
      WHEN len(words) > {fv.MAX_WORDS} THEN array_to_string(words[:200], ' ')
      ELSE {_replaced_sql("stripped")} END AS answer FROM split)
    SELECT doc_id, md5(coalesce(answer, 'Error generating explanation: refused')) AS explanation_md5,
      CASE WHEN answer IS NOT NULL THEN {_WORD_COUNT.format(c="answer")} END AS word_count,
      answer IS NULL AS failed FROM answers"""
)


def _document_prompts(spark, folder):
    return spread(a.table(spark, folder, "documents")).select(
        F.col("source").alias("repo"),
        F.col("doc_id").cast("string").alias("file"),
        F.lit("0").alias("cluster"),
        F.lit(0.0).alias("anomaly_score"),
        F.array().cast("array<string>").alias("provided_commits"),
        F.col("text").alias("prompt"),
    )


def _answers(rows):
    return rows.select(
        F.col("file").cast("bigint").alias("doc_id"),
        F.md5("explanation").alias("explanation_md5"),
        F.col("validation.word_count").cast("bigint").alias("word_count"),
        F.col("validation").isNull().alias("failed"),
    )


@query(_ANSWERED)
def batch_infer_retry(spark, folder):
    return _answers(explain.explain(_document_prompts(spark, folder), parrot))


def refusing(prompts: list[str]) -> list:
    """The same stand-in, with an exception in place of each answer that it refuses."""
    found = []
    for prompt in prompts:
        try:
            found += parrot([prompt])
        except ValueError as e:
            found.append(e)
    return found


@query(_ANSWERED)
def batch_checkpoints(spark, folder):
    """The same answers, committed batch by batch (three of them, at any size)."""
    prompts = _document_prompts(spark, folder)
    rows = -(-prompts.count() // 3)
    return _answers(explain.explain_pending(prompts, refusing, scratch_path(spark, "explained"), batch_rows=rows))


_SNAPSHOT_PROMPTS = f"""prompts AS (SELECT *, {_SNAPSHOT_PROMPT} AS prompt FROM snapshots)"""


@query(
    a.with_sql(*_SNAPSHOT_CTES, a.CHANGES, _SNAPSHOT_PROMPTS)
    + f"""SELECT p.repo_name AS repo, p.file_path AS file, p.commit_hash,
      md5(CASE WHEN length(prompt) % 7 = 0 THEN 'Error generating explanation: refused' ELSE prompt END)
        AS explanation_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commit_date DESC, commit_hash DESC) AS rn
        FROM prompts) p
      JOIN (SELECT file_path FROM text_changes GROUP BY file_path ORDER BY count(*) DESC, file_path
        LIMIT {fv.TOP_K}) f ON f.file_path = p.file_path WHERE rn = 1"""
)
def describe_run(spark, folder):
    changes = a.text_changes(spark, folder).select("repo_name", "file_path", "commit_hash")
    descriptions, _ = explain.describe_run(changes, _snapshots(spark, folder), parrot)
    return descriptions.select(
        "repo", "file", "commit_hash", F.md5("explanation").alias("explanation_md5")
    )


_EXPLAINED = f"""chosen AS (
  SELECT * EXCLUDE (provided), list_filter(string_split(provided, ' '), lambda v: v <> '') AS provided
  FROM file_prompts ORDER BY anomaly_score DESC, repo, file LIMIT {fv.TOP_K}),
first_answers AS (
  SELECT *, CASE WHEN length(prompt) % 7 <> 0 THEN {_replaced_sql("prompt")} END AS answer FROM chosen),
final_answers AS (
  SELECT *, CASE WHEN answer IS NULL THEN 'Error generating explanation: refused'
    WHEN {_WORD_COUNT.format(c="answer")} > {fv.MAX_WORDS} THEN array_to_string(list_filter(string_split_regex(
      prompt || chr(10) || chr(10) || {_quote(explain.SHORTER_RULE)}, '\\s+'), lambda w: w <> '')[:200], ' ')
    ELSE answer END AS explanation FROM first_answers)"""
_EXPLAINED_WORDS = a.WORDS.replace("FROM explanations", "FROM final_answers")


_EXPLANATION_ROWS = f"""SELECT repo, file, cluster, anomaly_score, answer IS NULL AS failed,
      CASE WHEN answer IS NOT NULL THEN {_WORD_COUNT.format(c="explanation")} END AS word_count,
      len(list_filter(hashes, lambda t: len(list_filter(provided, lambda v:
        {_SUPPORTED.format(t='t')})) > 0)) > 0 AS grounded,
      md5(CASE WHEN len(provided) = 0 OR answer IS NULL THEN explanation ELSE array_to_string(
        list_transform(parts, lambda w, i: (CASE WHEN regexp_full_match(w, '[a-f0-9]{{7,40}}')
          AND len(list_filter(provided, lambda v: {_SUPPORTED.format(t='w')})) = 0 THEN '[commit]'
          ELSE w END) || coalesce(gaps[i], '')), '') END) AS explanation_md5,
      {fv.TOP_K} AS files_reported FROM tokens"""


def _explained(explanations, report):
    schema = "metadata struct<files_analyzed:int>"
    reported = report.select(F.from_json("json", schema)["metadata"]["files_analyzed"]).scalar()
    return explanations.select(
        "repo",
        "file",
        "cluster",
        "anomaly_score",
        F.col("validation").isNull().alias("failed"),
        F.col("validation.word_count").cast("bigint").alias("word_count"),
        (F.size("referenced_commits") > 0).alias("grounded"),
        F.md5("explanation").alias("explanation_md5"),
    ).withColumn("files_reported", reported)


@query(a.with_sql(*_PROMPTS, _EXPLAINED, _EXPLAINED_WORDS) + _EXPLANATION_ROWS)
def explain_run(spark, folder):
    """Select, explain, measure, synthesise and report, with the stand-in generator."""
    labelled = add_rule_labels(a.analysed(spark, folder))
    clusters = summary.cluster_summary(labelled)
    retrieved = _retrieved(spark, folder)
    explanations, report = explain.explain_run(flat(spark, folder), retrieved, clusters, parrot)
    return _explained(explanations, report)


# Vectors that SQL can count as well: how often each of these letters occurs.
_LETTERS = "aeinorstlmd0123456789"
_CHANGE_SCOPES = """change_scopes AS (
  SELECT repo_name, file_path, CASE WHEN count(*) % 3 = 0 THEN NULL
    WHEN count(*) % 3 = 1 THEN list_distinct([min(commit_hash), max(commit_hash)])
    ELSE list_distinct([min(commit_hash), max(commit_hash), arg_min(commit_hash, md5(commit_hash || 'a')),
      arg_max(commit_hash, md5(commit_hash || 'a')), arg_min(commit_hash, md5(commit_hash || 'b')),
      arg_max(commit_hash, md5(commit_hash || 'b'))]) END AS inflection
  FROM text_changes GROUP BY repo_name, file_path)"""


def _letters_sql(column: str) -> str:
    letters = ", ".join(f"'{c}'" for c in _LETTERS)
    return f"list_transform([{letters}], lambda c: CAST(length({column}) - length(replace({column}, c, '')) AS DOUBLE))"


_SEARCHED = f"""questions AS (
  SELECT repo_name, file_path, 'Find code changes related to:' || chr(10) || 'File: ' || file_path
    || chr(10) || 'Repository: ' || repo_name || chr(10) || 'Behavior: ' || churn_label
    || ', anomaly score ' || q // 1000 || '.' || lpad(CAST(q % 1000 AS VARCHAR), 3, '0') AS question
  FROM thousandths),
searched AS (
  SELECT c.repo_name, c.file_path, commit_hash, content, inflection,
    list_distance({_letters_sql("question")}, {_letters_sql("content")}) AS distance
  FROM text_changes c JOIN questions USING (repo_name, file_path) JOIN change_scopes USING (repo_name, file_path)
  WHERE inflection IS NULL OR list_contains(inflection, commit_hash)),
retrieved AS (
  SELECT repo_name AS repo, file_path AS file, commit_hash AS "commit", content AS document,
    CASE WHEN inflection IS NOT NULL AND count(*) OVER (PARTITION BY repo_name, file_path) <= 3
      THEN row_number() OVER (PARTITION BY repo_name, file_path ORDER BY commit_hash)
      ELSE row_number() OVER (PARTITION BY repo_name, file_path ORDER BY distance, commit_hash) END AS rank
  FROM searched),
evidence AS {_RETRIEVED.split("evidence AS", 1)[1]}"""
_SEARCHED_PROMPTS = [*CONTEXT, a.TEXT_CHANGES, _CHANGE_SCOPES, _THOUSANDTHS, _SEARCHED, _CLUSTER_LABELS, _FILE_PROMPTS]


def count_letters(df, column, output):
    counts = [F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit(""))) for c in _LETTERS]
    return df.withColumn(output, F.array(*[c.cast("float") for c in counts]))


def _change_corpus(spark, folder):
    """Every change as a document with its vector, and the commits that some entities name."""
    documents = a.text_changes(spark, folder).select(
        F.col("repo_name").alias("repo"),
        F.col("file_path").alias("file"),
        F.col("commit_hash").alias("commit"),
        F.col("content").alias("document"),
    )
    ends = [F.min("commit"), F.max("commit")]
    drawn = [pick("commit", F.md5(F.concat("commit", F.lit(x)))) for x in "ab" for pick in (F.min_by, F.max_by)]
    named = (
        F.when(F.count("*") % 3 == 1, F.array_distinct(F.array(*ends)))
        .when(F.count("*") % 3 == 2, F.array_distinct(F.array(*ends, *drawn)))
    )
    inflections = documents.groupBy("repo", "file").agg(named.alias("inflection_commits"))
    return count_letters(documents, "document", "embedding"), inflections


@query(
    a.with_sql(*_SEARCHED_PROMPTS)
    + """SELECT repo, file, anomaly_score, provided, md5(prompt) AS prompt_md5 FROM file_prompts"""
)
def prompt_retrieval(spark, folder):
    """Entity, question, vector, search in its scope and prompt, for every entity, in one plan."""
    corpus, inflections = _change_corpus(spark, folder)
    entities = flat(spark, folder)
    retrieved = explain.retrieve_evidence(entities, corpus, count_letters, inflections)
    clusters = summary.cluster_summary(add_rule_labels(a.analysed(spark, folder)))
    rows = explain.prompt_table(entities, retrieved, clusters)
    provided = F.array_join("provided_commits", " ").alias("provided")
    return rows.select("repo", "file", "anomaly_score", provided, F.md5("prompt").alias("prompt_md5"))


@query(a.with_sql(*_SEARCHED_PROMPTS, _EXPLAINED, _EXPLAINED_WORDS) + _EXPLANATION_ROWS)
def explain_corpus(spark, folder):
    """The run with its own retrieval, from entities and documents to the report."""
    corpus, inflections = _change_corpus(spark, folder)
    clusters = summary.cluster_summary(add_rule_labels(a.analysed(spark, folder)))
    found = explain.explain_corpus(
        flat(spark, folder), corpus, clusters, parrot, embed=count_letters, inflections=inflections
    )
    return _explained(*found)
