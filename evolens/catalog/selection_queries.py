"""Queries that select, compare and summarise entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.catalog import adapters as a
from evolens.catalog.registry import query
from evolens.catalog.source_queries import DATED, dated_text
from evolens.functions import fixed_values as fv
from evolens.functions import paths, times
from evolens.functions.labels import add_rule_labels
from evolens.operators import context, quantiles, selection, summary
from evolens.session import materialise
from evolens.plans import study
from evolens.plans.analysis import flatten, pack
from evolens.sources import writers

REPOS = ("repo0", "repo1", "repo2")


def _labelled(spark, folder):
    return add_rule_labels(a.analysed(spark, folder))


def flat(spark, folder):
    rows = flatten(pack(_labelled(spark, folder)))
    return rows.withColumn("volatility_cc", F.col("volatility_comparison.cc")).drop(
        "volatility_comparison"
    )


FLAT = [a.ANALYSED, a.LABELLED, a.FLAT]

_COUNTS = """counts AS (
  SELECT repo_name, file_path, count(DISTINCT commit_hash) AS n_commits FROM changes
  WHERE repo_name IN ('repo0', 'repo1', 'repo2') GROUP BY repo_name, file_path)"""


@query(a.with_sql(a.CHANGES, _COUNTS) + "SELECT * FROM counts")
def commit_counts(spark, folder):
    return selection.commit_counts(a.changes(spark, folder), REPOS)


@query(
    a.with_sql(a.CHANGES)
    + """SELECT repo_name, file_path, true AS within_error FROM changes
    WHERE file_path <> '' AND commit_hash <> '' GROUP BY repo_name, file_path"""
)
def commit_count_sketches(spark, folder):
    """Sketches of two increments, united, against exact counts: within four standard errors."""
    changes = a.changes(spark, folder)
    added = F.pmod(F.xxhash64("commit_hash", "change_type"), F.lit(2))
    stored = [materialise(selection.commit_sketches(changes.where(added == i))) for i in (0, 1)]
    exact = selection.commit_counts(changes).withColumnRenamed("n_commits", "exact")
    both = selection.merged_counts(*stored).join(exact, ["repo_name", "file_path"])
    allowed = F.greatest(F.lit(0.5), 4 * selection.sketch_error() * F.col("exact"))
    return both.select("repo_name", "file_path", (F.abs(F.col("n_commits") - F.col("exact")) <= allowed).alias("within_error"))


_TOP_COUNT = f"""top_count AS (
  SELECT repo_name, file_path, CAST(n_commits AS DOUBLE) AS score, 'commit_count' AS score_label FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n_commits DESC, file_path) AS rn FROM counts)
  WHERE rn <= {fv.TOP_K})"""
_TOP_ANOMALY = f"""top_anomaly AS (
  SELECT repo_name, file_path, score, 'anomaly_score' AS score_label FROM (
    SELECT repo_name, file_path, anomaly_score AS score, row_number() OVER (PARTITION BY repo_name
      ORDER BY anomaly_score DESC, file_path) AS rn FROM analysed) WHERE rn <= {fv.TOP_K})"""


@query(a.with_sql(a.CHANGES, _COUNTS, _TOP_COUNT) + "SELECT * FROM top_count")
def topk_commit_count(spark, folder):
    return selection.select_by_commit_count(commit_counts(spark, folder))


@query(a.with_sql(a.ANALYSED, _TOP_ANOMALY) + "SELECT * FROM top_anomaly")
def topk_anomaly(spark, folder):
    return selection.select_by_anomaly(a.analysed(spark, folder), repos=REPOS)


@query(
    a.with_sql(*FLAT)
    + """SELECT repo_name, file_path, n_commits, churn_label, anomaly_score FROM flat
      ORDER BY anomaly_score DESC, repo_name, file_path LIMIT 15"""
)
def topk_global(spark, folder):
    top = selection.top_k(flat(spark, folder), "anomaly_score", 15)
    return top.select("repo_name", "file_path", "n_commits", "churn_label", "anomaly_score")


@query(
    a.with_sql(a.ANALYSED, _TOP_ANOMALY)
    + """SELECT repo_name, '[' || string_agg('{"repo_name":"' || repo_name || '","file_path":"'
      || replace(file_path, '\\', '\\\\') || '","score":' || CAST(score AS VARCHAR)
      || ',"score_label":"anomaly_score"}', ',' ORDER BY score DESC, file_path) || ']' AS records
    FROM top_anomaly GROUP BY repo_name"""
)
def selection_grouped_json(spark, folder):
    top = selection.select_by_anomaly(a.analysed(spark, folder))
    return writers.grouped_json(top, "repo_name", [-F.col("score"), F.col("file_path")])


@query(
    a.with_sql(a.ANALYSED)
    + """SELECT repo_name, file_path, CAST(cluster_id AS VARCHAR) AS cluster_id,
      CAST(CAST(anomaly_score * 10000 AS BIGINT) AS VARCHAR) AS anomaly_score FROM analysed"""
)
def cluster_assignments(spark, folder):
    whole = F.round(F.col("anomaly_score") * 10000).cast("bigint")
    scored = a.analysed(spark, folder).withColumn("anomaly_score", whole)
    return selection.cluster_assignments(scored, REPOS)


def _type_sql(path: str) -> str:
    lowered = f"lower(replace({path}, '\\', '/'))"
    parts = f"string_split({lowered}, '/')"
    name = f"{parts}[-1]"

    def ends(suffixes) -> str:
        return " OR ".join(f"ends_with({name}, '{s}')" for s in suffixes)

    def within(names) -> str:
        return " OR ".join(f"list_contains({parts}, '{n}')" for n in names)

    deps = ", ".join(f"'{n}'" for n in fv.DEP_FILENAMES)
    return (
        f"CASE WHEN {within(fv.TEST_DIRS)} OR starts_with({name}, '{fv.TEST_PREFIX}') "
        f"OR {ends(fv.TEST_SUFFIXES)} THEN 'tests' "
        f"WHEN {within(fv.DOC_DIRS)} OR {ends(fv.DOC_SUFFIXES)} THEN 'docs' "
        f"WHEN {name} IN ({deps}) OR {within(fv.DEP_DIRS)} OR {ends(fv.DEP_SUFFIXES)} THEN 'deps' "
        "ELSE 'code' END"
    )


@query(
    f"WITH files AS (SELECT p_partkey, {a.path_sql('p_partkey')} AS file_path FROM part) "
    f"SELECT p_partkey, {_type_sql('file_path')} AS file_type, "
    "string_split(replace(file_path, '\\', '/'), '/')[-1] AS file_name FROM files"
)
def file_type(spark, folder):
    path = a.path_of(F.col("p_partkey"))
    return a.table(spark, folder, "part").select(
        "p_partkey", paths.file_type(path).alias("file_type"), paths.file_name(path).alias("file_name")
    )


# Metadata of the files in the change log alone, so that some selected files have none.
_META = f"""meta AS (
  SELECT DISTINCT repo_name, file_path, {_type_sql("file_path")} AS file_type FROM changes)"""
_BOTH = f"""both_modes AS (
  SELECT repo_name AS repo, file_path, '{fv.MODE_FREQUENCY}' AS mode FROM top_count UNION ALL
  SELECT repo_name, file_path, '{fv.MODE_ANOMALY}' FROM top_anomaly)"""
_TYPES = """types AS (
  SELECT s.repo, s.mode, m.file_type, count(*) AS "count" FROM both_modes s JOIN meta m
    ON m.repo_name = s.repo AND m.file_path = s.file_path GROUP BY ALL)"""
_STUDY = [a.CHANGES, _COUNTS, _TOP_COUNT, a.ANALYSED, _TOP_ANOMALY, _META, _BOTH, _TYPES]


def _study(spark, folder):
    changes = a.changes(spark, folder)
    metadata = selection.file_metadata([changes])
    return study.compare_selections(changes, a.analysed(spark, folder), metadata, repos=REPOS)


@query(
    a.with_sql(*_STUDY)
    + f"""SELECT repo, mode, {fv.TOP_K} AS k_fixed, file_type AS dominant_file_type, "count" FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, mode ORDER BY "count" DESC, file_type) AS rn
      FROM types) WHERE rn = 1"""
)
def selection_quality(spark, folder):
    return _study(spark, folder)["selection_quality"]


@query(
    a.with_sql(*_STUDY)
    + """SELECT repo, mode, file_type, round_even(CAST(100 * "count" AS DOUBLE)
      / sum("count") OVER (PARTITION BY repo, mode), 2) AS percent FROM types"""
)
def file_type_distribution(spark, folder):
    return _study(spark, folder)["file_type_distribution"]


@query(
    a.with_sql(*_STUDY)
    + f"""SELECT s.repo, s.mode, {fv.TOP_K} AS files_explained, count(DISTINCT c.cluster_id) AS clusters_covered
    FROM both_modes s LEFT JOIN analysed c ON c.repo_name = s.repo AND c.file_path = s.file_path
    GROUP BY s.repo, s.mode"""
)
def cluster_coverage(spark, folder):
    return _study(spark, folder)["cluster_coverage"]


@query(
    a.with_sql(a.CHANGES, a.ANALYSED, a.HISTORY)
    + f"""SELECT repo_name, file_path, {_type_sql("file_path")} AS file_type FROM (
      SELECT repo_name, file_path FROM analysed UNION SELECT repo_name, file_path FROM changes
      UNION SELECT repo_name, file_path FROM history)"""
)
def file_metadata(spark, folder):
    tables = [a.analysed(spark, folder), a.changes(spark, folder), a.history(spark, folder)]
    return selection.file_metadata(tables)


@query("SELECT DISTINCT source FROM documents")
def distinct_values(spark, folder):
    return summary.distinct_values(a.table(spark, folder, "documents"), "source")


# --- series -----------------------------------------------------------------

_LONGEST = """dates AS (
  SELECT repo_name, CAST(o_orderkey AS VARCHAR) AS commit_hash, instant FROM dated WHERE instant IS NOT NULL),
sizes AS (
  SELECT repo_name, file_path, count(*) AS n FROM changes GROUP BY repo_name, file_path),
longest AS (
  SELECT repo_name, file_path FROM (SELECT *, row_number() OVER (PARTITION BY repo_name
    ORDER BY n DESC, file_path DESC) AS rn FROM sizes) WHERE rn = 1),
series AS (
  SELECT c.repo_name, c.file_path, c.commit_hash, d.instant,
    CASE WHEN c.change_type = 'D' THEN 'gone' ELSE CAST(length(c.commit_hash) AS VARCHAR) END AS metric_value
  FROM changes c JOIN longest l ON l.repo_name = c.repo_name AND l.file_path = c.file_path
    LEFT JOIN dates d ON d.repo_name = c.repo_name AND d.commit_hash = c.commit_hash)"""
_SERIES = [a.CHANGES, DATED, _LONGEST]


def _series(spark, folder):
    metrics = a.changes(spark, folder).withColumn(
        "loc_after",
        F.when(F.col("change_type") == "D", F.lit("gone")).otherwise(
            F.length("commit_hash").cast("string")
        ),
    )
    snapshots = dated_text(spark, folder).select(
        "repo_name",
        F.col("o_orderkey").cast("string").alias("commit_hash"),
        F.col("written").alias("commit_date"),
        F.col("o_orderkey").alias("ingest"),
    )
    return study.longest_series(metrics, study.commit_dates(snapshots, "ingest"), repos=REPOS)


@query(
    a.with_sql(*_SERIES)
    + """SELECT repo_name, file_path, 'loc_after' AS metric, commit_hash,
      strftime(instant, '%Y-%m-%dT%H:%M:%S') AS commit_date, metric_value FROM series"""
)
def longest_series(spark, folder):
    rows = _series(spark, folder)
    return rows.withColumn("commit_date", times.iso_utc(F.col("commit_date")))


@query(
    a.with_sql(*_SERIES)
    + """SELECT repo_name, file_path, commit_hash, strftime(instant, '%Y-%m-%dT%H:%M:%S') AS commit_date,
      TRY_CAST(metric_value AS DOUBLE) AS metric_value FROM series
    WHERE repo_name = (SELECT min(repo_name) FROM series) AND instant IS NOT NULL
      AND TRY_CAST(metric_value AS DOUBLE) IS NOT NULL"""
)
def series_clean(spark, folder):
    rows = study.first_series(_series(spark, folder))
    return rows.select(
        "repo_name",
        "file_path",
        "commit_hash",
        times.iso_utc(F.col("commit_date")).alias("commit_date"),
        "metric_value",
    )


# --- analysed records -------------------------------------------------------

# Column of the nested record, its name in the result, and its SQL.
_PACKED = (
    ("repo_name", "repo_name", "repo_name"),
    ("file_path", "file_path", "file_path"),
    ("historical_trends.cc.label", "cc_label", "cc_trend_label"),
    ("historical_trends.cc.value", "cc_value", "round_even(cc_trend, 6)"),
    ("historical_trends.mi.value", "mi_value", "round_even(mi_trend, 6)"),
    ("recent_trends.imports.value", "recent_imports", "round_even(recent_imports_trend, 6)"),
    (
        "recent_trends.imports.vs_historical",
        "recent_imports_label",
        "recent_imports_trend_vs_historical",
    ),
    ("volatility_comparison.cc", "volatility", "recent_cc_volatility_vs_historical"),
    ("raw_features.std_cc_after", "std_cc", "round_even(std_cc_after, 4)"),
    ("anomaly_score", "anomaly", "round_even(anomaly_score, 4)"),
)


@query(
    a.with_sql(a.ANALYSED, a.LABELLED)
    + "SELECT "
    + ", ".join(f"{sql} AS {name}" for _, name, sql in _PACKED)
    + " FROM labelled"
)
def pack_analysis(spark, folder):
    packed = pack(_labelled(spark, folder))
    return packed.select(*[F.col(column).alias(name) for column, name, _ in _PACKED])


@query(a.with_sql(*FLAT) + "SELECT * FROM flat")
def flatten_analysis(spark, folder):
    return flat(spark, folder)


@query(
    a.with_sql(*FLAT)
    + f"""SELECT {', '.join(summary.DASHBOARD_COLUMNS)} FROM flat
      WHERE repo_name = 'repo1' AND cluster_id IN (1, 2, 3, 5) AND anomaly_score >= 0.2"""
)
def dashboard_table(spark, folder):
    chosen = summary.dashboard_filter(flat(spark, folder), "repo1", [1, 2, 3, 5], 0.2)
    return summary.dashboard_table(chosen)


@query(
    a.with_sql(*FLAT)
    + """SELECT file_path, n_commits, cluster_id, raw_churn_rate, anomaly_score, hist_cc_value FROM flat"""
)
def scatter_inputs(spark, folder):
    return summary.scatter_inputs(flat(spark, folder))


@query(
    a.with_sql(*FLAT)
    + """SELECT count(*) AS files_analyzed, round_even(avg(anomaly_score), 3) AS avg_anomaly,
      count(DISTINCT cluster_id) AS clusters_present FROM flat"""
)
def overview_kpis(spark, folder):
    return summary.overview(flat(spark, folder))


@query(a.with_sql(a.ANALYSED) + "SELECT cluster_id, count(*) AS file_count FROM analysed GROUP BY cluster_id")
def cluster_sizes(spark, folder):
    return summary.count_by(a.analysed(spark, folder), "cluster_id", "file_count")


@query(
    a.with_sql(*FLAT)
    + " UNION ALL ".join(
        f"SELECT '{name}' AS slice, repo_name, file_path, anomaly_score FROM flat WHERE {c} = '{v}'"
        for name, (c, v) in summary.LABEL_SLICES.items()
    )
)
def label_slices(spark, folder):
    rows = flat(spark, folder)
    slices = [
        summary.label_slice(rows, name).select(
            F.lit(name).alias("slice"), "repo_name", "file_path", "anomaly_score"
        )
        for name in summary.LABEL_SLICES
    ]
    return reduce(DataFrame.unionByName, slices)


@query(
    a.with_sql(*FLAT)
    + "SELECT "
    + ", ".join(
        f"count(*) FILTER ({c} = '{v}') AS {name}" for name, (c, v) in summary.LABEL_SLICES.items()
    )
    + " FROM flat"
)
def label_slice_totals(spark, folder):
    return summary.label_slice_totals(flat(spark, folder))


_AVERAGES = ", ".join(f"round(avg({s}), 6) AS {n}" for n, s in summary.CLUSTER_AVERAGES.items())
_CLUSTER_LABEL = """concat_ws(', ',
  CASE WHEN avg(churn_rate) > 0.7 THEN 'high churn' WHEN avg(churn_rate) > 0.3 THEN 'moderate churn'
    ELSE 'low churn' END,
  CASE WHEN avg(cc_trend) > 0.01 THEN 'growing complexity' WHEN avg(cc_trend) < -0.01
    THEN 'declining complexity' ELSE 'stable complexity' END,
  CASE WHEN avg(std_cc_after) > 1 THEN 'high volatility' END)"""


@query(
    a.with_sql(a.ANALYSED, a.LABELLED)
    + f"""SELECT cluster_id, count(*) AS size, {_AVERAGES}, {_CLUSTER_LABEL} AS derived_cluster_label,
      count(*) FILTER (churn_label = 'high') AS churn_high,
      count(*) FILTER (cc_trend_label = 'stable') AS trend_stable FROM labelled GROUP BY cluster_id"""
)
def cluster_summary(spark, folder):
    rows = summary.cluster_summary(_labelled(spark, folder))
    return rows.select(
        "cluster_id",
        "size",
        *[F.round(n, 6).alias(n) for n in summary.CLUSTER_AVERAGES],
        "derived_cluster_label",
        F.coalesce(F.col("churn_label_distribution")["high"], F.lit(0)).alias("churn_high"),
        F.coalesce(F.col("cc_trend_label_distribution")["stable"], F.lit(0)).alias("trend_stable"),
    )


@query(
    a.with_sql(a.ANALYSED, a.LABELLED)
    + """SELECT cluster_id, churn_label, count(*) AS "rows" FROM labelled GROUP BY cluster_id, churn_label"""
)
def label_distribution(spark, folder):
    return summary.label_distribution(_labelled(spark, folder), "cluster_id", "churn_label")


_MEDIANS = """medians AS (
  SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, median(raw_churn_rate) AS median_churn,
    median(hist_cc_value) AS median_cc_slope FROM flat GROUP BY cluster_id)"""


@query(
    a.with_sql(*FLAT, _MEDIANS)
    + """SELECT cluster_id, round(median_churn, 6) AS median_churn,
      round(median_cc_slope, 6) AS median_cc_slope FROM medians"""
)
def cluster_medians(spark, folder):
    medians = context.cluster_medians(flat(spark, folder))
    return medians.withColumns({c: F.round(c, 6) for c in ("median_churn", "median_cc_slope")})


_RANKS = """ranked AS (
  SELECT f.*, CAST(floor((below + upto + 1) * (CAST(50 AS DOUBLE) / total)) AS INTEGER) AS percentile
  FROM flat f JOIN (
    SELECT anomaly_score, upto - n AS below, upto, total FROM (
      SELECT anomaly_score, count(*) AS n, sum(count(*)) OVER (ORDER BY anomaly_score) AS upto,
        sum(count(*)) OVER () AS total FROM flat GROUP BY anomaly_score)) r
  ON r.anomaly_score = f.anomaly_score)"""


@query(
    a.with_sql(*FLAT, _RANKS)
    + "SELECT repo_name, file_path, percentile, 100 - percentile AS top_percent FROM ranked"
)
def percentile_rank(spark, folder):
    ranked = quantiles.with_percentile_rank(flat(spark, folder), "anomaly_score")
    return ranked.select("repo_name", "file_path", "percentile", "top_percent")


@query(
    """WITH counts AS (SELECT l_extendedprice * (1 - l_discount) AS price, count(*) AS n FROM lineitem GROUP BY ALL),
    places AS (SELECT price, sum(n) OVER (ORDER BY price) AS upto, n, sum(n) OVER () AS total FROM counts)
    SELECT l_orderkey, l_linenumber, CAST(floor((upto - n + upto + 1) * (CAST(50 AS DOUBLE) / total)) AS INTEGER) AS percentile
    FROM lineitem JOIN places ON price = l_extendedprice * (1 - l_discount)"""
)
def percentile_rank_unrounded(spark, folder):
    """Nearly as many different scores as rows."""
    lines = a.table(spark, folder, "lineitem").withColumn("price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return quantiles.with_percentile_rank(lines, "price").select("l_orderkey", "l_linenumber", "percentile")


CONTEXT = [
    *FLAT,
    _MEDIANS,
    _RANKS,
    """rated AS (
  SELECT r.*, 100 - percentile AS top, coalesce(m.median_cc_slope, 0) AS median_slope,
    CASE WHEN coalesce(m.median_churn, 0) > 0 THEN r.raw_churn_rate / m.median_churn ELSE 1 END AS ratio
  FROM ranked r LEFT JOIN medians m ON m.cluster_id = CAST(r.cluster_id AS VARCHAR)),
context AS (
  SELECT *,
    CASE WHEN top <= 5 THEN 'Top ' || top || '% most atypical (extreme outlier)'
      WHEN top <= 20 THEN 'Top ' || top || '% most atypical' ELSE percentile || 'th percentile' END
      AS anomaly_context,
    printf('%.2f', round_even(ratio, 2)) || '× cluster median (' || CASE
      WHEN ratio < 0.8 THEN 'lower than cluster median (more stable)'
      WHEN ratio < 1.2 THEN 'similar to cluster median'
      WHEN ratio < 2 THEN 'moderately higher than cluster median'
      ELSE 'significantly higher than cluster median' END || ')' AS churn_comparison,
    CASE WHEN abs(median_slope) > 0.001 THEN
      CAST(round_even(abs(hist_cc_value / median_slope), 2) AS VARCHAR) || 'x '
      || CASE WHEN abs(hist_cc_value) > abs(median_slope) THEN 'faster' ELSE 'slower' END
      || ' than cluster median'
      ELSE 'slope ' || printf('%.4f', round_even(hist_cc_value, 4)) END AS complexity_comparison
  FROM rated)""",
]


@query(
    a.with_sql(*CONTEXT)
    + """SELECT repo_name, file_path, anomaly_context, churn_comparison, complexity_comparison, n_commits
    FROM context"""
)
def interpretation_context(spark, folder):
    rows = context.with_context(flat(spark, folder))
    return rows.select(
        "repo_name",
        "file_path",
        "anomaly_context",
        "churn_comparison",
        "complexity_comparison",
        "n_commits",
    )


@query(
    a.with_sql(*CONTEXT)
    + """SELECT repo_name, file_path, printf('%.1f', round_even(ratio, 1)) || 'x cluster median' AS churn_vs_cluster,
      hist_cc_label || ' (slope: ' || printf('%.4f', round_even(hist_cc_value, 4)) || ')' AS complexity_trend,
      hist_mi_label AS maintainability_trend, imports_volatility_label AS import_volatility FROM rated"""
)
def key_signals(spark, folder):
    rows = context.with_context(flat(spark, folder))
    return rows.select(
        "repo_name",
        "file_path",
        "churn_vs_cluster",
        "complexity_trend",
        "maintainability_trend",
        "import_volatility",
    )


@query(
    """SELECT o_orderkey, round((high - o_totalprice) / (high - low), 6) AS inverted
    FROM orders, (SELECT max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders)"""
)
def minmax_invert(spark, folder):
    prices = a.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    rows = quantiles.invert_min_max(prices, "o_totalprice", "inverted")
    return rows.select("o_orderkey", F.round("inverted", 6).alias("inverted"))


@query(
    a.with_sql(a.CHANGES)
    + """SELECT repo_name, commit_hash, count(*) AS files, count(DISTINCT file_path) AS distinct_files,
      CAST(sum(count(*)) OVER () AS BIGINT) AS total_files FROM changes GROUP BY repo_name, commit_hash"""
)
def files_per_commit(spark, folder):
    per_commit = summary.files_per_commit(a.changes(spark, folder))
    totals = summary.commit_totals(per_commit).select("total_files")
    return per_commit.withColumn("total_files", totals.scalar())
