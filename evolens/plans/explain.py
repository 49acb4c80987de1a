"""Explaining entities in batches: prompt tables in, checked response tables out.

The text generator itself is an outside service: any callable that takes a list of
prompts and returns a list of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import text
from evolens.operators import summary
from evolens.operators.context import with_context
from evolens.operators.joins import lookup_join
from evolens.operators.ordering import running_totals
from evolens.operators.retrieval import SCOPE, entity_query, hash_embedding, knn_windowed
from evolens.operators.selection import latest_by_frequency, top_k, top_k_per_group
from evolens.session import materialise, spread
from evolens.sources import parts
from evolens.sources.writers import pending, report_json, report_markdown

Generator = Callable[[list[str]], Sequence[str]]
# Adds a column of vectors to a table: (table, text column, vector column).
Embedder = Callable[[DataFrame, str, str], DataFrame]

# --- prompts ----------------------------------------------------------------

# Our own wording; the four headings are the ones answers are checked for.
FILE_TASK = "Say in plain words what is unusual about the history of this file."
FILE_RULES = (
    "Use these headings: ### Why This File Stands Out (two sentences, no numbers), "
    "### Evidence from Metrics (three points, each with a comparison), "
    "### Evidence from Code Changes, ### What Makes This Unusual (one sentence). "
    "At most 220 words. Name only commits shown above. No advice and no predictions."
)
EVIDENCE_RULE = "Name up to two of the commits above, and only where a change explains a number."
NO_EVIDENCE_RULE = "There is too little commit evidence; say so under the code heading."
SHORTER_RULE = "Answer in fewer than 200 words."
SNAPSHOT_TASK = "Describe what this one commit changed in this file."
SNAPSHOT_RULES = (
    "Use these headings: ### Change Summary, ### Specific Modifications, ### Apparent Intent, "
    "### Code Implications. At most 200 words. Describe only what is shown."
)
CHANGES_TASK = "Summarise the kinds of change these descriptions have in common."
SYNTHESIS_TASK = "Describe patterns that show only when these files are compared with each other."

MAX_SHOWN = 2
# Prompts of a batch, after which results are committed.
BATCH_ROWS = 1_000
# Prompts that a generator is given at once.
SENT_ROWS = 500
# Prompts of a batch that one task writes.
TASK_ROWS = 10_000
_PLAN, _RESULT = "plan", "result"
SHOWN_CHANGE = "[change %d, made by %s]\n%s\n[end of change %d]\n"


def evidence_text(documents: Column) -> Column:
    """The first documents of a list of (commit, document), or a note that there are none."""
    shown = F.transform(
        F.slice(documents, 1, MAX_SHOWN),
        lambda d, i: F.format_string(
            SHOWN_CHANGE, i + 1, text.short_hash(d["commit"]), d["document"], i + 1
        ),
    )
    return F.when(F.coalesce(F.size(documents), F.lit(0)) > 0, F.array_join(shown, "")).otherwise(
        F.lit(fv.NO_DIFFS)
    )


def file_prompt(documents: Column, cluster_label: Column) -> Column:
    """The prompt of one entity from its context columns and retrieved documents."""
    meaningful = F.exists(documents, lambda d: F.length(d["document"]) > fv.MEANINGFUL_CHARS)
    rule = F.when(F.coalesce(meaningful, F.lit(False)), EVIDENCE_RULE).otherwise(NO_EVIDENCE_RULE)
    percent = F.format_string("%.1f%%", F.bround(F.col("raw_churn_rate") * 100, 1))
    return F.concat_ws(
        "\n",
        F.lit(FILE_TASK),
        F.concat(F.lit("File: "), F.col("file_path")),
        F.concat(F.lit("Repository: "), F.col("repo_name")),
        F.concat(F.lit("Cluster: "), cluster_label),
        F.concat(F.lit("Anomaly: "), F.col("anomaly_context")),
        F.concat(F.lit("Churn: "), F.col("churn_comparison")),
        F.concat(
            F.lit("Complexity: "), F.col("hist_cc_label"), F.lit(", "), F.col("complexity_comparison")
        ),
        F.concat(F.lit("Commits analyzed: "), F.col("n_commits").cast("string")),
        F.concat(F.lit("Maintainability: "), F.col("hist_mi_label")),
        F.concat(F.lit("Imports: "), F.coalesce("imports_volatility_label", F.lit("N/A"))),
        F.concat(F.lit("Raw churn rate: "), percent),
        F.concat(F.lit("Diffs:\n"), evidence_text(documents)),
        rule,
        F.lit(FILE_RULES),
    )


def snapshot_prompt() -> Column:
    """The prompt of one commit snapshot, with long diffs and contents capped."""
    diff = text.cap_marked(F.col("diff"), fv.PROMPT_DIFF_CHARS, fv.DIFF_MARKER, fv.NO_DIFF)
    content = text.cap_marked(
        F.col("current_content"), fv.PROMPT_CONTENT_CHARS, fv.CONTENT_MARKER, fv.NO_CONTENT
    )
    return F.concat_ws(
        "\n",
        F.lit(SNAPSHOT_TASK),
        F.concat(F.lit("File: "), F.col("file_path")),
        F.concat(F.lit("Date: "), F.col("commit_date").cast("string")),
        F.concat(F.lit("Author: "), F.col("author")),
        F.concat(F.lit("Message: "), F.col("commit_message")),
        F.concat(F.lit("Diff:\n```\n"), diff, F.lit("\n```")),
        F.concat(F.lit("Content:\n```\n"), content, F.lit("\n```")),
        F.lit(SNAPSHOT_RULES),
    )


def prompt_table(
    flat: DataFrame,
    retrieved: DataFrame,
    cluster_labels: DataFrame,
    everyone: DataFrame | None = None,
) -> DataFrame:
    """Selected entities with their context, documents and prompt.

    ``retrieved`` holds a few ranked documents per entity, so the list per entity
    is short. A cluster without a label is named by its number.
    """
    documents = retrieved.filter(F.col("rank") <= MAX_SHOWN).groupBy(*SCOPE).agg(
        F.sort_array(F.collect_list(F.struct("rank", "commit", "document"))).alias("documents")
    )
    documents = documents.withColumnsRenamed({"repo": "repo_name", "file": "file_path"})
    contextual = with_context(flat, everyone).join(documents, ["repo_name", "file_path"], "left")
    labels = cluster_labels.select("cluster_id", F.col("derived_cluster_label").alias("_label"))
    labels = materialise(labels)
    joined = lookup_join(contextual, labels, ["cluster_id"], "left")
    label = F.coalesce(
        "_label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    )
    commits = F.coalesce(
        F.transform("documents", lambda d: d["commit"]), F.array().cast("array<string>")
    )
    return joined.select(
        F.col("repo_name").alias("repo"),
        F.col("file_path").alias("file"),
        F.col("cluster_id").cast("string").alias("cluster"),
        "anomaly_score",
        commits.alias("provided_commits"),
        file_prompt(F.col("documents"), label).alias("prompt"),
    )


def retrieve_evidence(
    flat: DataFrame,
    corpus: DataFrame,
    embed: Embedder = hash_embedding,
    inflections: DataFrame | None = None,
    k: int = 3,
) -> DataFrame:
    """Ranked documents of every entity: its question, the question's vector, and a search in its own scope.

    ``corpus`` has repo, file, commit, document and embedding, made by the same embedder. ``inflections`` (repo, file,
    inflection_commits) names the commits at which an entity's course changed; those are searched before all others.
    An entity asks one question, however often it is listed; one without documents has no rows.
    """
    question = entity_query(
        F.col("file_path"), F.col("repo_name"), F.col("churn_label"), F.bround("anomaly_score", 3)
    )
    asked = flat.groupBy(F.col("repo_name").alias("repo"), F.col("file_path").alias("file")).agg(
        F.min(question).alias("_question")
    )
    asked = embed(asked, "_question", "query").drop("_question")
    if inflections is None:
        none = F.lit(None).cast(f"array<{corpus.schema['commit'].dataType.simpleString()}>")
        asked = asked.withColumn("inflection_commits", none)
    else:
        asked = asked.join(inflections.select(*SCOPE, "inflection_commits"), list(SCOPE), "left")
    # The search reads its questions twice, to count and to join them.
    found = knn_windowed(corpus, materialise(asked), k)
    return found.select(*SCOPE, "commit", "document", "rank", "distance", "similarity")


# --- generation -------------------------------------------------------------


def generate(prompts: DataFrame, generator: Generator, column: str = "prompt") -> DataFrame:
    """Add ``response`` and ``error``.

    A generator may answer a prompt with an exception: that row keeps it as its error and nothing is sent again. A batch
    that fails as a whole is halved until the rows that fail stand alone; a row that stood alone is not sent again.
    """

    def answers(batch: list[str]) -> list[tuple[str | None, str | None]]:
        if not batch:
            return []
        try:
            texts = list(generator(batch))
            if len(texts) == len(batch):
                return [(None, str(t)) if isinstance(t, Exception) else (t, None) for t in texts]
            error = f"{len(texts)} answers to {len(batch)} prompts"
        except Exception as e:  # noqa: BLE001 - any failure becomes an error row
            error = str(e)
        if len(batch) == 1:
            return [(None, error)]
        half = len(batch) // 2
        return answers(batch[:half]) + answers(batch[half:])

    @F.arrow_udf("response string, error string")
    def respond(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for low in range(0, len(batch), SENT_ROWS):
                found = answers(batch.slice(low, SENT_ROWS).to_pylist())
                yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["response", "error"])

    return prompts.withColumn("_answer", respond(F.col(column))).select(
        "*", "_answer.response", "_answer.error"
    ).drop("_answer")


def explain(prompts: DataFrame, generator: Generator) -> DataFrame:
    """Explanations of a prompt table: generated, cleaned, checked, retried and grounded.

    Answers over the word limit are asked for once more with a shorter limit.
    First answers are stored, so no row is generated anew when its answer is read again.
    """
    def checked(df: DataFrame, explanation: Column) -> DataFrame:
        answered = df.withColumn("explanation", explanation)
        return text.with_validation(answered, F.col("explanation"), F.col("provided_commits"))

    answer = text.strip(F.col("response"))
    first = materialise(checked(generate(prompts, generator), text.replace_phrases(answer)))
    too_long = F.coalesce(F.col("validation.word_count") > fv.MAX_WORDS, F.lit(False))
    again = first.filter(too_long).select(*prompts.columns)
    again = again.withColumn("prompt", F.concat(F.col("prompt"), F.lit(f"\n\n{SHORTER_RULE}")))
    second = materialise(checked(generate(again, generator), answer))
    both = first.filter(~too_long).unionByName(second)

    commits = F.col("provided_commits")
    grounded = text.mask_ungrounded(F.col("explanation"), commits)
    referenced = F.when(
        F.col("error").isNull(), text.referenced_commits(F.col("explanation"), commits)
    ).otherwise(F.array().cast("array<string>"))
    return (
        both.withColumn(
            "explanation",
            F.when(F.col("error").isNull(), grounded).otherwise(
                F.concat(F.lit(fv.ERROR_PREFIX), F.col("error"))
            ),
        )
        .withColumn("referenced_commits", referenced)
        .select(
            "repo",
            "file",
            "cluster",
            "anomaly_score",
            "referenced_commits",
            "explanation",
            "validation",
        )
    )


def explain_snapshots(snapshots: DataFrame, generator: Generator) -> DataFrame:
    """The baseline: one description per commit snapshot, without checks."""
    answered = generate(snapshots.withColumn("prompt", snapshot_prompt()), generator)
    answer = F.when(F.col("error").isNull(), text.strip(F.col("response"))).otherwise(
        F.concat(F.lit(fv.ERROR_PREFIX), F.col("error"))
    )
    return answered.select(
        F.col("repo_name").alias("repo"),
        F.col("file_path").alias("file"),
        "commit_hash",
        "commit_date",
        answer.alias("explanation"),
    )


def explain_pending(
    prompts: DataFrame,
    generator: Generator,
    folder: str,
    keys: Sequence[str] = SCOPE,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Explain, batch after batch, what ``folder`` does not hold yet, and read all results back.

    Prompts are dealt into numbered batches of ``batch_rows`` by their keys, and the batches are stored; those of an
    earlier run stay as they were, prompts it did not know get new ones. A batch is one job on all executors, whose
    results are committed when it ends: a run that was killed repeats at most the batch it was in. Keys are unique.
    """
    spark = prompts.sparkSession
    planned = parts.committed(spark, folder, [_PLAN])
    if planned:
        prompts = pending(prompts, parts.read(spark, folder, planned), keys)
    prompts = materialise(prompts)
    if not prompts.isEmpty():
        first = 1 + max((v for _, v, _ in planned), default=0)
        numbered = running_totals(prompts, keys, output="_before")
        numbered = numbered.withColumn("_batch", F.lit(first) + F.floor(F.col("_before") / batch_rows)).drop("_before")
        last = first + (prompts.count() - 1) // batch_rows
        share = F.pmod(F.xxhash64(*keys), F.lit(-(-batch_rows // TASK_ROWS)))
        parts.add(numbered.repartition("_batch", share).sortWithinPartitions("_batch"), folder, _PLAN, last)
        planned = parts.committed(spark, folder, [_PLAN])
    done = {v for _, v, _ in parts.committed(spark, folder, [_RESULT])}
    if planned:
        plan = parts.read(spark, folder, planned)
        for batch in range(1, planned[-1][1] + 1):
            if batch not in done:
                some = plan.where(F.col("_batch") == batch).drop("_batch")
                parts.add(explain(spread(some), generator), folder, _RESULT, batch)
    found = parts.committed(spark, folder, [_RESULT])
    return parts.read(spark, folder, found) if found else explain(prompts, generator)


# --- synthesis --------------------------------------------------------------


def signal_lines(explanations: DataFrame) -> DataFrame:
    signal = text.attention_signal(F.col("explanation"))
    name = F.coalesce("file", F.lit("unknown"))
    return explanations.withColumn("line", F.format_string(fv.SIGNAL_LINE, name, signal))


def summary_lines(explanations: DataFrame) -> DataFrame:
    """The same for baseline descriptions."""
    change = text.change_summary(F.col("explanation"))
    return explanations.withColumn("line", F.format_string(fv.SUMMARY_LINE, F.col("file"), change))


def joined_lines(lines: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """The lines of each group as one text, in order.

    For explained entities, of which there are k per run; not for whole tables.
    """
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.col("line").alias("line"))
    rows = lines.groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias("_lines"))
    return rows.select(
        *group, F.array_join(F.transform("_lines", lambda r: r["line"]), "\n").alias("lines")
    )


def synthesis_prompts(
    explanations: DataFrame, group: Sequence[str] = (), k: int | None = None
) -> DataFrame:
    """One prompt per run: component lines, then signal lines, highest anomaly first.

    Components are counted over all explanations; ``k`` limits the signal lines.
    """
    group = list(group)
    order = [-F.coalesce(F.col("anomaly_score"), F.lit(0.0)), F.col("file")]
    shown = explanations if k is None else top_k_per_group(explanations, group, order, k).drop("rank")
    signals = joined_lines(signal_lines(shown), order, group)
    per_component = summary.component_summary(explanations, group)
    components = joined_lines(per_component, [F.col("component")], group)
    components = components.withColumnRenamed("lines", "component_lines")
    signals = signals.withColumnRenamed("lines", "signal_lines")
    if group:
        both = components.join(signals, group)
    else:
        both = components.withColumn("signal_lines", signals.scalar())
    prompt = F.concat(
        F.lit(f"{SYNTHESIS_TASK}\nComponents:\n"),
        F.col("component_lines"),
        F.lit("\nSignals:\n"),
        F.col("signal_lines"),
    )
    return both.withColumn("prompt", prompt)


def report(
    synthesis: DataFrame, explanations: DataFrame, clusters: DataFrame, **metadata: str | float | int
) -> DataFrame:
    """The report as Markdown and as JSON with its metadata: one row."""
    metrics = summary.grounding_metrics(explanations)
    rates = metrics.select(F.struct(*metrics.columns).alias("grounding_metrics"))
    counted = clusters.agg(F.count("*").alias("clusters"))
    row = synthesis.select("response").withColumns(
        {"_rates": rates.scalar(), "_clusters": counted.scalar()}
    )
    body = F.coalesce(F.col("response"), F.lit(""))
    fields = {
        "files_analyzed": F.col("_rates.total_files"),
        "clusters": F.col("_clusters"),
        **{name: F.lit(value) for name, value in metadata.items()},
        "grounding_metrics": F.col("_rates"),
    }
    return row.select(
        report_markdown(
            "Entity Evolution Synthesis", "Observed patterns, without advice or risk ratings.", body
        ).alias("markdown"),
        report_json(body, fields).alias("json"),
    )


def describe_run(
    changes: DataFrame, snapshots: DataFrame, generator: Generator, k: int = fv.TOP_K
) -> tuple[DataFrame, DataFrame]:
    """The baseline run: describe the latest snapshot of the k most changed files, then synthesise.

    Returns the descriptions and one row with the synthesis prompt and its answer.
    """
    chosen = latest_by_frequency(changes, snapshots, "commit_date", k)
    descriptions = materialise(explain_snapshots(chosen, generator))
    lines = joined_lines(summary_lines(descriptions), [F.col("file")])
    prompt = F.concat(F.lit(f"{CHANGES_TASK}\n"), F.col("lines"))
    synthesis = generate(lines.withColumn("prompt", prompt), generator)
    return descriptions, synthesis.select("prompt", "response", "error")


def explain_run(
    flat: DataFrame,
    retrieved: DataFrame,
    clusters: DataFrame,
    generator: Generator,
    k: int = fv.TOP_K,
) -> tuple[DataFrame, DataFrame]:
    """Select, explain, measure, synthesise and report: the explanations and the report."""
    return _explain_chosen(top_k(flat, "anomaly_score", k), flat, retrieved, clusters, generator, k)


def explain_corpus(
    flat: DataFrame,
    corpus: DataFrame,
    clusters: DataFrame,
    generator: Generator,
    k: int = fv.TOP_K,
    embed: Embedder = hash_embedding,
    inflections: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same with its own retrieval: the chosen entities' questions are searched in the corpus."""
    chosen = materialise(top_k(flat, "anomaly_score", k))
    retrieved = retrieve_evidence(chosen, corpus, embed, inflections)
    return _explain_chosen(chosen, flat, retrieved, clusters, generator, k)


def _explain_chosen(
    chosen: DataFrame,
    flat: DataFrame,
    retrieved: DataFrame,
    clusters: DataFrame,
    generator: Generator,
    k: int,
) -> tuple[DataFrame, DataFrame]:
    prompts = prompt_table(chosen, retrieved, clusters, everyone=flat)
    explanations = materialise(explain(prompts, generator))
    synthesis = materialise(generate(synthesis_prompts(explanations), generator))
    return explanations, report(synthesis, explanations, clusters, top_k=k)
