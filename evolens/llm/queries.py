"""The operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolens.llm import bpe, centroids, conversations, decontamination, html_text, jaccard_join, language, lm_scoring, neighbours, pii, quality, secrets, toxicity
from evolens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Target: all documents labelled as of good quality; background: all documents."""
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(docs, lm_scoring.train(docs, good))


@query
def op2_decontamination_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


@query
def op3_pii_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    counts = [pii.count_of(k, F.col("base")).alias(f"n_{k}") for k in pii.BASE]
    digest = F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.joined(F.col("spans")).alias("spans"))


@query
def op4_toxicity_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    remainder = language.id_remainder(F.col("doc_id"), 5)
    model = toxicity.train(docs, labels.where(remainder != 0))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.scores(docs, model).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", predicted)


@query
def op5_kmeans_tree_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), query_divisor=100)


@query
def op6_main_text_segment(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.train(pages))


@query
def op7_jaccard_multi_order(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, folder, "documents"), words=3, percent=90)


@query
def op8_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    remainder = language.id_remainder(F.col("doc_id"), 4)
    model = language.train(docs.where(remainder != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(language.id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_increment(table(spark, folder, "documents"), scratch_path(spark, "ledger"))


@query
def op10_bpe_rank_array(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(table(spark, folder, "documents"), path, outputs=())


@query
def op11_quality_subword_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    remainder = language.id_remainder(F.col("doc_id"), 5)
    model = quality.train(docs, labels.where(remainder != 0))
    held_out = F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    return quality.scores(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op12_centroids_equal_average(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    digest = F.sha2("centroid", 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


ORACLES["op12_centroids_equal_average"] = """
    WITH whole AS (SELECT vec_id, [floor(64 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM whole
        QUALIFY cluster < 16),
    """ + "".join(f"""
    n{i} AS (SELECT vec_id, v, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]), cluster)) AS best
        FROM (SELECT row_number() OVER () AS row, * FROM whole) CROSS JOIN c{i} GROUP BY row, vec_id, v),
    """ + (f"""m{i} AS (SELECT cluster, list(mean ORDER BY place) AS c FROM (
        SELECT best[2] AS cluster, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::HUGEINT // count(*) AS mean
        FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM n{i}) GROUP BY ALL) GROUP BY cluster),
    c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster)),
    """ if i < 3 else "") for i in range(4)) + """
    texts AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c3)
    SELECT vec_id, cluster::INT AS cluster, best[1]::BIGINT AS distance,
        (sum(best[1]) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM n3 JOIN texts ON best[2] = cluster
"""


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


# Viterbi's recursion over the rows in place of interval parsing; crc32 byte by byte from its table.
ORACLES["op13_conversation_repair"] = r"""
    WITH RECURSIVE crc AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS entries),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    hit AS (SELECT named.*, xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(name, '')],
            lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS hit FROM named, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
            CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE hit > 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
            rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS trimmed FROM damaged),
    judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN trimmed = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'okay' END AS fault,
            left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM numbered),
    step(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    added(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'),
            (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
    edit AS (SELECT conv_id, i, q AS p, q, 2 AS cost, 'D' AS audit FROM judged, (SELECT DISTINCT q FROM added)
        UNION ALL SELECT conv_id, i, p, q, 5 * (fault = 'truncated')::INT, 'K' FROM judged JOIN step USING (initial)
            WHERE fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT conv_id, i, p, q, 1 + 5 * (fault = 'truncated')::INT, 'R' FROM judged, step
            WHERE step.initial <> 's' AND fault NOT IN ('blank', 'duplicate')),
    whole_edit AS (SELECT conv_id, i, edit.p, added.q, min((edit.cost + added.cost, edit.audit || added.audit)) AS best
        FROM edit JOIN added ON edit.q = added.p GROUP BY ALL),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    path AS (SELECT conv_id, 0::BIGINT AS i, q, (cost, audit) AS best FROM ids, added WHERE p = 0
        UNION ALL SELECT path.conv_id, w.i, w.q, min((path.best[1] + w.best[1], path.best[2] || w.best[2]))
        FROM path JOIN whole_edit w ON w.conv_id IS NOT DISTINCT FROM path.conv_id AND w.i = path.i + 1 AND w.p = path.q GROUP BY ALL),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id),
    base AS (SELECT ids.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
            coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
        FROM ids LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id),
    solved AS (SELECT base.*, (SELECT min(best) FROM path WHERE path.conv_id IS NOT DISTINCT FROM base.conv_id AND path.i = base.n
            AND q IN (0, 3)) AS best FROM base),
    letters AS (SELECT conv_id, best[2] AS audit, unnest(string_split(best[2], '')) AS letter,
            generate_subscripts(string_split(best[2], ''), 1) AS k FROM solved WHERE best[2] <> ''),
    edited AS (SELECT conv_id, letter, k, sum((letter <> 'I')::INT) OVER w AS i,
            sum((letter <> 'D')::INT) OVER w + length(replace(audit, 'D', '')) % 2 AS place FROM letters
        WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
    repaired AS (SELECT edited.conv_id, string_agg(CASE letter WHEN 'K' THEN role || ':' || text
            ELSE (CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END,
            chr(10) ORDER BY k) AS text
        FROM edited LEFT JOIN judged ON edited.conv_id IS NOT DISTINCT FROM judged.conv_id AND edited.i = judged.i
        WHERE letter <> 'D' GROUP BY edited.conv_id)
    SELECT solved.conv_id, gaps, blank, duplicate, truncated, illegal, best[1]::BIGINT AS cost, best[2] AS audit,
        sha256(coalesce(repaired.text, '')) AS repaired_sha256
    FROM solved LEFT JOIN repaired ON solved.conv_id IS NOT DISTINCT FROM repaired.conv_id
"""
