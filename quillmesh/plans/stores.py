"""Queries for stored evidence, caches, jobs, and the roll-ups of evaluations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import audit as A
from quillmesh.operators import evaluation as E
from quillmesh.plans.registry import query
from quillmesh.session import load

_TABLES = "papers authors source_records identifier_claims extracted_references citation_contexts identity_events citation_assertions".split()


@query("storage_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def storage_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table, from the footers of its files."""
    parts = [load(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    "storage_pruned",
    """WITH k AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-10') SELECT event_id, ts FROM k WHERE pos <= 5000""",
)
def storage_pruned(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").select("event_id", "ts")
    return A.pruned(rows, A.prune_preview(rows, "event_id", "ts", datetime.datetime(2024, 1, 10), 5000), "event_id")


_NOW = datetime.datetime(2035, 1, 1)


@query(
    "cache_get",
    "SELECT record_id, max(retrieved_at) AS retrieved_at FROM source_records WHERE retrieved_at + INTERVAL 315360000 SECOND > TIMESTAMP '2035-01-01' GROUP BY 1",
)
def cache_get(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the ten years before 2035, the newest of each record."""
    rows = load(spark, folder, "source_records").select("record_id", "retrieved_at")
    return A.cache_get(rows, "record_id", "retrieved_at", 315_360_000, _NOW).select("record_id", F.max("retrieved_at").over(_whole("record_id")).alias("retrieved_at"))


def _whole(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


@query(
    "evidence_replay",
    """WITH o AS (SELECT subject_record_id AS citing, object_record_id AS cited, assertion_id, min(first_seen_at) AS seen, min(first_seen_at) FILTER (verification_status = 'verified') AS sure FROM citation_assertions WHERE subject_record_id <> object_record_id GROUP BY 1, 2, 3)
    SELECT 'ce:' || sha256(citing || chr(0) || cited)[:24] AS edge_id, citing, cited, CASE WHEN min(sure) > min(seen) THEN min(sure) END AS verified_at, string_agg(assertion_id, ' ' ORDER BY seen, assertion_id) AS evidence FROM o GROUP BY 2, 3""",
)
def evidence_replay(spark: SparkSession, folder: str) -> DataFrame:
    return A.evidence_replay(load(spark, folder, "citation_assertions")).withColumn("evidence", F.array_join("evidence", " "))


@query(
    "edge_status_events",
    """WITH o AS (SELECT subject_record_id AS citing, object_record_id AS cited, min(first_seen_at) AS seen, min(first_seen_at) FILTER (verification_status = 'verified') AS sure FROM citation_assertions WHERE subject_record_id <> object_record_id GROUP BY 1, 2)
    SELECT 'ce:' || sha256(citing || chr(0) || cited)[:24] AS edge_id, 'provider_asserted' AS old_status, 'verified' AS new_status, sure AS at FROM o WHERE sure > seen""",
)
def edge_status_events(spark: SparkSession, folder: str) -> DataFrame:
    """The one change of status an edge can have."""
    found = A.evidence_replay(load(spark, folder, "citation_assertions")).where("verified_at IS NOT NULL")
    return found.select("edge_id", F.lit("provider_asserted").alias("old_status"), F.lit("verified").alias("new_status"), F.col("verified_at").alias("at"))


@query("job_states", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, min(ts) AS began, max(ts) AS changed, count(*) AS events FROM events GROUP BY 1")
def job_states(spark: SparkSession, folder: str) -> DataFrame:
    return A.states(load(spark, folder, "events"), "user_id", "ts", "event_type")


@query(
    "retry_waits",
    """WITH g AS (SELECT user_id, event_type IN ('error', 'view') AS bad, lag(event_type IN ('error', 'view')) OVER w AS before, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 3) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS retries, count(*) FILTER (NOT bad) AS recovered, round(avg(gap), 6) AS mean_wait FROM g WHERE before AND gap <= 3600 GROUP BY 1""",
)
def retry_waits(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").withColumn("bad", F.col("event_type").isin("error", "view"))
    return A.retries(rows, "user_id", "ts", "bad", 3600)


@query(
    "snapshot_consensus",
    """WITH s AS (SELECT subject_record_id, provider, string_agg(DISTINCT object_record_id, ' ' ORDER BY object_record_id) AS s FROM citation_assertions GROUP BY 1, 2),
    l AS (SELECT *, lag(s) OVER (PARTITION BY subject_record_id ORDER BY provider) AS before FROM s) SELECT subject_record_id, min(provider) AS provider FROM l WHERE s = before GROUP BY 1""",
)
def snapshot_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Works for which two sources after one another give the same set of references, and the second of them."""
    return A.consensus(load(spark, folder, "citation_assertions"), "subject_record_id", "provider", "object_record_id")


_R = "r AS (SELECT doc_id, max(reading_level) FILTER (rater = 'rater_a') AS a, max(reading_level) FILTER (rater = 'rater_b') AS b FROM reading_labels GROUP BY 1), c AS (SELECT a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL)"


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    by = lambda n, c: F.max(F.when(F.col("rater") == n, F.col("reading_level"))).alias(c)
    return load(spark, folder, "reading_labels").groupBy("doc_id").agg(by("rater_a", "a"), by("rater_b", "b")).where("a IS NOT NULL AND b IS NOT NULL")


@query(
    "eval_label_scores",
    f"""WITH {_R}, l AS (SELECT a AS label FROM c UNION SELECT b FROM c), s AS (SELECT label, (SELECT count(*) FROM c WHERE a = label) AS support, (SELECT count(*) FROM c WHERE b = label) AS np, (SELECT count(*) FROM c WHERE a = label AND b = label) AS tp FROM l),
    f AS (SELECT *, coalesce(2 * tp / nullif(np + support, 0), 0) AS f1 FROM s)
    SELECT label, support, round(coalesce(tp / nullif(np, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(f1, 9) AS f1, round((SELECT sum(tp) / sum(support) FROM f), 9) AS accuracy, round((SELECT avg(f1) FROM f), 9) AS macro_f1 FROM f""",
)
def eval_label_scores(spark: SparkSession, folder: str) -> DataFrame:
    return E.label_scores(_rated(spark, folder), "a", "b")


@query(
    "eval_micro",
    """WITH c AS (SELECT DISTINCT subject_record_id, object_record_id, provider, verification_status FROM citation_assertions), p AS (SELECT DISTINCT provider, subject_record_id, object_record_id FROM c),
    g AS (SELECT DISTINCT subject_record_id, object_record_id FROM c WHERE verification_status = 'verified'), t AS (SELECT provider, count(*) AS np, count(*) FILTER ((subject_record_id, object_record_id) IN (SELECT (subject_record_id, object_record_id) FROM g)) AS tp FROM p GROUP BY 1),
    s AS (SELECT sum(tp) AS tp, sum(np) AS np, count(*) * (SELECT count(*) FROM g) AS ng FROM t)
    SELECT round(tp / np, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (np + ng), 9) AS f1 FROM s""",
)
def eval_micro(spark: SparkSession, folder: str) -> DataFrame:
    """Every source's edges against the verified ones, rolled up."""
    c = load(spark, folder, "citation_assertions").select("subject_record_id", "object_record_id", "provider", "verification_status")
    gold = c.where("verification_status = 'verified'").select("subject_record_id", "object_record_id").distinct().withColumn("hit", F.lit(1))
    n = gold.agg(F.count("*").alias("gold"))
    made = c.select("provider", "subject_record_id", "object_record_id").distinct().join(gold, ["subject_record_id", "object_record_id"], "left")
    per = made.groupBy("provider").agg(F.count("*").alias("predicted"), F.count("hit").alias("true_positive"))
    return E.micro(per.join(F.broadcast(n)))  # the one row of a count


@query(
    "eval_universe_gaps",
    "SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN a.record_id IS NULL THEN 'gold' ELSE 'predicted' END AS missing_from FROM (SELECT DISTINCT record_id FROM papers) a FULL JOIN (SELECT DISTINCT object_record_id AS record_id FROM citation_assertions) b ON a.record_id = b.record_id WHERE a.record_id IS NULL OR b.record_id IS NULL",
)
def eval_universe_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return E.universe_gaps(load(spark, folder, "papers"), load(spark, folder, "citation_assertions").select(F.col("object_record_id").alias("record_id")), "record_id")
