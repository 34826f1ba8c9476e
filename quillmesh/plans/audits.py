"""Queries over logs: evidence, identity events, retention, quotas, streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import audit as A
from quillmesh.plans.registry import query
from quillmesh.session import load, shared_dir
from quillmesh.streaming import quotas as Q


@query(
    "evidence_upsert",
    """SELECT assertion_id, first_seen_at, last_seen_at, status, r.provider, r.relation, r.evidence_type FROM (SELECT assertion_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at,
      CASE WHEN max((verification_status = 'verified')::INT) = 1 THEN 'verified' ELSE 'provider_asserted' END AS status,
      max({'l': last_seen_at, 'provider': provider, 'relation': relation, 'evidence_type': evidence_type}) AS r FROM citation_assertions GROUP BY 1)""",
)
def evidence_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return A.upserted(load(spark, folder, "citation_assertions"))


@query(
    "identity_event_active",
    """SELECT DISTINCT event_id, action, left_record_id, right_record_id FROM identity_events WHERE action <> 'revert' AND event_id NOT IN (SELECT reverts_event_id FROM identity_events WHERE reverts_event_id IS NOT NULL)""",
)
def identity_event_active(spark: SparkSession, folder: str) -> DataFrame:
    return A.active_events(load(spark, folder, "identity_events")).select("event_id", "action", "left_record_id", "right_record_id").distinct()


@query(
    "latest_retrieval",
    "SELECT record_id, max(retrieved_at) AS retrieved_at, arg_max(provider_rank, {'a': retrieved_at, 'b': coalesce(provider_rank, -1)}) AS rank FROM source_records WHERE provider_rank IS NOT NULL GROUP BY 1",
)
def latest_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "source_records").where("provider_rank IS NOT NULL").select("record_id", "retrieved_at", F.col("provider_rank").alias("rank"))
    return A.latest(rows.withColumn("o", F.struct("retrieved_at", "rank")), "record_id", "o").drop("o")


@query(
    "storage_prune_preview",
    """WITH k AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10')
    SELECT event_id, 'age' AS reason FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, 'capacity' FROM k WHERE pos <= n - 5000""",
)
def storage_prune_preview(spark: SparkSession, folder: str) -> DataFrame:
    return A.prune_preview(load(spark, folder, "events").select("event_id", "ts"), "event_id", "ts", datetime.datetime(2024, 1, 10), 5000)


@query(
    "circuit_breaker_streaks",
    """WITH g AS (SELECT user_id, ts, event_type = 'error' OR event_type = 'view' AS bad, sum((NOT (event_type = 'error' OR event_type = 'view'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS failures FROM g WHERE bad GROUP BY user_id, island HAVING count(*) >= 3""",
)
def circuit_breaker_streaks(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").withColumn("bad", F.col("event_type").isin("error", "view"))
    return A.streaks(rows, "user_id", "ts", "bad", 3)


@query(
    "attempts_pacing_gaps",
    """SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS gap FROM events) WHERE gap < 60""",
)
def attempts_pacing_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return A.pacing_gaps(load(spark, folder, "events"), "user_id", "ts", 60)


@query("quota_minute_aligned", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n > 1")
def quota_minute_aligned(spark: SparkSession, folder: str) -> DataFrame:
    return Q.minute_quota(load(spark, folder, "events"), "event_type", "ts", 1)


@query("quota_first_hit_window")
def quota_first_hit_window(spark: SparkSession, folder: str) -> DataFrame:
    return Q.first_hit_quota(load(spark, folder, "events"), "user_id", "ts", 3, 6 * 3600)


_WINDOWS = """SELECT time_bucket(INTERVAL '1 hour', ts) AS "start", time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS events, round(sum(value), 6) AS value FROM events {0} GROUP BY 1, 2, 3"""


@query("window_counts", _WINDOWS.format(""))
def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return Q.window_counts(load(spark, folder, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query("stream_window_counts", _WINDOWS.format("WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"))
def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a stream: everything available is read, closed windows are appended to a table in the shared folder."""
    table = spark.read.parquet(f"{folder}/events.parquet")
    path = f"{shared_dir(spark)}/quillmesh/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    counts = Q.window_counts(source, "ts", "1 hour", "10 minutes", "event_type")
    run = counts.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)
