"""Append-only logs and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import stable_id


def active_events(events: DataFrame) -> DataFrame:
    """Events that are neither reverts nor named by one."""
    named = events.where("reverts_event_id IS NOT NULL").select(F.col("reverts_event_id").alias("event_id")).distinct()
    return events.where("action <> 'revert'").join(named, "event_id", "left_anti")


def upserted(assertions: DataFrame) -> DataFrame:
    """One row per assertion: first and last sight, verified once means verified ever, the rest as last seen (largest values among ties)."""
    rest = F.max_by(F.struct("provider", "relation", "evidence_type"), F.struct("last_seen_at", "provider", "relation", "evidence_type"))
    a = assertions.groupBy("assertion_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max((F.col("verification_status") == "verified").cast("int")).alias("v"), rest.alias("r"))
    return a.select("assertion_id", "first_seen_at", "last_seen_at", F.when(F.col("v") == 1, "verified").otherwise("provider_asserted").alias("status"), "r.provider", "r.relation", "r.evidence_type")


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of every key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), by).alias("r")).select(key, "r.*")


def prune_preview(rows: DataFrame, key: str, at: str, before, most: int) -> DataFrame:
    """``key, reason`` of what a retention rule would delete: older than ``before``, or the oldest over capacity ``most``.

    Where the capacity cuts is found from counts per day, then per second of
    the day it falls on; only rows of that second are ordered.
    """
    old = F.col(at) < F.lit(before)
    out = rows.where(old).select(key, F.lit("age").alias("reason"))
    young = rows.where(F.coalesce(~old, F.lit(True)) & F.col(at).isNotNull())
    left = young.count() - most
    if left <= 0:
        return out
    edge = young
    gone: list[DataFrame] = []
    for unit in ("DAY", "SECOND"):
        bins = edge.groupBy(F.date_trunc(unit, F.col(at)).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").toLocalIterator()
        for r in bins:  # days of the log; then at most the seconds of one day
            if r.n >= left:
                bound = F.lit(r.bin)
                break
            left -= r.n
        gone.append(edge.where(F.date_trunc(unit, F.col(at)) < bound))
        edge = edge.where(F.date_trunc(unit, F.col(at)) == bound)
    for part in gone:
        out = out.unionAll(part.select(key, F.lit("capacity").alias("reason")))
    return out.unionAll(edge.orderBy(at, key).limit(left).select(key, F.lit("capacity").alias("reason")))


def pruned(rows: DataFrame, preview: DataFrame, key: str) -> DataFrame:
    """What is left of ``rows`` after a preview is applied; write it as the table's next version."""
    return rows.join(preview.select(key), key, "left_anti")


def cache_get(rows: DataFrame, key: str, at: str, ttl_seconds: int, now) -> DataFrame:
    """The newest row of every key that is not older than ``ttl_seconds`` at ``now``; only good answers (``status`` 200, where there is one) are ever served."""
    if ttl_seconds <= 0:
        return rows.limit(0)
    good = rows.where("status = 200") if "status" in rows.columns else rows
    fresh = F.col(at).cast("timestamp") + F.make_interval(secs=F.lit(ttl_seconds)) > F.lit(now).cast("timestamp")
    return latest(good.where(fresh), key, at)


def states(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """``key, state, began, changed, events``: where every run or job stands, from its appended events (ties: the largest ``event_id``)."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, "event_id")).alias("state"), F.min(at).alias("began"), F.max(at).alias("changed"), F.count("*").alias("events"))


def evidence_replay(assertions: DataFrame) -> DataFrame:
    """``edge_id, citing, cited, verified_at, evidence``: every edge with its assertions as first seen, and when it changed from asserted to verified (null if it never did, or was verified from the start)."""
    one = assertions.where("subject_record_id <> object_record_id").groupBy("subject_record_id", "object_record_id", "assertion_id").agg(F.min("first_seen_at").alias("seen"), F.min(F.when(F.col("verification_status") == "verified", F.col("first_seen_at"))).alias("sure"))
    edges = one.groupBy(F.col("subject_record_id").alias("citing"), F.col("object_record_id").alias("cited")).agg(F.min("seen").alias("first"), F.min("sure").alias("sure"), F.sort_array(F.collect_list(F.struct("seen", "assertion_id"))).alias("e"))
    return edges.select(stable_id("ce:", "citing", "cited").alias("edge_id"), "citing", "cited", F.when(F.col("sure") > F.col("first"), F.col("sure")).alias("verified_at"), F.transform("e", lambda x: x["assertion_id"]).alias("evidence"))


def retries(attempts: DataFrame, key: str, at: str, failed: str, within_seconds: float) -> DataFrame:
    """``key, retries, recovered, mean_wait``: attempts that came within ``within_seconds`` after a failed one, how many of them worked, and how long was waited."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    seconds = F.col(at).cast("timestamp").cast("double")
    gap = F.round(seconds - F.lag(seconds).over(w), 3)
    again = attempts.withColumn("gap", gap).withColumn("before", F.lag(failed).over(w)).where(F.col("before") & (F.col("gap") <= within_seconds))
    return again.groupBy(key).agg(F.count("*").alias("retries"), F.sum((~F.col(failed)).cast("bigint")).alias("recovered"), F.round(F.avg("gap"), 6).alias("mean_wait"))


def consensus(snapshots: DataFrame, key: str, turn: str, member: str) -> DataFrame:
    """``key, turn``: the first turn of each key whose set of members equals that of the turn before.

    Sets are compared by their size and two sums of hashes, so none is ever gathered.
    """
    once = snapshots.select(key, turn, member).distinct()
    wide = lambda seed: F.sum(F.xxhash64(member, F.lit(seed)).cast("decimal(38,0)"))
    sets = once.groupBy(key, turn).agg(F.struct(F.count("*").alias("n"), wide(1).alias("x"), wide(2).alias("y")).alias("s"))
    same = sets.withColumn("before", F.lag("s").over(Window.partitionBy(key).orderBy(turn))).where("s = before")
    return same.groupBy(key).agg(F.min(turn).alias(turn))


def streaks(attempts: DataFrame, key: str, at: str, failed: str, least: int = 5) -> DataFrame:
    """``key, started, ended, failures``: runs of at least ``least`` failures in a row, where a circuit breaker would have opened."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    good = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = attempts.withColumn("island", good).where(F.col(failed)).groupBy(key, "island")
    return runs.agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("failures")).where(F.col("failures") >= least).drop("island")


def pacing_gaps(attempts: DataFrame, key: str, at: str, least_seconds: float) -> DataFrame:
    """``key, event_id, gap``: attempts that came sooner than ``least_seconds`` after the one before."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(w)
    return attempts.withColumn("gap", F.round(gap, 3)).where(F.col("gap") < least_seconds).select(key, "event_id", "gap")
