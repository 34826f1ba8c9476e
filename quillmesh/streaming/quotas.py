"""Quotas over windows, in batch and on streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minute_quota(events: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """Events beyond the first ``limit`` of their key in each calendar minute."""
    w = Window.partitionBy(key, F.date_trunc("minute", at)).orderBy(at, "event_id")
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") > limit).select(key, "event_id")


def first_hit_quota(events: DataFrame, key: str, at: str, limit: int, seconds: float) -> DataFrame:
    """``key, event_id``: events refused by windows that start with a key's first hit and last ``seconds``.

    A key's events must be walked in order. Keys whose window can't be full
    (fewer events than ``limit`` in all) are settled before that.
    """
    busy = events.groupBy(key).count().where(F.col("count") > limit).select(key)
    kind = events.schema[key].dataType.simpleString()

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "event_id"])
        start, n, out = None, 0, []
        for t, e in zip(group.t, group.event_id, strict=True):
            if start is None or t - start >= seconds:
                start, n = t, 0
            n += 1
            if n > limit:
                out.append(e)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(out), "event_id": out})

    rows = events.join(busy, key, "left_semi").select(key, "event_id", F.col(at).cast("timestamp").cast("double").alias("t"))
    return rows.groupBy(key).applyInPandas(walk, f"{key} {kind}, event_id bigint")


def window_counts(stream: DataFrame, at: str, window: str, late: str, by: str) -> DataFrame:
    """Counts per window and ``by``, on a stream with a watermark of ``late`` or on a table."""
    rows = stream.withColumn("at", F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    g = rows.groupBy(F.window("at", window), by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "events", "value")
