"""Mixing sources to target shares of the total size in tokens.

A source's budget is met by whole passes over all its documents plus one part
pass. The part pass takes the documents whose hash lies under a threshold, so
a larger budget always takes a superset. Thresholds come from histograms of
tokens over hash buckets; only the bucket in which a budget ends is looked
into again, with finer buckets, until a bucket can't be divided. The rows
themselves are then filtered, never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.bpe import count_tokens
from quillmesh.session import cut

#: Bits of the hash that one histogram divides; five of them use 60 bits.
LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS


def source_sizes(documents: DataFrame, weights: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, source, tokens, h`` of the documents of weighted sources, written once; documents of no tokens (null, empty) are left out."""
    wanted = weights.where(F.col("target_share") > 0).select("source").distinct()
    docs = documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    # the count goes through Arrow, which has one key column: id and source travel as one struct
    sized = count_tokens(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", folder)
    h = F.shiftrightunsigned(F.xxhash64("k.doc_id", F.lit(11)), 64 - HASH_BITS)
    return cut(sized.where("tokens > 0").select("k.doc_id", "k.source", "tokens", h.alias("h")), "sizes")


def plan_mixture(sizes: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """One row per weighted source: ``source, target_share, max_repeats, tokens, budget, passes, part, threshold``.

    ``total`` is the wanted size in tokens. Without one it is the largest at
    which each source that has documents can give its full share within
    ``max_repeats`` passes. A source without documents can give nothing; the
    shares of the others are scaled to sum 1. With a ``total`` beyond reach a
    source stops at its cap and the shortfall shows in the actual shares.
    ``passes`` is the number of whole passes, ``part`` the tokens wanted of
    the part pass, ``threshold`` the exclusive bound of ``h`` that meets it
    best from below (null: no part pass). Repeated rows of a source in
    ``weights`` are added up, with the lower ``max_repeats``; null or negative
    shares count as 0.
    """
    w = weights.where(F.col("target_share") > 0).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    per = w.join(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    able = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    per = cut(per, "sources")
    able_sum, reach = per.agg(F.sum(able), F.min(F.when(able.isNotNull(), F.col("tokens") * F.col("max_repeats") / able))).first()
    able_sum = able_sum or 1.0
    whole = float(total) if total is not None else (reach or 0.0) * able_sum
    share = F.coalesce(able / F.lit(able_sum), F.lit(0.0))
    budget = F.least(F.floor(share * F.lit(whole) + 1e-6), F.col("tokens") * F.col("max_repeats")).cast("bigint")
    per = per.withColumn("budget", F.coalesce(budget, F.lit(0)))
    per = per.withColumn("passes", F.coalesce(F.floor(F.try_divide("budget", "tokens")), F.lit(0)).cast("int"))
    per = cut(per.withColumn("part", F.col("budget") - F.col("passes") * F.col("tokens")), "plan")
    # low: the hash from which the open bucket starts; left: tokens still to take from it
    open_ = per.where("part > 0").select("source", F.lit(0).cast("bigint").alias("low"), F.col("part").alias("left"))
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        span = 1 << (shift + LEVEL_BITS)
        inside = sizes.join(open_, "source") if level else sizes.join(open_.select("source", "low"), "source")
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(span)))
        bars = inside.groupBy("source", F.shiftright("h", shift).alias("bar")).agg(F.sum("tokens").alias("t"))
        running = F.sum("t").over(Window.partitionBy("source").orderBy("bar"))
        bars = bars.withColumn("upto", running).join(open_, "source")
        over = bars.where(F.col("upto") > F.col("left"))
        # the first bar that would exceed what is left stays open; without one all is taken
        pick = over.groupBy("source").agg(F.min(F.struct("bar", (F.col("upto") - F.col("t")).alias("before"))).alias("p"))
        moved = open_.join(pick, "source", "left").select(
            "source",
            F.coalesce(F.shiftleft("p.bar", shift), F.col("low") + F.lit(span)).alias("low"),
            F.when(F.col("p").isNotNull(), F.col("left") - F.col("p.before")).otherwise(F.lit(0)).cast("bigint").alias("left"),
        )
        open_ = cut(moved, "thresholds")
    return per.join(open_.select("source", F.col("low").alias("threshold")), "source", "left")


def mixture(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, copies``: each document of the mixture and how often it stands in it."""
    extra = F.coalesce((F.col("h") < F.col("threshold")).cast("int"), F.lit(0))
    rows = sizes.join(plan.select("source", "passes", "threshold"), "source")
    return rows.select("doc_id", "source", "tokens", (F.col("passes") + extra).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, mixed_tokens, source_tokens, max_copies``: what each weighted source really gives."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("max_copies"))
    whole = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    rows = plan.join(got, "source", "left")
    return rows.select(
        "source",
        "target_share",
        F.coalesce(F.col("mixed_tokens") / F.lit(whole), F.lit(0.0)).alias("actual_share"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.col("tokens").alias("source_tokens"),
        F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
