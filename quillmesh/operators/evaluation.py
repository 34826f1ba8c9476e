"""Measures of retrieval, linking and clustering against a gold standard."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.assignment import best_total
from quillmesh.session import cut, ship

_div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per topic: precision, recall, number needed to read, reciprocal rank, average precision, nDCG of the first ``k``.

    ``ranked`` (topic, id, rank) is made distinct first, ``relevant`` (topic, id) is a set.
    """
    once = ranked.groupBy("topic", "id").agg(F.min("rank").alias("rank"))
    top = once.withColumn("pos", F.row_number().over(Window.partitionBy("topic").orderBy("rank", "id"))).where(F.col("pos") <= k)
    rel = relevant.select("topic", "id").distinct()
    hit = top.join(rel.withColumn("hit", F.lit(1)), ["topic", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hits = F.sum("hit").over(Window.partitionBy("topic").orderBy("pos"))
    per = hit.withColumn("hits", hits).groupBy("topic").agg(
        F.count("*").alias("n"), F.sum("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("pos"))).alias("ap"), F.sum(F.col("hit") / F.log2(F.col("pos") + 1)).alias("dcg"),
    )
    total = rel.groupBy("topic").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("total", "n"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = total.join(per, "topic", "left").fillna(0, ["n", "found", "ap", "dcg"])
    return rows.select(
        "topic", F.round(_div("found", "n"), 9).alias("precision"), F.round(_div("found", "total"), 9).alias("recall"), F.round(F.try_divide("n", "found"), 9).alias("needed_to_read"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"), F.round(_div("ap", "total"), 9).alias("average_precision"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 9).alias("ndcg"),
    )


def work_saved(ranked: DataFrame, relevant: DataFrame, target: float) -> DataFrame:
    """Per topic: rows to screen until the share ``target`` of all relevant ones is found, and the work saved over sampling."""
    rel = relevant.select("topic", "id").distinct()
    need = rel.groupBy("topic").agg(F.ceil(F.lit(target) * F.count("*")).alias("need"))
    hit = ranked.join(rel, ["topic", "id"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("topic").orderBy("rank", "id")))
    at = hit.join(need, "topic").where("nth = need").select("topic", F.col("rank").alias("screened"))
    size = ranked.groupBy("topic").agg(F.count("*").alias("candidates"))
    return size.join(at, "topic", "left").select("topic", "candidates", "screened", F.round(F.lit(target) - F.col("screened") / F.col("candidates"), 9).alias("saved"))


def edges_f1(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of rows."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    n = p.join(g, list(keys), "full_outer").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("tp"))
    return n.select(F.coalesce("tp", F.lit(0)).alias("true_positive"), F.round(_div("tp", "np"), 9).alias("precision"), F.round(_div("tp", "ng"), 9).alias("recall"), F.round(_div(2 * F.col("tp"), F.col("np") + F.col("ng")), 9).alias("f1"))


def _cells(clusters: DataFrame) -> DataFrame:
    """``p, g, n, np, ng``: sizes of the intersections and of both clusters; ``clusters`` has ``id, p, g``."""
    cell = clusters.groupBy("p", "g").agg(F.count("*").alias("n"))
    return cell.join(cell.groupBy("p").agg(F.sum("n").alias("np")), "p").join(cell.groupBy("g").agg(F.sum("n").alias("ng")), "g")


def bcubed(clusters: DataFrame) -> DataFrame:
    c = _cells(clusters)
    a = c.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("np")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"))
    p, r = _div("p", "n"), _div("r", "n")
    return a.select(F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(_div(2 * p * r, p + r), 9).alias("f1"))


def pairwise(clusters: DataFrame) -> DataFrame:
    """Pairs in common, falsely merged and falsely split, counted from sizes without listing a pair."""
    two = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("bigint")
    cell = clusters.groupBy("p", "g").agg(F.count("*").alias("n"))
    both = cell.agg(F.sum(two("n")).alias("tp"))
    p, g = clusters.groupBy("p").agg(F.count("*").alias("n")).agg(F.sum(two("n")).alias("pp")), clusters.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(two("n")).alias("gp"))
    tp, pp, gp = (df.first()[0] or 0 for df in (both, p, g))
    r = lambda a, b: round(a / b, 9) if b else 0.0
    return clusters.sparkSession.createDataFrame([(tp, pp - tp, gp - tp, r(tp, pp), r(tp, gp), r(2 * tp, pp + gp))], "true_positive long, false_merge long, false_split long, precision double, recall double, f1 double")


def exact_clusters(clusters: DataFrame) -> DataFrame:
    a = _cells(clusters).agg(F.sum(F.when((F.col("n") == F.col("np")) & (F.col("n") == F.col("ng")), 1).otherwise(0)).alias("exact"), F.countDistinct("p").alias("predicted"), F.countDistinct("g").alias("gold"))
    return a.select(F.coalesce("exact", F.lit(0)).alias("exact"), "predicted", "gold")


def ceaf_e(clusters: DataFrame) -> DataFrame:
    """CEAF with entity similarity.

    The best alignment splits along the components of overlapping clusters.
    Two clusters that overlap with each other only are aligned where they
    are; of the other components each is solved in its own task, over the
    cells that are not empty.
    """
    from quillmesh.operators.components import components

    cell = _cells(clusters).withColumn("w", 2 * F.col("n") / (F.col("np") + F.col("ng")))
    ship(clusters.sparkSession)
    width = lambda k: cell.groupBy(k).agg(F.count("*").alias(f"cells_{k}"))
    cell = cut(cell.join(width("p"), "p").join(width("g"), "g"), "cells")
    n = cell.agg(F.countDistinct("p").alias("p"), F.countDistinct("g").alias("g"), F.sum(F.when((F.col("cells_p") == 1) & (F.col("cells_g") == 1), F.col("w"))).alias("alone")).first()
    tied = cell.where("cells_p > 1 OR cells_g > 1").withColumn("id", F.concat(F.lit("p"), "p"))
    comp = components(tied.select("id", F.concat(F.lit("g"), "g").alias("b")), "id", "b")
    rows = tied.join(comp, "id").select("root", F.col("p").cast("string").alias("p"), F.col("g").cast("string").alias("g"), "w")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [best_total(zip(part.p, part.g, part.w, strict=True))]})

    total = (rows.groupBy("root").applyInPandas(solve, "s double").agg(F.sum("s")).first()[0] or 0.0) + (n.alone or 0.0)
    p, r = (total / n.p if n.p else 0.0), (total / n.g if n.g else 0.0)
    return clusters.sparkSession.createDataFrame([(round(p, 9), round(r, 9), round(2 * p * r / (p + r), 9) if p + r else 0.0)], "precision double, recall double, f1 double")


def confusion(rows: DataFrame, gold: str, predicted: str, labels: Sequence) -> DataFrame:
    """Counts per gold label (rows) and predicted label (columns ``to_...``)."""
    c = rows.groupBy(F.col(gold).alias("gold")).pivot(predicted, list(labels)).count().fillna(0)
    return c.select("gold", *[F.col(str(x)).cast("bigint").alias(f"to_{x}") for x in labels])


def label_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support, accuracy, macro_f1``: each label's scores beside those of the whole."""
    cell = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    ends = cell.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("ng"), F.lit(0).alias("np"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).alias("ng"), F.col("n").alias("np"), F.lit(0).alias("tp")))).alias("e")).select("e.*")
    per = ends.where("label IS NOT NULL").groupBy("label").agg(F.sum("ng").alias("support"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
    per = per.select("label", _div("tp", "np").alias("precision"), _div("tp", "support").alias("recall"), _div(2 * F.col("tp"), F.col("np") + F.col("support")).alias("f1"), "support", "tp")
    whole = Window.partitionBy()  # over the labels, of which there are few
    out = per.withColumns({"accuracy": _div(F.sum("tp").over(whole), F.sum("support").over(whole)), "macro_f1": F.avg("f1").over(whole)})
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")])


def micro(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from the sums of ``true_positive, predicted, gold`` over all rows."""
    a = counts.agg(F.coalesce(F.sum("true_positive"), F.lit(0)).alias("tp"), F.coalesce(F.sum("predicted"), F.lit(0)).alias("np"), F.coalesce(F.sum("gold"), F.lit(0)).alias("ng"))
    return a.select(F.round(_div("tp", "np"), 9).alias("precision"), F.round(_div("tp", "ng"), 9).alias("recall"), F.round(_div(2 * F.col("tp"), F.col("np") + F.col("ng")), 9).alias("f1"))


def universe_gaps(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """``key, missing_from``: members that only one of two sides knows; both sides must be equal for measures over items to mean anything."""
    g, p = gold.select(key).distinct().withColumn("g", F.lit(1)), predicted.select(key).distinct().withColumn("p", F.lit(1))
    return g.join(p, key, "full_outer").where("g IS NULL OR p IS NULL").select(key, F.when(F.col("g").isNull(), "gold").otherwise("predicted").alias("missing_from"))


def same_universe(gold: DataFrame, predicted: DataFrame, key: str) -> None:
    """Raise, naming some, if one side has members the other lacks."""
    gaps = universe_gaps(gold, predicted, key).orderBy(key).limit(5).collect()
    if gaps:
        raise ValueError("only one side has " + ", ".join(f"{r[0]} (missing from {r[1]})" for r in gaps))


def bootstrap_interval(values: Sequence[float], samples: int, seed: int) -> tuple[float, float, float]:
    """Mean of per-topic values (a short list) and the 95 % interval of resampled means."""
    if not values:
        return 0.0, 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(math.fsum(rng.choice(values) for _ in values) / len(values) for _ in range(samples))
    return math.fsum(values) / len(values), means[max(0, int(0.025 * samples) - 1)], means[min(samples - 1, int(0.975 * samples))]
