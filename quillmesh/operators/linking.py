"""Scoring and deciding links between bibliography entries and records by fixed weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the traits of an entry.
WEIGHTS = {"title": 0.65, "authors": 0.15, "year": 0.10, "venue": 0.10}


@dataclass
class Policy:
    threshold: float = 0.92
    margin: float = 0.08
    candidates: int = 5


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def text_similarity(a: Column, b: Column) -> Column:
    """Seven parts of edit similarity and three of shared words; 1 for equal, 0 where one is empty."""
    x, y = plain(a), plain(b)
    wx, wy = F.split(x, " "), F.split(y, " ")
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    words = F.size(F.array_intersect(wx, wy)) / F.size(F.array_union(wx, wy))
    return F.when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(0.7 * edit + 0.3 * words)


def surnames(names: Column) -> Column:
    """Family names: before a comma, else the last word."""
    one = lambda n: F.when(F.contains(n, F.lit(",")), F.replace(plain(F.split_part(n, F.lit(","), F.lit(1))), F.lit(" "), F.lit(""))).otherwise(F.element_at(F.split(plain(n), " "), -1))
    return F.array_distinct(F.filter(F.transform(names, one), lambda s: s != ""))


def scored(pairs: DataFrame, title: Column | None = None, venue: Column | None = None) -> DataFrame:
    """``score`` of pairs with the traits of both sides (``title, authors, year, venue`` and the same with ``c_``), over the traits the entry has.

    ``title`` and ``venue`` are the similarities of those, if they were made before; else
    edit similarity, which needs no Python, stands in for matching blocks.
    """
    own = surnames(F.col("authors"))
    gap = F.abs(F.col("year") - F.col("c_year"))
    traits = {
        "title": (plain(F.col("title")) != "", text_similarity(F.col("title"), F.col("c_title")) if title is None else title),
        "authors": (F.size(own) > 0, F.size(F.array_intersect(own, surnames(F.coalesce("c_authors", F.array().cast("array<string>"))))) / F.greatest(F.size(own), F.lit(1))),
        "year": (F.col("year").isNotNull(), F.when(gap == 0, 1.0).when(gap == 1, 0.8).otherwise(0.0)),
        "venue": (plain(F.col("venue")) != "", text_similarity(F.col("venue"), F.col("c_venue")) if venue is None else venue),
    }
    there = {t: F.coalesce(has, F.lit(False)) for t, (has, _) in traits.items()}
    total = sum((F.when(there[t], F.coalesce(v, F.lit(0.0)) * WEIGHTS[t]).otherwise(0.0) for t, (_, v) in traits.items()), F.lit(0.0))
    weight = sum((F.when(there[t], WEIGHTS[t]).otherwise(0.0) for t in traits), F.lit(0.0))
    return pairs.withColumn("score", F.round(F.coalesce(F.try_divide(total, weight), F.lit(0.0)), 6))


def decided(scores: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``entry, candidate, score, status, reason``: the best candidate of each entry and whether it may be linked without a person.

    ``scores`` has ``entry, candidate, score, by_id``; a strong identifier decides
    alone if it names one candidate only.
    """
    w = Window.partitionBy("entry").orderBy(F.desc("by_id"), F.desc("score"), "candidate")
    ids = F.sum(F.col("by_id").cast("int")).over(Window.partitionBy("entry"))
    top = scores.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).withColumn("ids", ids).where("n = 1")
    # fixed values: the names of the reasons
    reason = (
        F.when(F.col("ids") == 1, "unique_strong_identifier").when(F.col("ids") > 1, "conflicting_strong_identifier_candidates")
        .when(F.col("score") < policy.threshold, "top_score_below_auto_match_threshold").when(F.round(F.col("score") - F.col("second"), 6) < policy.margin, "top_candidates_within_minimum_margin").otherwise("score_and_margin_satisfied")
    )
    out = top.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("unique_strong_identifier", "score_and_margin_satisfied"), "resolved").when(F.col("reason") == "top_score_below_auto_match_threshold", "unresolved").otherwise("ambiguous")
    return out.select("entry", "candidate", "score", status.alias("status"), "reason")
