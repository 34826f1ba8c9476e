"""Filtering, ranking and fusion of records."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import TOKEN, collapse, search_tokens

# Types that are no works of their own, and types of withdrawn works.
NO_WORKS = ("component", "peer-review", "grant", "supplementary-materials", "paratext", "erratum", "published erratum", "correction", "retraction", "retraction of publication")
WITHDRAWN = ("retracted publication", "retracted-article")
RRF_K = 60


def _holds(word: str):
    return lambda x: F.contains(F.lower(x), F.lit(word.lower()))


@dataclass
class Filters:
    """Conditions on canonical records; those left None hold for every record."""

    title: str | None = None
    abstract: str | None = None
    venue: str | None = None
    author: str | None = None
    field_of_study: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    open_access: bool | None = None
    work_types: tuple[str, ...] = ()
    min_citations: int = 0

    def condition(self) -> Column:
        """All conditions, as bare conjuncts, so that those on years, types and access reach the scan. Null counts as false: use it in ``where``."""
        parts: list[Column] = []
        for name, word in (("title", self.title), ("abstract", self.abstract), ("venue", self.venue)):
            if word:
                parts.append(F.contains(F.lower(name), F.lit(word.lower())))
        for name, word in (("authors", self.author), ("fields_of_study", self.field_of_study)):
            if word:
                parts.append(F.exists(name, _holds(word)))
        if self.year_from is not None:
            parts.append(F.col("publication_year") >= self.year_from)
        if self.year_to is not None:
            parts.append(F.col("publication_year") <= self.year_to)
        if self.open_access is not None:
            parts.append(F.col("open_access").eqNullSafe(F.lit(self.open_access)))
        kind = F.lower(collapse("work_type"))
        if self.work_types:
            parts.append(kind.isin([" ".join(w.lower().split()) for w in self.work_types]))
        else:
            parts.append(~F.coalesce(kind.isin(*NO_WORKS), F.lit(False)))
        if self.min_citations:
            parts.append(F.coalesce("citations", F.lit(0)) >= self.min_citations)
        return reduce(lambda a, b: a & b, parts)

    def plan(self, pushed: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """Where each condition in use is evaluated: by the source, or here."""
        used = [f for f, v in vars(self).items() if v not in (None, (), 0)]
        return [(f, "provider" if f in pushed else "local") for f in used]


@dataclass
class Node:
    """A Boolean search expression. Leaves (term, phrase) have a value, the others children."""

    kind: str
    value: str | None = None
    field: str = "all"
    children: list["Node"] = dataclasses.field(default_factory=list)

    def __post_init__(self) -> None:
        leaf = self.kind in ("term", "phrase")
        if leaf and (not (self.value or "").strip() or self.children):
            raise ValueError("a term or phrase needs a value and no children")
        if self.kind == "not" and len(self.children) != 1 or self.kind in ("and", "or") and len(self.children) < 2:
            raise ValueError(f"wrong number of children for {self.kind}")
        if not leaf and self.field != "all":
            raise ValueError("only terms and phrases have a field")

    @classmethod
    def from_json(cls, text: str | dict) -> Node:
        """A tree written as ``{"operator", "value", "field", "children"}``; other keys are refused."""
        given = json.loads(text) if isinstance(text, str) else text
        if not isinstance(given, dict) or set(given) - {"operator", "value", "field", "children"} or "operator" not in given:
            raise ValueError("a node has an operator, and may have value, field and children")
        kind, field = str(given["operator"]).lower(), str(given.get("field") or "all").lower()
        if kind not in ("and", "or", "not", "term", "phrase") or field not in ("all", "title", "abstract", "author", "venue", "field"):
            raise ValueError(f"no such operator or field: {kind}, {field}")
        return cls(kind, given.get("value"), field, [cls.from_json(c) for c in given.get("children") or []])

    def condition(self) -> Column:
        """True or false, never null, so that NOT of a missing value holds."""
        if self.kind == "and":
            return reduce(lambda a, b: a & b, [c.condition() for c in self.children])
        if self.kind == "or":
            return reduce(lambda a, b: a | b, [c.condition() for c in self.children])
        if self.kind == "not":
            return ~self.children[0].condition()
        values = F.transform(F.filter(_values(self.field), lambda x: x.isNotNull()), lambda x: F.lower(collapse(x)))
        wanted = " ".join(self.value.lower().split())
        if self.kind == "phrase":
            return F.coalesce(F.exists(values, lambda x: F.contains(x, F.lit(wanted))), F.lit(False))
        words = F.array(*[F.lit(w) for w in dict.fromkeys(wanted.split())])
        return F.coalesce(F.exists(values, lambda x: F.size(F.array_except(words, F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))) == 0), F.lit(False))


def _values(name: str) -> Column:
    none = F.array().cast("array<string>")
    authors, fields = F.coalesce("authors", none), F.coalesce("fields_of_study", none)
    return {
        "title": F.array("title"), "abstract": F.array("abstract"), "venue": F.array("venue"), "author": authors, "field": fields,
        "all": F.concat(F.array("title", "abstract", "venue"), authors, fields),
    }[name]


def withdrawn() -> Column:
    return F.coalesce(F.lower(collapse("work_type")).isin(*WITHDRAWN), F.lit(False)) | F.coalesce(F.col("title").rlike(r"(?i)^[^\p{L}\p{N}_]*retracted\b"), F.lit(False))


def relevance(records: DataFrame, ranks: DataFrame, text: str) -> DataFrame:
    """``record_id, score, best_rank`` of every record for a query.

    ``ranks`` has ``record_id, provider, rank``. Weights of query words come
    from document frequencies over all of ``records``; one pass computes all
    counts, as the query has few words.
    """
    words = [r[0] for r in records.sparkSession.range(1).select(F.explode(search_tokens(F.lit(text)))).collect()]
    parts = records.select(
        "record_id",
        search_tokens("title").alias("t"),
        search_tokens(F.concat_ws(" ", "title", "abstract", "venue", F.concat_ws(" ", "fields_of_study"))).alias("b"),
        F.lower(collapse(F.concat_ws(" ", "title", "abstract", "venue"))).alias("p"),
        withdrawn().alias("gone"),
    )
    counts = parts.agg(F.count("*").alias("n"), *[F.sum(F.array_contains("b", w).cast("long")).alias(f"d{k}") for k, w in enumerate(words)]).first()
    import math

    n = max(1, counts["n"])
    weights = [(math.log((n + 1) / ((counts[f"d{k}"] or 0) + 1)) + 1) ** 2 for k in range(len(words))]
    total = sum(weights) or 1.0

    def cover(c: str) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.array_contains(c, w), F.lit(x)).otherwise(0.0) for w, x in zip(words, weights, strict=True)], F.lit(0.0)) / total

    best = ranks.where("rank IS NOT NULL").groupBy("record_id", "provider").agg(F.min("rank").alias("rank")).groupBy("record_id")
    best = best.agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.count("*").alias("providers"))
    scored = parts.join(best, "record_id", "left")
    phrase = F.contains("p", F.lit(" ".join(text.lower().split()))).cast("int")
    score = 4 * cover("t") + 1.25 * cover("b") + 0.75 * phrase + 10 * F.coalesce("rrf", F.lit(0.0)) + 0.05 * F.least(F.coalesce("providers", F.lit(0)), F.lit(3))
    score = score * F.when(F.col("gone"), 0.5).otherwise(1.0)
    return scored.select("record_id", F.round(score, 6).alias("score"), F.coalesce("best_rank", F.lit(10000)).alias("best_rank"))


def rrf(ranked: DataFrame, key: str = "record_id", k: int = RRF_K) -> DataFrame:
    """``key, score``: reciprocal ranks summed over all rows of all lists."""
    return ranked.where("rank IS NOT NULL").groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def overfetch(ranked: DataFrame, limit: int) -> DataFrame:
    """The first ``min(100, 3 * limit)`` rows of every provider by rank, as each source would be asked for."""
    w = Window.partitionBy("provider").orderBy("rank", "record_id")
    return ranked.withColumn("at", F.row_number().over(w)).where(F.col("at") <= min(100, 3 * limit)).drop("at")


def contributions(rows: DataFrame) -> DataFrame:
    """Per provider: raw records, works, works only it has, works shared, share of works. ``rows``: ``provider, work``."""
    raw = rows.groupBy("provider").agg(F.count("*").alias("raw_records"))
    once = rows.select("provider", "work").distinct()
    wide = once.join(once.groupBy("work").agg(F.count("*").alias("n")), "work")
    per = wide.groupBy("provider").agg(F.count("*").alias("works"), F.sum((F.col("n") == 1).cast("long")).alias("unique_works"), F.sum((F.col("n") > 1).cast("long")).alias("shared_works"))
    all_ = once.select("work").distinct().count()
    return raw.join(per, "provider").withColumn("share", F.round(F.col("works") / F.lit(max(1, all_)), 9))


def overlaps(rows: DataFrame) -> DataFrame:
    """Per pair of providers: shared works, works of both together, Jaccard and overlap coefficient."""
    once = rows.select("provider", "work").distinct()
    size = once.groupBy("provider").agg(F.count("*").alias("n"))
    # all pairs of the providers of one work, of which there are as many as providers
    both = once.withColumnRenamed("provider", "l").join(once.withColumnRenamed("provider", "r"), "work").where("l < r").groupBy("l", "r").agg(F.count("*").alias("shared"))
    names = size.select(F.col("provider").alias("l"), F.col("n").alias("nl")).join(size.select(F.col("provider").alias("r"), F.col("n").alias("nr")), F.col("l") < F.col("r"))
    out = names.join(both, ["l", "r"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("nl") + F.col("nr") - F.col("shared")
    return out.select(F.col("l").alias("left_provider"), F.col("r").alias("right_provider"), "shared", union.alias("together"), F.round(F.coalesce(F.try_divide("shared", union), F.lit(0.0)), 9).alias("jaccard"), F.round(F.coalesce(F.try_divide(F.col("shared"), F.least("nl", "nr")), F.lit(0.0)), 9).alias("overlap"))


def overall_status(reports: DataFrame, key: str) -> DataFrame:
    """One status per ``key`` from the reports of its sources (``status, results``), in fixed order of precedence."""
    n = lambda c: F.sum(c.cast("int"))
    s = F.col("status")
    a = reports.groupBy(key).agg(n(s != "skipped").alias("active"), n(s == "partial").alias("partial"), n(s.isin("complete", "empty")).alias("good"), n(s == "throttled").alias("slow"), F.sum("results").alias("results"))
    status = (
        F.when(F.col("active") == 0, "degraded").when(F.col("partial") > 0, "partial")
        .when(F.col("good") == F.col("active"), F.when(F.col("results") > 0, "complete").otherwise("empty"))
        .when(F.col("good") > 0, "partial").when(F.col("slow") > 0, "throttled").otherwise("failed")
    )
    return a.select(key, status.alias("status"))
