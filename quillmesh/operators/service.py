"""The operations a user asks for, composed of the single operators: search, resolve, related works, relations, linking of bibliographies."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import stable_id, strong_key
from quillmesh.operators import linking as L
from quillmesh.operators import search as S
from quillmesh.session import cut, ship
from quillmesh.sources.mappers import Source


def search(records: DataFrame, ranked: DataFrame, groups: DataFrame, text: str, filters: S.Filters, limit: int, sort: str = "relevance") -> DataFrame:
    """``rank, record_id, score``: the union of what each source returns, as canonical records, filtered, ranked and limited.

    ``ranked`` (``provider, record_id, rank``) holds each source's answer; of
    each the first ``min(100, 3 * limit)`` count. ``groups`` (``record_id,
    root``) tells which records are one. A canonical record has the fields of
    its first record in order of source, rank and id, with a missing abstract
    filled from the next; document frequencies come from what the filters
    leave. Besides ``relevance`` there are ``newest``, ``oldest`` and
    ``citations``.
    """
    batch = S.overfetch(ranked, limit).select("provider", "record_id", "rank")
    found = batch.join(groups, "record_id").join(records, "record_id")
    order = F.struct("provider", "rank", "record_id")
    fields = [c for c in records.columns if c not in ("record_id", "abstract", "citations")]
    first = found.groupBy("root").agg(
        F.min_by(F.struct("record_id", *fields), order).alias("f"), F.min_by("abstract", F.when(F.coalesce("abstract", F.lit("")) != "", order)).alias("abstract"), F.max("citations").alias("citations")
    )
    kept = cut(first.select("root", "f.*", "abstract", "citations").where(filters.condition()), "found")
    if sort == "relevance":
        ranks = found.select("root", "provider", "rank").join(kept.select("root", F.col("record_id").alias("id")), "root").select(F.col("id").alias("record_id"), "provider", "rank")
        scored = S.relevance(kept, ranks, text)
        by = [F.desc("score"), F.asc("best_rank"), F.desc("record_id")]
    else:
        scored = kept.select("record_id", "publication_year", F.coalesce("citations", F.lit(0)).cast("double").alias("score"))
        by = {"newest": [F.desc_nulls_last("publication_year")], "oldest": [F.asc_nulls_last("publication_year")], "citations": [F.desc("score")]}[sort] + [F.asc("record_id")]
    top = scored.orderBy(*by).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("rank"), "record_id", "score")  # over the rows of the result


def plan_search(filters: S.Filters, sources: Iterable[Source]) -> list[tuple[str, str, str]]:
    """``source, condition, evaluated`` for each condition in use, the text always: by the source (``provider``), here (``local``), or by neither (``unsupported``)."""
    used = ["text", *[f for f, v in vars(filters).items() if v not in (None, (), 0)]]
    return [(s.name, f, "provider" if f in s.filters else "unsupported" if f in s.unsupported else "local") for s in sources for f in used]


def resolve(identifiers: DataFrame, claims: DataFrame, groups: DataFrame) -> DataFrame:
    """``asked, root, records``: for each identifier (``scheme, value``) the works that claim it, and how many of their records do."""
    asked = identifiers.select(strong_key(F.col("scheme"), F.col("value")).alias("asked")).where("asked IS NOT NULL").distinct()
    held = claims.select("record_id", strong_key(F.col("scheme"), F.col("value")).alias("asked")).where("asked IS NOT NULL").distinct()
    return held.join(asked, "asked", "left_semi").join(groups, "record_id").groupBy("asked", "root").agg(F.count("*").alias("records"))


def related(lists: DataFrame, groups: DataFrame, negative: DataFrame, limit: int, k: int = S.RRF_K) -> DataFrame:
    """``rank, root, score, evidence``: works by fused ranks, without those of ``negative`` (``root``).

    All rows of the lists add to the score, repeated ones too; the evidence
    (``provider`` and ``rank``) is listed once each.
    """
    rows = lists.where("rank IS NOT NULL").join(groups, "record_id", "left").withColumn("root", F.coalesce("root", "record_id")).join(negative, "root", "left_anti")
    fused = rows.groupBy("root").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.sort_array(F.collect_set(F.struct("provider", "rank"))).alias("evidence"))
    by = [F.desc("score"), F.asc("root")]
    return fused.orderBy(*by).limit(limit).select(F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("rank"), "root", "score", "evidence")


def evidence_type(provider: Column, relation: Column) -> Column:
    """What an assertion rests on: deposits of publishers, or the graph of the source."""
    return F.when((provider == "crossref") & (relation == "references"), "depositor_metadata").otherwise("provider_graph")


def aliases(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """``alias, root``: all names a record goes by (its id; source and the source's own id), each once, the largest record's where two claim one."""
    own = groups.select(F.col("record_id").alias("alias"), "root", "record_id")
    other = sources.select("record_id", F.concat_ws(":", "provider", "source_record_id").alias("alias")).distinct().join(groups, "record_id").select("alias", "root", "record_id")
    return own.unionByName(other).groupBy("alias").agg(F.max_by("root", "record_id").alias("root"))


def relations(assertions: DataFrame, seeds: DataFrame, operation: str, limit: int, names: DataFrame | None = None) -> DataFrame:
    """``seed, provider, record_id, evidence_type``: what each source says the seeds (``record_id``) cite or are cited by.

    Of each source and seed the ``limit`` first different targets in the order
    they were seen count. With ``names`` (``alias, root``) both ends are
    replaced by what they stand for, and relations of a work to itself go.
    """
    here, there = ("subject_record_id", "object_record_id") if operation == "references" else ("object_record_id", "subject_record_id")
    said = assertions.join(seeds.select(F.col("record_id").alias(here)).distinct(), here, "left_semi").where(F.col(here) != F.col(there))
    once = said.groupBy(F.col(here).alias("seed"), "provider", F.col(there).alias("record_id")).agg(F.min("first_seen_at").alias("seen"))
    place = F.row_number().over(Window.partitionBy("seed", "provider").orderBy("seen", "record_id"))
    got = once.withColumn("at", place).where(F.col("at") <= limit).select("seed", "provider", "record_id", evidence_type(F.col("provider"), F.lit(operation)).alias("evidence_type"))
    if names is not None:
        known = names.select(F.col("alias"), F.col("root"))
        for c in ("seed", "record_id"):
            got = got.join(known.withColumnRenamed("alias", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        got = got.where("seed <> record_id").select("seed", "provider", "record_id", "evidence_type").distinct()
    return got


def visible(assertions: DataFrame, records: DataFrame) -> DataFrame:
    """Assertions both ends of which are in ``records`` (``record_id``)."""
    for c in ("subject_record_id", "object_record_id"):
        assertions = assertions.join(records.select(F.col("record_id").alias(c)).distinct(), c, "left_semi")
    return assertions


def block_similarity(left: str, right: str) -> float:
    """Seven parts of matching blocks and three of shared words of two plain texts; 1 for equal ones."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    a, b = set(left.split()), set(right.split())
    return 0.7 * difflib.SequenceMatcher(None, left, right, autojunk=False).ratio() + 0.3 * len(a & b) / len(a | b)


def _blocks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([block_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


_blocks.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def title_candidates(entries: DataFrame, records: DataFrame, band: int = 1) -> DataFrame:
    """``entry, candidate``: records whose title holds the entry's title as whole words, the years at most ``band`` apart where both are known.

    All words of the entry's title stand in such a record's title, so the
    join goes over the one of them that fewest records have: nothing is lost.
    """
    e = entries.select("entry", L.plain(F.col("title")).alias("t"), "year").where("t <> ''")
    r = records.select("candidate", L.plain(F.col("c_title")).alias("ct"), "c_year").where("ct <> ''")
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    r_words = cut(r.select("candidate", "ct", "c_year", word("ct")), "title-words")
    freq = r_words.groupBy("w").agg(F.count("*").alias("n"))
    # a word that no record has leaves the entry without candidate
    e_words = e.select("entry", "t", "year", word("t")).join(freq, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = e_words.groupBy("entry").agg(F.min(F.struct("n", "w")).alias("k"), F.first("t").alias("t"), F.first("year").alias("year")).where("k.n > 0").select("entry", "t", "year", F.col("k.w").alias("w"))
    near = F.col("year").isNull() | F.col("c_year").isNull() | (F.abs(F.col("year") - F.col("c_year")) <= band)
    holds = F.contains(F.concat(F.lit(" "), "ct", F.lit(" ")), F.concat(F.lit(" "), "t", F.lit(" ")))
    return rarest.join(r_words, "w").where(near & holds).select("entry", "candidate").distinct()


def link_references(entries: DataFrame, records: DataFrame, claims: DataFrame, policy: L.Policy = L.Policy()) -> DataFrame:
    """``entry, candidate, score, status, reason`` for every entry, one row each; entries without candidate are unresolved.

    ``entries``: ``entry, title, authors, year, venue, doi``; ``records``:
    ``candidate, c_title, c_authors, c_year, c_venue``; ``claims``:
    ``candidate, doi``. Candidates are the records of the entry's DOI, and
    those of its title; the best ``policy.candidates`` are judged.
    """
    ship(entries.sparkSession)
    by_id = entries.select("entry", "doi").where("doi IS NOT NULL").join(claims.distinct(), "doi").join(records.select("candidate"), "candidate", "left_semi").select("entry", "candidate").distinct()
    pairs = by_id.withColumn("i", F.lit(1)).unionByName(title_candidates(entries, records).withColumn("i", F.lit(0))).groupBy("entry", "candidate").agg((F.max("i") == 1).alias("by_id"))
    like = F.pandas_udf(_blocks, "double")
    rows = cut(pairs.join(entries, "entry").join(records, "candidate"), "candidates")
    rows = rows.withColumns({"title_sim": like(L.plain(F.col("title")), L.plain(F.col("c_title"))), "venue_sim": like(L.plain(F.col("venue")), L.plain(F.col("c_venue")))})
    scored = L.scored(rows, F.col("title_sim"), F.col("venue_sim")).select("entry", "candidate", "by_id", "score")
    w = Window.partitionBy("entry").orderBy(F.desc("by_id"), F.desc("score"), "candidate")
    best = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= policy.candidates).drop("n")
    done = entries.select("entry").distinct().join(L.decided(best, policy), "entry", "left")
    return done.select("entry", "candidate", "score", F.coalesce("status", F.lit("unresolved")).alias("status"), F.coalesce("reason", F.lit("no_candidates")).alias("reason"))


def link_edges(links: DataFrame, entries: DataFrame) -> DataFrame:
    """``edge_id, citing, cited, entry``: the links that become citations: resolved, and of entries whose callout was seen in the text.

    ``entries``: ``entry, citing, evidence_level``. No work cites itself.
    """
    sure = links.where("status = 'resolved'").join(entries.where("evidence_level = 'verified_anchor'"), "entry").where("citing <> candidate")
    return sure.select(stable_id("ce:", "citing", "candidate").alias("edge_id"), "citing", F.col("candidate").alias("cited"), "entry")
