"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, citations, confusables, contraction, mixture, reading, scans, survivors, variants
from quillmesh.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_pairs(load(spark, folder, "authors"), load(spark, folder, "papers"))


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of every row: what ``p1_found`` lists as pairs, linear in the rows."""
    return variants.entities(load(spark, folder, "authors"), load(spark, folder, "papers")).select(F.col("id").alias("author_id"), "group_id")


def _scanned(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, str, str]]:
    return [
        ("raw_text", load(spark, folder, "extracted_references"), "reference_key", "raw_text"),
        ("context_text", load(spark, folder, "citation_contexts"), "context_id", "text"),
    ]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(_scanned(spark, folder))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired_fields(_scanned(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    links = contraction.merge_links(load(spark, folder, "identity_events"))
    return contraction.linked_groups(links, "left_record_id", "right_record_id")


P3_SQL = """
WITH RECURSIVE links AS (
  SELECT left_record_id AS a, right_record_id AS b FROM identity_events e
  WHERE action = 'merge' AND left_record_id <> right_record_id
    AND (event_id IS NULL OR event_id NOT IN (SELECT reverts_event_id FROM identity_events WHERE reverts_event_id IS NOT NULL))
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, s.b FROM reach r JOIN both_ways s ON r.b = s.a)
SELECT a AS record_id, min(b) AS group_id FROM reach GROUP BY a
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cited(spark, folder).select("reference_key", "record_id")


def p4_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _cited(spark, folder).withColumn("confidence", F.round("confidence", 6))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    return citations.matches(load(spark, folder, "extracted_references"), load(spark, folder, "papers"), load(spark, folder, "authors"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    names = confusables.look_alikes(load(spark, folder, "authors"), "author_id", "name")
    titles = confusables.look_alikes(load(spark, folder, "extracted_references"), "reference_key", "title")
    return names.select(F.lit("author_name").alias("field_name"), F.col("author_id").alias("row_id")).unionAll(
        titles.select(F.lit("reference_title").alias("field_name"), F.col("reference_key").alias("row_id"))
    )


def _family_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [load(spark, folder, t) for t in ("papers", "source_records", "identifier_claims", "providers")]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.contested(*_family_tables(spark, folder))


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(*_family_tables(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(load(spark, folder, "documents"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    weights = load(spark, folder, "mix_weights")
    sizes = mixture.source_sizes(load(spark, folder, "documents"), weights)
    plan = mixture.plan_mixture(sizes, weights)
    return mixture.mixture(sizes, plan), plan


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    mixed, plan = _mixed(spark, folder)
    return mixture.shares(mixed, plan).withColumn("actual_share", F.round("actual_share", 9))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(load(spark, folder, "documents"), load(spark, folder, "reading_labels"))


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reading.profile(load(spark, folder, "documents")).select("doc_id", *[F.round(c, 9).alias(c) for c in ("unfamiliar_share", "mean_sentence", "score")])


P9_PROFILE_SQL = r"""
WITH t AS (SELECT doc_id, lower(text) AS x FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
w AS (SELECT doc_id, unnest(regexp_extract_all(x, '\p{L}+')) AS w FROM t),
f AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT doc_id) >= greatest(1, 0.002 * (SELECT count(*) FROM t))),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE w NOT IN (SELECT w FROM f)) AS odd FROM w GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(s, '\p{L}')) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(x, '[.!?;。！？]+|\n\s*\n')) AS s FROM t) GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(odd / n, 0.0), 9) AS unfamiliar_share, round(coalesce(n / s, 0.0), 9) AS mean_sentence,
       round(coalesce(15.79 * odd / n + 0.0496 * n / s, 0.0), 9) AS score
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
""".replace("\\\\", "\\")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_profile": p9_profile}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p9_profile": P9_PROFILE_SQL}
