"""Queries over citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import stable_id
from quillmesh.operators import graph as G
from quillmesh.plans.registry import query
from quillmesh.session import load

_E = "(SELECT DISTINCT subject_record_id AS citing, object_record_id AS cited FROM citation_assertions WHERE subject_record_id <> object_record_id)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "citation_assertions")
    return c.where("subject_record_id <> object_record_id").select(F.col("subject_record_id").alias("citing"), F.col("object_record_id").alias("cited")).distinct()


@query(
    "edges_visible",
    """SELECT 'ce:' || sha256(subject_record_id || chr(0) || object_record_id)[:24] AS edge_id, subject_record_id AS citing, object_record_id AS cited, count(DISTINCT assertion_id) AS assertions,
      count(DISTINCT provider) AS providers, CASE WHEN max((verification_status = 'verified')::INT) = 1 THEN 'verified' ELSE 'provider_asserted' END AS status
    FROM citation_assertions WHERE subject_record_id <> object_record_id GROUP BY 2, 3""",
)
def edges_visible(spark: SparkSession, folder: str) -> DataFrame:
    return G.folded_edges(load(spark, folder, "citation_assertions"))


@query("co_citation", f"SELECT a.cited AS left_id, b.cited AS right_id, count(*) AS shared FROM {_E} a JOIN {_E} b ON a.citing = b.citing AND a.cited < b.cited GROUP BY 1, 2")
def co_citation(spark: SparkSession, folder: str) -> DataFrame:
    return G.pairs_sharing(edges(spark, folder), "citing", "cited")


@query(
    "bib_coupling",
    f"""SELECT a.citing AS query_id, b.citing AS other_id, count(*) AS shared FROM {_E} a JOIN {_E} b ON a.cited = b.cited AND a.citing <> b.citing
    WHERE regexp_extract(a.citing, '(\\d+)$', 1) <> '' AND regexp_extract(a.citing, '(\\d{{2}})$', 1) = '00' GROUP BY 1, 2""",
)
def bib_coupling(spark: SparkSession, folder: str) -> DataFrame:
    """Coupling of the records whose number is divisible by 100 with all others."""
    e = edges(spark, folder)
    asked = e.select(F.col("citing").alias("query_id")).distinct().where(F.col("query_id").rlike(r"00$"))
    return G.sharing_with(e, "cited", "citing", asked)


@query("degree_stats", f"SELECT record_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT citing AS record_id, 0 AS i, 1 AS o FROM {_E} UNION ALL SELECT cited, 1, 0 FROM {_E}) GROUP BY 1")
def degree_stats(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(edges(spark, folder))


@query(
    "pagerank",
    f"""WITH RECURSIVE e AS (SELECT * FROM {_E}), v AS (SELECT citing AS id FROM e UNION SELECT cited FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v),
    o AS (SELECT citing AS id, count(*) AS o FROM e GROUP BY 1),
    r(k, id, r) AS (SELECT 0, id, 1 / n FROM v, n UNION ALL
      SELECT t.k + 1, t.id, 0.15 / n + 0.85 * (t.lost / n + coalesce(t.g, 0)) FROM (
        SELECT s.k, v.id, s.lost, g.g FROM v CROSS JOIN (SELECT max(k) AS k, coalesce(sum(r.r) FILTER (o.id IS NULL), 0) AS lost FROM r LEFT JOIN o USING (id)) s
        LEFT JOIN (SELECT e.cited AS id, sum(r.r / o.o) AS g FROM r JOIN e ON r.id = e.citing JOIN o ON o.id = r.id GROUP BY 1) g ON g.id = v.id) t, n WHERE t.k < 50)
    SELECT id AS record_id, round(r, 10) AS score FROM r WHERE k = 50""",
)
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return G.pagerank(edges(spark, folder)).withColumn("score", F.round("score", 10))


@query(
    "bfs_expand",
    f"""WITH e AS (SELECT * FROM {_E}), s AS (SELECT DISTINCT record_id FROM seed_papers WHERE record_id IN (SELECT cited FROM e UNION SELECT citing FROM e)),
    a AS (SELECT DISTINCT e.citing AS record_id FROM e JOIN s ON e.cited = s.record_id WHERE e.citing NOT IN (SELECT record_id FROM s)),
    b AS (SELECT DISTINCT e.citing AS record_id FROM e JOIN a ON e.cited = a.record_id WHERE e.citing NOT IN (SELECT record_id FROM s UNION SELECT record_id FROM a))
    SELECT record_id, 0 AS depth FROM s UNION ALL SELECT record_id, 1 FROM a UNION ALL SELECT record_id, 2 FROM b""",
)
def bfs_expand(spark: SparkSession, folder: str) -> DataFrame:
    """All that cites the seed papers, or cites what does: an expansion without binding limits."""
    limits = G.Expansion(depth=2, frontier_cap=2**31 - 1, top_k=2**31 - 1, per_node=2**31 - 1, operations=("citations",))
    return G.expand(edges(spark, folder), load(spark, folder, "seed_papers"), limits)[0]


@query("bfs_capped")
def bfs_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of an expansion under limits, in both directions."""
    limits = G.Expansion(depth=2, frontier_cap=50, top_k=200, per_node=20, operations=("references", "citations"))
    return G.expand(edges(spark, folder), load(spark, folder, "seed_papers"), limits)[1]


@query(
    "graph_exclusions",
    """SELECT record_id, list_filter([CASE WHEN publication_year IS NULL THEN 'year_missing' END, CASE WHEN publication_year < 2015 THEN 'year_before_range' END, CASE WHEN publication_year > 2030 THEN 'year_after_range' END,
      CASE WHEN work_type IS NULL THEN 'work_type_missing' END, CASE WHEN lower(work_type) <> 'journal-article' THEN 'work_type_not_included' END], lambda x: x IS NOT NULL) AS reasons
    FROM papers WHERE publication_year IS NULL OR publication_year < 2015 OR publication_year > 2030 OR work_type IS NULL OR lower(work_type) <> 'journal-article'""",
)
def graph_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    return G.exclusions(load(spark, folder, "papers"), 2015, 2030, ("journal-article",))


@query(
    "references_of", f"SELECT e.citing AS seed, e.cited AS record_id, 'references' AS relation FROM {_E} e WHERE e.citing IN (SELECT record_id FROM papers WHERE work_type = 'book-chapter' OR lower(venue) = 'in press')"
)
def references_of(spark: SparkSession, folder: str) -> DataFrame:
    seeds = load(spark, folder, "papers").where("work_type = 'book-chapter' OR lower(venue) = 'in press'").select(F.col("record_id").alias("citing"))
    return edges(spark, folder).join(seeds, "citing", "left_semi").select(F.col("citing").alias("seed"), F.col("cited").alias("record_id"), F.lit("references").alias("relation"))


@query("citations_of", f"SELECT e.cited AS seed, e.citing AS record_id, 'cites' AS relation FROM {_E} e WHERE e.cited IN (SELECT record_id FROM seed_papers)")
def citations_of(spark: SparkSession, folder: str) -> DataFrame:
    seeds = load(spark, folder, "seed_papers").select(F.col("record_id").alias("cited"))
    return edges(spark, folder).join(seeds, "cited", "left_semi").select(F.col("cited").alias("seed"), F.col("citing").alias("record_id"), F.lit("cites").alias("relation"))


@query(
    "assertion_ids",
    "SELECT DISTINCT assertion_id, 'ca:' || sha256(concat_ws(chr(0), subject_record_id, object_record_id, relation, provider, coalesce(source_record_id, ''), evidence_type))[:24] AS derived_id FROM citation_assertions",
)
def assertion_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "citation_assertions")
    return c.select("assertion_id", stable_id("ca:", "subject_record_id", "object_record_id", "relation", "provider", "source_record_id", "evidence_type").alias("derived_id")).distinct()
