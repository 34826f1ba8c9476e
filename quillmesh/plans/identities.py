"""Identity queries over papers and their identifier claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import identity as I
from quillmesh.operators.audit import active_events
from quillmesh.plans.registry import query
from quillmesh.session import load

_DOI = "lower(regexp_replace(trim(value), '[.,;)]+$', ''))"
_KEYS = f"""k AS (SELECT DISTINCT record_id, scheme, scheme || ':' || CASE scheme WHEN 'doi' THEN regexp_replace({_DOI}, '[./]v\\d+$', '')
    WHEN 'arxiv' THEN lower(regexp_extract(trim(value), '(?i)^(?:arxiv:)?(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?$', 1)) ELSE lower(trim(value)) END AS k FROM identifier_claims
    WHERE (scheme = 'doi' AND regexp_full_match({_DOI}, '10\\.\\d{{4,9}}/\\S+')) OR (scheme = 'arxiv' AND regexp_full_match(trim(value), '(?i)(?:arxiv:)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?')) OR scheme IN ('pmid', 'pmcid')),
    f AS (SELECT k, min(record_id) AS a FROM k GROUP BY 1), l AS (SELECT DISTINCT a, record_id AS b FROM k JOIN f USING (k) WHERE record_id <> a)"""
_ROOTS = f"""{_KEYS}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
    c AS (SELECT a AS record_id, min(b) AS root FROM reach GROUP BY 1), roots AS (SELECT p.record_id, coalesce(c.root, p.record_id) AS root FROM (SELECT DISTINCT record_id FROM papers) p LEFT JOIN c USING (record_id))"""


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, folder, "papers"), load(spark, folder, "identifier_claims")


@query("identity_exact_clusters", f"WITH RECURSIVE {_ROOTS} SELECT * FROM roots")
def identity_exact_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return I.clusters(*_tables(spark, folder))


@query(
    "identity_decisions",
    f"""WITH {_KEYS}, s AS (SELECT record_id, scheme, list_sort(list(DISTINCT k)) AS ks FROM k GROUP BY 1, 2)
    SELECT l.a AS left_id, l.b AS right_id, CASE WHEN max((x.ks <> y.ks)::INT) = 1 THEN 'cannot_link' ELSE 'must_link' END AS decision
    FROM l JOIN s x ON x.record_id = l.a JOIN s y ON y.record_id = l.b AND x.scheme = y.scheme GROUP BY 1, 2""",
)
def identity_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return I.decisions(*_tables(spark, folder))


@query("identity_resolved")
def identity_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The greedy resolution with reviewed merges and splits, checked against a plain loop in the tests."""
    papers, claims = _tables(spark, folder)
    events = active_events(load(spark, folder, "identity_events")).select(F.col("left_record_id").alias("left_id"), F.col("right_record_id").alias("right_id"), "action", "relation", "created_at", "event_id")
    return I.resolve(papers.select("record_id", F.col("record_id").alias("ord")).distinct(), claims, events)


@query(
    "canonical_merge",
    f"""WITH RECURSIVE {_ROOTS} SELECT root AS record_id, arg_min_null(title, p.record_id) AS title, arg_min_null(publication_year, p.record_id) AS publication_year, arg_min_null(venue, p.record_id) AS venue,
    arg_min(abstract, p.record_id) FILTER (abstract IS NOT NULL AND abstract <> '') AS abstract, count(*) AS sources FROM papers p JOIN roots USING (record_id) GROUP BY 1""",
)
def canonical_merge(spark: SparkSession, folder: str) -> DataFrame:
    papers, claims = _tables(spark, folder)
    return I.merged(papers, I.clusters(papers, claims))


@query(
    "entity_view",
    """SELECT record_id, 'manifestation:' || sha256('manifestation' || chr(0) || record_id)[:24] AS manifestation_id, 'version:' || sha256('version' || chr(0) || record_id)[:24] AS version_id,
    'work:' || sha256('work' || chr(0) || coalesce(work_family_id, 'single:' || record_id))[:24] AS work_id, 'artifact:' || sha256('artifact' || chr(0) || landing_page_url)[:24] AS artifact_id,
    CASE WHEN work_family_id IS NULL THEN 'singleton' ELSE 'asserted' END AS basis FROM papers""",
)
def entity_view(spark: SparkSession, folder: str) -> DataFrame:
    return I.entity_view(load(spark, folder, "papers"))


@query("identity_review_pairs")
def identity_review_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return I.review_pairs(load(spark, folder, "papers"), load(spark, folder, "authors"), load(spark, folder, "identifier_claims"))


@query(
    "version_families",
    """WITH RECURSIVE l AS (SELECT left_record_id AS a, right_record_id AS b FROM identity_events WHERE action = 'merge' AND relation = 'version_of' AND left_record_id <> right_record_id
      AND event_id NOT IN (SELECT reverts_event_id FROM identity_events WHERE reverts_event_id IS NOT NULL)), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a), m AS (SELECT a AS record_id, min(b) AS root FROM reach GROUP BY 1), f AS (SELECT root, 'review-family:' || sha256(string_agg(record_id, chr(0) ORDER BY record_id))[:24] AS family FROM m GROUP BY 1)
    SELECT record_id, root, family FROM m JOIN f USING (root)""",
)
def version_families(spark: SparkSession, folder: str) -> DataFrame:
    links = active_events(load(spark, folder, "identity_events")).where("action = 'merge' AND relation = 'version_of' AND left_record_id <> right_record_id")
    return I.version_families(links, "left_record_id", "right_record_id")


@query(
    "canonical_whole",
    f"""WITH RECURSIVE {_ROOTS}, n AS (SELECT record_id, count(*) AS n, string_agg(name, '|' ORDER BY author_position, name) AS names FROM authors WHERE name IS NOT NULL GROUP BY 1),
    x AS (SELECT root, arg_min_null(title, p.record_id) AS title, arg_min(abstract, p.record_id) FILTER (abstract IS NOT NULL AND abstract <> '') AS abstract FROM papers p JOIN roots USING (record_id) GROUP BY 1),
    w AS (SELECT root, arg_min(names, (-n, record_id)) AS authors FROM n JOIN roots USING (record_id) GROUP BY 1),
    i AS (SELECT root, string_agg(DISTINCT scheme || '=' || value, '|' ORDER BY scheme || '=' || value) AS identifiers FROM identifier_claims JOIN roots USING (record_id) GROUP BY 1),
    s AS (SELECT root, string_agg(DISTINCT provider || ':' || source_record_id, '|' ORDER BY provider || ':' || source_record_id) AS sources FROM source_records JOIN roots USING (record_id) GROUP BY 1)
    SELECT root AS record_id, title, abstract, authors, identifiers, sources FROM x LEFT JOIN w USING (root) LEFT JOIN i USING (root) LEFT JOIN s USING (root)""",
)
def canonical_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical records with the longest author list and all identifiers and sources."""
    papers, claims = _tables(spark, folder)
    whole = I.merged_whole(papers, I.clusters(papers, claims), load(spark, folder, "authors"), claims, load(spark, folder, "source_records"))
    return whole.select("record_id", "title", "abstract", *[F.array_join(c, "|").alias(c) for c in ("authors", "identifiers", "sources")])


@query("merge_exact_records")
def merge_exact_records(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical records of the resolution itself, which keeps contradicting records apart; checked against a plain loop in the tests."""
    papers, claims = _tables(spark, folder)
    groups = identity_resolved(spark, folder).withColumnRenamed("canonical_id", "root")
    return I.merged_whole(papers, groups, load(spark, folder, "authors"), claims, load(spark, folder, "source_records"))
