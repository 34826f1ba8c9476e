"""Queries for the composed operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import identifiers as X
from quillmesh.functions import text as T
from quillmesh.operators import identity as I
from quillmesh.operators import linking as L
from quillmesh.operators import search as S
from quillmesh.operators import service as V
from quillmesh.plans.identities import _KEYS, _ROOTS
from quillmesh.plans.registry import query
from quillmesh.plans.searches import _NO_WORKS, _tokens, records
from quillmesh.session import load

_TEXT = "boundary of linear networks and their retrieval"
_GROUPS = f"{_ROOTS}, all_roots AS (SELECT DISTINCT s.record_id, coalesce(r.root, s.record_id) AS root FROM source_records s LEFT JOIN roots r USING (record_id))"
#: The canonical record of each root among what the sources return, in SQL.
_FOUND = f"""{_GROUPS},
  ranked AS (SELECT provider, record_id, min(provider_rank) AS rank FROM source_records WHERE provider_rank IS NOT NULL GROUP BY 1, 2),
  batch AS (SELECT provider, record_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY rank, record_id) AS pos FROM ranked) WHERE pos <= 100),
  hits AS (SELECT b.provider, b.rank, p.*, g.root, row_number() OVER (PARTITION BY g.root ORDER BY b.provider, b.rank, b.record_id) AS n,
        row_number() OVER (PARTITION BY g.root ORDER BY coalesce(p.abstract, '') = '', b.provider, b.rank, b.record_id) AS na FROM batch b JOIN all_roots g USING (record_id) JOIN papers p USING (record_id)),
  one AS (SELECT x.root, x.record_id, x.title, nullif(y.abstract, '') AS abstract, x.venue, x.fields_of_study, x.publication_year, x.work_type FROM hits x JOIN hits y ON x.root = y.root AND y.na = 1 WHERE x.n = 1),
  kept AS (SELECT * FROM one WHERE publication_year >= 2005 AND (work_type IS NULL OR trim(regexp_replace(lower(work_type), '\\s+', ' ', 'g')) NOT IN {_NO_WORKS}))"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """Record and root of all records that any source returned."""
    known = I.clusters(load(spark, folder, "papers"), load(spark, folder, "identifier_claims"))
    return load(spark, folder, "source_records").select("record_id").distinct().join(known, "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("root"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "source_records").where("provider_rank IS NOT NULL").groupBy("provider", "record_id").agg(F.min("provider_rank").alias("rank"))


@query(
    "search_end_to_end",
    f"""WITH RECURSIVE {_FOUND}, q AS (SELECT unnest({_tokens("'" + _TEXT + "'")}) AS w),
    d AS (SELECT root, record_id, {_tokens('title')} AS t, {_tokens("concat_ws(' ', title, abstract, venue, list_aggregate(fields_of_study, 'string_agg', ' '))")} AS b,
      trim(regexp_replace(lower(concat_ws(' ', title, abstract, venue)), '\\s+', ' ', 'g')) AS p,
      coalesce(lower(work_type) IN ('retracted publication', 'retracted-article'), false) OR coalesce(regexp_matches(lower(title), '^[^\\p{{L}}\\p{{N}}_]*retracted\\b'), false) AS gone FROM kept),
    n AS (SELECT count(*) AS n FROM d), w AS (SELECT w, pow(ln((n + 1) / ((SELECT count(*) FROM d WHERE list_contains(b, w)) + 1)) + 1, 2) AS x FROM q, n),
    r AS (SELECT root, sum(1 / (60 + rank)) AS rrf, min(rank) AS best_rank, count(*) AS providers FROM (SELECT root, provider, min(rank) AS rank FROM hits GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT d.record_id, round((4 * (SELECT coalesce(sum(x), 0) FROM w WHERE list_contains(t, w)) / (SELECT sum(x) FROM w) + 1.25 * (SELECT coalesce(sum(x), 0) FROM w WHERE list_contains(b, w)) / (SELECT sum(x) FROM w)
      + 0.75 * contains(p, '{_TEXT}')::INT + 10 * rrf + 0.05 * least(providers, 3)) * CASE WHEN gone THEN 0.5 ELSE 1 END, 6) AS score, best_rank FROM d JOIN r USING (root))
    SELECT row_number() OVER (ORDER BY score DESC, best_rank, record_id DESC) AS rank, record_id, score FROM s ORDER BY 1 LIMIT 50""",
)
def search_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """What every source returns, as canonical works since 2005, best first."""
    return V.search(records(spark, folder), _ranked(spark, folder), _groups(spark, folder), _TEXT, S.Filters(year_from=2005), 50)


@query(
    "search_end_to_end_newest",
    f"WITH RECURSIVE {_FOUND} SELECT row_number() OVER (ORDER BY publication_year DESC NULLS LAST, record_id) AS rank, record_id FROM kept ORDER BY 1 LIMIT 50",
)
def search_end_to_end_newest(spark: SparkSession, folder: str) -> DataFrame:
    found = V.search(records(spark, folder), _ranked(spark, folder), _groups(spark, folder), _TEXT, S.Filters(year_from=2005), 50, "newest")
    return found.select("rank", "record_id")


_ASKED = f"""asked AS (SELECT DISTINCT 'doi:' || regexp_replace(d, '[./]v\\d+$', '') AS asked FROM (SELECT lower(regexp_replace(trim(doi), '[.,;)]+$', '')) AS d FROM extracted_references WHERE doi IS NOT NULL) WHERE regexp_full_match(d, '10\\.\\d{{4,9}}/\\S+'))"""


@query("resolve_identifiers", f"WITH RECURSIVE {_ROOTS}, {_ASKED} SELECT asked, r.root, count(*) AS records FROM asked JOIN k ON k.k = asked JOIN roots r USING (record_id) GROUP BY 1, 2")
def resolve_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """The works behind the DOIs of all bibliographies."""
    asked = load(spark, folder, "extracted_references").where("doi IS NOT NULL").select(F.lit("doi").alias("scheme"), F.col("doi").alias("value"))
    claims = load(spark, folder, "identifier_claims")
    return V.resolve(asked, claims, I.clusters(load(spark, folder, "papers"), claims))


@query(
    "related_ranked",
    """WITH l AS (SELECT provider, coalesce(p.work_family_id, s.record_id) AS root, provider_rank AS rank FROM source_records s LEFT JOIN papers p USING (record_id) WHERE provider_rank IS NOT NULL),
    g AS (SELECT DISTINCT coalesce(work_family_id, record_id) AS root FROM papers WHERE lower(venue) = 'preprint deposit'),
    s AS (SELECT root, round(sum(1.0 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT provider || ':' || rank)), ' ') AS evidence FROM l WHERE root NOT IN (SELECT root FROM g) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY score DESC, root) AS rank, root, score, evidence FROM s ORDER BY 1 LIMIT 100""",
)
def related_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred works related most, all retrievals counted, with their evidence; those of negative examples are left out."""
    work = load(spark, folder, "papers").select("record_id", F.coalesce("work_family_id", "record_id").alias("root"), "venue")
    lists = load(spark, folder, "source_records").select("record_id", "provider", F.col("provider_rank").alias("rank"))
    found = V.related(lists, work.select("record_id", "root"), work.where("lower(venue) = 'preprint deposit'").select("root").distinct(), 100)
    return found.withColumn("evidence", F.array_join(F.sort_array(F.transform("evidence", lambda e: F.concat_ws(":", e["provider"], e["rank"]))), " "))


_RELATION = """WITH o AS (SELECT {here} AS seed, provider, {there} AS record_id, min(first_seen_at) AS seen FROM citation_assertions WHERE {here} IN ({seeds}) AND {here} <> {there} GROUP BY 1, 2, 3),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, provider ORDER BY seen, record_id) AS pos FROM o) WHERE pos <= 100)
  SELECT seed, provider, record_id, {kind} AS evidence_type FROM t"""


@query("relation_citations", _RELATION.format(here="object_record_id", there="subject_record_id", seeds="SELECT record_id FROM seed_papers", kind="'provider_graph'"))
def relation_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Who cites the seeds: of every source and seed the first hundred."""
    return V.relations(load(spark, folder, "citation_assertions"), load(spark, folder, "seed_papers"), "citations", 100)


_CITING = "SELECT subject_record_id FROM citation_assertions WHERE object_record_id IN (SELECT record_id FROM seed_papers)"


@query("relation_references", _RELATION.format(here="subject_record_id", there="object_record_id", seeds=_CITING, kind="CASE WHEN provider = 'crossref' THEN 'depositor_metadata' ELSE 'provider_graph' END"))
def relation_references(spark: SparkSession, folder: str) -> DataFrame:
    """What the works that cite a seed cite themselves."""
    said = load(spark, folder, "citation_assertions")
    citing = said.join(load(spark, folder, "seed_papers").select(F.col("record_id").alias("object_record_id")), "object_record_id", "left_semi").select(F.col("subject_record_id").alias("record_id"))
    return V.relations(said, citing, "references", 100)


_ALIAS = f"""{_GROUPS}, names AS (SELECT record_id AS alias, root, record_id FROM all_roots UNION ALL SELECT s.provider || ':' || s.source_record_id, g.root, g.record_id FROM (SELECT DISTINCT record_id, provider, source_record_id FROM source_records) s JOIN all_roots g USING (record_id)),
  alias AS (SELECT alias, arg_max(root, record_id) AS root FROM names GROUP BY 1)"""


@query("relation_aliases", f"""WITH RECURSIVE {_ALIAS}, x AS ({_RELATION.replace('WITH o', 'WITH o').format(here="object_record_id", there="subject_record_id", seeds="SELECT record_id FROM seed_papers", kind="'provider_graph'")}),
  y AS (SELECT coalesce(a.root, seed) AS seed, provider, coalesce(b.root, x.record_id) AS record_id, evidence_type FROM x LEFT JOIN alias a ON a.alias = x.seed LEFT JOIN alias b ON b.alias = x.record_id)
  SELECT DISTINCT * FROM y WHERE seed <> record_id""")
def relation_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The same with both ends as canonical works."""
    names = V.aliases(load(spark, folder, "source_records"), _groups(spark, folder))
    return V.relations(load(spark, folder, "citation_assertions"), load(spark, folder, "seed_papers"), "citations", 100, names)


@query("assertions_visible", "SELECT provider, count(*) AS assertions, count(DISTINCT assertion_id) AS ids FROM citation_assertions WHERE subject_record_id IN (SELECT record_id FROM papers) AND object_record_id IN (SELECT record_id FROM papers) GROUP BY 1")
def assertions_visible(spark: SparkSession, folder: str) -> DataFrame:
    """Assertions between known papers, per source."""
    seen = V.visible(load(spark, folder, "citation_assertions"), load(spark, folder, "papers"))
    return seen.groupBy("provider").agg(F.count("*").alias("assertions"), F.countDistinct("assertion_id").alias("ids"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "extracted_references").select(F.col("reference_key").alias("entry"), F.col("document_record_id").alias("citing"), "evidence_level", "title", "authors", F.col("publication_year").alias("year"), "venue", T.doi("doi").alias("doi"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    names = load(spark, folder, "authors").groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_position", "name"))), lambda x: x["name"]).alias("c_authors"))
    return load(spark, folder, "papers").join(names, "record_id", "left").select(F.col("record_id").alias("candidate"), F.col("title").alias("c_title"), "c_authors", F.col("publication_year").alias("c_year"), F.col("venue").alias("c_venue"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    claims = load(spark, folder, "identifier_claims").where("scheme = 'doi'").select(F.col("record_id").alias("candidate"), T.doi("value").alias("doi")).where("doi IS NOT NULL")
    return V.link_references(_entries(spark, folder).drop("citing", "evidence_level"), _targets(spark, folder), claims)


_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    "link_title_candidates",
    f"""WITH e AS (SELECT reference_key AS entry, {_PLAIN.format('title')} AS t, publication_year AS y FROM extracted_references), r AS (SELECT record_id AS candidate, {_PLAIN.format('title')} AS ct, publication_year AS cy FROM papers)
    SELECT entry, candidate FROM e JOIN r ON contains(' ' || ct || ' ', ' ' || t || ' ') WHERE t <> '' AND (y IS NULL OR cy IS NULL OR abs(y - cy) <= 1)""",
)
def link_title_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return V.title_candidates(_entries(spark, folder), _targets(spark, folder))


@query("link_references")
def link_references(spark: SparkSession, folder: str) -> DataFrame:
    """One judgement for every entry of every bibliography; matching blocks have no SQL, so the tests compare with a plain loop."""
    return _links(spark, folder)


@query("link_edges")
def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    return V.link_edges(_links(spark, folder), _entries(spark, folder).select("entry", "citing", "evidence_level"))


# Fixed value: schemes by how well other sources understand them.
_ORDER = "doi arxiv pmid pmcid omid dblp inspire openreview acl_anthology openaire openalex semantic_scholar crossref google_scholar".split()


@query(
    "portable_ids",
    "SELECT record_id, arg_min(scheme, o) AS scheme, arg_min(value, o) AS value FROM (SELECT record_id, scheme, value, (list_position([" + ", ".join(f"'{s}'" for s in _ORDER) + "], scheme), value) AS o FROM identifier_claims WHERE list_position([" + ", ".join(f"'{s}'" for s in _ORDER) + "], scheme) > 0 AND value IS NOT NULL) GROUP BY 1",
)
def portable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The one claim of each record to ask other sources with."""
    claims = load(spark, folder, "identifier_claims").where("value IS NOT NULL").groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("scheme", "value"))).alias("c"))
    best = F.array_sort("c", lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    return claims.select("record_id", X.preferred(best).alias("p")).where("p IS NOT NULL").select("record_id", "p.scheme", "p.value")


@query(
    "redacted_requests",
    """SELECT DISTINCT record_id, coalesce(source_url, 'https://x.example/y') || '?api_key=[R]&q=1'  AS url, sha256(provider || chr(10) || 'GET' || chr(10) || coalesce(source_url, 'https://x.example/y')) AS cache_key FROM source_records""",
)
def redacted_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses with a key, shown without it, and what their answers are stored under."""
    url = F.coalesce("source_url", F.lit("https://x.example/y"))
    shown = F.replace(T.redacted_url(F.concat(url, F.lit("?api_key=secret&q=1"))), F.lit("%5BREDACTED%5D"), F.lit("[R]"))
    return load(spark, folder, "source_records").select("record_id", shown.alias("url"), T.cache_key("provider", F.lit("get"), url).alias("cache_key")).distinct()


_KEPT = "title publication_year venue".split()


@query(
    "row_fingerprints",
    "SELECT record_id, 'v1:' || sha256('{\"publication_year\":' || coalesce(publication_year::VARCHAR, 'null') || ',\"title\":' || coalesce(to_json(title)::VARCHAR, 'null') || ',\"venue\":' || coalesce(to_json(venue)::VARCHAR, 'null') || '}') AS fingerprint FROM papers",
)
def row_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "papers").select("record_id", T.fingerprint(*_KEPT).alias("fingerprint"))


@query("distinct_sources", "SELECT DISTINCT record_id, provider, source_record_id, provider_rank, provider_score, retrieval_method FROM source_records")
def distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source records without the retrieval time, the first of equal ones kept."""
    rows = load(spark, folder, "source_records").select("record_id", "provider", "source_record_id", "provider_rank", "provider_score", "retrieval_method", "retrieved_at")
    return T.distinct_rows(rows, "retrieved_at").drop("retrieved_at")
