"""Search queries over papers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import search as S
from quillmesh.operators.service import plan_search
from quillmesh.plans.registry import query
from quillmesh.session import load, ship
from quillmesh.sources.mappers import SOURCES


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with the names of their authors in order and the number of records that cite them."""
    names = load(spark, folder, "authors").groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_position", "name"))), lambda x: x["name"]).alias("authors"))
    cited = load(spark, folder, "citation_assertions").groupBy(F.col("object_record_id").alias("record_id")).agg(F.countDistinct("subject_record_id").alias("citations"))
    return load(spark, folder, "papers").join(names, "record_id", "left").join(cited, "record_id", "left")


_CITED = "(SELECT object_record_id AS record_id, count(DISTINCT subject_record_id) AS citations FROM citation_assertions GROUP BY 1)"
_NO_WORKS = "('component','peer-review','grant','supplementary-materials','paratext','erratum','published erratum','correction','retraction','retraction of publication')"


@query(
    "search_advanced_filters",
    f"""SELECT p.record_id, p.publication_year, coalesce(c.citations, 0) AS citations
    FROM papers p LEFT JOIN {_CITED} c USING (record_id)
    WHERE contains(lower(title), 'networks') AND contains(lower(venue), 'of') AND publication_year BETWEEN 2005 AND 2033
      AND lower(work_type) IN ('journal-article', 'conference-paper') AND coalesce(c.citations, 0) >= 1
      AND list_contains(list_transform(fields_of_study, lambda x: contains(lower(x), 'i')), true)
      AND EXISTS (SELECT 1 FROM authors a WHERE a.record_id = p.record_id AND contains(lower(a.name), 'a'))
      AND open_access IS NOT DISTINCT FROM true""",
)
def search_advanced_filters(spark: SparkSession, folder: str) -> DataFrame:
    f = S.Filters(title="networks", venue="of", year_from=2005, year_to=2033, work_types=("Journal-Article", "conference-paper"), min_citations=1, field_of_study="i", author="a", open_access=True)
    return records(spark, folder).where(f.condition()).select("record_id", "publication_year", F.coalesce("citations", F.lit(0)).alias("citations"))


@query(
    "search_boolean_ast",
    """SELECT record_id FROM papers p WHERE
      contains(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 'based')
      AND NOT coalesce(list_contains(regexp_extract_all(lower(abstract), '[\\p{L}\\p{N}]+'), 'samples'), false)
      AND (coalesce(contains(lower(venue), 'letters in'), false)
           OR EXISTS (SELECT 1 FROM authors a WHERE a.record_id = p.record_id AND list_contains(regexp_extract_all(lower(a.name), '[\\p{L}\\p{N}]+'), 'j')))""",
)
def search_boolean_ast(spark: SparkSession, folder: str) -> DataFrame:
    tree = S.Node("and", children=[
        S.Node("phrase", "based", "title"), S.Node("not", children=[S.Node("term", "samples", "abstract")]),
        S.Node("or", children=[S.Node("phrase", "letters in", "venue"), S.Node("term", "J", "author")]),
    ])
    return records(spark, folder).where(tree.condition()).select("record_id")


_STEM = "CASE WHEN length(x) <= 4 OR NOT regexp_full_match(x, '\\p{L}+') THEN x " + " ".join(
    f"WHEN x LIKE '%{s}' AND length(x) - {len(s)} >= {m} THEN x[:length(x) - {len(s)}] || '{r}'" for s, r, m in X.STEM_RULES
) + " ELSE x END"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _tokens(c: str) -> str:
    raw = f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'))"
    strong = f"list_filter({raw}, lambda y: NOT list_contains({_STOP}, y))"
    return f"list_distinct(list_transform(CASE WHEN len({strong}) > 0 THEN {strong} ELSE {raw} END, lambda x: {_STEM}))"


@query("tokenize_stem", f"SELECT record_id, list_aggregate(list_sort({_tokens('title')}), 'string_agg', ' ') AS tokens FROM papers WHERE title IS NOT NULL")
def tokenize_stem(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "papers").where("title IS NOT NULL").select("record_id", F.array_join(F.sort_array(X.search_tokens("title")), " ").alias("tokens"))


_QUERY = "boundary of linear networks and their retrieval"


@query(
    "search_relevance_rank",
    f"""WITH q AS (SELECT unnest({_tokens("'" + _QUERY + "'")}) AS w),
    d AS (SELECT record_id, {_tokens('title')} AS t, {_tokens("concat_ws(' ', title, abstract, venue, list_aggregate(fields_of_study, 'string_agg', ' '))")} AS b,
          trim(regexp_replace(lower(concat_ws(' ', title, abstract, venue)), '\\s+', ' ', 'g')) AS p,
          coalesce(lower(work_type) IN ('retracted publication', 'retracted-article'), false) OR coalesce(regexp_matches(lower(title), '^[^\\p{{L}}\\p{{N}}_]*retracted\\b'), false) AS gone FROM papers),
    n AS (SELECT count(*) AS n FROM d),
    f AS (SELECT w, pow(ln((n + 1) / ((SELECT count(*) FROM d WHERE list_contains(b, w)) + 1)) + 1, 2) AS x FROM q, n),
    r AS (SELECT record_id, sum(1 / (60 + rank)) AS rrf, min(rank) AS best_rank, count(*) AS providers FROM
          (SELECT record_id, provider, min(provider_rank) AS rank FROM source_records WHERE provider_rank IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT d.record_id, round((4 * (SELECT coalesce(sum(x), 0) FROM f WHERE list_contains(t, w)) / (SELECT sum(x) FROM f)
             + 1.25 * (SELECT coalesce(sum(x), 0) FROM f WHERE list_contains(b, w)) / (SELECT sum(x) FROM f)
             + 0.75 * contains(p, '{_QUERY}')::INT + 10 * coalesce(rrf, 0) + 0.05 * least(coalesce(providers, 0), 3)) * CASE WHEN gone THEN 0.5 ELSE 1 END, 6) AS score,
             coalesce(best_rank, 10000) AS best_rank FROM d LEFT JOIN r USING (record_id))
    SELECT row_number() OVER (ORDER BY score DESC, best_rank, record_id DESC) AS rank, record_id, score FROM s ORDER BY 1 LIMIT 100""",
)
def search_relevance_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = load(spark, folder, "source_records").select("record_id", "provider", F.col("provider_rank").alias("rank"))
    top = S.relevance(load(spark, folder, "papers"), ranks, _QUERY).orderBy(F.desc("score"), "best_rank", F.desc("record_id")).limit(100)
    w = Window.orderBy(F.desc("score"), "best_rank", F.desc("record_id"))  # over the hundred rows of the result
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "record_id", "score")


def _sorted(spark: SparkSession, folder: str, *order) -> DataFrame:
    top = records(spark, folder).select("record_id", "publication_year", F.coalesce("citations", F.lit(0)).alias("citations")).orderBy(*order).limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


_SORT = "SELECT record_id, publication_year, coalesce(citations, 0) AS citations, row_number() OVER (ORDER BY {0}) AS rank FROM papers LEFT JOIN " + _CITED + " USING (record_id) ORDER BY rank LIMIT 100"


@query("search_sort_newest", _SORT.format("publication_year DESC NULLS LAST, record_id"))
def search_sort_newest(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted(spark, folder, F.desc_nulls_last("publication_year"), F.asc("record_id"))


@query("search_sort_oldest", _SORT.format("publication_year ASC NULLS LAST, record_id"))
def search_sort_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted(spark, folder, F.asc_nulls_last("publication_year"), F.asc("record_id"))


@query("search_sort_citations", _SORT.format("coalesce(citations, 0) DESC, record_id"))
def search_sort_citations(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted(spark, folder, F.desc("citations"), F.asc("record_id"))


_LISTS = "(SELECT DISTINCT provider, record_id, provider_rank AS rank FROM source_records WHERE provider_rank IS NOT NULL)"


def ranked_lists(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "source_records").where("provider_rank IS NOT NULL").select("provider", "record_id", F.col("provider_rank").alias("rank")).distinct()


@query("search_overfetch_topk", f"SELECT provider, record_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY rank, record_id) AS pos FROM {_LISTS}) WHERE pos <= 60")
def search_overfetch_topk(spark: SparkSession, folder: str) -> DataFrame:
    return S.overfetch(ranked_lists(spark, folder), 20).select("provider", "record_id", "rank")


@query(
    "related_rrf",
    f"""SELECT coalesce(p.work_family_id, l.record_id) AS work, round(sum(1.0 / (60 + rank)), 9) AS score FROM {_LISTS} l LEFT JOIN papers p USING (record_id)
    WHERE coalesce(p.work_family_id, l.record_id) NOT IN (SELECT coalesce(work_family_id, record_id) FROM papers WHERE lower(venue) = 'preprint deposit') GROUP BY 1""",
)
def related_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Fused ranks per work, without the works of negative examples (those with a mere deposit)."""
    papers = load(spark, folder, "papers").select("record_id", F.coalesce("work_family_id", "record_id").alias("work"), "venue")
    lists = ranked_lists(spark, folder).join(papers.drop("venue"), "record_id", "left").withColumn("work", F.coalesce("work", "record_id"))
    negative = papers.where("lower(venue) = 'preprint deposit'").select("work").distinct()
    return S.rrf(lists.join(negative, "work", "left_anti"), "work").withColumn("score", F.round("score", 9))


@query(
    "provider_contributions",
    """WITH r AS (SELECT provider, coalesce(work_family_id, record_id) AS work FROM source_records LEFT JOIN papers USING (record_id)),
    o AS (SELECT DISTINCT * FROM r), w AS (SELECT work, count(*) AS n FROM o GROUP BY 1)
    SELECT o.provider, (SELECT count(*) FROM r WHERE r.provider = o.provider) AS raw_records, count(*) AS works, count(*) FILTER (n = 1) AS unique_works,
      count(*) FILTER (n > 1) AS shared_works, round(count(*) / (SELECT count(*) FROM w), 9) AS share FROM o JOIN w USING (work) GROUP BY 1""",
)
def provider_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return S.contributions(_provided(spark, folder))


def _provided(spark: SparkSession, folder: str) -> DataFrame:
    work = load(spark, folder, "papers").select("record_id", "work_family_id")
    return load(spark, folder, "source_records").join(work, "record_id", "left").select("provider", F.coalesce("work_family_id", "record_id").alias("work"))


@query(
    "provider_overlaps",
    """WITH o AS (SELECT DISTINCT provider, coalesce(work_family_id, record_id) AS work FROM source_records LEFT JOIN papers USING (record_id)),
    n AS (SELECT provider, count(*) AS n FROM o GROUP BY 1),
    b AS (SELECT l.provider AS l, r.provider AS r, count(*) AS shared FROM o l JOIN o r ON l.work = r.work AND l.provider < r.provider GROUP BY 1, 2)
    SELECT a.provider AS left_provider, z.provider AS right_provider, coalesce(shared, 0) AS shared, a.n + z.n - coalesce(shared, 0) AS together,
      round(coalesce(shared, 0) / (a.n + z.n - coalesce(shared, 0)), 9) AS jaccard, round(coalesce(shared, 0) / least(a.n, z.n), 9) AS overlap
    FROM n a JOIN n z ON a.provider < z.provider LEFT JOIN b ON b.l = a.provider AND b.r = z.provider""",
)
def provider_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return S.overlaps(_provided(spark, folder))


_REPORT = "CASE verification_status WHEN 'verified' THEN 'complete' ELSE CASE WHEN provider < 'd' THEN 'throttled' WHEN provider < 'i' THEN 'skipped' ELSE 'failed' END END"


@query(
    "overall_status",
    f"""WITH r AS (SELECT subject_record_id, {_REPORT} AS status FROM citation_assertions), a AS (SELECT subject_record_id, count(*) FILTER (status <> 'skipped') AS active, count(*) FILTER (status = 'complete') AS good, count(*) FILTER (status = 'throttled') AS slow FROM r GROUP BY 1)
    SELECT subject_record_id, CASE WHEN active = 0 THEN 'degraded' WHEN good = active THEN 'complete' WHEN good > 0 THEN 'partial' WHEN slow > 0 THEN 'throttled' ELSE 'failed' END AS status FROM a""",
)
def overall_status(spark: SparkSession, folder: str) -> DataFrame:
    reports = load(spark, folder, "citation_assertions").select("subject_record_id", F.expr(_REPORT).alias("status"), F.lit(1).alias("results"))
    return S.overall_status(reports, "subject_record_id")


_USED = ("text", "title", "author", "year_from", "open_access")
#: Conditions that each source evaluates itself (``p``), leaves to us (``l``) or can't (``u``), in the order above.
_PUSHED = {
    "openalex": "ppppp", "semantic_scholar": "pllpp", "crossref": "plppu", "europe_pmc": "plppp", "arxiv": "plppu", "datacite": "ppppu", "dblp": "pllll", "acl_anthology": "pllll",
    "openaire": "ppppl", "openreview": "pllll", "inspire": "pllll", "opencitations": "ullll", "google_scholar_serpapi": "plppl", "ads": "pllll",
}
_STATE = {"p": "provider", "l": "local", "u": "unsupported"}


@query("filter_execution_plan", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', '{_STATE[c]}')" for s, x in _PUSHED.items() for f, c in zip(_USED, x, strict=True)) + ") t(source, condition, evaluated)")
def filter_execution_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Where each condition of a search runs, for every source."""
    f = S.Filters(title="networks", year_from=2010, open_access=True, author="a")
    return spark.createDataFrame(plan_search(f, SOURCES), "source string, condition string, evaluated string")


@query(
    "normalize_identifiers",
    """SELECT record_id, scheme, value, CASE scheme WHEN 'doi' THEN CASE WHEN regexp_full_match(d, '10\\.\\d{4,9}/\\S+') THEN d END
      WHEN 'openalex' THEN upper(regexp_extract(value, '(?i)^(?:https?://openalex\\.org/)?(W\\d+)$', 1)) WHEN 'arxiv' THEN nullif(lower(regexp_extract(trim(value), '(?i)^(?:arxiv:)?(\\d{4}\\.\\d{4,5}(?:v\\d+)?)$', 1)), '') END AS normal
    FROM (SELECT DISTINCT record_id, scheme, value, lower(regexp_replace(regexp_replace(regexp_replace(trim(value), '(?i)^https?://(?:dx\\.)?doi\\.org/', ''), '(?i)^doi:\\s*', ''), '[.,;)]+$', '')) AS d FROM identifier_claims)
    WHERE scheme IN ('doi', 'openalex', 'arxiv')""",
)
def normalize_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "identifier_claims").where("scheme IN ('doi', 'openalex', 'arxiv')").select("record_id", "scheme", "value").distinct()
    normal = F.when(F.col("scheme") == "doi", X.doi("value")).when(F.col("scheme") == "openalex", X.openalex("value")).otherwise(X.arxiv("value"))
    return rows.withColumn("normal", normal)


#: Queries compared with all vectors at a time.
QUERY_BLOCK = 1024


@query(
    "related_cosine",
    """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)
    SELECT query_id, vec_id, rank, similarity FROM (SELECT q.q AS query_id, v.vec_id, round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 5) AS similarity,
      row_number() OVER (PARTITION BY q.q ORDER BY round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 5) DESC, v.vec_id) AS rank FROM q JOIN embeddings v ON q.q <> v.vec_id) WHERE rank <= 10""",
)
def related_cosine(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """The ``k`` nearest vectors of each query vector (ids divisible by 100): blocks of queries against all rows, best ``k`` kept per part."""
    ship(spark)
    rows = load(spark, folder, "embeddings").select("vec_id", "embedding")
    out, block = None, []

    def flush():
        nonlocal out, block
        ids = np.array([r.vec_id for r in block])
        mat = np.array([r.embedding for r in block], dtype=np.float64)
        mat /= np.linalg.norm(mat, axis=1, keepdims=True)
        box = spark.sparkContext.broadcast((ids, mat))

        def near(parts):
            ids, mat = box.value
            for p in parts:
                if len(p):
                    m = np.stack(p.embedding.to_numpy()).astype(np.float64)
                    sim = np.round(mat @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 5)
                    for q in range(len(ids)):
                        order = np.lexsort((p.vec_id.to_numpy(), -sim[q]))[: k + 1]
                        yield pd.DataFrame({"query_id": ids[q], "vec_id": p.vec_id.to_numpy()[order], "similarity": sim[q][order]})

        part = rows.mapInPandas(near, "query_id long, vec_id long, similarity double")
        out = part if out is None else out.unionAll(part)
        block = []

    for r in rows.where("vec_id % 100 = 0").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            flush()
    if block or out is None:
        flush() if block else None
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, rank long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.where("query_id <> vec_id").withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
