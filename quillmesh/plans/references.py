"""Queries over bibliographies, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import linking as L
from quillmesh.plans.registry import query
from quillmesh.sources import bibliographies as B
from quillmesh.sources import exports as E
from quillmesh.session import load

_SIM = "CASE WHEN coalesce({0}, '') = '' OR coalesce({1}, '') = '' THEN 0.0 WHEN {0} = {1} THEN 1.0 ELSE 0.7 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)) + 0.3 * len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / len(list_distinct(list_concat(string_split({0}, ' '), string_split({1}, ' ')))) END"
_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SUR = "list_distinct(list_filter(list_transform({0}, lambda n: CASE WHEN contains(n, ',') THEN replace(trim(regexp_replace(lower(string_split(n, ',')[1]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '') ELSE string_split(trim(regexp_replace(lower(n), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')[-1] END), lambda s: s <> ''))"
_SCORES = f"""a AS (SELECT record_id, list(name ORDER BY author_position, name) AS authors FROM authors GROUP BY 1),
  r AS (SELECT reference_key AS entry, {_PLAIN.format('title')} AS t, {_SUR.format('authors')} AS s, publication_year AS y, {_PLAIN.format('venue')} AS v, lower(doi) AS doi FROM extracted_references),
  p AS (SELECT record_id AS candidate, {_PLAIN.format('title')} AS ct, {_SUR.format("coalesce(a.authors, [])")} AS cs, publication_year AS cy, {_PLAIN.format('venue')} AS cv FROM papers LEFT JOIN a USING (record_id)),
  d AS (SELECT DISTINCT r.entry, i.record_id AS candidate FROM r JOIN identifier_claims i ON i.scheme = 'doi' AND lower(i.value) = r.doi WHERE i.record_id IN (SELECT record_id FROM papers)),
  c AS (SELECT entry, candidate FROM d UNION SELECT r.entry, p.candidate FROM r JOIN p ON r.t = p.ct AND r.t <> ''),
  s AS (SELECT c.entry, c.candidate, (d.entry IS NOT NULL) AS by_id, round(coalesce(((CASE WHEN t <> '' THEN 0.65 * {_SIM.format('t', 'ct')} ELSE 0 END) + (CASE WHEN len(s) > 0 THEN 0.15 * len(list_intersect(s, cs)) / len(s) ELSE 0 END)
    + (CASE WHEN y IS NOT NULL THEN 0.1 * coalesce(CASE abs(y - cy) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0 END, 0) ELSE 0 END) + (CASE WHEN v <> '' THEN 0.1 * {_SIM.format('v', 'cv')} ELSE 0 END))
    / nullif((CASE WHEN t <> '' THEN 0.65 ELSE 0 END) + (CASE WHEN len(s) > 0 THEN 0.15 ELSE 0 END) + (CASE WHEN y IS NOT NULL THEN 0.1 ELSE 0 END) + (CASE WHEN v <> '' THEN 0.1 ELSE 0 END), 0), 0), 6) AS score
    FROM c JOIN r USING (entry) JOIN p USING (candidate) LEFT JOIN d USING (entry, candidate))"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    names = load(spark, folder, "authors").groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_position", "name"))), lambda x: x["name"]).alias("c_authors"))
    papers = load(spark, folder, "papers").join(names, "record_id", "left").select(F.col("record_id").alias("candidate"), F.col("title").alias("c_title"), "c_authors", F.col("publication_year").alias("c_year"), F.col("venue").alias("c_venue"))
    refs = load(spark, folder, "extracted_references").select(F.col("reference_key").alias("entry"), "title", "authors", F.col("publication_year").alias("year"), "venue", F.lower("doi").alias("doi"))
    claims = load(spark, folder, "identifier_claims").where("scheme = 'doi'").select(F.col("record_id").alias("candidate"), F.lower("value").alias("doi")).distinct()
    by_id = refs.select("entry", "doi").join(claims, "doi").join(papers.select("candidate"), "candidate", "left_semi").select("entry", "candidate").distinct()
    by_title = refs.select("entry", L.plain(F.col("title")).alias("k")).where("k <> ''").join(papers.select("candidate", L.plain(F.col("c_title")).alias("k")), "k").select("entry", "candidate")
    pairs = by_id.withColumn("i", F.lit(1)).unionAll(by_title.withColumn("i", F.lit(0))).groupBy("entry", "candidate").agg((F.max("i") == 1).alias("by_id"))
    return L.scored(pairs.join(refs, "entry").join(papers, "candidate")).select("entry", "candidate", "by_id", "score")


@query("reference_score", f"WITH {_SCORES} SELECT entry, candidate, by_id, score FROM s")
def reference_score(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


@query(
    "reference_decide",
    f"""WITH {_SCORES}, w AS (SELECT *, row_number() OVER o AS n, lead(score) OVER o AS second, sum(by_id::INT) OVER (PARTITION BY entry) AS ids FROM s WINDOW o AS (PARTITION BY entry ORDER BY by_id DESC, score DESC, candidate)),
    x AS (SELECT *, CASE WHEN ids = 1 THEN 'unique_strong_identifier' WHEN ids > 1 THEN 'conflicting_strong_identifier_candidates' WHEN score < 0.92 THEN 'top_score_below_auto_match_threshold' WHEN round(score - second, 6) < 0.08 THEN 'top_candidates_within_minimum_margin' ELSE 'score_and_margin_satisfied' END AS reason FROM w WHERE n = 1)
    SELECT entry, candidate, score, CASE WHEN reason IN ('unique_strong_identifier', 'score_and_margin_satisfied') THEN 'resolved' WHEN reason = 'top_score_below_auto_match_threshold' THEN 'unresolved' ELSE 'ambiguous' END AS status, reason FROM x""",
)
def reference_decide(spark: SparkSession, folder: str) -> DataFrame:
    return L.decided(_scores(spark, folder))


@query("reference_extract_bibtex")
def reference_extract_bibtex(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip: the papers as BibTeX entries, parsed again."""
    entries = E.bibtex(export_records(spark, folder)).select(F.col("record_id").alias("doc"), F.lit("bibtex").alias("format"), F.col("entry").alias("content"))
    return B.extracted(entries, include_uncited=True).select("doc", "reference_id", "title", "year", "doi", "venue")


def export_records(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with ordered authors, their best doi and their providers."""
    names = load(spark, folder, "authors").groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_position", "name"))), lambda x: x["name"]).alias("authors"))
    doi = load(spark, folder, "identifier_claims").where("scheme = 'doi'").withColumn("doi", X.doi("value")).where("doi IS NOT NULL").groupBy("record_id").agg(F.min("doi").alias("doi"))
    sources = load(spark, folder, "source_records").groupBy("record_id").agg(F.sort_array(F.collect_set("provider")).alias("providers"))
    none = F.array().cast("array<string>")
    rows = load(spark, folder, "papers").join(names, "record_id", "left").join(doi, "record_id", "left").join(sources, "record_id", "left")
    return rows.withColumn("authors", F.coalesce("authors", none)).withColumn("providers", F.coalesce("providers", none))


_X = """x AS (SELECT p.*, coalesce(a.names, []) AS names, d.doi, coalesce(s.ps, []) AS ps FROM papers p LEFT JOIN (SELECT record_id, list(name ORDER BY author_position, name) AS names FROM authors GROUP BY 1) a USING (record_id)
  LEFT JOIN (SELECT record_id, min(lower(regexp_replace(trim(value), '[.,;)]+$', ''))) AS doi FROM identifier_claims WHERE scheme = 'doi' AND regexp_full_match(lower(regexp_replace(trim(value), '[.,;)]+$', '')), '10\\.\\d{4,9}/\\S+') GROUP BY 1) d USING (record_id)
  LEFT JOIN (SELECT record_id, list_sort(list(DISTINCT provider)) AS ps FROM source_records GROUP BY 1) s USING (record_id))"""


@query(
    "export_csv_rows",
    f"WITH {_X} SELECT record_id, coalesce(title, '') AS title, coalesce(array_to_string(names, '; '), '') AS authors, coalesce(publication_year::VARCHAR, '') AS publication_year, coalesce(venue, '') AS venue, coalesce(doi, '') AS doi, coalesce(landing_page_url, '') AS url, coalesce(array_to_string(ps, '; '), '') AS providers FROM x",
)
def export_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    return E.csv_rows(export_records(spark, folder))


@query(
    "export_ris",
    f"""WITH {_X} SELECT record_id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || coalesce(title, ''), CASE WHEN len(names) > 0 THEN array_to_string(list_transform(names, lambda n: 'AU  - ' || n), chr(10)) END, 'PY  - ' || publication_year::VARCHAR,
      'JO  - ' || nullif(venue, ''), 'DO  - ' || doi, 'UR  - ' || nullif(landing_page_url, ''), 'ID  - ' || record_id, 'ER  - ') AS entry FROM x""",
)
def export_ris(spark: SparkSession, folder: str) -> DataFrame:
    return E.ris(export_records(spark, folder))


@query(
    "export_bibtex",
    f"""WITH {_X}, k AS (SELECT *, lower(regexp_replace(CASE WHEN len(names) > 0 THEN string_split(names[1], ' ')[-1] ELSE 'anon' END, '[^A-Za-z0-9]', '', 'g')) AS stem FROM x)
    SELECT record_id, '@article{{' || CASE stem WHEN '' THEN 'paper' ELSE stem END || coalesce(publication_year::VARCHAR, 'nd') || sha1(record_id)[:6] || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || coalesce(title, '') || '}}',
      '  author = {{' || nullif(array_to_string(names, ' and '), '') || '}}', '  year = {{' || publication_year::VARCHAR || '}}', '  journal = {{' || nullif(venue, '') || '}}', '  doi = {{' || doi || '}}', '  url = {{' || nullif(landing_page_url, '') || '}}') || chr(10) || '}}' AS entry FROM k""",
)
def export_bibtex(spark: SparkSession, folder: str) -> DataFrame:
    return E.bibtex(export_records(spark, folder))


@query("export_jsonl")
def export_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    return E.jsonl(export_records(spark, folder))
