"""Measures over the tables: identity clusters against families, raters against each other, ranks against citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as V
from quillmesh.operators import identity as I
from quillmesh.plans.identities import _ROOTS
from quillmesh.plans.registry import query
from quillmesh.session import cut, load

_C = f"WITH RECURSIVE {_ROOTS}, cl AS (SELECT r.record_id, r.root AS p, p.work_family_id AS g FROM roots r JOIN papers p USING (record_id) WHERE p.work_family_id IS NOT NULL), cell AS (SELECT p, g, count(*) AS n FROM cl GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM cell)"


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    papers = load(spark, folder, "papers").where("work_family_id IS NOT NULL")
    groups = I.clusters(load(spark, folder, "papers"), load(spark, folder, "identifier_claims"))
    return cut(papers.select("record_id", "work_family_id").join(groups, "record_id").select(F.col("record_id").alias("id"), F.col("root").alias("p"), F.col("work_family_id").alias("g")), "clusters")


@query("eval_bcubed", _C + ", a AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / ng) / sum(n) AS r FROM x) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM a")
def eval_bcubed(spark: SparkSession, folder: str) -> DataFrame:
    return V.bcubed(_clusters(spark, folder))


@query(
    "eval_pairwise",
    _C
    + """, t AS (SELECT (SELECT sum(n * (n - 1) / 2)::BIGINT FROM cell) AS tp, (SELECT sum(n * (n - 1) / 2)::BIGINT FROM (SELECT count(*) AS n FROM cl GROUP BY p)) AS pp, (SELECT sum(n * (n - 1) / 2)::BIGINT FROM (SELECT count(*) AS n FROM cl GROUP BY g)) AS gp)
    SELECT tp AS true_positive, pp - tp AS false_merge, gp - tp AS false_split, round(tp / pp, 9) AS precision, round(tp / gp, 9) AS recall, round(2 * tp / (pp + gp), 9) AS f1 FROM t""",
)
def eval_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    return V.pairwise(_clusters(spark, folder))


@query("eval_exact", _C + " SELECT count(*) FILTER (n = np AND n = ng) AS exact, count(DISTINCT p) AS predicted, count(DISTINCT g) AS gold FROM x")
def eval_exact(spark: SparkSession, folder: str) -> DataFrame:
    return V.exact_clusters(_clusters(spark, folder))


@query("eval_ceaf_e")
def eval_ceaf_e(spark: SparkSession, folder: str) -> DataFrame:
    return V.ceaf_e(_clusters(spark, folder))


_R = """r AS (SELECT provider AS topic, record_id AS id, min(provider_rank) AS rank FROM source_records WHERE provider_rank IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT DISTINCT s.provider AS topic, s.record_id AS id FROM source_records s JOIN papers p USING (record_id) WHERE p.open_access)"""


def _topics(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, folder, "source_records")
    ranked = rows.where("provider_rank IS NOT NULL").groupBy(F.col("provider").alias("topic"), F.col("record_id").alias("id")).agg(F.min("provider_rank").alias("rank"))
    open_ = load(spark, folder, "papers").where("open_access").select("record_id")
    return ranked, rows.join(open_, "record_id").select(F.col("provider").alias("topic"), F.col("record_id").alias("id")).distinct()


@query(
    "eval_retrieval",
    f"""WITH {_R}, t AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank, id) AS pos FROM r QUALIFY pos <= 50), h AS (SELECT t.*, (g.id IS NOT NULL)::INT AS hit FROM t LEFT JOIN g ON g.topic = t.topic AND g.id = t.id),
    c AS (SELECT *, sum(hit) OVER (PARTITION BY topic ORDER BY pos) AS hits FROM h), n AS (SELECT topic, count(*) AS total FROM g GROUP BY 1),
    m AS (SELECT topic, count(*) AS n, sum(hit) AS found, min(pos) FILTER (hit = 1) AS first, sum(hits / pos) FILTER (hit = 1) AS ap, sum(hit / log2(pos + 1)) AS dcg FROM c GROUP BY 1)
    SELECT topic, round(found / m.n, 9) AS precision, round(found / total, 9) AS recall, round(m.n / nullif(found, 0), 9) AS needed_to_read, round(coalesce(1 / first, 0), 9) AS reciprocal_rank, round(coalesce(ap, 0) / total, 9) AS average_precision,
      round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(total, m.n) + 1) q(i)), 9) AS ndcg FROM n JOIN m USING (topic)""",
)
def eval_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's order of its records, judged by open access."""
    return V.retrieval(*_topics(spark, folder), 50)


@query(
    "eval_wss",
    f"""WITH {_R}, p AS (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY rank, id) AS pos FROM r), h AS (SELECT p.*, row_number() OVER (PARTITION BY p.topic ORDER BY pos) AS nth FROM p JOIN g ON g.topic = p.topic AND g.id = p.id),
    n AS (SELECT topic, ceil(0.5 * count(*)) AS need FROM g GROUP BY 1), s AS (SELECT topic, count(*) AS candidates FROM p GROUP BY 1)
    SELECT s.topic, s.candidates, h.pos AS screened, round(0.5 - h.pos / s.candidates, 9) AS saved FROM s LEFT JOIN (SELECT h.topic, h.pos FROM h JOIN n ON h.topic = n.topic AND h.nth = n.need) h ON h.topic = s.topic""",
)
def eval_wss(spark: SparkSession, folder: str) -> DataFrame:
    ranked, relevant = _topics(spark, folder)
    placed = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("rank", "id")).cast("bigint"))
    return V.work_saved(placed, relevant, 0.5)


_V = "SELECT DISTINCT subject_record_id, object_record_id FROM citation_assertions WHERE "


@query(
    "eval_edges",
    f"""WITH p AS ({_V} provider = 'openalex'), g AS ({_V} verification_status = 'verified'), n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp)
    SELECT tp AS true_positive, round(coalesce(tp / nullif(np, 0), 0), 9) AS precision, round(coalesce(tp / nullif(ng, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0), 9) AS f1 FROM n""",
)
def eval_edges(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "citation_assertions")
    return V.edges_f1(c.where("provider = 'openalex'"), c.where("verification_status = 'verified'"), ("subject_record_id", "object_record_id"))


@query(
    "eval_confusion",
    """WITH r AS (SELECT doc_id, max(reading_level) FILTER (rater = 'rater_a') AS a, max(reading_level) FILTER (rater = 'rater_b') AS b FROM reading_labels GROUP BY 1)
    SELECT a AS gold, count(*) FILTER (b = 1) AS to_1, count(*) FILTER (b = 2) AS to_2, count(*) FILTER (b = 3) AS to_3, count(*) FILTER (b = 4) AS to_4 FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
)
def eval_confusion(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "reading_labels").groupBy("doc_id").agg(F.max(F.when(F.col("rater") == "rater_a", F.col("reading_level"))).alias("a"), F.max(F.when(F.col("rater") == "rater_b", F.col("reading_level"))).alias("b"))
    return V.confusion(r.where("a IS NOT NULL AND b IS NOT NULL"), "a", "b", (1, 2, 3, 4))


@query("eval_bootstrap")
def eval_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Macro mean of recall over the sources (a dozen) with its interval."""
    recall = [r.recall for r in V.retrieval(*_topics(spark, folder), 50).orderBy("topic").collect()]
    return spark.createDataFrame([V.bootstrap_interval(recall, 200, 7)], "mean double, low double, high double")
