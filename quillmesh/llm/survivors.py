"""The best representative of each group of duplicate records, built field by field.

Fields are unpivoted to rows (group, field, value, record). Each row votes for
its value with the odds of its source's trust, times the confidence it was
claimed with, times a decay with its age. Votes are summed per normalised
value, the heaviest value wins, and winners are pivoted back to one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Days after which a vote counts half.
HALF_LIFE_DAYS = 120.0
#: Trust of a source nobody rated.
UNRATED = 0.3
#: Power of the odds of a claim's confidence: it speaks of this one value, trust of all values of a source.
CONFIDENCE_POWER = 4.0
#: Fields of papers that are judged, besides doi.
FIELDS = ("title", "publication_year", "venue", "abstract", "publication_date", "work_type", "language", "open_access", "landing_page_url", "pdf_url")


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return p / (1 - p)


def _normal(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def votes(papers: DataFrame, sources: DataFrame, claims: DataFrame, providers: DataFrame, fields: tuple[str, ...] = FIELDS, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """``work_family_id, field_name, field_value, record_id, weight``: one row per record, field and distinct non-null value.

    Rows of papers without family are no duplicates and give nothing. A record
    retrieved several times counts once, as of its latest retrieval; repeated
    claims of one value count once with the highest confidence. A record
    without retrieval counts as old as the oldest, one without rated source
    with trust ``UNRATED``, a claim without confidence with 0.5.
    """
    trust = providers.groupBy("provider").agg(F.max("trust").alias("trust"))
    rows = papers.where("work_family_id IS NOT NULL AND record_id IS NOT NULL")
    got = sources.groupBy("record_id").agg(F.max("retrieved_at").alias("at"), F.max_by("provider", "retrieved_at").alias("provider"))
    got = got.join(trust, "provider", "left")
    record = rows.select("work_family_id", "record_id", *fields).join(got.select("record_id", "at", "trust"), "record_id", "left")
    unpivot = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value")) for f in fields]))
    long = record.select("work_family_id", "record_id", "at", "trust", unpivot.alias("u")).select("work_family_id", "record_id", "u.*", "at", "trust", F.lit(None).cast("double").alias("confidence"))
    doi = claims.where("scheme = 'doi' AND value IS NOT NULL").groupBy("record_id", F.col("value").alias("field_value"))
    doi = doi.agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.max("retrieved_at").alias("at"), F.max_by("provider", "retrieved_at").alias("provider"))
    doi = doi.join(trust, "provider", "left").join(rows.select("work_family_id", "record_id").distinct(), "record_id")
    long = long.unionByName(doi.select("work_family_id", "record_id", F.lit("doi").alias("field_name"), "field_value", "at", "trust", "confidence"))
    long = long.where("field_value IS NOT NULL").groupBy("work_family_id", "field_name", "field_value", "record_id").agg(F.max("at").alias("at"), F.max("trust").alias("trust"), F.max("confidence").alias("confidence"))
    span = sources.agg(F.min("retrieved_at"), F.max("retrieved_at")).first()
    days = F.lit(0.0)
    if span[1] is not None:
        days = (F.lit(span[1]).cast("timestamp").cast("double") - F.coalesce(F.col("at"), F.lit(span[0])).cast("timestamp").cast("double")) / 86400.0
    weight = _odds(F.coalesce("trust", F.lit(UNRATED))) * F.when(F.col("confidence").isNull(), 1.0).otherwise(F.pow(_odds(F.col("confidence")), F.lit(CONFIDENCE_POWER))) * F.pow(F.lit(0.5), days / half_life_days)
    return long.select("work_family_id", "field_name", "field_value", "record_id", weight.alias("weight"))


#: How a shortened text ends.
_CUT_END = r"\s*(\.\.\.|…)$"
#: Votes for a text that is visibly the beginning of another one, or ends in an ellipsis, count this much.
CUT_FACTOR = 1e-3


def winners(long: DataFrame) -> DataFrame:
    """``work_family_id, field_name, field_value, support, n_values``: the value each field should have, as one of its rows has it.

    ``n_values`` counts the different values. A text cut short (it ends in an
    ellipsis, or another text of the field continues it, other than by a
    remark in brackets) is less complete and counts ``CUT_FACTOR``. Of the
    spellings of the winning normalised value the heaviest is given; ties go
    to the larger value in byte order.
    """
    value = long.groupBy("work_family_id", "field_name", "field_value").agg(F.sum("weight").alias("weight"))
    stem = F.regexp_replace(F.lower("field_value"), _CUT_END, "")
    value = value.withColumn("stem", stem)
    # a text's continuations follow it directly in byte order
    w = Window.partitionBy("work_family_id", "field_name", F.substring("stem", 1, 8)).orderBy("stem", "field_value")
    after = F.lead("stem").over(w)
    rest = F.expr("substring(after, length(stem) + 1)")
    value = value.withColumn("after", after)
    # letters, not numbers: "12" is no shortened "123"
    short = F.col("stem").rlike(r"^\D*$") & (F.length("stem") >= 8) & F.col("after").startswith(F.col("stem")) & (rest != "") & ~rest.rlike(r"^\s*[\(\[]")
    short = F.coalesce(short, F.lit(False)) | F.col("field_value").rlike(_CUT_END)
    kept = F.when(F.col("field_name").isin("title", "venue", "abstract") & short, F.col("weight") * CUT_FACTOR).otherwise(F.col("weight"))
    value = value.select("work_family_id", "field_name", "field_value", kept.alias("weight"))
    normal = value.groupBy("work_family_id", "field_name", _normal(F.col("field_value")).alias("n")).agg(
        F.sum("weight").alias("support"), F.count("*").alias("spellings"), F.max(F.struct("weight", "field_value")).alias("best")
    )
    top = normal.groupBy("work_family_id", "field_name").agg(F.max_by(F.struct("best", "support"), F.struct("support", "best")).alias("w"), F.sum("spellings").alias("n_values"))
    return top.select("work_family_id", "field_name", F.col("w.best.field_value").alias("field_value"), F.col("w.support").alias("support"), "n_values")


def survivors(papers: DataFrame, sources: DataFrame, claims: DataFrame, providers: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per family: ``work_family_id`` and every field's winning value as string."""
    best = winners(votes(papers, sources, claims, providers, fields))
    return best.groupBy("work_family_id").pivot("field_name", [*fields, "doi"]).agg(F.first("field_value"))


def contested(papers: DataFrame, sources: DataFrame, claims: DataFrame, providers: DataFrame, fields: tuple[str, ...] = ("title", "publication_year", "venue")) -> DataFrame:
    """The winners of the fields (and doi) for which a family's records hold several values."""
    long = cut(votes(papers, sources, claims, providers, fields), "votes")
    return winners(long).where("n_values > 1").select("work_family_id", "field_name", "field_value")
