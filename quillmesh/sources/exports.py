"""Records as rows of exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_rows(records: DataFrame) -> DataFrame:
    """Eight columns; lists joined with ``; ``, missing values empty. Write with ``write.csv(header=True)``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return records.select("record_id", text("title").alias("title"), F.array_join("authors", "; ").alias("authors"), text("publication_year").alias("publication_year"), text("venue").alias("venue"), text("doi").alias("doi"), text("landing_page_url").alias("url"), F.array_join("providers", "; ").alias("providers"))


def _line(tag: str, c: str) -> Column:
    return F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(tag), F.col(c).cast("string")))


def ris(records: DataFrame) -> DataFrame:
    """``record_id, entry`` in RIS."""
    names = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda n: F.concat(F.lit("AU  - "), n)), "\n"))
    lines = [F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), F.coalesce("title", F.lit(""))), names, _line("PY  - ", "publication_year"), _line("JO  - ", "venue"), _line("DO  - ", "doi"), _line("UR  - ", "landing_page_url"), F.concat(F.lit("ID  - "), "record_id"), F.lit("ER  - ")]
    return records.select("record_id", F.concat_ws("\n", *lines).alias("entry"))


def bibtex(records: DataFrame) -> DataFrame:
    """``record_id, entry`` in BibTeX; keys from the first author's last word, the year and a hash of the id."""
    last = F.lower(F.regexp_replace(F.when(F.size("authors") > 0, F.element_at(F.split(F.get("authors", F.lit(0)), " "), -1)).otherwise("anon"), "[^A-Za-z0-9]", ""))
    key = F.concat(F.when(last == "", "paper").otherwise(last), F.coalesce(F.col("publication_year").cast("string"), F.lit("nd")), F.substring(F.sha1("record_id"), 1, 6))
    names = F.when(F.size("authors") > 0, F.array_join("authors", " and "))
    field = lambda n, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {n} = {{"), c, F.lit("}")))
    text = lambda c: F.col(c).cast("string")
    fields = [F.concat(F.lit("  title = {"), F.coalesce("title", F.lit("")), F.lit("}")), field("author", names), field("year", text("publication_year")), field("journal", text("venue")), field("doi", text("doi")), field("url", text("landing_page_url"))]
    return records.select("record_id", F.concat(F.lit("@article{"), key, F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}")).alias("entry"))


def jsonl(records: DataFrame) -> DataFrame:
    """``entry``: one JSON object per record, nulls kept. Write with ``write.text``."""
    return records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("entry"))
