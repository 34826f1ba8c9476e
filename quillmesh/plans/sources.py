"""Loading of source payloads: the tables rendered as each source would deliver them, and mapped back.

The SQL reads the tables directly, so a field that a mapper loses or bends shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans.registry import query
from quillmesh.session import load
from quillmesh.sources import mappers as M


def base(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with names and ORCIDs of their authors in order, the least value of some schemes, and their citing records counted."""
    who = load(spark, folder, "authors").where("name IS NOT NULL AND trim(name) <> ''").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("author_position", "name", "orcid"))).alias("who"))
    least = lambda s: F.min(F.when(F.col("scheme") == s, F.col("value"))).alias(s)
    ids = load(spark, folder, "identifier_claims").groupBy("record_id").agg(*[least(s) for s in ("doi", "pmid", "arxiv")])
    cited = load(spark, folder, "citation_assertions").groupBy(F.col("object_record_id").alias("record_id")).agg(F.countDistinct("subject_record_id").alias("cited"))
    rows = load(spark, folder, "papers").join(who, "record_id", "left").join(ids, "record_id", "left").join(cited, "record_id", "left")
    rows = rows.withColumn("who", F.coalesce("who", F.array().cast("array<struct<author_position:int,name:string,orcid:string>>"))).withColumn("cited", F.coalesce("cited", F.lit(0)))
    return rows.withColumn("sid", F.regexp_replace("record_id", "^[^:]*:", "")).withColumn("names", F.transform("who", lambda a: a["name"]))


_DOI = "lower(regexp_replace(regexp_replace(regexp_replace(trim(c.doi), '(?i)^https?://(?:dx\\.)?doi\\.org/', ''), '(?i)^doi:\\s*', ''), '[.,;)]+$', ''))"
_B = f"""n AS (SELECT record_id, list(name ORDER BY author_position, name, orcid NULLS FIRST) AS names FROM authors WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY 1),
  c AS (SELECT record_id, min(value) FILTER (scheme = 'doi') AS doi, min(value) FILTER (scheme = 'pmid') AS pmid, min(value) FILTER (scheme = 'arxiv') AS arxiv FROM identifier_claims GROUP BY 1),
  k AS (SELECT object_record_id AS record_id, count(DISTINCT subject_record_id) AS cited FROM citation_assertions GROUP BY 1),
  b AS (SELECT p.*, coalesce(n.names, []) AS names, CASE WHEN regexp_full_match({_DOI}, '10\\.\\d{{4,9}}/\\S+') THEN {_DOI} END AS doi, nullif(trim(c.pmid), '') AS pmid,
      CASE WHEN regexp_full_match(lower(trim(c.arxiv)), '(?:arxiv:)?\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?') THEN regexp_replace(regexp_replace(lower(trim(c.arxiv)), '^arxiv:', ''), 'v\\d+$', '') END AS axv, '2101.' || right('00000' || regexp_replace(regexp_replace(p.record_id, '^[^:]*:', ''), '\\D', '', 'g'), 5) AS num, coalesce(k.cited, 0) AS cited,
      regexp_replace(p.record_id, '^[^:]*:', '') AS sid FROM papers p LEFT JOIN n USING (record_id) LEFT JOIN c USING (record_id) LEFT JOIN k USING (record_id))"""
_JOIN = "array_to_string({0}, '|')"
_TIGHT = r"trim(regexp_replace({0}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"
#: Columns of every query here, and what they are where a source has no such field.
COLUMNS = {
    "record_id": "NULL", "family": "NULL", "title": "NULL", "abstract": "NULL", "authors": "''", "publication_date": "NULL", "publication_year": "NULL", "work_type": "NULL", "venue": "NULL", "fields": "''",
    "language": "NULL", "open_access": "NULL", "landing_page_url": "NULL", "pdf_url": "NULL", "identifiers": "''", "citation_count": "NULL",
}
_KINDS = {"publication_date": "DATE", "publication_year": "INT", "open_access": "BOOLEAN", "citation_count": "BIGINT"}


def flat(records: DataFrame) -> DataFrame:
    """Lists as text, so that rows compare."""
    return records.select(
        "record_id", F.col("work_family_id").alias("family"), "title", "abstract", F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"), "publication_date", "publication_year",
        "work_type", "venue", F.array_join("fields_of_study", "|").alias("fields"), "language", "open_access", "landing_page_url", "pdf_url",
        F.array_join(F.transform("identifiers", lambda c: F.concat_ws("=", c["scheme"], c["value"])), "|").alias("identifiers"), "citation_count",
    )


def _sql(where: str = "true", **columns: str) -> str:
    picked = COLUMNS | columns
    cols = ", ".join(f"CAST({e} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c, e in picked.items())
    return f"WITH {_B} SELECT {cols} FROM b WHERE {where}"


def _ids(*pairs: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"'{s}=' || {e}" for s, e in pairs) + ")"


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _people(f) -> Column:
    return F.transform("who", f)


def _payloads(spark: SparkSession, folder: str, payload: Column, key: Column | None = None) -> DataFrame:
    return base(spark, folder).select((F.col("sid") if key is None else key).alias("key"), payload.alias("payload"))


def _o(*pairs: tuple[str, Column]) -> Column:
    return F.struct(*[x.alias(n) for n, x in pairs])


_c = F.col


def _date() -> Column:
    return F.date_format("publication_date", "yyyy-MM-dd")


def _inverted() -> Column:
    every = F.split(F.regexp_replace(F.trim("abstract"), r"\s+", " "), " ")
    words = F.array_distinct(every)
    at = F.transform(words, lambda w: F.filter(F.transform(every, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))
    return F.when(F.col("abstract").isNotNull(), F.map_from_arrays(words, at))


@query("source_openalex", _sql(
    record_id="'openalex:' || upper(sid)", title="title", abstract="trim(regexp_replace(abstract, '\\s+', ' ', 'g'))", authors=_JOIN.format("names"), publication_date="publication_date", publication_year="publication_year",
    work_type="work_type", venue="venue", fields=_JOIN.format("list_filter(fields_of_study, lambda x: x <> '')"), language="language", open_access="open_access", landing_page_url="coalesce(landing_page_url, 'https://openalex.org/' || sid)", pdf_url="pdf_url",
    identifiers=_ids(("openalex", "upper(sid)"), ("doi", "doi"), ("pmid", "pmid")), citation_count="cited", where="NOT contains(sid, '/')"))
def source_openalex(spark: SparkSession, folder: str) -> DataFrame:
    """Works with inverted abstracts and nested authorships; numbers with a slash belong to other sources."""
    payload = _json(
        F.concat(F.lit("https://openalex.org/"), "sid").alias("id"), _c("title").alias("display_name"), _inverted().alias("abstract_inverted_index"),
        _people(lambda a: _o(("author", _o(("id", F.lit(None).cast("string")), ("display_name", a["name"]), ("orcid", a["orcid"]))))).alias("authorships"), _date().alias("publication_date"), "publication_year",
        _c("work_type").alias("type"), F.transform("fields_of_study", lambda f: _o(("display_name", f))).alias("topics"), "language", _o(("is_oa", _c("open_access"))).alias("open_access"),
        _o(("landing_page_url", _c("landing_page_url")), ("pdf_url", _c("pdf_url")), ("source", _o(("display_name", _c("venue"))))).alias("primary_location"),
        _o(("doi", F.concat(F.lit("https://doi.org/"), "doi")), ("pmid", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.trim("pmid")))).alias("ids"), _c("cited").alias("cited_by_count"),
    )
    rows = base(spark, folder).where("NOT contains(sid, '/')").select(payload.alias("payload"))
    return flat(M.openalex(rows))


@query("source_semantic_scholar", _sql(
    record_id="'semantic_scholar:' || sid", title="title", abstract="abstract", authors=_JOIN.format("names"), publication_date="publication_date", publication_year="publication_year", work_type="work_type", venue="venue",
    fields=_JOIN.format("fields_of_study"), open_access="open_access", landing_page_url="'https://www.semanticscholar.org/paper/' || sid", pdf_url="pdf_url",
    identifiers=_ids(("semantic_scholar", "sid"), ("doi", "doi"), ("arxiv", "axv"), ("pmid", "pmid")), citation_count="cited"))
def source_semantic_scholar(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the venues come as objects, half as plain strings."""
    venue = F.when(F.length("sid") % 2 == 0, F.to_json(_o(("name", _c("venue"))))).otherwise(F.to_json(F.array("venue"), {"ignoreNullFields": "false"}))
    shape = F.regexp_replace(F.regexp_replace(venue, r"^\[", ""), r"\]$", "")
    body = _json(
        _c("sid").alias("paperId"), "title", "abstract", _people(lambda a: _o(("name", a["name"]), ("authorId", F.lit(None).cast("string")))).alias("authors"), _date().alias("publicationDate"), _c("publication_year").alias("year"),
        F.when(_c("work_type").isNotNull(), F.array("work_type")).alias("publicationTypes"), _c("fields_of_study").alias("fieldsOfStudy"), _c("open_access").alias("isOpenAccess"), _o(("url", _c("pdf_url"))).alias("openAccessPdf"),
        _o(("DOI", _c("doi")), ("ArXiv", _c("arxiv")), ("PubMed", F.trim("pmid"))).alias("externalIds"), _c("cited").alias("citationCount"),
    )
    return flat(M.semantic_scholar(_payloads(spark, folder, F.concat(F.lit('{"publicationVenue":'), shape, F.lit(","), F.substring(body, 2, 10_000_000)))))


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "0123456789" * 2


def _composed(x: str) -> str:
    """Compatibility composition in SQL, for the characters that stand in the tables."""
    return f"""nfc_normalize(translate(replace({x}, '…', '...'), '{_WIDE}', '{_NARROW.replace("'", "''")}'))"""


@query("source_crossref", _sql(
    where="doi IS NOT NULL", record_id="'crossref:' || doi", title=_TIGHT.format(_composed("title")), abstract="nullif(" + _TIGHT.format(_composed("abstract")) + ", '')", authors=_JOIN.format("list_transform(names, lambda x: " + _TIGHT.format(_composed("x")) + ")"),
    publication_date="publication_date", publication_year="year(publication_date)", work_type="work_type", venue="nullif(" + _TIGHT.format(_composed("venue")) + ", '')", fields=_JOIN.format("fields_of_study"), language="language",
    landing_page_url="'https://doi.org/' || doi", pdf_url="pdf_url", identifiers="'doi=' || doi", citation_count="cited"))
def source_crossref(spark: SparkSession, folder: str) -> DataFrame:
    """Deposits with marked-up abstracts, escaped titles and dates in parts."""
    escape = lambda c: F.replace(F.replace(F.replace(_c(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.when(_c("publication_date").isNotNull(), F.array(F.array(F.year("publication_date"), F.month("publication_date"), F.dayofmonth("publication_date"))))
    payload = _json(
        _c("doi").alias("DOI"), F.array(escape("title")).alias("title"), F.concat(F.lit("<jats:p>"), escape("abstract"), F.lit("</jats:p>")).alias("abstract"), _people(lambda a: _o(("family", a["name"]), ("ORCID", a["orcid"]))).alias("author"),
        _o(("date-parts", F.array(F.array(F.lit(None).cast("int"))))).alias("published-print"), _o(("date-parts", parts)).alias("issued"), _c("work_type").alias("type"), F.when(_c("venue").isNotNull(), F.array(escape("venue"))).alias("container-title"),
        _c("fields_of_study").alias("subject"), "language", F.array(_o(("content-type", F.lit("text/html")), ("URL", F.lit("x"))), _o(("content-type", F.lit("application/PDF")), ("URL", _c("pdf_url")))).alias("link"), _c("cited").alias("is-referenced-by-count"),
    )
    return flat(M.crossref(_payloads(spark, folder, payload)))


@query("source_europe_pmc", _sql(
    record_id="'europe_pmc:MED:' || sid", title="title", abstract="abstract", authors=_JOIN.format("names"), publication_date="publication_date", publication_year="publication_year", work_type="work_type", venue="venue", language="language",
    open_access="open_access", landing_page_url="coalesce(landing_page_url, 'https://europepmc.org/article/MED/' || sid)", pdf_url="pdf_url", identifiers=_ids(("doi", "doi"), ("pmid", "coalesce(pmid, sid)")), citation_count="cited"))
def source_europe_pmc(spark: SparkSession, folder: str) -> DataFrame:
    """One author or link is delivered as an object, several as a list."""
    authors = _people(lambda a: _o(("fullName", a["name"])))
    links = F.filter(F.array(_o(("url", _c("landing_page_url")), ("documentStyle", F.lit("html"))), _o(("url", _c("pdf_url")), ("documentStyle", F.lit("pdf")))), lambda x: x["url"].isNotNull())
    single = lambda items: F.when(F.size(items) == 1, F.to_json(F.get(items, F.lit(0)))).otherwise(F.to_json(items))
    body = _json(
        F.lit("med").alias("source"), _c("sid").alias("id"), F.trim("pmid").alias("pmid"), "doi", "title", _c("abstract").alias("abstractText"), _date().alias("firstPublicationDate"), _c("publication_year").cast("string").alias("pubYear"),
        _o(("pubType", _c("work_type"))).alias("pubTypeList"), _c("venue").alias("journalTitle"), "language", F.when(_c("open_access"), "Y").when(~_c("open_access"), "N").alias("isOpenAccess"), _c("cited").alias("citedByCount"),
    )
    payload = F.concat(F.lit('{"authorList":{"author":'), single(authors), F.lit('},"fullTextUrlList":{"fullTextUrl":'), single(links), F.lit("},"), F.substring(body, 2, 10_000_000))
    return flat(M.europe_pmc(_payloads(spark, folder, payload)))


def _xml_text(c: Column) -> Column:
    """Text for XML: what XML can't hold is left out, its own signs are escaped."""
    x = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


@query("source_arxiv", _sql(
    record_id="'arxiv:' || num || 'v3'", family="'arxiv:' || num", title=_TIGHT.format(_composed("title")), abstract="nullif(" + _TIGHT.format(_composed("abstract")) + ", '')", authors=_JOIN.format("list_transform(names, lambda x: " + _TIGHT.format(_composed("x")) + ")"),
    publication_date="publication_date", publication_year="year(publication_date)", work_type="'preprint'", venue=_TIGHT.format(_composed("venue")), fields="coalesce(venue, '')", open_access="true", landing_page_url="'http://arxiv.org/abs/' || num || 'v3'", pdf_url="pdf_url",
    identifiers=_ids(("arxiv", "num"), ("doi", "doi"))))
def source_arxiv(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of an Atom feed; the preprint numbers are made from the record ids."""
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), _xml_text(c), F.lit(f"</{name}>")))
    link = F.when(_c("pdf_url").isNotNull(), F.concat(F.lit('<link type="text/html" href="x"/><link title="pdf" href="'), _xml_text(_c("pdf_url")), F.lit('"/>')))
    topic = F.when(_c("venue").isNotNull(), F.concat(F.lit('<arxiv:primary_category term="'), _xml_text(_c("venue")), F.lit('"/>')))
    number = F.concat(F.lit("2101."), F.right(F.concat(F.lit("00000"), F.regexp_replace("sid", r"\D", "")), F.lit(5)))
    payload = F.concat_ws(
        "", F.lit('<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/'), number, F.lit("v3</id>"), tag("title", _c("title")), tag("summary", _c("abstract")),
        tag("published", F.concat(_date(), F.lit("T10:00:00Z"))), F.array_join(_people(lambda a: F.concat(F.lit("<author><name>"), _xml_text(a["name"]), F.lit("</name></author>"))), ""), link, topic, tag("arxiv:doi", _c("doi")), F.lit("</entry>"),
    )
    rows = base(spark, folder).select(payload.alias("payload"))
    return flat(M.arxiv(rows))


@query("source_datacite", _sql(
    where="doi IS NOT NULL", record_id="'datacite:' || doi", title=r"trim(title, ' ')", abstract="nullif(trim(abstract), '')", authors=_JOIN.format("list_transform(names, lambda x: regexp_replace(x, '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g'))"), publication_date="publication_date",
    publication_year="coalesce(publication_year, year(publication_date))", work_type="lower(work_type)", venue="venue", landing_page_url="coalesce(landing_page_url, 'https://doi.org/' || doi)", identifiers="'doi=' || doi", citation_count="cited"))
def source_datacite(spark: SparkSession, folder: str) -> DataFrame:
    attributes = _o(
        ("doi", _c("doi")), ("url", _c("landing_page_url")), ("titles", F.array(_o(("title", F.lit(""))), _o(("title", _c("title"))))), ("creators", _people(lambda a: _o(("name", a["name"])))), ("published", _date()), ("publicationYear", _c("publication_year")),
        ("descriptions", F.array(_o(("descriptionType", F.lit("Methods")), ("description", F.lit("x"))), _o(("descriptionType", F.lit("Abstract")), ("description", _c("abstract"))))), ("types", _o(("resourceTypeGeneral", _c("work_type")))), ("publisher", _c("venue")),
        ("citationCount", _c("cited")),
    )
    return flat(M.datacite(_payloads(spark, folder, _json(attributes.alias("attributes")))))


_STOPPED = "trim(rtrim(trim(title), '.'))"


@query("source_dblp", _sql(
    record_id="'dblp:' || sid", title=_STOPPED, authors=_JOIN.format("names"), publication_date="make_date(publication_year, 1, 1)", publication_year="publication_year", work_type="nullif(lower(work_type), '')", venue="venue",
    open_access="CASE WHEN open_access THEN true ELSE NULL END", landing_page_url="'https://dblp.org/rec/' || sid", identifiers=_ids(("dblp", "sid"), ("doi", "doi"))))
def source_dblp(spark: SparkSession, folder: str) -> DataFrame:
    """A single author comes as a string, several as a list of objects."""
    people = F.when(F.size("names") == 1, F.to_json(F.array(F.get("names", F.lit(0))))).otherwise(F.to_json(_people(lambda a: _o(("text", a["name"]), ("@pid", F.lit("1"))))))
    people = F.when(F.size("names") == 1, F.regexp_replace(people, r"^\[|\]$", "")).otherwise(people)
    body = _json(_c("sid").alias("key"), F.concat("title", F.lit(".")).alias("title"), _c("publication_year").cast("string").alias("year"), _c("work_type").alias("type"), "venue", F.when(_c("open_access"), "open").alias("access"), "doi")
    return flat(M.dblp(_payloads(spark, folder, F.concat(F.lit('{"authors":{"author":'), people, F.lit("},"), F.substring(body, 2, 10_000_000)))))


@query("source_dblp_xml", _sql(
    record_id="'dblp:' || sid", title=_STOPPED, authors=_JOIN.format("list_transform(names, lambda x: regexp_replace(x, '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g'))"), publication_date="make_date(publication_year, 1, 1)", publication_year="publication_year", work_type="'article'", venue="venue",
    open_access="CASE WHEN open_access THEN true ELSE NULL END", landing_page_url="'https://dblp.org/rec/' || sid", identifiers=_ids(("dblp", "sid"), ("doi", "doi"))))
def source_dblp_xml(spark: SparkSession, folder: str) -> DataFrame:
    tag = lambda name, c, more="": F.when(c.isNotNull(), F.concat(F.lit(f"<{name}{more}>"), _xml_text(c), F.lit(f"</{name}>")))
    access = F.when(_c("open_access"), F.lit('<ee type="oa">https://example.org/x</ee>'))
    payload = F.concat_ws(
        "", F.lit('<?xml version="1.0"?><!DOCTYPE dblp SYSTEM "dblp.dtd"><dblp><article key="'), _xml_text(_c("sid")), F.lit('">'), F.array_join(_people(lambda a: F.concat(F.lit("<author>"), _xml_text(a["name"]), F.lit("</author>"))), ""),
        tag("title", F.concat("title", F.lit("."))), tag("journal", _c("venue")), tag("year", _c("publication_year").cast("string")), access, F.when(_c("doi").isNotNull(), F.concat(F.lit("<ee>https://doi.org/"), _xml_text(F.regexp_replace("doi", "^https?://[^/]*/", "")), F.lit("</ee>"))), F.lit("</article></dblp>"),
    )
    return flat(M.dblp_xml(_payloads(spark, folder, payload)))


@query("source_acl_anthology", _sql(
    record_id="'acl_anthology:' || sid", title=_TIGHT.format("title"), authors=_JOIN.format("list_transform(names, lambda x: " + _TIGHT.format("x") + ")"), publication_date="publication_date", publication_year="year(publication_date)", work_type="'conference-paper'",
    venue=f"nullif({_TIGHT.format('venue')}, '')", language="language", open_access="true", landing_page_url="'https://aclanthology.org/' || sid || '/'", pdf_url="'https://aclanthology.org/' || sid || '.pdf'", identifiers=_ids(("acl_anthology", "sid"), ("doi", "doi"))))
def source_acl_anthology(spark: SparkSession, folder: str) -> DataFrame:
    """MODS records; editors stand beside the authors and don't count."""
    role = lambda r: f'<role><roleTerm authority="marcrelator" type="text">{r}</roleTerm></role>'
    people = F.array_join(_people(lambda a: F.concat(F.lit('<name type="personal"><namePart type="family">'), _xml_text(a["name"]), F.lit("</namePart>" + role("author") + "</name>"))), "")
    tag = lambda before, c, after: F.when(c.isNotNull(), F.concat(F.lit(before), _xml_text(c), F.lit(after)))
    payload = F.concat_ws(
        "", F.lit('<modsCollection xmlns="http://www.loc.gov/mods/v3"><mods ID="x"><titleInfo><title>'), _xml_text(_c("title")), F.lit("</title></titleInfo>"), people, F.lit('<name type="personal"><namePart type="family">Ed</namePart>' + role("editor") + "</name>"),
        tag("<originInfo><dateIssued>", _date(), "</dateIssued></originInfo>"), tag("<language><languageTerm>", _c("language"), "</languageTerm></language>"), tag('<relatedItem type="host"><titleInfo><title>', _c("venue"), "</title></titleInfo></relatedItem>"),
        tag('<identifier type="doi">', _c("doi"), "</identifier>"), F.lit("</mods></modsCollection>"),
    )
    return flat(M.acl_anthology(_payloads(spark, folder, payload)))


_ENDS = r"regexp_replace({0}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"


@query("source_openaire", _sql(
    record_id="'openaire:' || sid", title=_ENDS.format("title"), abstract=f"nullif({_ENDS.format('abstract')}, '')", authors=_JOIN.format("list_transform(names, lambda x: " + _ENDS.format("x") + ")"), publication_date="publication_date", publication_year="coalesce(year(publication_date), publication_year)",
    work_type="coalesce(lower(work_type), 'publication')", venue="venue", open_access="open_access", landing_page_url="coalesce(landing_page_url, 'https://api.openaire.eu/graph/v3/research-products/' || replace(sid, '/', '%2F'))",
    identifiers=_ids(("openaire", "sid"), ("doi", "doi"), ("pmid", "pmid")), citation_count="cited"))
def source_openaire(spark: SparkSession, folder: str) -> DataFrame:
    claim = lambda s, c: _o(("scheme", F.lit(s)), ("value", c))
    payload = _json(
        _c("sid").alias("id"), _c("title").alias("mainTitle"), F.array("abstract").alias("descriptions"), _people(lambda a: _o(("fullName", a["name"]))).alias("authors"), F.coalesce(_date(), _c("publication_year").cast("string")).alias("publicationDate"),
        F.array(_o(("type", _c("work_type")), ("urls", F.array(F.lit("ftp://x"), _c("landing_page_url"))))).alias("instances"), _o(("name", _c("venue"))).alias("container"), _o(("label", F.when(_c("open_access"), "Open Access").when(~_c("open_access"), "CLOSED"))).alias("bestAccessRight"),
        F.array(claim("DOI", _c("doi")), claim("pmid", _c("pmid")), claim("handle", F.lit("x"))).alias("pids"), _o(("citationImpact", _o(("citationCount", _c("cited"))))).alias("indicators"),
    )
    return flat(M.openaire(_payloads(spark, folder, payload)))


@query("source_openreview", _sql(
    record_id="'openreview:' || sid", title=_ENDS.format("title"), abstract=f"nullif({_ENDS.format('abstract')}, '')", authors=_JOIN.format("list_transform(names, lambda x: " + _ENDS.format("x") + ")"), publication_date="publication_date", publication_year="year(publication_date)",
    work_type="CASE WHEN venue IS NULL THEN 'preprint' ELSE 'conference-paper' END", venue=_ENDS.format("venue"), fields=_JOIN.format("fields_of_study"), open_access="pdf_url IS NOT NULL", landing_page_url="'https://openreview.net/forum?id=' || sid", pdf_url="pdf_url",
    identifiers=_ids(("openreview", "sid"), ("doi", "doi"), ("arxiv", "axv"))))
def source_openreview(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the notes wrap their values, half don't."""
    wrapped = lambda c: _o(("value", c))
    fields = [("title", _c("title")), ("abstract", _c("abstract")), ("authors", _c("names")), ("venue", _c("venue")), ("keywords", _c("fields_of_study")), ("pdf", _c("pdf_url")), ("doi", _c("doi")), ("arxiv", T.arxiv(_c("arxiv"), False))]
    content = F.when(F.length("title") % 2 == 0, F.to_json(_o(*[(n, wrapped(c)) for n, c in fields]))).otherwise(F.to_json(_o(*fields)))
    body = _json(_c("sid").alias("id"), (F.unix_timestamp(_c("publication_date").cast("timestamp")) * 1000).alias("pdate"))
    return flat(M.openreview(_payloads(spark, folder, F.concat(F.lit('{"content":'), content, F.lit(","), F.substring(body, 2, 10_000_000)))))


@query("source_inspire", _sql(
    record_id="'inspire:' || sid", title=_ENDS.format("title"), abstract=f"nullif({_ENDS.format('abstract')}, '')", authors=_JOIN.format("list_transform(names, lambda x: " + _ENDS.format("x") + ")"), publication_date="publication_date", publication_year="coalesce(publication_year, year(publication_date))",
    work_type="lower(work_type)", venue="venue", landing_page_url="'https://inspirehep.net/literature/' || sid", identifiers=_ids(("inspire", "sid"), ("doi", "doi"), ("arxiv", "axv")), citation_count="cited"))
def source_inspire(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda n, c: F.array(_o((n, c)))
    metadata = _o(
        ("titles", one("title", _c("title"))), ("abstracts", one("value", _c("abstract"))), ("authors", _people(lambda a: _o(("full_name", a["name"])))), ("publication_info", F.array(_o(("year", _c("publication_year")), ("journal_title", _c("venue"))))),
        ("earliest_date", _date()), ("document_type", F.array("work_type")), ("dois", one("value", _c("doi"))), ("arxiv_eprints", one("value", _c("arxiv"))), ("citation_count", _c("cited")),
    )
    return flat(M.inspire(_payloads(spark, folder, _json(_c("sid").alias("id"), metadata.alias("metadata")))))


@query("source_opencitations", _sql(
    where="doi IS NOT NULL", record_id="'opencitations:doi:' || doi", title=_ENDS.format("title"), authors=_JOIN.format("list_filter(list_transform(string_split(replace(array_to_string(names, '; '), '[', '('), ';'), lambda x: trim(x)), lambda x: x <> '')"), publication_date="publication_date",
    publication_year="coalesce(year(publication_date), publication_year)", work_type="nullif(lower(work_type), '')", venue=f"nullif({_ENDS.format('venue')}, '')", landing_page_url="'https://doi.org/' || doi", identifiers=_ids(("doi", "doi"), ("pmid", "pmid"))))
def source_opencitations(spark: SparkSession, folder: str) -> DataFrame:
    """Authors in one text with ids in brackets, ids in another."""
    rows = base(spark, folder).withColumn("d", T.doi(_c("doi"))).where("d IS NOT NULL")
    payload = _json(
        F.concat_ws(" ", F.concat(F.lit("doi:"), "d"), F.concat(F.lit("pmid:"), F.trim("pmid"))).alias("id"), "title", F.array_join(_people(lambda a: F.concat(F.replace(a["name"], F.lit("["), F.lit("(")), F.lit(" [omid:ra/1]"))), "; ").alias("author"),
        F.coalesce(_date(), _c("publication_year").cast("string")).alias("pub_date"), _c("work_type").alias("type"), F.concat("venue", F.lit(" [omid:br/2]")).alias("venue"),
    )
    return flat(M.opencitations(rows.select(payload.alias("payload"))))


@query("source_google_scholar", _sql(
    record_id="'google_scholar:' || sid", family="'google_scholar_cluster:' || work_family_id", title="title", abstract="abstract", authors=_JOIN.format("names"), publication_year="publication_year", open_access="pdf_url IS NOT NULL", landing_page_url="landing_page_url",
    pdf_url="pdf_url", identifiers="'google_scholar=c' || sid", citation_count="cited", where="len(names) > 0 AND NOT regexp_matches(concat_ws(' ', title, landing_page_url, abstract), '10\\.\\d{4}|arxiv')"))
def source_google_scholar(spark: SparkSession, folder: str) -> DataFrame:
    """Results of records with authors whose text names no identifier; the year stands last in a summary."""
    rows = base(spark, folder).where("size(names) > 0").where(~F.concat_ws(" ", "title", "landing_page_url", "abstract").rlike(r"10\.\d{4}|arxiv"))
    payload = _json(
        _c("sid").alias("result_id"), "title", _c("landing_page_url").alias("link"), _c("abstract").alias("snippet"),
        _o(("summary", F.concat_ws(" ", F.lit("A B - J,"), _c("publication_year"), F.lit("- example.org"))), ("authors", _people(lambda a: _o(("name", a["name"]))))).alias("publication_info"),
        _o(("cited_by", _o(("total", _c("cited")), ("cites_id", F.concat(F.lit("c"), "sid")))), ("versions", _o(("cluster_id", _c("work_family_id"))))).alias("inline_links"), F.array(_o(("file_format", F.lit("PDF")), ("link", _c("pdf_url")))).alias("resources"),
    )
    return flat(M.google_scholar_serpapi(rows.select(payload.alias("payload"))))


@query("source_ads", _sql(
    record_id="'ads:' || sid", title="title", abstract="abstract", authors=_JOIN.format("names"), publication_year="publication_year", venue="venue", landing_page_url="'https://ui.adsabs.harvard.edu/abs/' || replace(sid, '/', '%2F') || '/abstract'",
    identifiers="concat_ws('|', 'doi=' || doi, 'arxiv=' || axv)", citation_count="cited"))
def source_ads(spark: SparkSession, folder: str) -> DataFrame:
    payload = _json(
        _c("sid").alias("bibcode"), F.array("title").alias("title"), "abstract", _c("names").alias("author"), _c("publication_year").cast("string").alias("year"), _c("venue").alias("pub"), F.array_compact(F.array("doi")).alias("doi"),
        F.array_compact(F.array(F.concat(F.lit("arXiv:"), T.arxiv(_c("arxiv"), False)))).alias("identifier"), _c("cited").alias("citation_count"),
    )
    return flat(M.ads(_payloads(spark, folder, payload)))


@query(
    "source_reference_split",
    f"""WITH r AS (SELECT document_record_id, row_number() OVER (PARTITION BY document_record_id ORDER BY ordinal, reference_key) AS ordinal, title, raw_text, publication_year, {_DOI.replace('c.doi', 'doi')} AS d FROM extracted_references),
    x AS (SELECT *, CASE WHEN regexp_full_match(d, '10\\.\\d{{4,9}}/\\S+') THEN d END AS doi, '10.5555/' || md5(document_record_id) AS seed FROM r)
    SELECT seed, ordinal::INT AS ordinal, doi, CASE WHEN doi IS NULL THEN 'no_identifier' END AS reason, CASE WHEN doi IS NOT NULL THEN publication_year END AS year FROM x""",
)
def source_reference_split(spark: SparkSession, folder: str) -> DataFrame:
    """Deposited bibliographies: entries with a DOI are works, the rest stays unresolved."""
    entry = F.struct("ordinal", "reference_key", _o(("DOI", _c("doi")), ("article-title", _c("title")), ("unstructured", _c("raw_text")), ("year", _c("publication_year").cast("string"))).alias("e"))
    whole = load(spark, folder, "extracted_references").groupBy("document_record_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("reference"))
    rows = whole.select(_json(F.concat(F.lit("10.5555/"), F.md5("document_record_id")).alias("DOI"), "reference").alias("payload"))
    linked, rest = M.crossref_references(rows)
    none = F.lit(None).cast("string")
    return linked.select("seed", "ordinal", "doi", none.alias("reason"), "year").unionAll(rest.select("seed", "ordinal", none.alias("doi"), "reason", F.lit(None).cast("int").alias("year")))


@query(
    "source_all",
    "SELECT split_part(record_id, ':', 1) AS provider, count(*) AS records, count(DISTINCT record_id) AS ids FROM papers WHERE split_part(record_id, ':', 1) IN ('openalex', 'semantic_scholar', 'ads', 'dblp') GROUP BY 1",
)
def source_all(spark: SparkSession, folder: str) -> DataFrame:
    """One table of payloads of several sources through the registry: the union of all their mappers."""
    title = _c("title")
    provider = F.split_part("record_id", F.lit(":"), F.lit(1))
    payload = (
        F.when(provider == "openalex", _json(_c("sid").alias("id"), title)).when(provider == "semantic_scholar", _json(_c("sid").alias("paperId"), title))
        .when(provider == "ads", _json(_c("sid").alias("bibcode"), F.array(title).alias("title"))).when(provider == "dblp", _json(_c("sid").alias("key"), title))
    )
    rows = base(spark, folder).select(provider.alias("provider"), _c("sid").alias("key"), payload.alias("payload")).where("payload IS NOT NULL")
    return M.SOURCES.records(rows, ("openalex", "semantic_scholar", "ads", "dblp")).groupBy("provider").agg(F.count("*").alias("records"), F.countDistinct("record_id").alias("ids"))
