"""Source payloads as canonical records.

Each source delivers its own JSON or XML; a mapper turns a column of such
texts into records of one schema, by column expressions only, so a scan of a
hundred terabytes of payloads stays in the JVM and in code generation.
Payloads that can't be read, lack their id, or (XML) declare entities give no
record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import identifiers as X
from quillmesh.functions import payloads as P
from quillmesh.functions.text import compatible
from quillmesh.session import ship

AUTHOR = "struct<name:string,orcid:string,provider_ids:map<string,string>>"
CLAIM = "struct<scheme:string,value:string>"
RECORD = (
    f"record_id string, provider string, source_record_id string, source_url string, work_family_id string, title string, abstract string, authors array<{AUTHOR}>, publication_date date, "
    f"publication_year int, work_type string, venue string, fields_of_study array<string>, language string, open_access boolean, landing_page_url string, pdf_url string, "
    f"identifiers array<{CLAIM}>, citation_count bigint"
)
_FIELDS = [tuple(x.split(" ", 1)) for x in RECORD.split(", ")]


def author(name: Column, orcid: Column | None = None, ids: Column | None = None) -> Column:
    return F.struct(name.alias("name"), (F.lit(None).cast("string") if orcid is None else orcid).alias("orcid"), (F.lit(None).cast("map<string,string>") if ids is None else ids).alias("provider_ids"))


def claim(scheme: str, value: Column) -> Column:
    return F.struct(F.lit(scheme).alias("scheme"), value.cast("string").alias("value"))


def _own_id(provider: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.create_map(F.lit(provider), value))


def _claims(*claims: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*claims), lambda c: c["value"].isNotNull() & (c["value"] != "")))


def _named(authors: Column) -> Column:
    return F.filter(authors, lambda a: a["name"].isNotNull() & (a["name"] != ""))


def _record(rows: DataFrame, prefix: str, sid: Column, **fields: Column) -> DataFrame:
    """The canonical record; fields that a source has not are null, lists empty."""
    fields = {"provider": F.lit(prefix), "source_record_id": sid, "record_id": F.concat(F.lit(f"{prefix}:"), sid)} | fields
    fields["publication_year"] = fields.get("publication_year", F.year(fields["publication_date"]) if "publication_date" in fields else F.lit(None))
    out = []
    for name, kind in _FIELDS:
        x = fields.get(name, F.lit(None)).cast(kind)
        out.append((F.coalesce(x, F.array().cast(kind)) if kind.startswith("array") else x).alias(name))
    return rows.where(sid.isNotNull() & (sid != "")).select(*out)


def _normal(records: DataFrame) -> DataFrame:
    """Title, abstract, venue and names in compatibility composition."""
    n = 3
    done = records.withColumn("t", compatible(F.concat(F.array("title", "abstract", "venue"), F.transform("authors", lambda a: a["name"]))))
    at = lambda k: F.get("t", F.lit(k))
    names = F.slice("t", n + 1, F.greatest(F.size("authors"), F.lit(0)))
    people = F.zip_with("authors", names, lambda a, x: F.struct(x.alias("name"), a["orcid"].alias("orcid"), a["provider_ids"].alias("provider_ids")))
    return done.withColumns({"title": at(0), "abstract": at(1), "venue": at(2), "authors": people}).drop("t")


def _json(rows: DataFrame, column: str) -> tuple[DataFrame, Column]:
    ship(rows.sparkSession)
    return rows.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL"), F.col("v")


def _xml(rows: DataFrame, column: str, schema: str, doctype: bool = False) -> tuple[DataFrame, Callable[[str], Column]]:
    """Parsed elements of texts without entity declarations (and, unless ``doctype``, without document types)."""
    bad = F.lower(column).contains("<!entity") | (F.lit(False) if doctype else F.lower(column).contains("<!doctype"))
    parsed = rows.where(~bad).select(F.from_xml(F.regexp_replace(column, r"<!DOCTYPE[^>]*>", ""), schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x")).where("x IS NOT NULL")
    return parsed, lambda path: F.col(f"x.{path}")


def _text(c: Column) -> Column:
    return P.filled(F.regexp_replace(c, r"(?U)\s+", " "))


def _urls_doi(d: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), d)


def openalex(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    sid = F.upper(P.last_segment(get("id")))
    people = F.coalesce(F.try_variant_get(v, "$.authorships", "array<struct<author:struct<id:string,display_name:string,orcid:string>>>"), F.array().cast("array<struct<author:struct<id:string,display_name:string,orcid:string>>>"))
    people = F.transform(people, lambda a: author(a["author"]["display_name"], a["author"]["orcid"], _own_id("openalex", F.upper(P.last_segment(a["author"]["id"])))))
    topics = F.transform(P.one_or_many(v, "$.topics"), lambda t: P.value(t, "$.display_name"))
    return _record(
        rows, "openalex", sid, source_url=get("id"), title=F.coalesce(P.filled(get("title")), P.filled(get("display_name")), F.concat(F.lit("Untitled "), sid)),
        abstract=P.restored_text(get("abstract_inverted_index", "map<string,array<int>>")), authors=_named(people), publication_date=P.iso_date(get("publication_date")),
        publication_year=get("publication_year", "int"), work_type=get("type"), venue=get("primary_location.source.display_name"), fields_of_study=F.filter(topics, lambda t: t.isNotNull() & (t != "")),
        language=get("language"), open_access=get("open_access.is_oa", "boolean"), landing_page_url=F.coalesce(get("primary_location.landing_page_url"), get("id")), pdf_url=get("primary_location.pdf_url"),
        identifiers=_claims(claim("openalex", sid), claim("doi", X.doi(F.coalesce(get("ids.doi"), get("doi")))), claim("pmid", P.last_segment(get("ids.pmid"))), claim("pmcid", P.last_segment(get("ids.pmcid")))),
        citation_count=F.coalesce(P.int_or_null(get("cited_by_count")), F.lit(0)),
    )


def semantic_scholar(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    sid = get("paperId")
    people = F.transform(P.one_or_many(v, "$.authors"), lambda a: author(P.value(a, "$.name"), None, _own_id("semantic_scholar", P.value(a, "$.authorId"))))
    page = F.coalesce(P.filled(get("url")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), sid))
    # the venue comes as an object or as a plain string
    boxed = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.publicationVenue", "variant")), F.lit("OBJECT"))
    venue = F.coalesce(P.filled(F.when(boxed, get("publicationVenue.name")).otherwise(get("publicationVenue"))), get("venue"))
    return _record(
        rows, "semantic_scholar", sid, source_url=page, title=F.coalesce(P.filled(get("title")), F.concat(F.lit("Untitled "), sid)), abstract=get("abstract"), authors=_named(people),
        publication_date=P.iso_date(get("publicationDate")), publication_year=get("year", "int"), work_type=get("publicationTypes[0]"), venue=venue, fields_of_study=get("fieldsOfStudy", P.STRINGS),
        open_access=get("isOpenAccess", "boolean"), landing_page_url=page, pdf_url=get("openAccessPdf.url"),
        identifiers=_claims(claim("semantic_scholar", sid), claim("doi", X.doi(get("externalIds.DOI"))), claim("arxiv", X.arxiv(get("externalIds.ArXiv"), False)), claim("pmid", get("externalIds.PubMed")), claim("pmcid", get("externalIds.PubMedCentral"))),
        citation_count=F.coalesce(P.int_or_null(get("citationCount")), F.lit(0)),
    )


_CROSSREF_DATES = ("published-print", "published-online", "published", "issued", "created")


def crossref(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$['{path}']", kind)
    sid = X.doi(get("DOI"))
    clean = lambda c: _text(P.unescaped(c))
    people = F.transform(P.one_or_many(v, "$.author"), lambda a: author(_text(F.concat_ws(" ", P.value(a, "$.given"), P.value(a, "$.family"))), P.value(a, "$.ORCID")))
    page = F.coalesce(P.filled(get("URL")), _urls_doi(sid))
    head = lambda key: P.value(F.get(P.one_or_many(v, f"$['{key}']"), F.lit(0)), "$")
    link = P.first(P.one_or_many(v, "$.link"), lambda x: F.lower(P.value(x, "$['content-type']")).contains("pdf"), lambda x: P.value(x, "$.URL"))
    found = _record(
        rows, "crossref", sid, source_url=page, title=F.coalesce(clean(head("title")), F.concat(F.lit("Untitled "), sid)), abstract=P.without_markup(get("abstract")), authors=_named(people),
        publication_date=P.date_from_parts(*[P.value(v, f"$['{k}']['date-parts'][0]", "array<int>") for k in _CROSSREF_DATES]), work_type=get("type"), venue=clean(head("container-title")),
        fields_of_study=get("subject", P.STRINGS), language=get("language"), landing_page_url=page, pdf_url=link, identifiers=_claims(claim("doi", sid)),
        citation_count=F.greatest(F.lit(0), F.coalesce(P.int_or_null(get("is-referenced-by-count")), F.lit(0))),
    )
    return _normal(found)


def crossref_references(rows: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Deposited bibliographies as ``seed, ordinal, doi, title, author, year`` of entries with a DOI, and ``seed, ordinal, raw, reason`` of the rest."""
    rows, v = _json(rows, column)
    each = rows.select(X.doi(P.value(v, "$.DOI")).alias("seed"), F.posexplode(P.one_or_many(v, "$.reference")).alias("at", "r")).where("seed IS NOT NULL")
    r = F.col("r")
    each = each.select("seed", (F.col("at") + 1).alias("ordinal"), X.doi(P.value(r, "$.DOI")).alias("doi"), _text(P.unescaped(F.coalesce(P.filled(P.value(r, "$['article-title']")), P.value(r, "$.unstructured")))).alias("title"), _text(P.value(r, "$.author")).alias("author"), P.year_or_null(P.value(r, "$.year")).alias("year"), F.to_json("r").alias("raw"))
    linked = each.where("doi IS NOT NULL").select("seed", "ordinal", "doi", F.coalesce("title", F.concat(F.lit("DOI "), "doi")).alias("title"), "author", "year")
    return linked, each.where("doi IS NULL").select("seed", "ordinal", "raw", F.lit("no_identifier").alias("reason"))


def europe_pmc(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    source = F.upper(F.coalesce(P.filled(get("source")), F.lit("UNKNOWN")))
    number = F.coalesce(P.filled(get("id")), P.filled(get("pmid")), P.filled(get("pmcid")), F.lit("UNKNOWN"))
    sid = F.concat_ws(":", source, number)
    page = F.concat(F.lit("https://europepmc.org/article/"), source, F.lit("/"), number)
    name = lambda a: F.coalesce(P.filled(P.value(a, "$.fullName")), F.concat_ws(" ", P.filled(P.value(a, "$.firstName")), P.filled(P.value(a, "$.lastName"))))
    people = F.transform(P.one_or_many(v, "$.authorList.author"), lambda a: author(name(a), None, _own_id("europe_pmc", P.value(a, "$.authorId"))))
    links = F.filter(P.one_or_many(v, "$.fullTextUrlList.fullTextUrl"), lambda x: P.filled(P.value(x, "$.url")).isNotNull())
    is_pdf = lambda x: F.coalesce(F.lower(P.value(x, "$.documentStyle")) == "pdf", F.lit(False))
    pdf = F.transform(F.filter(links, is_pdf), lambda x: P.value(x, "$.url"))
    return _record(
        rows, "europe_pmc", sid, source_url=page, title=F.coalesce(P.filled(get("title")), F.concat(F.lit("Untitled "), sid)), abstract=get("abstractText"), authors=_named(people),
        publication_date=P.iso_date(get("firstPublicationDate")), publication_year=P.int_or_null(get("pubYear")), work_type=P.value(F.get(P.one_or_many(v, "$.pubTypeList.pubType"), F.lit(0)), "$"),
        venue=F.coalesce(P.filled(get("journalInfo.journal.title")), P.filled(get("journalTitle")), get("journalAbbreviation")), language=get("language"), open_access=P.yes_no(get("isOpenAccess")),
        landing_page_url=F.coalesce(P.first(links, lambda x: ~is_pdf(x), lambda x: P.value(x, "$.url")), page), pdf_url=F.try_element_at(pdf, F.lit(-1)),
        identifiers=_claims(claim("doi", X.doi(get("doi"))), claim("pmid", F.coalesce(P.filled(get("pmid")), F.when(source == "MED", number))), claim("pmcid", F.coalesce(P.filled(get("pmcid")), F.when(source == "PMC", number)))),
        citation_count=P.int_or_null(get("citedByCount")),
    )


def arxiv(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Entries of the Atom feed, one per text."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_type:string>>, primary_category struct<_term:string>, doi string"
    rows, x = _xml(rows, column, schema)
    sid, work = X.arxiv(_text(x("id"))), X.arxiv(_text(x("id")), False)
    people = F.transform(F.coalesce(x("author"), F.array().cast("array<struct<name:string>>")), lambda a: author(_text(a["name"])))
    pdf = P.first(x("link"), lambda a: F.coalesce(a["_title"] == "pdf", F.lit(False)) | F.coalesce(a["_type"] == "application/pdf", F.lit(False)), lambda a: a["_href"])
    topic = x("primary_category._term")
    found = _record(
        rows, "arxiv", sid, source_url=_text(x("id")), work_family_id=F.concat(F.lit("arxiv:"), work), title=F.coalesce(_text(x("title")), F.concat(F.lit("Untitled "), sid)), abstract=_text(x("summary")),
        authors=_named(people), publication_date=P.iso_date(_text(x("published"))), work_type=F.lit("preprint"), venue=topic, fields_of_study=F.filter(F.array(topic), lambda t: t.isNotNull()),
        open_access=F.lit(True), landing_page_url=_text(x("id")), pdf_url=pdf, identifiers=_claims(claim("arxiv", work), claim("doi", X.doi(_text(x("doi"))))),
    )
    return _normal(found)


def datacite(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.attributes.{path}", kind)
    sid = X.doi(F.coalesce(P.filled(get("doi")), P.value(v, "$.id")))
    page = F.coalesce(P.filled(get("url")), _urls_doi(sid))
    there = lambda key: lambda x: P.filled(P.value(x, f"$.{key}")).isNotNull()
    text = lambda key: lambda x: P.filled(P.value(x, f"$.{key}"))
    when = P.iso_date(get("published"))
    year = P.int_or_null(get("publicationYear"))
    people = F.transform(P.one_or_many(v, "$.attributes.creators"), lambda a: author(P.filled(P.value(a, "$.name"))))
    about = F.filter(P.one_or_many(v, "$.attributes.descriptions"), lambda x: F.lower(P.value(x, "$.descriptionType")) == "abstract")
    return _record(
        rows, "datacite", sid, source_url=page, title=F.coalesce(P.first(P.one_or_many(v, "$.attributes.titles"), there("title"), text("title")), sid), abstract=P.first(about, there("description"), text("description")),
        authors=_named(people), publication_date=when, publication_year=F.coalesce(F.when(year != 0, year), F.year(when)), work_type=F.lower(F.coalesce(P.filled(get("types.resourceTypeGeneral")), P.filled(get("types.resourceType")))),
        venue=get("publisher"), landing_page_url=page, identifiers=_claims(claim("doi", sid)), citation_count=P.int_or_null(get("citationCount")),
    )


def _dblp(rows: DataFrame, key: Column, title: Column, people: Column, year: Column, kind: Column, venue: Column, access: Column, page: Column, doi: Column) -> DataFrame:
    page = F.coalesce(P.filled(page), F.concat(F.lit("https://dblp.org/rec/"), key))
    return _record(
        rows, "dblp", key, source_url=page, title=F.trim(F.rtrim(F.coalesce(P.filled(title), key), F.lit("."))), authors=_named(people), publication_date=F.when(year != 0, F.make_date(year, F.lit(1), F.lit(1))), publication_year=year,
        work_type=P.filled(F.lower(kind)), venue=venue, open_access=F.when(P.filled(access).isNotNull(), access == "open"), landing_page_url=page, identifiers=_claims(claim("dblp", key), claim("doi", X.doi(doi))),
    )


def dblp(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Hits of the search interface. Authors come as one or many, each a string or an object."""
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    name = lambda a: F.when(F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), P.value(a, "$.text")).otherwise(P.value(a, "$"))
    people = F.transform(P.one_or_many(v, "$.authors.author"), lambda a: author(name(a)))
    key = F.coalesce(P.filled(get("key")), P.filled(get("url")), F.lit("unknown"))
    return _dblp(rows, key, get("title"), people, P.int_or_null(get("year")).cast("int"), get("type"), get("venue"), get("access"), get("url"), get("doi"))


def dblp_xml(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Single records of the XML export; the record element is the only child of the root."""
    one = "_key string, author array<struct<_VALUE:string,_pid:string>>, editor array<struct<_VALUE:string,_pid:string>>, title string, booktitle string, journal string, year string, doi array<string>, ee array<struct<_VALUE:string,_type:string>>"
    kinds = "article inproceedings proceedings book incollection phdthesis mastersthesis www data".split()
    rows, x = _xml(rows, column, ", ".join(f"{k} struct<{one.replace(' ', ':').replace(',:', ',')}>" for k in kinds), doctype=True)
    rows = rows.select(F.coalesce(*[F.when(x(k).isNotNull(), F.lit(k)) for k in kinds]).alias("kind"), F.coalesce(*[x(k) for k in kinds]).alias("e")).where("e IS NOT NULL")
    e = lambda path: F.col(f"e.{path}")
    none = F.array().cast("array<struct<_VALUE:string,_pid:string>>")
    people = F.transform(F.concat(F.coalesce(e("author"), none), F.coalesce(e("editor"), none)), lambda a: author(P.filled(a["_VALUE"])))
    editions = F.coalesce(e("ee"), F.array().cast("array<struct<_VALUE:string,_type:string>>"))
    doi = F.coalesce(F.get(e("doi"), F.lit(0)), P.first(editions, lambda a: X.doi(a["_VALUE"]).isNotNull(), lambda a: a["_VALUE"]))
    access = F.when(F.exists(editions, lambda a: F.coalesce(a["_type"] == "oa", F.lit(False))), F.lit("open"))
    return _dblp(rows, e("_key"), e("title"), people, P.int_or_null(e("year")).cast("int"), F.col("kind"), F.coalesce(e("booktitle"), e("journal")), access, F.lit(None).cast("string"), doi)


def acl_anthology(rows: DataFrame, column: str = "payload", key: str = "key") -> DataFrame:
    """MODS records with their Anthology number in column ``key``."""
    part = "array<struct<_VALUE:string,_type:string>>"
    mods = (
        f"titleInfo:struct<title:string>,name:array<struct<namePart:{part},role:array<struct<roleTerm:array<struct<_VALUE:string>>>>,nameIdentifier:{part}>>,originInfo:struct<dateIssued:string>,"
        f"relatedItem:array<struct<_type:string,titleInfo:struct<title:string>>>,language:struct<languageTerm:struct<_VALUE:string>>,identifier:{part}"
    )
    bad = F.lower(column).contains("<!entity") | F.lower(column).contains("<!doctype")
    # a record by itself or the first of a collection
    inner = F.regexp_extract(column, r"(?s)<(?:\w+:)?mods[ >].*?</(?:\w+:)?mods>", 0)
    rows = rows.where(~bad).select(P.filled(key).alias("acl_id"), F.from_xml(inner, _ddl(mods), {"ignoreNamespace": "true"}).alias("x"))
    x = lambda path: F.col(f"x.{path}")
    sid = F.col("acl_id")
    typed = lambda items, kind: P.first(items, lambda p: F.lower(p["_type"]) == kind, lambda p: _text(p["_VALUE"]))
    is_author = lambda n: F.exists(n["role"], lambda r: F.exists(r["roleTerm"], lambda t: F.lower(_text(t["_VALUE"])) == "author"))
    full = lambda n: F.coalesce(P.filled(F.concat_ws(" ", typed(n["namePart"], "given"), typed(n["namePart"], "family"))), P.filled(F.array_join(F.transform(n["namePart"], lambda p: _text(p["_VALUE"])), " ")))
    people = F.transform(F.filter(x("name"), lambda n: F.coalesce(is_author(n), F.lit(False))), lambda n: author(full(n), typed(n["nameIdentifier"], "orcid")))
    when = P.partial_date(_text(x("originInfo.dateIssued")))
    dois = F.transform(F.filter(F.coalesce(x("identifier"), F.array().cast(part)), lambda i: F.lower(i["_type"]) == "doi"), lambda i: claim("doi", X.doi(_text(i["_VALUE"]))))
    page = F.concat(F.lit("https://aclanthology.org/"), sid, F.lit("/"))
    ids = F.array_distinct(F.filter(F.concat(F.array(claim("acl_anthology", sid)), dois), lambda c: c["value"].isNotNull()))
    return _record(
        rows.where("x.titleInfo.title IS NOT NULL"), "acl_anthology", sid, source_url=page, title=_text(x("titleInfo.title")), authors=_named(people), publication_date=when, work_type=F.lit("conference-paper"),
        venue=P.first(x("relatedItem"), lambda r: r["_type"] == "host", lambda r: _text(r["titleInfo"]["title"])), language=_text(x("language.languageTerm._VALUE")), open_access=F.lit(True), landing_page_url=page,
        pdf_url=F.concat(F.lit("https://aclanthology.org/"), sid, F.lit(".pdf")), identifiers=ids,
    )


def _ddl(fields: str) -> str:
    """The fields of a struct type (``name:type,...``) as those of a schema (``name type, ...``)."""
    out, depth, head = "", 0, True
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == ":" and not depth and head:
            out, head = out + " ", False
        elif c == "," and not depth:
            out, head = out + ", ", True
        else:
            out += c
    return out


def openaire(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    sid = F.coalesce(P.filled(get("id")), F.lit("unknown"))
    page = F.concat(F.lit("https://api.openaire.eu/graph/v3/research-products/"), F.replace(F.url_encode(sid), F.lit("%3A"), F.lit(":")))
    people = F.transform(P.one_or_many(v, "$.authors"), lambda a: author(P.filled(P.value(a, "$.fullName"))))
    when = P.iso_date(get("publicationDate"))
    instances = P.one_or_many(v, "$.instances")
    kinds = F.filter(F.transform(instances, lambda i: P.filled(P.value(i, "$.type"))), lambda t: t.isNotNull())
    urls = F.filter(F.flatten(F.transform(instances, lambda i: F.coalesce(P.value(i, "$.urls", P.STRINGS), F.array().cast(P.STRINGS)))), lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")))
    scheme = lambda i: F.lower(P.value(i, "$.scheme"))
    text = lambda i: P.filled(P.value(i, "$.value"))
    fixed = lambda i: F.when(scheme(i) == "doi", X.doi(text(i))).when(scheme(i) == "arxiv", X.arxiv(text(i), False)).when(scheme(i).isin("pmid", "pmc", "pmcid"), text(i))
    pids = F.transform(P.one_or_many(v, "$.pids"), lambda i: F.struct(F.when(scheme(i) == "pmc", "pmcid").otherwise(scheme(i)).alias("scheme"), fixed(i).alias("value")))
    label = P.filled(get("bestAccessRight.label"))
    about = F.filter(F.transform(P.one_or_many(v, "$.descriptions"), lambda d: P.filled(P.value(d, "$"))), lambda d: d.isNotNull())
    return _record(
        rows, "openaire", sid, source_url=page, title=F.coalesce(P.filled(get("mainTitle")), sid), abstract=F.get(about, F.lit(0)), authors=_named(people), publication_date=when,
        publication_year=F.coalesce(F.year(when), P.leading_year(get("publicationDate"))), work_type=F.lower(F.coalesce(F.get(kinds, F.lit(0)), P.filled(get("type")), F.lit("publication"))),
        venue=F.coalesce(P.filled(get("container.name")), get("publisher")), open_access=F.when(label.isNotNull(), F.upper(label).contains("OPEN")), landing_page_url=F.coalesce(F.get(urls, F.lit(0)), page),
        identifiers=F.array_distinct(F.filter(F.concat(F.array(claim("openaire", sid)), pids), lambda c: c["value"].isNotNull())), citation_count=P.int_or_null(get("indicators.citationImpact.citationCount")),
    )


def openreview(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Notes of either version of the interface: values bare or wrapped."""
    rows, v = _json(rows, column)
    top = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    content = F.try_variant_get(v, "$.content", "variant")
    get = lambda key: P.filled(P.unboxed(content, key))
    strings = lambda key: F.transform(P.unboxed_many(content, key), lambda x: P.filled(P.value(x, "$")))
    sid = F.coalesce(P.filled(top("id")), P.filled(top("forum")), F.lit("unknown"))
    page = F.concat(F.lit("https://openreview.net/forum?id="), F.coalesce(P.filled(top("forum")), sid))
    people = F.transform(strings("authors"), lambda n, i: author(n, None, _own_id("openreview", F.get(strings("authorids"), i))))
    venue = F.coalesce(get("venue"), get("venueid"))
    pdf = get("pdf")
    claims = [F.transform(strings("doi"), lambda x: claim("doi", X.doi(x))), *[F.transform(strings(k), lambda x: claim("arxiv", X.arxiv(x))) for k in ("arxiv", "arxiv_id")]]
    return _record(
        rows, "openreview", sid, source_url=page, title=F.coalesce(get("title"), sid), abstract=get("abstract"), authors=_named(people), publication_date=P.millis_date(F.coalesce(top("pdate"), top("cdate"), top("tcdate"))),
        work_type=F.when(venue.isNotNull(), "conference-paper").otherwise("preprint"), venue=venue, fields_of_study=F.filter(strings("keywords"), lambda k: k.isNotNull()), open_access=pdf.isNotNull(), landing_page_url=page,
        pdf_url=F.when(pdf.rlike("^https?://"), pdf).otherwise(F.concat(F.lit("https://openreview.net"), F.when(F.startswith(pdf, F.lit("/")), pdf).otherwise(F.concat(F.lit("/"), pdf)))),
        identifiers=F.array_distinct(F.filter(F.concat(F.array(claim("openreview", sid)), *claims), lambda c: c["value"].isNotNull())),
    )


def _inspire(rows: DataFrame, m: Column, sid: Column) -> DataFrame:
    there = lambda key: lambda x: P.filled(P.value(x, f"$.{key}")).isNotNull()
    text = lambda key: lambda x: P.filled(P.value(x, f"$.{key}"))
    page = F.concat(F.lit("https://inspirehep.net/literature/"), sid)
    first = F.get(P.one_or_many(m, "$.publication_info"), F.lit(0))
    people = F.transform(P.one_or_many(m, "$.authors"), lambda a: author(P.filled(P.value(a, "$.full_name"))))
    dois = F.transform(P.one_or_many(m, "$.dois"), lambda x: claim("doi", X.doi(P.value(x, "$.value"))))
    prints = F.transform(P.one_or_many(m, "$.arxiv_eprints"), lambda x: claim("arxiv", X.arxiv(P.value(x, "$.value"), False)))
    earliest = P.value(m, "$.earliest_date")
    when = P.iso_date(earliest)
    return _record(
        rows, "inspire", sid, source_url=page, title=F.coalesce(P.first(P.one_or_many(m, "$.titles"), there("title"), text("title")), F.concat(F.lit("INSPIRE reference "), sid)),
        abstract=P.first(P.one_or_many(m, "$.abstracts"), there("value"), text("value")), authors=_named(people), publication_date=when,
        publication_year=F.coalesce(P.int_or_null(P.value(first, "$.year")), P.leading_year(earliest), F.year(when)), work_type=F.lower(P.value(m, "$.document_type[0]")),
        venue=F.coalesce(P.filled(P.value(first, "$.journal_title")), P.value(first, "$.conference_title")), landing_page_url=page,
        identifiers=F.array_distinct(F.filter(F.concat(F.array(claim("inspire", sid)), dois, prints), lambda c: c["value"].isNotNull())), citation_count=P.int_or_null(P.value(m, "$.citation_count")),
    )


def inspire(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    return _inspire(rows, F.try_variant_get(v, "$.metadata", "variant"), F.coalesce(P.filled(P.value(v, "$.id")), P.filled(P.value(v, "$.metadata.control_number")), F.lit("unknown")))


def inspire_references(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Entries of a bibliography; those without a linked record get an id from their content."""
    rows, v = _json(rows, column)
    linked = P.last_segment(P.value(v, "$.record['$ref']"))
    sid = F.coalesce(P.filled(linked), F.concat(F.lit("unlinked-"), P.content_id(16, F.to_json(v))))
    return _inspire(rows, F.coalesce(F.try_variant_get(v, "$.reference", "variant"), v), sid)


def id_tokens(c: Column | str) -> Column:
    """``scheme:value`` tokens of a list separated by spaces, in lower case."""
    return F.filter(F.split(F.lower(P.col(c)), r"\s+"), lambda t: t.contains(":"))


def _preferred(tokens: Column) -> Column:
    by = lambda p: P.first(tokens, lambda t: F.startswith(t, F.lit(p)), lambda t: t)
    return F.coalesce(by("doi:"), by("pmid:"), by("omid:"))


def opencitations(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path: P.value(v, f"$.{path}")
    ids = F.coalesce(id_tokens(get("id")), F.array().cast(P.STRINGS))
    sid = F.coalesce(_preferred(ids), F.get(ids, F.lit(0)), F.lit("unknown"))
    of = lambda p: P.first(ids, lambda t: F.startswith(t, F.lit(p)), lambda t: F.substring(t, len(p) + 1, 500))
    page = F.coalesce(_urls_doi(of("doi:")), F.concat(F.lit("https://w3id.org/oc/meta/"), of("omid:")))
    scheme, raw = lambda t: F.split_part(t, F.lit(":"), F.lit(1)), lambda t: F.regexp_extract(t, r"^[^:]*:(.*)$", 1)
    claims = F.transform(F.filter(ids, lambda t: scheme(t).isin("doi", "openalex", "pmid", "pmcid", "omid")), lambda t: F.struct(scheme(t).alias("scheme"), F.when(scheme(t) == "doi", X.doi(raw(t))).when(scheme(t) == "openalex", F.upper(raw(t))).otherwise(raw(t)).alias("value")))
    when = P.iso_date(get("pub_date"))
    return _record(
        rows, "opencitations", sid, source_url=page, title=F.coalesce(P.filled(get("title")), sid), authors=F.transform(F.coalesce(P.listed_names(get("author")), F.array().cast(P.STRINGS)), lambda n: author(n)),
        publication_date=when, publication_year=F.coalesce(F.year(when), P.leading_year(get("pub_date"))), work_type=P.filled(F.lower(get("type"))), venue=P.filled(F.regexp_replace(get("venue"), r"\s+\[.*\]$", "")),
        landing_page_url=page, identifiers=F.filter(claims, lambda c: F.coalesce(c["value"] != "", F.lit(False))),
    )


def enriched(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """``edges`` (``edge, ids``: tokens) with the first metadata row (``ids, ord, title``) that shares a token, or null."""
    tokens = metadata.select(F.explode("ids").alias("token"), F.struct("ord", "title").alias("m")).groupBy("token").agg(F.min("m").alias("m"))
    found = edges.select("edge", F.explode("ids").alias("token")).join(tokens, "token").groupBy("edge").agg(F.min("m").alias("m"))
    return edges.join(found, "edge", "left").select(*edges.columns, F.col("m.title").alias("title"))


def google_scholar_serpapi(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    cites, cluster = P.filled(get("inline_links.cited_by.cites_id")), P.filled(get("inline_links.versions.cluster_id"))
    sid = F.coalesce(P.filled(get("result_id")), cites, P.content_id(24, get("title"), get("link")))
    summary = F.coalesce(get("publication_info.summary"), F.lit(""))
    listed = _named(F.transform(P.one_or_many(v, "$.publication_info.authors"), lambda a: author(P.value(a, "$.name"))))
    written = F.transform(F.filter(F.transform(F.split(F.split_part(summary, F.lit(" - "), F.lit(1)), ","), lambda n: F.trim(n)), lambda n: n != ""), lambda n: author(n))
    text = F.concat_ws(" ", get("title"), get("link"), get("snippet"), F.replace(summary, F.lit("arxiv. org"), F.lit("arxiv.org")))
    doi = X.doi(F.regexp_extract(text, r"(?i)\b10\.\d{4,9}/[^\s<>\]}]+", 0))
    pre = X.arxiv(F.regexp_extract(text, r"(?i)arxiv\.org/(?:abs|pdf)/([a-z.\-/0-9]*\d)", 1), False)
    pdf = P.first(P.one_or_many(v, "$.resources"), lambda r: F.lower(P.value(r, "$.file_format")) == "pdf", lambda r: P.value(r, "$.link"))
    count = P.int_or_null(get("inline_links.cited_by.total"))
    return _record(
        rows, "google_scholar", sid, provider=F.lit("google_scholar_serpapi"), source_url=get("link"), work_family_id=F.concat(F.lit("google_scholar_cluster:"), cluster), title=F.coalesce(P.filled(get("title")), F.lit("Untitled Google Scholar result")),
        abstract=get("snippet"), authors=F.when(F.size(listed) > 0, listed).otherwise(written), publication_year=P.last_year(summary), landing_page_url=get("link"), pdf_url=pdf, open_access=pdf.isNotNull(),
        identifiers=_claims(claim("google_scholar", cites), claim("doi", doi), claim("arxiv", pre)), citation_count=F.when(count >= 0, count),
    )


def ads(rows: DataFrame, column: str = "payload") -> DataFrame:
    rows, v = _json(rows, column)
    get = lambda path, kind="string": P.value(v, f"$.{path}", kind)
    sid = get("bibcode")
    page = F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), F.url_encode(sid), F.lit("/abstract"))
    values = F.transform(F.concat(P.one_or_many(v, "$.doi"), P.one_or_many(v, "$.identifier")), lambda x: P.value(x, "$"))
    inner = lambda d: F.when(F.startswith(d, F.lit("10.48550/arxiv.")), X.arxiv(F.substring(d, 16, 60), False))
    claims = F.flatten(F.transform(values, lambda x: F.array(claim("doi", X.doi(x)), claim("arxiv", F.coalesce(inner(X.doi(x)), X.arxiv(x, False))))))
    return _record(
        rows, "ads", sid, source_url=page, title=P.value(F.get(P.one_or_many(v, "$.title"), F.lit(0)), "$"), abstract=get("abstract"), authors=_named(F.transform(P.one_or_many(v, "$.author"), lambda a: author(P.value(a, "$")))),
        publication_year=P.int_or_null(get("year")), venue=get("pub"), landing_page_url=page, identifiers=F.array_distinct(F.filter(claims, lambda c: c["value"].isNotNull())), citation_count=P.int_or_null(get("citation_count")),
    )


@dataclass(frozen=True)
class Source:
    """A source: how its payloads are read, which conditions it evaluates itself, and what it knows of relations (``list``, ``count``, ``none``)."""

    name: str
    mapper: Callable[..., DataFrame]
    filters: tuple[str, ...] = ()
    unsupported: tuple[str, ...] = ()
    references: str = "none"
    citations: str = "none"


class Registry:
    """Sources by name; a second one of a name is an error."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        if source.name in self._sources:
            raise ValueError(f"source {source.name} is there already")
        self._sources[source.name] = source

    def __getitem__(self, name: str) -> Source:
        if name not in self._sources:
            raise ValueError(f"no source {name}")
        return self._sources[name]

    def names(self) -> list[str]:
        return list(self._sources)

    def __iter__(self) -> Iterator[Source]:
        return iter(self._sources.values())

    def records(self, payloads: DataFrame, sources: Sequence[str] | None = None, provider: str = "provider", column: str = "payload") -> DataFrame:
        """The records of ``sources`` (all registered ones) in one table of payloads, told apart by ``provider``, a column to partition the table by."""
        parts = [self[name].mapper(payloads.where(F.col(provider) == name), column) for name in (sources or self.names())]
        if not parts:
            raise ValueError("no source is registered")
        return reduce(DataFrame.unionByName, parts)


#: What the public interfaces offer. Names of conditions are those of ``search.Filters``.
SOURCES = Registry()
for _s in (
    Source("openalex", openalex, ("text", "year_from", "year_to", "author", "open_access", "title", "min_citations", "sort"), (), "list", "list"),
    Source("semantic_scholar", semantic_scholar, ("text", "year_from", "year_to", "open_access"), (), "list", "list"),
    Source("crossref", crossref, ("text", "year_from", "year_to", "author"), ("open_access",), "list", "count"),
    Source("europe_pmc", europe_pmc, ("text", "year_from", "year_to", "author", "open_access"), (), "list", "list"),
    Source("arxiv", arxiv, ("text", "year_from", "year_to", "author"), ("open_access",)),
    Source("datacite", datacite, ("text", "year_from", "year_to", "author", "title", "sort"), ("open_access",), "none", "count"),
    Source("dblp", dblp, ("text",)),
    Source("acl_anthology", acl_anthology, ("text",)),
    Source("openaire", openaire, ("text", "title", "author", "year_from", "year_to", "sort")),
    Source("openreview", openreview, ("text",)),
    Source("inspire", inspire, ("text", "sort"), (), "list", "list"),
    Source("opencitations", opencitations, (), ("text",), "list", "list"),
    Source("google_scholar_serpapi", google_scholar_serpapi, ("text", "year_from", "year_to", "author", "venue"), (), "none", "list"),
    Source("ads", ads, ("text",), (), "list", "list"),
):
    SOURCES.register(_s)
