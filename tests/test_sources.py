import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import identifiers as X
from quillmesh.functions import payloads as P
from quillmesh.functions import text as T
from quillmesh.sources import mappers as M

KILN = {"titles": [{"title": ""}, {"title": " Kilns "}], "creators": [{"name": "Amadi"}], "publicationYear": "2018", "descriptions": [{"descriptionType": "Abstract", "description": "Of clay."}], "types": {"resourceTypeGeneral": "Dataset"}}
CASES = [
    ("openalex", {"id": "https://openalex.org/w77", "ids": {"pmid": "https://x/99"}, "doi": "https://doi.org/10.5555/AB", "display_name": "Moss", "abstract_inverted_index": {"dry": [1], "moss": [0, 2]}, "authorships": [{"author": {"id": "https://openalex.org/a1", "display_name": "Una"}}, {"author": {"display_name": ""}}], "publication_date": "2020-02-30", "cited_by_count": 5},
     {"record_id": "openalex:W77", "title": "Moss", "abstract": "moss dry moss", "publication_date": None, "citation_count": 5, "names": ["Una"], "ids": ["openalex=W77", "doi=10.5555/ab", "pmid=99"]}),
    ("semantic_scholar", {"paperId": "s1", "publicationVenue": "Plain Letters", "externalIds": {"ArXiv": "2101.00001v2"}, "authors": [{"name": "Bo", "authorId": "7"}, {"authorId": "8"}], "publicationTypes": ["Review"]},
     {"title": "Untitled s1", "venue": "Plain Letters", "work_type": "Review", "names": ["Bo"], "ids": ["semantic_scholar=s1", "arxiv=2101.00001"], "citation_count": 0}),
    ("crossref", {"DOI": "10.5555/X", "title": ["Ａsh &amp; clay"], "author": [{"given": "Ife", "family": "Okoro"}, {}], "published-print": {"date-parts": [[None]]}, "issued": {"date-parts": [[2019, 3]]}, "abstract": "<p>x &lt; y</p>", "is-referenced-by-count": -1},
     {"title": "Ash & clay", "abstract": "x < y", "publication_date": datetime.date(2019, 3, 1), "publication_year": 2019, "citation_count": 0, "names": ["Ife Okoro"]}),
    ("europe_pmc", {"source": "pmc", "id": "PMC4", "authorList": {"author": {"firstName": "Li", "lastName": "Wu"}}, "pubTypeList": {"pubType": ["review", "letter"]}, "isOpenAccess": "maybe", "pubYear": "x", "fullTextUrlList": {"fullTextUrl": {"url": "b", "documentStyle": "pdf"}}},
     {"record_id": "europe_pmc:PMC:PMC4", "work_type": "review", "open_access": None, "publication_year": None, "pdf_url": "b", "landing_page_url": "https://europepmc.org/article/PMC/PMC4", "names": ["Li Wu"], "ids": ["pmcid=PMC4"]}),
    ("datacite", {"id": "10.5555/d", "attributes": KILN}, {"title": "Kilns", "abstract": "Of clay.", "publication_year": 2018, "work_type": "dataset", "names": ["Amadi"]}),
    ("dblp", {"key": "k/1", "title": "Slate.", "authors": {"author": "Novak"}, "year": "2001", "type": "Article", "access": "closed"}, {"title": "Slate", "publication_date": datetime.date(2001, 1, 1), "open_access": False, "names": ["Novak"], "work_type": "article"}),
    ("openaire", {"id": "oa::1", "descriptions": "One text", "publicationDate": "2020", "instances": [{"urls": ["ftp://x", "http://y"]}], "bestAccessRight": {"label": "Restricted"}, "pids": [{"scheme": "pmc", "value": "PMC1"}], "type": "Software"},
     {"title": "oa::1", "abstract": "One text", "publication_date": None, "publication_year": 2020, "open_access": False, "landing_page_url": "http://y", "work_type": "software", "ids": ["openaire=oa::1", "pmcid=PMC1"]}),
    ("openreview", {"id": "n1", "forum": "f1", "cdate": 1600000000000, "content": {"title": {"value": "Tides"}, "authors": ["A", "B"], "authorids": {"value": ["~A1"]}, "pdf": "/pdf/x.pdf", "doi": ["10.5555/o", "10.5555/O"]}},
     {"title": "Tides", "publication_date": datetime.date(2020, 9, 13), "work_type": "preprint", "pdf_url": "https://openreview.net/pdf/x.pdf", "landing_page_url": "https://openreview.net/forum?id=f1", "names": ["A", "B"], "ids": ["openreview=n1", "doi=10.5555/o"]}),
    ("inspire", {"id": "5", "metadata": {"publication_info": [{"year": 1999, "conference_title": "C"}], "arxiv_eprints": [{"value": "hep-th/9901001"}], "earliest_date": "1998-01"}}, {"title": "INSPIRE reference 5", "publication_year": 1999, "publication_date": None, "venue": "C", "ids": ["inspire=5", "arxiv=hep-th/9901001"]}),
    ("inspire_references", {"reference": {"titles": [{"title": "R"}]}}, {"title": "R"}),
    ("opencitations", {"id": "omid:br/1 pmid:3", "author": "Doe, A [omid:ra/1]; Roe, B;", "pub_date": "2001-05", "venue": "J [omid:br/2]"}, {"record_id": "opencitations:pmid:3", "names": ["Doe, A", "Roe, B"], "publication_year": 2001, "venue": "J", "landing_page_url": "https://w3id.org/oc/meta/br/1"}),
    ("google_scholar_serpapi", {"title": "T", "link": "l", "publication_info": {"summary": "A B, C D - J, 2001 - x 2003"}, "snippet": "see 10.5555/g and"}, {"names": ["A B", "C D"], "publication_year": 2003, "open_access": False, "ids": ["doi=10.5555/g"], "provider": "google_scholar_serpapi"}),
    ("ads", {"bibcode": "2001A&A", "title": ["T"], "doi": ["10.48550/arxiv.2101.00001"], "identifier": ["arXiv:2101.00001v3"]}, {"landing_page_url": "https://ui.adsabs.harvard.edu/abs/2001A%26A/abstract", "ids": ["doi=10.48550/arxiv.2101.00001", "arxiv=2101.00001"]}),
    ("arxiv", '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:a="u"><id>http://arxiv.org/abs/2101.00001v2</id><title> Kiln\n ash</title><published>2021-01-02T00:00:00Z</published><author><name>X Y</name></author><link href="h" type="application/pdf"/><a:primary_category term="cs.CL"/></entry>',
     {"record_id": "arxiv:2101.00001v2", "work_family_id": "arxiv:2101.00001", "title": "Kiln ash", "pdf_url": "h", "venue": "cs.CL", "publication_year": 2021}),
    ("dblp_xml", '<!DOCTYPE dblp SYSTEM "dblp.dtd"><dblp><proceedings key="conf/x"><editor>A B</editor><title>T.</title><booktitle>C</booktitle><year>2003</year><ee type="oa">https://doi.org/10.5555/q</ee></proceedings></dblp>',
     {"record_id": "dblp:conf/x", "work_type": "proceedings", "names": ["A B"], "venue": "C", "open_access": True, "ids": ["dblp=conf/x", "doi=10.5555/q"]}),
    ("acl_anthology", '<mods xmlns="m"><titleInfo><title>T x</title></titleInfo><name><namePart>Solo Name</namePart><role><roleTerm>author</roleTerm></role></name><name><namePart>Ed</namePart><role><roleTerm>editor</roleTerm></role></name><originInfo><dateIssued>2020-13</dateIssued></originInfo></mods>',
     {"record_id": "acl_anthology:2020.abc-main.1", "names": ["Solo Name"], "publication_date": datetime.date(2020, 1, 1), "open_access": True}),
]


@pytest.mark.parametrize("name,payload,want", CASES, ids=[c[0] for c in CASES])
def test_mapper(spark, name, payload, want):
    """Also: unreadable and null payloads give no record, other columns are ignored."""
    body = payload if isinstance(payload, str) else json.dumps(payload)
    rows = spark.createDataFrame([(body, "2020.abc-main.1", 1), ("{broken <", "x", 2), (None, "x", 3)], "payload string, key string, title int")
    got = getattr(M, name)(rows).where("record_id IS NOT NULL AND title IS NOT NULL").collect()
    (r,) = got
    found = r.asDict(True) | {"names": [a.name for a in r.authors], "ids": [f"{c.scheme}={c.value}" for c in r.identifiers]}
    assert {k: found[k] for k in want} == want
    assert r.record_id.startswith(f"{name.removesuffix('_references').removesuffix('_serpapi').removesuffix('_xml')}:")


def test_refused_and_registered(spark):
    rows = spark.createDataFrame([('<!DOCTYPE a [<!ENTITY x "y">]><entry><id>http://arxiv.org/abs/2101.00001</id></entry>',)], "payload string")
    assert M.arxiv(rows).count() == 0 and M.dblp_xml(rows).count() == 0
    own = M.Registry()
    own.register(M.Source("ads", M.ads))
    with pytest.raises(ValueError):
        own.register(M.Source("ads", M.ads))
    with pytest.raises(ValueError):
        own["dblp"]
    two = spark.createDataFrame([("ads", '{"bibcode":"b","title":["T"]}'), ("other", "{}")], "provider string, payload string")
    assert [r.record_id for r in own.records(two).collect()] == ["ads:b"] and len(M.SOURCES.names()) == 14
    linked, rest = M.crossref_references(spark.createDataFrame([(json.dumps({"DOI": "10.5555/s", "reference": [{"DOI": "10.5555/T", "year": "2001a"}, {"unstructured": "u"}]}),)], "payload string"))
    assert [(r.ordinal, r.doi, r.title, r.year) for r in linked.collect()] == [(1, "10.5555/t", "DOI 10.5555/t", None)] and [(r.ordinal, r.reason) for r in rest.collect()] == [(2, "no_identifier")]
    edges = spark.createDataFrame([("e", ["doi:1", "pmid:2"]), ("f", ["doi:9"])], "edge string, ids array<string>")
    meta = spark.createDataFrame([(["pmid:2"], 2, "late"), (["doi:1", "x:1"], 1, "early")], "ids array<string>, ord int, title string")
    assert {r.edge: r.title for r in M.enriched(edges, meta).collect()} == {"e": "early", "f": None}


def column(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").orderBy("k").select(f(F.col("x"))).collect()]


def test_identifiers(spark):
    assert column(spark, X.arxiv, ["arXiv:2101.00001V2", "https://arxiv.org/pdf/math.GT/0309136v1.pdf", "https://arxiv.org/abs/2101.00001?x=1", "2101.001", "https://example.org/abs/2101.00001", None, ""]) == ["2101.00001v2", "math.gt/0309136v1", None, None, None, None, None]
    assert column(spark, X.openreview, ["https://www.openreview.net/forum?id=aB_1~x&n=2", "openreview: aB9", "a", "https://openreview.net/group?id=abc", "a b c"]) == ["aB_1~x", "aB9", None, None, None]
    assert column(spark, X.acl, ["https://aclanthology.org/p19-1001.pdf", "ACL:2020.ABC-Main.12", "10.18653/v1/2021.naacl-main.4", "https://aclanthology.org/2020.abc-main.1/", "P1-1", "x"]) == ["P19-1001", "2020.abc-main.12", "2021.naacl-main.4", "2020.abc-main.1", None, None]
    assert column(spark, X.semantic_scholar_key, ["10.5555/A", "arxiv:2101.00001v3", "pmid:12", "34", "abc"]) == ["DOI:10.5555/a", "ARXIV:2101.00001", "PMID:12", "PMID:34", "abc"]
    assert column(spark, X.europe_pmc_key, ["europe_pmc:ppr:7", "PMID:12", "34", "pmcid:pmc5", "PMC6", "x"]) == ["PPR:7", "MED:12", "MED:34", "PMC:PMC5", "PMC:PMC6", None]
    assert column(spark, X.ads_query, ["https://ui.adsabs.harvard.edu/abs/2001Ap/x", "ads:2001A", "10.48550/arXiv.2101.00001v2", "10.5555/a", "z"]) == ['identifier:"2001Ap"', 'bibcode:"2001A"', 'identifier:"arXiv:2101.00001"', 'doi:"10.5555/a"', 'identifier:"z"']
    assert column(spark, X.opencitations_key, ["10.5555/A", "OMID:br/1", "omid:", "x"]) == ["doi:10.5555/a", "omid:br/1", None, None]
    assert column(spark, X.openaire_key, ["10.5555/A", "2101.00001v1", "pmcid:PMC1", "x"]) == ["10.5555/a", "2101.00001", "PMC1", None]
    claims = spark.sql("SELECT array(struct('openalex' AS scheme, 'W1' AS value), struct('pmid' AS scheme, '9' AS value), struct('x' AS scheme, 'y' AS value)) AS c, array(struct('x' AS scheme, 'y' AS value)) AS d")
    assert claims.select(X.preferred("c")["value"], X.preferred("d")).first() == ("9", None)


def test_scalars(spark):
    assert column(spark, P.partial_date, ["2020", "2020-05", "2020-05-40", "x", None]) == [datetime.date(2020, 1, 1), datetime.date(2020, 5, 1), datetime.date(2020, 1, 1), None, None]
    assert column(spark, P.yes_no, ["Y", " no ", "?", None]) == [True, False, None, None] and column(spark, P.int_or_null, ["12", "1.5", "", None]) == [12, None, None, None]
    assert column(spark, P.iso_date, ["2020-02-29T01", "2020-02-30", "2020"]) == [datetime.date(2020, 2, 29), None, None] and column(spark, P.last_year, ["1999, 2001", "12345"]) == [2001, None]
    assert column(spark, P.without_markup, ["<b>a</b>&amp;<i>b</i>", "<p></p>", None]) == ["a &b".replace("&", "& "), None, None]
    assert column(spark, T.normal_text, ["ﬁne   Ａ", "plain  x", None]) == ["fine A", "plain x", None] and column(spark, T.casefold, ["STRAẞE", "Straße", "Σας"]) == ["strasse", "strasse", "σασ"]
    assert column(spark, T.redacted_url, ["https://x/y?q=1&API_KEY=s&z=2#f"]) == ["https://x/y?q=1&API_KEY=%5BREDACTED%5D&z=2#f"] and column(spark, T.search_terms, ["The use of moss", "of the"]) == [["use", "moss"], ["of", "the"]]
    now = F.lit(datetime.datetime(2030, 1, 1, 0, 0, 0))
    assert column(spark, lambda c: T.retry_after(c, now), ["7", "-3", "Tue, 01 Jan 2030 00:01:00 GMT", "x", None])[:3] == [7.0, 0.0, 60.0]
