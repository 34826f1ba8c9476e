import pytest

from quillmesh.operators import linking as L
from quillmesh.sources import bibliographies as B
from quillmesh.sources import exports as E

JATS = """<!DOCTYPE article SYSTEM "x.dtd"><article><body><sec><title>Tide gauges</title><p>Gauges drift <xref ref-type="bibr" rid="tide-04">4</xref>, <xref ref-type="fig" rid="f1">Fig. 1</xref>.</p></sec>
<sec><title>Outlook</title><p>Others <xref ref-type="bibr" rid="tide-04 tide-77">4, 77</xref> differ.</p></sec></body><back><ref-list>
<ref id="tide-04"><element-citation><person-group><name><surname>Okoro</surname><given-names>Ife</given-names></name><collab>Harbour Group</collab></person-group><article-title>Drift of gauges</article-title><source>Coast Letters</source><year>c. 1998</year><volume>12</volume><issue>3</issue><fpage>101</fpage><lpage>119</lpage><pub-id pub-id-type="doi">10.55555/CL.98.</pub-id></element-citation></ref>
<ref id="tide-05"><article-title>Left out</article-title></ref></ref-list></back></article>"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Mosses</head><p>Mosses dry <ref type="bibr" target="#m7">(7)</ref> and recover <ref type="bibr" target="#m8">(8)</ref>.</p></div></body>
<back><listBibl><biblStruct xml:id="m7"><analytic><title level="a">Drying of mosses</title><author><persName><forename>Una</forename><surname>Birk</surname></persName></author></analytic><monogr><title level="j">Annals of Moss</title><imprint><biblScope unit="volume">9</biblScope><date when="2004-11"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
LATEX = r"""\section{Kilns} A \emph{kiln} cools slowly \citep[see][ch. 2]{kiln88, glaze} % \cite{hidden}
\begin{thebibliography}{2}\bibitem{kiln88} R. Amadi, \emph{Kilns and time}, 1988. doi:10.55555/kt.88
\bibitem{ash} S. Novak. Ash.\end{thebibliography}"""
BIBTEX = r"""@string{ql = "Quarry Letters"} @preamble{"x"} @article{slate, title = {Slate {and} shale}, author = "Amadi, Ruth and Novak, S.", journal = ql # { Supplement}, year = 1991, volume={4}, number={2}, pages={7--19}, doi={10.55555/QL.7}}
@book(chalk, title = "Chalk {cliffs}", booktitle={Coasts}) @misc{slate, title={Again}}"""


def test_formats():
    a, b = (dict(zip(B.NAMES, r, strict=True)) for r in B.jats(JATS))
    assert (a["reference_id"], a["ordinal"], a["cited"], a["evidence"], a["callouts"], a["section"]) == ("tide-04", 1, True, "verified_anchor", 2, "Tide gauges")
    assert (a["title"], a["authors"], a["year"], a["doi"], a["venue"]) == ("Drift of gauges", ["Ife Okoro", "Harbour Group"], 1998, "10.55555/cl.98", "Coast Letters")
    assert (a["volume"], a["issue"], a["pages"], b["cited"]) == ("12", "3", "101-119", False)
    (t,) = (dict(zip(B.NAMES, r, strict=True)) for r in B.tei(TEI))
    assert (t["reference_id"], t["title"], t["authors"], t["year"], t["venue"], t["volume"], t["callouts"], t["section"]) == ("m7", "Drying of mosses", ["Una Birk"], 2004, "Annals of Moss", "9", 1, "Mosses")
    x, y = (dict(zip(B.NAMES, r, strict=True)) for r in B.latex(LATEX))
    assert (x["reference_id"], x["year"], x["doi"], x["section"]) == ("kiln88", 1988, "10.55555/kt.88", "Kilns") and "cools slowly" in x["context"] and not y["cited"]
    p, q = (dict(zip(B.NAMES, r, strict=True)) for r in B.bibtex(BIBTEX))
    assert (p["title"], p["authors"], p["year"], p["doi"], p["pages"], p["volume"], p["issue"], p["venue"]) == ("Slate and shale", ["Amadi, Ruth", "Novak, S."], 1991, "10.55555/ql.7", "7-19", "4", "2", "ql Supplement")
    assert (q["title"], q["venue"]) == ("Chalk cliffs", "Coasts")
    assert B.dangling("jats", JATS) == ["tide-77"] and B.dangling("tei", TEI) == ["m8"] and B.dangling("latex", LATEX) == ["glaze"]
    with pytest.raises(ValueError):
        B.safe_xml('<!DOCTYPE a [<!ENTITY x "y">]><a/>')
    with pytest.raises(ValueError):
        B.bibtex("@article{k, title={x}")


def test_extracted(spark):
    docs = [("1", "jats", JATS, 0), ("2", "bibtex", BIBTEX, 0), ("3", "jats", "<broken", 0), ("4", "latex", None, 0), ("5", "word", "x", 0)]
    df = spark.createDataFrame(docs, "doc string, format string, content string, title int")
    assert sorted((r.doc, r.reference_id, r.evidence) for r in B.extracted(df).collect() if r.reference_id) == [("1", "tide-04", "verified_anchor"), ("2", "chalk", "bibliography_only"), ("2", "slate", "bibliography_only")]
    assert sorted(r.doc for r in B.extracted(df).collect() if r.evidence == "failed") == ["3", "5"]
    assert len(B.extracted(df, True).where("doc = '1'").collect()) == 2
    told = {(r.doc, r.reference_id, r.kind) for r in B.warnings(df).collect()}
    assert told == {("1", "tide-77", "dangling_callout"), ("1", "tide-05", "uncited_reference"), ("2", "slate", "uncited_reference"), ("2", "slate", "duplicate_key"), ("2", "chalk", "uncited_reference")}


def test_scores_and_decisions(spark):
    cols = "entry string, candidate string, title string, authors array<string>, year int, venue string, c_title string, c_authors array<string>, c_year int, c_venue string, by_id boolean"
    rows = [("a", "x", "On X", ["Doe, A."], 2020, "V", "on x", ["Ann Doe"], 2020, "V", False), ("b", "x", "On X", None, 2020, None, "On X", None, None, None, False), ("c", "x", None, None, None, None, "t", None, None, None, False)]
    got = {r.entry: r.score for r in L.scored(spark.createDataFrame(rows, cols)).collect()}
    assert got["a"] == 1.0 and got["b"] == round(0.65 / 0.75, 6) and got["c"] == 0.0
    s = [("r", "x", 0.96, False), ("r", "y", 0.9, False), ("s", "x", 0.96, False), ("t", "x", 0.8, False), ("u", "x", 0.1, True), ("v", "x", 0.1, True), ("v", "y", 0.9, True)]
    d = {r.entry: r.status for r in L.decided(spark.createDataFrame(s, "entry string, candidate string, score double, by_id boolean")).collect()}
    assert d == {"r": "ambiguous", "s": "resolved", "t": "unresolved", "u": "resolved", "v": "ambiguous"}


def test_exports(spark):
    cols = "record_id string, title string, authors array<string>, publication_year int, venue string, doi string, landing_page_url string, providers array<string>"
    df = spark.createDataFrame([("p:1", "T", ["Ann Doe", "Bo Li"], 2020, "V", "10.1/x", None, ["p", "q"]), ("p:2", None, [], None, None, None, None, [])], cols)
    a, b = E.csv_rows(df).orderBy("record_id").collect()
    assert a.authors == "Ann Doe; Bo Li" and b.title == "" and b.publication_year == ""
    r = E.ris(df).orderBy("record_id").collect()
    assert r[0].entry.split("\n")[:4] == ["TY  - JOUR", "TI  - T", "AU  - Ann Doe", "AU  - Bo Li"] and r[1].entry.endswith("ER  - ")
    t = E.bibtex(df).orderBy("record_id").collect()
    assert t[0].entry.startswith("@article{doe2020") and t[1].entry.startswith("@article{anonnd")
    assert '"venue":null' in E.jsonl(df).orderBy("entry").collect()[1].entry
