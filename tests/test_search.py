import pytest

from quillmesh.functions import text as X
from quillmesh.operators import search as S

SCHEMA = "record_id string, title string, abstract string, venue string, authors array<string>, fields_of_study array<string>, publication_year int, open_access boolean, work_type string, citations long"


def rows(spark, *given):
    base = dict(record_id="x", title="Graph neural networks", abstract="Reproducible retrieval", venue="Evidence", authors=["Ann B."], fields_of_study=["Computer Science"], publication_year=2020, open_access=None, work_type="article", citations=3)
    return spark.createDataFrame([tuple((base | g)[c.split(" ")[0]] for c in SCHEMA.split(", ")) for g in given], SCHEMA)


def ids(df):
    return sorted(r.record_id for r in df.collect())


def test_filters_and_nulls(spark):
    df = rows(spark, {"record_id": "a"}, {"record_id": "b", "publication_year": None}, {"record_id": "c", "open_access": False}, {"record_id": "d", "work_type": None}, {"record_id": "e", "work_type": "Erratum"}, {"record_id": "f", "title": None, "citations": None, "authors": None})
    assert ids(df.where(S.Filters().condition())) == ["a", "b", "c", "d", "f"]
    assert ids(df.where(S.Filters(year_from=2019, year_to=2020).condition())) == ["a", "c", "d", "f"]
    assert ids(df.where(S.Filters(open_access=False).condition())) == ["c"]
    assert ids(df.where(S.Filters(work_types=(" ERRATUM",)).condition())) == ["e"]
    assert ids(df.where(S.Filters(title="NEURAL", author="ann", min_citations=1, field_of_study="computer").condition())) == ["a", "b", "c", "d"]
    assert S.Filters(title="x", year_to=3).plan(("title",)) == [("title", "provider"), ("year_to", "local")]


def test_boolean_expressions(spark):
    df = rows(spark, {"record_id": "a"}, {"record_id": "b", "abstract": None}, {"record_id": "c", "title": "Networks graph", "authors": ["Bob"]})
    T = S.Node
    tree = T("and", children=[T("phrase", "graph  neural networks", "title"), T("not", children=[T("term", "clinical", "abstract")]), T("or", children=[T("term", "reproducible", "abstract"), T("term", "Bob", "author")])])
    assert ids(df.where(tree.condition())) == ["a"]
    assert ids(df.where(T("term", "networks graph").condition())) == ["a", "b", "c"]
    assert ids(df.where(T("not", children=[T("term", "retrieval", "abstract")]).condition())) == ["b"]
    for bad in (lambda: T("not"), lambda: T("term"), lambda: T("and", children=[T("term", "x")]), lambda: T("or", field="title", children=[T("term", "x")] * 2)):
        with pytest.raises(ValueError):
            bad()


def test_tokens_and_stems(spark):
    words = "harnesses retrieving retrieved queries analysis class bert boxes"
    got = spark.createDataFrame([(words,), ("of the",), (None,)], "t string").select(X.search_tokens("t").alias("x")).collect()
    assert [sorted(r.x) for r in got] == [sorted(["harness", "retriev", "query", "analysis", "class", "bert", "boxe"]), ["of", "the"], []]


def test_identifiers(spark):
    df = spark.createDataFrame([("https://doi.org/10.1234/ABC%2B1.",), ("arXiv:2101.00001v2",), ("https://openalex.org/w12",), ("https://aclanthology.org/P19-1001.pdf",), ("https://openreview.net/forum?id=abc_1&x=2",), ("none of it here",)], "v string")
    r = [tuple(x) for x in df.select(X.doi("v"), X.arxiv("v"), X.openalex("v"), X.acl("v"), X.openreview("v")).collect()]
    assert r[0][0] == "10.1234/abc+1" and r[1][1] == "2101.00001v2" and r[2][2] == "W12" and r[3][3] == "P19-1001" and r[4][4] == "abc_1" and r[5] == (None,) * 5


def test_relevance_and_retractions(spark):
    df = rows(spark, {"record_id": "a", "title": "Dense retrieval for open domain question answering"}, {"record_id": "b", "title": "RETRACTED: Dense retrieval for open domain question answering"}, {"record_id": "c", "title": "Other things", "abstract": None})
    ranks = spark.createDataFrame([("a", "p", 2), ("b", "p", 1), ("b", "q", 1), ("c", "p", 3), ("c", "p", None)], "record_id string, provider string, rank int")
    got = S.relevance(df, ranks, "dense retrieval open domain question answering").orderBy("score", ascending=False).collect()
    assert [r.record_id for r in got] == ["a", "b", "c"] and got[1].best_rank == 1


def test_rrf_overlaps_status(spark):
    lists = spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("q", "y", 1), ("q", "x", 2)], "provider string, record_id string, rank int")
    assert len({round(r.score, 12) for r in S.rrf(lists).collect()}) == 1
    works = lists.select("provider", lists.record_id.alias("work")).unionAll(spark.createDataFrame([("r", "z")], "provider string, work string"))
    o = {(r.left_provider, r.right_provider): (r.shared, r.jaccard) for r in S.overlaps(works).collect()}
    assert o == {("p", "q"): (2, 1.0), ("p", "r"): (0, 0.0), ("q", "r"): (0, 0.0)}
    c = {r.provider: (r.unique_works, r.shared_works) for r in S.contributions(works).collect()}
    assert c == {"p": (0, 2), "q": (0, 2), "r": (1, 0)}
    reports = [("a", "skipped", 0), ("b", "complete", 2), ("b", "partial", 0), ("c", "complete", 0), ("c", "empty", 0), ("d", "failed", 0), ("d", "throttled", 0), ("e", "failed", 0), ("f", "complete", 1), ("f", "failed", 0)]
    got = S.overall_status(spark.createDataFrame(reports, "k string, status string, results int"), "k").collect()
    assert {r.k: r.status for r in got} == {"a": "degraded", "b": "partial", "c": "empty", "d": "throttled", "e": "failed", "f": "partial"}


def test_trees_from_json_and_plans():
    import pytest

    from quillmesh.operators.service import plan_search
    from quillmesh.sources.mappers import SOURCES

    tree = S.Node.from_json('{"operator": "AND", "children": [{"operator": "phrase", "field": "title", "value": "dry moss"}, {"operator": "not", "children": [{"operator": "term", "value": "kiln"}]}]}')
    assert (tree.kind, tree.children[0].field, tree.children[1].children[0].value) == ("and", "title", "kiln")
    for bad in ('{"operator": "xor"}', '{"value": "x"}', '{"operator": "term", "value": "x", "boost": 2}', '{"operator": "and", "children": []}', "[]"):
        with pytest.raises(ValueError):
            S.Node.from_json(bad)
    plan = {(s, f): e for s, f, e in plan_search(S.Filters(year_from=2000, open_access=True), SOURCES)}
    assert plan["openalex", "year_from"] == "provider" and plan["dblp", "year_from"] == "local" and plan["arxiv", "open_access"] == "unsupported" and plan["opencitations", "text"] == "unsupported"
