import datetime
import difflib

import pytest


from quillmesh.operators import audit as A
from quillmesh.operators import evaluation as E
from quillmesh.operators import search as S
from quillmesh.operators import service as V

PAPERS = "record_id string, title string, abstract string, venue string, fields_of_study array<string>, authors array<string>, publication_year int, work_type string, open_access boolean, citations long"


def test_search_pushes_years_and_keeps_one_record_per_work(spark, tmp_path):
    rows = [("a:1", "Moss drying", None, "V", [], [], 2010, "article", True, 3), ("b:1", "Moss drying", "How moss dries", "V", None, None, 2010, "article", True, 7), ("a:2", "Moss", None, None, [], [], 1990, "article", None, 0), ("a:3", "Kilns", None, None, [], [], 2011, "Erratum", None, 0), ("a:4", "Retracted: moss drying", None, None, [], [], 2012, None, None, 1)]
    spark.createDataFrame(rows, PAPERS).write.parquet(str(tmp_path / "p"))
    papers = spark.read.parquet(str(tmp_path / "p"))
    ranked = spark.createDataFrame([("a", "a:1", 2), ("b", "b:1", 1), ("a", "a:2", 1), ("a", "a:3", 3), ("a", "a:4", 4)], "provider string, record_id string, rank int")
    groups = spark.createDataFrame([("a:1", "w"), ("b:1", "w"), ("a:2", "a:2"), ("a:3", "a:3"), ("a:4", "a:4")], "record_id string, root string")
    got = V.search(papers, ranked, groups, "moss drying", S.Filters(year_from=2000), 5).collect()
    assert [(r.rank, r.record_id) for r in got] == [(1, "a:1"), (2, "a:4")]
    assert [r.record_id for r in V.search(papers, ranked, groups, "x", S.Filters(year_from=2000), 5, "newest").collect()] == ["a:4", "a:1"]
    assert [r.score for r in V.search(papers, ranked, groups, "x", S.Filters(), 1, "citations").collect()] == [7.0]
    spark.conf.set("spark.sql.debug.maxToStringFields", "100")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = papers.where(S.Filters(year_from=2000, year_to=2020, open_access=True).condition())._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("DataFilters: ")[1].split("Format")[0] if "DataFilters: " in plan else plan
    assert "publication_year" in pushed and "2000" in pushed and "PushedFilters: [" in plan


def test_related_counts_repeats_and_lists_them_once(spark):
    lists = spark.createDataFrame([("p", "x", 1), ("p", "x", 1), ("q", "y", 1), ("q", "z", 2), ("q", "n", 1), ("p", "x", None)], "provider string, record_id string, rank int")
    groups = spark.createDataFrame([("x", "X"), ("n", "N")], "record_id string, root string")
    got = V.related(lists, groups, spark.createDataFrame([("N",)], "root string"), 2).collect()
    assert [(r.rank, r.root, len(r.evidence)) for r in got] == [(1, "X", 1), (2, "y", 1)] and abs(got[0].score - 2 / 61) < 1e-8


def test_relations(spark):
    day = datetime.datetime(2020, 1, 1)
    rows = [("s", "a", "crossref", 2), ("s", "b", "crossref", 1), ("s", "b", "crossref", 3), ("s", "c", "crossref", 4), ("s", "s", "ads", 1), ("x", "s", "ads", 1), ("s", "s2", "ads", 2)]
    said = spark.createDataFrame([(a, b, p, day + datetime.timedelta(days=d)) for a, b, p, d in rows], "subject_record_id string, object_record_id string, provider string, first_seen_at timestamp")
    seeds = spark.createDataFrame([("s",), ("s",), ("missing",)], "record_id string")
    assert sorted(tuple(r) for r in V.relations(said, seeds, "references", 2).collect()) == [("s", "ads", "s2", "provider_graph"), ("s", "crossref", "a", "depositor_metadata"), ("s", "crossref", "b", "depositor_metadata")]
    assert [tuple(r) for r in V.relations(said, seeds, "citations", 2).collect()] == [("s", "ads", "x", "provider_graph")]
    names = spark.createDataFrame([("s", "S"), ("s2", "S"), ("a", "B"), ("b", "B")], "alias string, root string")
    assert sorted(tuple(r) for r in V.relations(said, seeds, "references", 3, names).collect()) == [("S", "crossref", "B", "depositor_metadata"), ("S", "crossref", "c", "depositor_metadata")]
    assert V.visible(said, spark.createDataFrame([("s",), ("b",)], "record_id string")).count() == 3
    sources = spark.createDataFrame([("r1", "p", "9"), ("r2", "p", "9")], "record_id string, provider string, source_record_id string")
    groups = spark.createDataFrame([("r1", "A"), ("r2", "B")], "record_id string, root string")
    assert {r.alias: r.root for r in V.aliases(sources, groups).collect()} == {"r1": "A", "r2": "B", "p:9": "B"}


ENTRIES = "entry string, title string, authors array<string>, year int, venue string, doi string, citing string, evidence_level string"
TARGETS = "candidate string, c_title string, c_authors array<string>, c_year int, c_venue string"


def test_linking(spark):
    entries = spark.createDataFrame(
        [("e1", "On kilns", ["Amadi, R."], 2001, None, None, "d", "verified_anchor"), ("e2", "Kiln", None, None, None, None, "d", "verified_anchor"), ("e3", None, None, None, None, "10.5555/k", "d", "bibliography_only"), ("e4", "", [], None, "", None, "d", "verified_anchor"), ("e5", "On kilns", None, 1990, None, None, "d", "verified_anchor"), ("e6", "On kilns", ["Amadi"], 2000, None, None, "t1", "verified_anchor")], ENTRIES,
    )
    targets = spark.createDataFrame([("t1", "On Kilns!", ["Ruth Amadi"], 2000, "V"), ("t2", "More on kilns and ash", None, None, None), ("t3", "Ash", None, 2001, None)], TARGETS)
    claims = spark.createDataFrame([("t3", "10.5555/k"), ("gone", "10.5555/k")], "candidate string, doi string")
    pairs = sorted(tuple(r) for r in V.title_candidates(entries, targets).collect())
    assert pairs == [("e1", "t1"), ("e1", "t2"), ("e5", "t2"), ("e6", "t1"), ("e6", "t2")]
    got = {r.entry: r for r in V.link_references(entries.drop("citing", "evidence_level"), targets, claims).collect()}
    assert {k: (r.candidate, r.status) for k, r in got.items()} == {"e1": ("t1", "resolved"), "e2": (None, "unresolved"), "e3": ("t3", "resolved"), "e4": (None, "unresolved"), "e5": ("t2", "unresolved"), "e6": ("t1", "resolved")}
    assert got["e1"].score == round((0.65 + 0.15 + 0.08) / 0.9, 6) and got["e2"].reason == "no_candidates" and got["e3"].reason == "unique_strong_identifier"
    like = 0.7 * difflib.SequenceMatcher(None, "on kilns", "more on kilns and ash", autojunk=False).ratio() + 0.3 * 2 / 5
    assert got["e5"].score == round(0.65 * like / 0.75, 6)
    edges = V.link_edges(V.link_references(entries.drop("citing", "evidence_level"), targets, claims), entries.select("entry", "citing", "evidence_level")).collect()
    assert [(r.citing, r.cited, r.entry) for r in edges] == [("d", "t1", "e1")]
    assert V.link_references(entries.limit(0).drop("citing", "evidence_level"), targets, claims).count() == 0


def test_audit(spark):
    t = lambda s: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([(k, t(s)) for k, s in enumerate([0, 5, 5, 5, 90_000, 90_001, 200_000])], "event_id int, at timestamp")
    gone = {r.event_id: r.reason for r in A.prune_preview(rows, "event_id", "at", t(3), 4).collect()}
    assert gone == {0: "age", 1: "capacity", 2: "capacity"}
    assert sorted(r.event_id for r in A.pruned(rows, A.prune_preview(rows, "event_id", "at", t(3), 2), "event_id").collect()) == [5, 6]
    assert A.prune_preview(rows, "event_id", "at", t(3), 6).count() == 1
    cache = spark.createDataFrame([("k", t(1), 200), ("k", t(9), 500), ("j", t(2), 200)], "key string, at timestamp, status int")
    assert [(r.key, r.status) for r in A.cache_get(cache, "key", "at", 9, t(10.5)).orderBy("key").collect()] == [("j", 200)] and A.cache_get(cache, "key", "at", 0, t(0)).count() == 0
    snaps = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 2, "b"), ("k", 3, "b"), ("k", 3, "a"), ("k", 3, "a"), ("j", 1, "a")], "key string, turn int, id string")
    assert [tuple(r) for r in A.consensus(snaps, "key", "turn", "id").collect()] == [("k", 3)]


def test_scores(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "g string, p string")
    got = {r.label: r for r in E.label_scores(rows, "g", "p").collect()}
    assert (got["x"].precision, got["x"].recall, got["y"].precision) == (1.0, 0.5, 0.5) and got["x"].accuracy == round(2 / 3, 9) and got["x"].macro_f1 == round(2 / 3, 9)
    m = E.micro(spark.createDataFrame([(1, 2, 2), (0, 0, 2)], "true_positive long, predicted long, gold long")).first()
    assert (m.precision, m.recall) == (0.5, 0.25)
    one, two = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("b",)], "id string")
    E.same_universe(two, two, "id")
    with pytest.raises(ValueError, match="a .missing from predicted"):
        E.same_universe(one, two, "id")

