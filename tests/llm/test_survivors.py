from datetime import datetime

import pytest

from quillmesh.llm.survivors import contested, survivors, votes, winners

PAPERS = "record_id string, work_family_id string, title string, publication_year int, venue string, abstract string, publication_date date, work_type string, language string, open_access boolean, landing_page_url string, pdf_url string, field_name string"


def tables(spark, papers, sources=(), claims=(), providers=(("hi", 0.95), ("mid", 0.7), ("low", 0.4))):
    full = [(*p, *[None] * (13 - len(p))) for p in papers]
    return (
        spark.createDataFrame(full, PAPERS),
        spark.createDataFrame([(r, p, datetime(*d)) for r, p, d in sources], "record_id string, provider string, retrieved_at timestamp"),
        spark.createDataFrame([(r, s, v, c, p, datetime(*d)) for r, s, v, c, p, d in claims], "record_id string, scheme string, value string, confidence double, provider string, retrieved_at timestamp"),
        spark.createDataFrame(list(providers), "provider string, trust double"),
    )


def found(spark, *args):
    return {(r.work_family_id, r.field_name): r.field_value for r in contested(*tables(spark, *args)).collect()}


def test_trust_recency_and_cut_titles(spark):
    near, old, new = (2033, 1, 5), (2031, 1, 5), (2033, 1, 1)
    papers = [
        ("a", "f1", "Right thing", 2030, "V"), ("b", "f1", "Wrong thing", 2031, "V"), ("c", "f1", "Wrong thing", 2031, "V"),
        ("d", "f2", "Old name of it", 2029, None), ("e", "f2", "New name of it", 2030, None), ("f", "f2", "Old name of it", 2029, None),
        ("g", "f3", "A long title of some length", 12, "W"), ("h", "f3", "A long ti", 123, None), ("i", "f3", "A long title ...", 12, None),
        ("j", None, "alone", 1, "x"), ("k", "f4", "A long title", 1, "W"), ("l", "f4", "A long title (draft)", 1, " w"),
    ]
    sources = [("a", "hi", near), ("b", "low", new), ("c", "low", near), ("d", "mid", old), ("e", "mid", new), ("f", "mid", old), ("g", "low", near), ("h", "hi", near), ("h", "hi", old), ("i", "hi", near), ("k", "hi", near), ("l", "low", near)]
    got = found(spark, papers, sources)
    assert got == {
        ("f1", "title"): "Right thing", ("f1", "publication_year"): "2030", ("f2", "title"): "New name of it", ("f2", "publication_year"): "2030",
        ("f3", "title"): "A long title of some length", ("f3", "publication_year"): "12", ("f4", "title"): "A long title", ("f4", "venue"): "W",
    }
    wide = {r.work_family_id: r for r in survivors(*tables(spark, papers, sources)).collect()}
    assert wide["f3"].venue == "W" and wide["f2"].venue is None and set(wide) == {"f1", "f2", "f3", "f4"}


def test_confidence_repeats_nulls_and_unknown_sources(spark):
    at = (2033, 1, 1)
    papers = [("a", "f", "T", None, None), ("b", "f", "t", None, None), ("b", "f", "t", None, None)]
    claims = [("a", "doi", "10.1/x", 0.55, "hi", at)] * 3 + [("b", "doi", "10.1/y", 0.9, "low", at), ("b", "doi", None, 1.0, "hi", at), ("b", "pmid", "1", 1.0, "hi", at), ("zz", "doi", "10.1/z", 1.0, "hi", at)]
    got = found(spark, papers, [("a", "nobody", at)], claims)
    assert got == {("f", "doi"): "10.1/y", ("f", "title"): "t"}  # b, unrated too and twice as one, ties with a; byte order decides


def test_empty(spark):
    assert found(spark, []) == {}


def test_sum_per_normalised_value(spark):
    at = (2033, 1, 1)
    papers = [("a", "f", "Blue  Moon", 1, None), ("b", "f", "blue moon", 1, None), ("c", "f", "red moon", 1, None)]
    parts = tables(spark, papers, [("a", "low", at), ("b", "low", at), ("c", "low", at)])
    top = [r for r in winners(votes(*parts)).collect() if r.field_name == "title"][0]
    assert top.field_value == "blue moon" and top.n_values == 3
    assert top.support == pytest.approx(2 * 0.4 / 0.6)
