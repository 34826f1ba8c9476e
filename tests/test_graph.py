import random

from quillmesh.operators import graph as G
from quillmesh.operators.components import components

EDGES = [("S", "A"), ("S", "B"), ("E", "B"), ("E", "D"), ("A", "C"), ("B", "C"), ("B", "D")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "citing string, cited string")


def pairs(df):
    return {(r.left_id, r.right_id): r.shared for r in df.collect()}


def test_co_citation_coupling_degrees(spark):
    e = edges(spark, [x for x in EDGES if x[0] != "E"])
    assert pairs(G.pairs_sharing(e, "citing", "cited")) == {("A", "B"): 1, ("C", "D"): 1}
    assert pairs(G.pairs_sharing(e, "cited", "citing")) == {("A", "B"): 1}
    asked = spark.createDataFrame([("A",)], "query_id string")
    assert [(r.query_id, r.other_id, r.shared) for r in G.sharing_with(e, "cited", "citing", asked).collect()] == [("A", "B", 1)]
    assert {r.record_id: (r.in_degree, r.out_degree) for r in G.degrees(e).collect()}["C"] == (2, 0)


def test_expansion_and_limits(spark):
    e, s = edges(spark), spark.createDataFrame([("S",), ("MISSING",)], "record_id string")
    known, paths, why = G.expand(e, s, G.Expansion(depth=2))
    assert {r.record_id: r.depth for r in known.collect()} == {"S": 0, "A": 1, "B": 1, "C": 2, "D": 2} and why == []
    assert {(r.predecessor, r.record_id) for r in paths.collect()} == {("S", "A"), ("S", "B"), ("A", "C"), ("B", "C"), ("B", "D")}
    known, _, why = G.expand(e, s.limit(1), G.Expansion(depth=1, per_node=1))
    assert {r.record_id for r in known.collect()} == {"S", "A"} and why == ["provider_limit"]
    known, _, why = G.expand(e, s, G.Expansion(depth=2, frontier_cap=1))
    assert {r.record_id for r in known.collect()} == {"S", "A", "B", "C"} and why == ["frontier_cap"]
    both = G.Expansion(depth=1, operations=("references", "citations"))
    assert {r.record_id for r in G.expand(e, spark.createDataFrame([("B",)], "record_id string"), both)[0].collect()} == {"B", "C", "D", "S", "E"}
    allowed = spark.createDataFrame([("B",)], "record_id string")
    assert {r.record_id for r in G.expand(e, s, G.Expansion(depth=1), allowed)[0].collect()} == {"S", "B"}


def test_pagerank_against_a_loop(spark):
    rng = random.Random(1)
    rows = list({(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(30)})
    rows = [r for r in rows if r[0] != r[1]]
    nodes = sorted({x for r in rows for x in r})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {n: [b for a, b in rows if a == n] for n in nodes}
    for _ in range(6):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] / len(out[a]) for a, b in rows if b == n)) for n in nodes}
    got = {r.record_id: r.score for r in G.pagerank(edges(spark, rows), 6).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in nodes)


def test_folding_and_exclusions(spark):
    a = spark.createDataFrame([("1", "S", "A", "p", "provider_asserted"), ("2", "S", "A", "q", "verified"), ("2", "S", "A", "q", "verified"), ("3", "S", "S", "q", "verified"), ("4", "S", None, "q", "verified")], "assertion_id string, subject_record_id string, object_record_id string, provider string, verification_status string")
    (row,) = G.folded_edges(a).collect()
    assert (row.assertions, row.providers, row.status) == (2, 2, "verified") and row.edge_id.startswith("ce:") and len(row.edge_id) == 27
    papers = spark.createDataFrame([("a", 2014, "article"), ("b", None, None), ("c", 2018, "conference-paper")], "record_id string, publication_year int, work_type string")
    got = {r.record_id: list(r.reasons) for r in G.exclusions(papers, 2015, 2021, ("conference-paper",)).collect()}
    assert got == {"a": ["year_before_range", "work_type_not_included"], "b": ["year_missing", "work_type_missing"]}


def test_components(spark):
    rows = [(f"c{k:02}", f"c{k + 1:02}") for k in range(20)] + [("x", "y"), (None, "z")]
    got = {r.id: r.root for r in components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert got == {f"c{k:02}": "c00" for k in range(21)} | {"x": "x", "y": "x"}
