import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.operators.assignment import best_assignment
from quillmesh.operators import evaluation as V


def test_retrieval_and_work_saved(spark):
    ranked = spark.createDataFrame([("t", "A", 1), ("t", "A", 2), ("t", "B", 3), ("t", "C", 4)], "topic string, id string, rank int")
    rel = spark.createDataFrame([("t", "A"), ("t", "C"), ("t", "D"), ("u", "Z")], "topic string, id string")
    got = {r.topic: r for r in V.retrieval(ranked, rel, 10).collect()}
    assert abs(got["t"].recall - 2 / 3) < 1e-8 and got["t"].needed_to_read == 1.5 and got["u"].recall == 0 and got["u"].needed_to_read is None
    many = spark.createDataFrame([("t", str(k), k) for k in range(1, 11)], "topic string, id string, rank int")
    gold = spark.createDataFrame([("t", str(k)) for k in (1, 3, 8)], "topic string, id string")
    (w,) = V.work_saved(many, gold, 0.95).collect()
    assert (w.screened, w.saved) == (8, 0.15)


def test_clusters(spark):
    c = spark.createDataFrame([("A", "p1", "g1"), ("B", "p2", "g1"), ("C", "p1", "g2")], "id string, p string, g string")
    b = V.bcubed(c).first()
    assert abs(b.precision - 2 / 3) < 1e-8 and abs(b.recall - 2 / 3) < 1e-8
    w = V.pairwise(c).first()
    assert (w.true_positive, w.false_merge, w.false_split) == (0, 1, 1)
    assert V.exact_clusters(c).first().exact == 0
    assert abs(V.ceaf_e(c).first().f1 - 2 / 3) < 1e-8


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.data())
def test_assignment_is_the_best(n, m, data):
    weight = st.sampled_from([0.0, 0.2, 0.25, 0.5, 0.75, 1.0])
    table = {(i, j): data.draw(weight) for i in range(n) for j in range(m)}
    long_, short = (range(n), range(m)) if n >= m else (range(m), range(n))
    at = (lambda i, j: table[i, j]) if n >= m else (lambda i, j: table[j, i])
    best = max(sum(at(i, j) for i, j in zip(p, short, strict=True)) for p in itertools.permutations(long_, len(short)))
    found = best_assignment((i, j, w) for (i, j), w in table.items())
    assert len({c for c, _ in found.values()}) == len(found)
    assert abs(sum(w for _, w in found.values()) - best) < 1e-12


def test_aligned_clusters_with_ties(spark):
    """One gold cluster split over three, one shared by two, one alone."""
    rows = [("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 3, 1), ("e", 3, 2), ("f", 3, 2), ("g", 4, 3)]
    df = spark.createDataFrame(rows, "id string, p int, g int")
    total = 2 * 2 / (2 + 4) + 2 * 2 / (3 + 2) + 1.0
    got = V.ceaf_e(df).first()
    assert abs(got.precision - total / 4) < 1e-8 and abs(got.recall - total / 3) < 1e-8
    assert V.ceaf_e(df.limit(0)).first().f1 == 0.0


def test_edges_confusion_bootstrap(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "l string, r string")
    assert V.edges_f1(e, spark.createDataFrame([("a", "b"), ("x", "c")], "l string, r string"), ("l", "r")).first().f1 == 0.5
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "g int, p int")
    assert {r.gold: (r.to_1, r.to_2) for r in V.confusion(rows, "g", "p", (1, 2)).collect()} == {1: (1, 1), 2: (0, 1)}
    assert V.bootstrap_interval([0.5, 1.0], 100, 7)[0] == 0.75 and V.bootstrap_interval([], 10, 1) == (0.0, 0.0, 0.0)
