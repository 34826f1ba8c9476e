import random

import pytest

from quillmesh.functions import skew
from quillmesh.llm.contraction import linked_groups, merge_links


def brute(pairs):
    up = {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            for x in (a, b):
                up.setdefault(x, x)
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {x: top(x) for x in up}


def found(spark, pairs):
    df = spark.createDataFrame(pairs, "l string, r string, record_id int") if pairs and len(pairs[0]) == 3 else spark.createDataFrame(pairs, "l string, r string")
    rows = linked_groups(df, "l", "r").collect()
    assert len({r.record_id for r in rows}) == len(rows)
    return {r.record_id: r.group_id for r in rows}


def test_chain_star_loops_nulls_and_repeats(spark):
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("hub", f"leaf{k}") for k in range(50)]
    pairs += [("x", "x"), (None, "y"), ("z", None), ("b", "a"), ("a", "b"), ("b", "a"), ("é", "a"), ("", "q")]
    assert found(spark, pairs) == brute(pairs)


def test_random_graph_with_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rng = random.Random(4)
    pairs = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(180)] + [("v7", f"v{k}") for k in range(300, 400)]
    assert found(spark, pairs) == brute(pairs)


def test_empty_and_clashing_names(spark):
    assert found(spark, []) == {}
    assert found(spark, [("b", "a", 1), ("c", "b", None)]) == {"a": "a", "b": "a", "c": "a"}


def test_reverted_and_other_actions(spark):
    rows = [("1", "merge", "a", "b", None), ("2", "revert", None, None, "1"), ("3", "split", "a", "c", None), ("4", "merge", "c", "d", None), (None, "merge", "e", "f", None), ("4", "merge", "c", "d", None)]
    df = spark.createDataFrame(rows, "event_id string, action string, left_record_id string, right_record_id string, reverts_event_id string")
    assert sorted((r.left_record_id, r.right_record_id) for r in merge_links(df).collect()) == [("c", "d"), ("c", "d"), ("e", "f")]


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_changes_nothing(spark, seed):
    pairs = [(str(a), str(a * 3 % 40)) for a in range(40)]
    df = spark.createDataFrame(pairs, "l string, r string")
    assert {r.record_id: r.group_id for r in linked_groups(df, "l", "r", seed).collect()} == brute(pairs)
