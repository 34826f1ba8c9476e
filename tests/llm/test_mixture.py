import random

from quillmesh.llm import mixture


def sizes_of(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    return df.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 64 - mixture.HASH_BITS))


def brute_part(rows, budget):
    """Documents in hash order while they fit; equal hashes stand or fall together."""
    by = {}
    for h, t in rows:
        by[h] = by.get(h, 0) + t
    total, chosen = 0, set()
    for h in sorted(by):
        if total + by[h] > budget:
            break
        total += by[h]
        chosen.add(h)
    return chosen


def test_thresholds_against_sorting(spark):
    rng = random.Random(1)
    rows = [(k, "abc"[min(2, k % 7)], rng.randrange(1, 90)) for k in range(3000)]
    sizes = sizes_of(spark, rows).cache()
    weights = spark.createDataFrame([("a", 0.5, 4), ("b", 0.2, 2), ("c", 0.25, 1), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    plan = mixture.plan_mixture(sizes, weights).collect()
    assert {p.source for p in plan} == {"a", "b", "c", "gone"}
    for p in plan:
        own = [(r.h, r.tokens) for r in sizes.where(f"source = '{p.source}'").collect()]
        assert p.budget <= p.tokens * p.max_repeats
        want = brute_part(own, p.part) if p.part else set()
        got = {h for h, _ in own if p.threshold is not None and h < p.threshold}
        assert got == want
    plan_df = mixture.plan_mixture(sizes, weights)
    mixed = mixture.mixture(sizes, plan_df)
    out = {r.source: r for r in mixture.shares(mixed, plan_df).collect()}
    assert out["gone"].mixed_tokens == 0
    for s, share in (("a", 0.5 / 0.95), ("b", 0.2 / 0.95), ("c", 0.25 / 0.95)):
        assert abs(out[s].actual_share - share) < 0.01 and out[s].max_copies <= {"a": 4, "b": 2, "c": 1}[s]


def test_nested_budgets_ties_and_caps(spark):
    rows = [(1, "a", 5), (1, "a", 5), (2, "a", 7), (3, "b", 1)]
    sizes = sizes_of(spark, rows)
    weights = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1), ("b", None, 1)], "source string, target_share double, max_repeats int")
    small = {(r.doc_id, r.copies) for r in mixture.mixture(sizes, mixture.plan_mixture(sizes, weights, 8)).collect()}
    large = mixture.mixture(sizes, mixture.plan_mixture(sizes, weights, 10_000)).collect()
    assert {d for d, _ in small} <= {r.doc_id for r in large}
    assert {(r.doc_id, r.copies) for r in large} == {(1, 2), (2, 2), (3, 1)}


def test_empty(spark):
    sizes = sizes_of(spark, [])
    weights = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    plan = mixture.plan_mixture(sizes, weights)
    assert mixture.mixture(sizes, plan).collect() == []
    assert mixture.shares(mixture.mixture(sizes, plan), plan).collect()[0].actual_share == 0.0
