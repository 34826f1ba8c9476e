"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import lookup_join
from quillmesh.session import counted, cut, discard, measured

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, root``: the smallest id each id is linked to over ``edges``; ids without edge don't appear.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so chains shorten by half; minima are aggregated
    before the shuffle. Written every round, so the plan stays short.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both, n = counted(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    for _ in range(MAX_ROUNDS):
        # a vertex with very many links is looked up by broadcast, see lookup_join
        near = lookup_join(both, label.withColumnRenamed("u", "v"), "v", n, "inner").groupBy("u").agg(F.min("l").alias("n"))
        low = label.join(near, "u").select("u", "l", F.least("l", "n").alias("n"))
        jump = label.select(F.col("u").alias("n"), F.col("l").alias("j"))
        step = low.join(jump, "n", "left").select("u", F.col("l").alias("was"), F.least(F.col("n"), F.coalesce("j", "n")).alias("l"))
        new, seen = measured(step, "labels", changed=F.sum((F.col("l") != F.col("was")).cast("long")))
        discard(label)
        label = new.select("u", "l")
        if not seen["changed"]:
            discard(both)
            return label.select(F.col("u").alias("id"), F.col("l").alias("root"))
        label = new
    raise RuntimeError("components did not settle")
