"""Groups of records linked directly or indirectly, by randomised graph contraction.

Each round gives every vertex a fresh pseudo-random rank, lets it hook to the
lowest-ranked member of its closed neighbourhood, relabels both ends of every
edge, and removes loops and repetitions. A constant share of the vertices
vanishes per round whatever the shape of the graph (long chains, stars,
cliques), so the rounds grow with the logarithm of the input and their sizes
shrink geometrically. Afterwards the recorded hooks are expanded backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import lookup_join
from quillmesh.session import counted, cut, discard

#: Far above what any graph needs (a billion vertices take about 40); a guard against endless loops.
MAX_ROUNDS = 400


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))


def linked_groups(pairs: DataFrame, left: str, right: str, seed: int = 7) -> DataFrame:
    """``record_id, group_id``: the group of each id that stands in at least one pair of two different ids.

    ``group_id`` is the smallest id (byte order) of all ids reachable over the
    pairs. Pairs with a null on either side and pairs of an id with itself
    link nothing; repeated and reversed pairs count once; an empty input gives
    an empty result; other columns are ignored.

    Everything is distributed: hooks come from a pre-aggregated minimum, and
    relabelling uses :func:`lookup_join`, so a vertex that has a third of all
    edges does not end up in one task. Each round is written to the shared
    folder, which bounds the plan and survives lost executors.
    """
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    edges, n_edges = counted(pairs.select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).where(l.isNotNull() & r.isNotNull() & (l != r)).distinct(), "edges")
    # hooks[k]: v, r (what v hooks to), m (smallest original id contracted into v so far)
    hooks: list[tuple[DataFrame, int]] = []
    smallest: DataFrame | None = None
    while n_edges:
        if len(hooks) >= MAX_ROUNDS:
            raise RuntimeError(f"{n_edges} edges left after {MAX_ROUNDS} rounds")
        salt = F.lit(seed * 1_000_003 + len(hooks))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("id"))
        hook = _both_ways(edges).groupBy("v").agg(F.min(rank("w")).alias("near")).select("v", F.least(rank("v"), F.col("near"))["id"].alias("r"))
        hook = hook.withColumn("m", F.col("v")) if smallest is None else hook.join(smallest, "v", "left").withColumn("m", F.coalesce("m", "v"))
        hook, n = counted(hook, "hooks")
        hooks.append((hook, n))
        smallest = hook.groupBy(F.col("r").alias("v")).agg(F.min("m").alias("m"))
        once = lookup_join(edges, hook.select(F.col("v").alias("a"), F.col("r").alias("x")), "a", n_edges)
        twice = lookup_join(once, hook.select(F.col("v").alias("b"), F.col("r").alias("y")), "b", n_edges)
        old = edges
        edges, n_edges = counted(twice.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old)
    if not hooks:
        return edges.select(F.col("a").alias("record_id"), F.col("b").alias("group_id"))
    found: DataFrame | None = None
    for k in range(len(hooks) - 1, -1, -1):
        hook, n = hooks[k]
        top = hook.groupBy("r").agg(F.min("m").alias("m"))
        if found is not None:  # what r became later, if it was still alive
            top = top.join(found.select(F.col("v").alias("r"), "g"), "r", "left").select("r", F.coalesce("g", "m").alias("m"))
        found = lookup_join(hook.select("v", "r"), top, "r", n).select("v", F.col("m").alias("g"))
        if k and k % 4 == 0:
            found = cut(found, "groups")
    return found.select(F.col("v").alias("record_id"), F.col("g").alias("group_id"))


def merge_links(events: DataFrame) -> DataFrame:
    """The pairs of ``merge`` events that no event reverts.

    An event is reverted if any row names its id in ``reverts_event_id``, even
    one that came late; an event without id can't be. Other actions give no pair.
    """
    named = events.where(F.col("reverts_event_id").isNotNull()).select(F.col("reverts_event_id").alias("event_id")).distinct()
    merges = events.where(F.col("action") == "merge").select("event_id", "left_record_id", "right_record_id")
    return merges.join(named, "event_id", "left_anti")
