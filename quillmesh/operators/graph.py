"""Citation edges and what is computed over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import stable_id
from quillmesh.session import cut


def folded_edges(assertions: DataFrame) -> DataFrame:
    """One row per directed pair citing -> cited, never from a record to itself, with its evidence counted; verified if any assertion is."""
    a = assertions.where("subject_record_id IS NOT NULL AND object_record_id IS NOT NULL AND subject_record_id <> object_record_id")
    e = a.groupBy(F.col("subject_record_id").alias("citing"), F.col("object_record_id").alias("cited")).agg(
        F.countDistinct("assertion_id").alias("assertions"), F.countDistinct("provider").alias("providers"), F.max((F.col("verification_status") == "verified").cast("int")).alias("v")
    )
    return e.select(stable_id("ce:", "citing", "cited").alias("edge_id"), "citing", "cited", "assertions", "providers", F.when(F.col("v") == 1, "verified").otherwise("provider_asserted").alias("status"))


def pairs_sharing(edges: DataFrame, by: str, of: str) -> DataFrame:
    """``left_id, right_id, shared``: pairs of ``of`` that share ``by`` (co-citation: by citing, of cited)."""
    e = edges.select(F.col(by).alias("k"), F.col(of).alias("x")).distinct()
    pairs = e.withColumnRenamed("x", "left_id").join(e.withColumnRenamed("x", "right_id"), "k").where("left_id < right_id")
    return pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def sharing_with(edges: DataFrame, by: str, of: str, queries: DataFrame) -> DataFrame:
    """``query_id, other_id, shared`` for a stated query set (column ``query_id``) against all: what hubs share stays linear in the queries."""
    e = edges.select(F.col(by).alias("k"), F.col(of).alias("other_id")).distinct()
    q = e.join(queries.withColumnRenamed("query_id", "other_id"), "other_id", "left_semi").withColumnRenamed("other_id", "query_id")
    return q.join(e, "k").where("query_id <> other_id").groupBy("query_id", "other_id").agg(F.count("*").alias("shared"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("citing").alias("record_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("cited", F.lit(0), F.lit(1)))
    return ends.groupBy("record_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, rounds: int = 50, d: float = 0.85, batch: int = 5) -> DataFrame:
    """``record_id, score`` after exactly ``rounds`` rounds from a uniform start; what dangling vertices hold is spread over all.

    A round is ``r' = b + d A r`` with a constant ``b`` that depends on the
    dangling mass. So every ``r`` is a sum of the vectors ``(d A)^j 1`` whose
    weights follow from their dangling sums alone. These vectors need no
    number from the driver between rounds: ``batch`` of them are made by one
    job, which carries them along as columns and sums their dangling part as
    it is written. The weights are worked out at the end. Sums are
    pre-aggregated, so a hub costs a partition one row per partition.
    """
    e = edges.select("citing", "cited").distinct()
    nodes = cut(e.select(F.col("citing").alias("id")).union(e.select("cited")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select(F.col("id").alias("record_id"), F.lit(0.0).alias("score"))
    out = e.groupBy("citing").agg(F.count("*").alias("out"))
    flow = e.join(out, "citing").select(F.col("citing").alias("id"), F.col("cited").alias("to"), (F.lit(d) / F.col("out")).alias("w"), F.lit(False).alias("own"))
    # a way from each vertex to itself hands its columns on
    links = cut(flow.unionAll(nodes.select("id", "id", F.lit(0.0), F.lit(True))), "links")
    state = cut(nodes.join(out.withColumnRenamed("citing", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0).alias("x")), "ranks")
    sums = [float(state.where("dangling").count())]
    made: list[DataFrame] = []
    while len(sums) <= rounds:
        size = min(batch, rounds + 1 - len(sums))
        cols: list[str] = []
        for k in range(size):
            new = f"x{k}"
            handed = ["dangling", *cols]
            step = state.join(links, "id").select(F.col("to").alias("id"), (F.col("x") * F.col("w")).alias("f"), *[F.when(F.col("own"), F.col(c)).alias(c) for c in handed])
            state = step.groupBy("id").agg(*[F.max(c).alias(c) for c in handed], F.sum("f").alias(new)).withColumn("x", F.col(new))
            cols.append(new)
        seen = Observation()
        done = state.drop("x").observe(seen, *[F.sum(F.when(F.col("dangling"), F.col(c)).otherwise(0.0)).alias(c) for c in cols])
        done = cut(done, "ranks")
        sums += [seen.get[c] or 0.0 for c in cols]
        made.append(done)
        state = done.select("id", "dangling", F.col(cols[-1]).alias("x"))
    base: list[float] = []
    for i in range(rounds):
        lost = sums[i] / n + sum(base[m] * sums[i - 1 - m] for m in range(i))
        base.append((1 - d) / n + d * lost / n)
    weight = [base[rounds - 1 - j] for j in range(rounds)] + [1.0 / n]
    total = nodes.select("id", F.lit(weight[0]).alias("r"))
    at = 1
    for part in made:
        xs = [c for c in part.columns if c.startswith("x")]
        total = total.unionAll(part.select("id", sum((F.col(c) * F.lit(weight[at + k]) for k, c in enumerate(xs)), F.lit(0.0)).alias("r")))
        at += len(xs)
    return total.groupBy(F.col("id").alias("record_id")).agg(F.sum("r").alias("score"))


@dataclass
class Expansion:
    """Limits of a breadth-first expansion."""

    depth: int = 2
    frontier_cap: int = 1000
    top_k: int = 5000
    per_node: int = 1000
    operations: tuple[str, ...] = ("references",)


def expand(edges: DataFrame, seeds: DataFrame, limits: Expansion, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Layered expansion from ``seeds`` (``record_id``): accepted records with their depth, all paths, and why it stopped short.

    Per layer: the frontier in order of discovery up to ``frontier_cap``; of
    every frontier record and operation the first ``per_node`` neighbours;
    records outside ``allowed`` are left out before ``top_k`` counts. A path
    is kept for every arrival at an accepted record, also a later one.
    """
    spark = edges.sparkSession
    e = cut(edges.select("citing", "cited").distinct(), "edges")
    both = e.join(seeds.select(F.col("record_id").alias("citing")), "citing", "left_semi").select(F.col("citing").alias("record_id"))
    both = both.union(e.join(seeds.select(F.col("record_id").alias("cited")), "cited", "left_semi").select("cited"))
    known = cut(seeds.select("record_id").distinct().join(both.distinct(), "record_id", "left_semi").withColumn("depth", F.lit(0)).withColumn("place", F.row_number().over(Window.orderBy("record_id"))), "known")
    paths, why = None, []
    frontier = known
    n_known = known.count()
    for depth in range(1, limits.depth + 1):
        size = frontier.count()
        if not size:
            break
        if size > limits.frontier_cap:
            why.append("frontier_cap")
            frontier = frontier.orderBy("place").limit(limits.frontier_cap)
        layer = None
        for k, op in enumerate(limits.operations):
            source, target = ("citing", "cited") if op == "references" else ("cited", "citing")
            part = e.join(frontier.select(F.col("record_id").alias(source), "place"), source).select(F.col(source).alias("predecessor"), F.col(target).alias("record_id"), "place", F.lit(k).alias("op"), F.lit(op).alias("operation"))
            layer = part if layer is None else layer.unionAll(part)
        order = F.row_number().over(Window.partitionBy("predecessor", "op").orderBy("record_id"))
        layer = cut(layer.withColumn("at", order), "layer")
        if layer.where(F.col("at") > limits.per_node).limit(1).count():
            why.append("provider_limit")
        layer = layer.where(F.col("at") <= limits.per_node)
        if allowed is not None:
            layer = layer.join(allowed.select("record_id"), "record_id", "left_semi")
        fresh = layer.join(known.select("record_id"), "record_id", "left_anti").groupBy("record_id").agg(F.min(F.struct("place", "op", "at")).alias("first"))
        room = max(0, limits.top_k + seeds.count() - n_known)
        w = Window.orderBy("first", "record_id")  # bounded by frontier_cap * per_node
        fresh = cut(fresh.withColumn("place", F.row_number().over(w)).withColumn("depth", F.lit(depth)), "fresh")
        if fresh.where(F.col("place") > room).limit(1).count():
            why.append("top_k")
            fresh = fresh.where(F.col("place") <= room)
        fresh = fresh.select("record_id", "depth", (F.col("place") + n_known).alias("place"))
        known = cut(known.unionByName(fresh), "known")
        n_known = known.count()
        here = layer.join(known.select("record_id"), "record_id", "left_semi").select("predecessor", "record_id", F.lit(depth).alias("depth"), "operation")
        paths = here if paths is None else paths.unionAll(here)
        frontier = known.where(F.col("depth") == depth)
    if paths is None:
        paths = spark.createDataFrame([], "predecessor string, record_id string, depth int, operation string")
    return known.select("record_id", "depth"), paths, list(dict.fromkeys(why))


def exclusions(candidates: DataFrame, year_from: int | None, year_to: int | None, work_types: tuple[str, ...] = ()) -> DataFrame:
    """``record_id, reasons`` of the candidates that a graph filter leaves out, reasons in fixed order."""
    y, t = F.col("publication_year"), F.lower("work_type")
    reasons = []
    if year_from is not None or year_to is not None:
        reasons.append(F.when(y.isNull(), "year_missing"))
    if year_from is not None:
        reasons.append(F.when(y < year_from, "year_before_range"))
    if year_to is not None:
        reasons.append(F.when(y > year_to, "year_after_range"))
    if work_types:
        reasons += [F.when(t.isNull(), "work_type_missing"), F.when(~t.isin(*work_types), "work_type_not_included")]
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return candidates.select("record_id", found.alias("reasons")).where(F.size("reasons") > 0)
