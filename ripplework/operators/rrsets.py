"""Reverse-reachable sets: the origins that could have activated a random root.

Set q is the reverse reach of its root in live-edge world q, so a sample is extended by
appending a range of ids and nothing drawn before changes.
"""

from __future__ import annotations

import copy
import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.keyed import TWO32, draw, u32
from ripplework.functions.scratch import stored
from ripplework.operators.aux_graph import AuxGraph
from ripplework.operators.spread import Held, broadcast_graph, closure, is_local, live, local_graph, per_world, prepared
from ripplework.sources.edges import dense_rank_by


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """(id, rank): the origins in ascending order."""
    return dense_rank_by(nodes.select("id").distinct(), ["id"]).select("id", "rank")


def roots(ranked: DataFrame, n: int, count: int, seed: int, first: int = 0) -> DataFrame:
    """(rr_id, node): a uniform root for each set, as an expanded id."""
    ids = ranked.sparkSession.range(first, first + count).select(F.col("id").alias("rr_id"))
    place = ids.withColumn("rank", F.floor(u32("root", seed, F.col("rr_id")) * F.lit(float(n)) / F.lit(TWO32)).cast("long"))
    return place.join(ranked, "rank").select("rr_id", (F.col("id") * 8).alias("node"))


class Sampler:
    """RR sets of one expanded graph under one seed.

    ``take(first, count)`` gives (rr_id, node) with node as an original id; ``uses`` gives the
    stateful form (rr_id, root, parent, target, factor).
    """

    def __init__(self, g: AuxGraph, seed: int = 44, strategy: str = "auto", normalise: bool = True):
        self.g, self.seed = g, seed
        self.prep = stored(prepared(g, normalise), "prepared")
        self.ranked = stored(ranked_nodes(g.nodes), "origins")
        self.n = self.ranked.count()
        self.local = strategy == "local" or (strategy == "auto" and is_local(self.prep, g.model) and self.n <= 4_000_000)
        self.held: Held | None = None
        self.ids: list[int] | None = None

    def reseeded(self, seed: int) -> Sampler:
        """Samples under another seed of the same graph, which is prepared and broadcast once."""
        if self.local and self.n:
            self._broadcast()
        other = copy.copy(self)
        other.seed = seed
        return other

    def _broadcast(self) -> tuple[Held, object]:
        if self.held is None:
            self.held = broadcast_graph(self.prep, self.g.model, True)
            ids = self.ranked.orderBy("rank").select("id").toArrow().column(0).to_numpy()  # at most 4 million
            self.ids = self.ranked.sparkSession.sparkContext.broadcast(ids)
        return self.held, self.ids

    def take(self, first: int, count: int) -> DataFrame:
        g, seed, n = self.g, self.seed, self.n
        spark = self.prep.sparkSession
        if n == 0 or count == 0:
            return spark.createDataFrame([], "rr_id long, node long")
        if self.local:
            held, ids = self._broadcast()
            model, factors = g.model, g.factors

            def run(q: int):
                root = int(ids.value[draw(f"root|{seed}|{q}") * n // (1 << 32)]) * 8
                return [(q, v >> 3) for v in local_graph(held, model, factors, seed, True).reach(q, [root]) if not v & 7]

            return per_world(spark, first, count, run, "rr_id long, node long")
        start = roots(self.ranked, n, count, seed, first).withColumnRenamed("rr_id", "r")
        prep = self.prep

        def step(front: DataFrame) -> DataFrame:
            j = front.join(prep, F.col("node") == F.col("dst"))
            return j.where(live(g.model, g.factors, seed, F.col("r"), F.col("src"), F.col("dst"))).select("r", F.col("src").alias("node"))

        reached = closure(start, step).where("(node & 7) = 0")
        return reached.select(F.col("r").alias("rr_id"), F.shiftright("node", 3).alias("node"))

    def uses(self, first: int, count: int) -> DataFrame:
        """A row for each live tie among the origins of a set; factor -1 is a direct edge.

        A row without a parent stands for the root, so that sets of one origin are kept.
        """
        g, seed, n = self.g, self.seed, self.n
        if n == 0 or count == 0:
            return self.prep.sparkSession.createDataFrame([], "rr_id long, root long, parent long, target long, factor int")
        if not self.local:
            return self._uses_by_joins(first, count)
        held, ids = self._broadcast()
        model, factors = g.model, g.factors

        def run(q: int):
            root = int(ids.value[draw(f"root|{seed}|{q}") * n // (1 << 32)])
            graph, memo = local_graph(held, model, factors, seed, True), {}
            rows, seen, todo = [(q, root, None, root, None)], {root}, [root]
            while todo:
                t = todo.pop()
                for u in graph.neighbours(q, t * 8, memo):
                    for parent, f in [(u >> 3, -1)] if not u & 7 else [(p >> 3, u & 7) for p in graph.neighbours(q, u, memo)]:
                        rows.append((q, root, parent, t, f))
                        if parent not in seen:
                            seen.add(parent)
                            todo.append(parent)
            return rows

        return per_world(self.prep.sparkSession, first, count, run, "rr_id long, root long, parent long, target long, factor int")

    def _uses_by_joins(self, first: int, count: int) -> DataFrame:
        """``uses`` for graphs of any size: the origins of all sets by a frontier loop over the
        ties among origins, then the ties themselves in one pass."""
        g, seed = self.g, self.seed
        start = roots(self.ranked, self.n, count, seed, first).withColumnRenamed("rr_id", "r")
        fires = live(g.model, g.factors, seed, F.col("r"), F.col("src"), F.col("dst"))
        prep = self.prep

        def ties(front: DataFrame) -> DataFrame:
            """r, target and the origin ``parent`` of each live tie, with its factor or -1."""
            into = front.join(prep, F.col("node") == F.col("dst")).where(fires).select("r", F.col("dst").alias("target"), F.col("src").alias("node"))
            direct = into.where("(node & 7) = 0").select("r", "target", F.col("node").alias("parent"), F.lit(-1).alias("factor"))
            gated = into.where("(node & 7) > 0").join(prep, F.col("node") == F.col("dst")).where(fires)
            return direct.unionByName(gated.select("r", "target", F.col("src").alias("parent"), F.col("node").bitwiseAND(F.lit(7)).cast("int").alias("factor")))

        origins = stored(closure(start, lambda front: ties(front).select("r", F.col("parent").alias("node"))), "origins")
        of = start.select(F.col("r").alias("rr_id"), F.shiftright("node", 3).alias("root"))
        none = of.select("rr_id", "root", F.lit(None).cast("long").alias("parent"), F.col("root").alias("target"), F.lit(None).cast("int").alias("factor"))
        rows = ties(origins).select(F.col("r").alias("rr_id"), F.shiftright("parent", 3).alias("parent"), F.shiftright("target", 3).alias("target"), "factor")
        return none.unionByName(rows.join(of, "rr_id").select("rr_id", "root", "parent", "target", "factor"))


def coverage(rr: DataFrame, seeds: DataFrame, n: int, count: int) -> DataFrame:
    """(covered, influence): sets that hold a seed, and n * covered / count."""
    covered = rr.join(seeds.select(F.col("id").alias("node")).distinct(), "node", "left_semi").agg(F.countDistinct("rr_id").alias("covered"))
    return covered.select("covered", (F.col("covered") * F.lit(float(n)) / F.lit(float(max(count, 1)))).alias("influence"))


class Estimate(NamedTuple):
    influence: float
    sets: int
    #: whether enough sets were covered; if not, ``influence`` is a plain mean without a guarantee
    reached: bool


def stopping_rule(sampler: Sampler, seeds: list[int], delta: float = 1e-3, eps: float = 0.1, first_batch: int = 2000, max_sets: int = 5_000_000) -> Estimate:
    """Influence by sampling until enough sets are covered.

    Batches double up to ``max_sets`` in all, and the last one is cut at the very set that
    reaches the target, so the estimate is the sequential one.
    """
    target = math.ceil(1 + 4 * (math.e - 2) * (1 + eps) * math.log(2 / delta) / eps**2)
    spark = sampler.prep.sparkSession
    if not seeds:
        return Estimate(0.0, 0, True)
    wanted = spark.createDataFrame([(s,) for s in seeds], "node long")
    covered, first, batch = 0, 0, first_batch
    while first < max_sets:
        batch = min(batch, max_sets - first)
        hit = stored(sampler.take(first, batch).join(F.broadcast(wanted), "node", "left_semi").select("rr_id").distinct(), "covered")
        found = hit.count()
        if covered + found >= target:
            last = hit.orderBy("rr_id").limit(target - covered).agg(F.max("rr_id")).first()[0]
            return Estimate(target * sampler.n / (last + 1), last + 1, True)
        covered, first, batch = covered + found, first + batch, batch * 2
    return Estimate(covered * sampler.n / first, first, False)


def frequency(rr: DataFrame) -> DataFrame:
    """(node, count): in how many sets a node is."""
    return rr.groupBy("node").agg(F.countDistinct("rr_id").alias("count"))


def candidate_pool(rr: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` nodes that are in most sets, smaller ids first on ties."""
    return frequency(rr).orderBy(F.desc("count"), "node").limit(cap)


