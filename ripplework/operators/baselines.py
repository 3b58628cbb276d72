"""Baseline selectors: degree, random, and greedy on Monte-Carlo worlds or reachability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.keyed import u32
from ripplework.functions.scratch import stored
from ripplework.operators.aux_graph import AuxGraph
from ripplework.operators.graph import out_degree
from ripplework.operators.select import Cover, greedy_cover, lazy_greedy
from ripplework.operators.spread import Forest, and_closure, broadcast_graph, closure, in_worlds, is_local, live, local_graph, per_world, prepared

GATED = ("IC2", "IC2MIX")


def max_degree(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, degree): the k nodes of largest out-degree, fewer if there are fewer."""
    return out_degree(edges, nodes).orderBy(F.desc("degree"), "id").limit(max(k, 0))


def random_seeds(nodes: DataFrame, k: int, seed: int = 47) -> DataFrame:
    """(id): k nodes without replacement, the first by a keyed hash."""
    return nodes.select("id").distinct().orderBy(u32("random", seed, F.col("id")), "id").limit(max(k, 0))


def _ids(nodes: DataFrame) -> np.ndarray:
    """All ids, for a broadcast beside a graph that ``is_local`` counted."""
    return nodes.select("id").toArrow().column(0).to_numpy()


def _parts(spark, worlds: int, candidates: int) -> int:
    """Tasks among which the candidates of a world are dealt."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism // worlds, candidates // 10_000))


def reach_relation(g: AuxGraph, worlds: int, seed: int = 43, strategy: str = "auto", candidates: DataFrame | None = None) -> DataFrame:
    """(r, source, node): the origins that each candidate reaches in each world."""
    spark = g.edges.sparkSession
    prep = stored(prepared(g), "prepared")
    model, factors = g.model, g.factors
    from_ = (candidates if candidates is not None else g.nodes).select("id").distinct()
    if strategy == "local" or (strategy == "auto" and is_local(prep, model)):
        held = broadcast_graph(prep, model, False)
        ids = spark.sparkContext.broadcast(_ids(from_))
        parts = _parts(spark, worlds, len(ids.value))

        def run(x: int):
            graph, known, memo = local_graph(held, model, factors, seed, False), {}, {}
            r, i = divmod(x, parts)
            return ((r, s, v >> 3) for s in ids.value[i::parts].tolist() for v in graph.reach(r, [s * 8], known, memo) if not v & 7)

        return per_world(spark, 0, worlds * parts, run, "r long, source long, node long")
    start = from_.select((F.col("id") * 8).alias("source")).withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(worlds - 1).cast("long"))))
    # a world and a source together are the key of a closure
    start = start.select(F.struct("w", "source").alias("r"), F.col("source").alias("node"))

    def step(front: DataFrame) -> DataFrame:
        j = front.join(prep, F.col("node") == F.col("src"))
        return j.where(live(model, factors, seed, F.col("r.w"), F.col("src"), F.col("dst"))).select("r", F.col("dst").alias("node"))

    out = closure(start, step).where("(node & 7) = 0")
    return out.select(F.col("r.w").alias("r"), F.shiftright("r.source", 3).alias("source"), F.shiftright("node", 3).alias("node"))


def world_greedy(g: AuxGraph, k: int, worlds: int, seed: int = 43, strategy: str = "auto", lazy: bool = False) -> Cover:
    """Greedy on the mean spread over shared worlds.

    Spread over fixed live edges is a coverage function of (world, node) pairs, so one reach
    relation and greedy cover give exactly what re-simulating every candidate would.  ``lazy``
    evaluates gains lazily (CELF), in workers that hold the graph or over the same relation,
    and fills up with nodes without gain.
    All-factor models are not submodular, so that lazy evaluation is refused and every
    candidate is tried.
    """
    if g.model in GATED:
        if lazy:
            raise ValueError("lazy greedy needs submodular spread; the all-factor model has none")
        return gated_greedy(g, k, worlds, seed, strategy)
    if lazy:
        prep = stored(prepared(g), "prepared")
        if strategy == "local" or (strategy == "auto" and is_local(prep, g.model)):
            return lazy_walks(g, prep, k, worlds, seed)
        return lazy_cover(stored(reach_relation(g, worlds, seed, "relational"), "reach"), g.nodes, k)
    rel = reach_relation(g, worlds, seed, strategy)
    pairs = rel.select(F.struct("r", "node").alias("rr_id"), F.col("source").alias("node"))
    return greedy_cover(pairs, g.nodes, k, skip_zero=True)


def lazy_walks(g: AuxGraph, prep: DataFrame, k: int, worlds: int, seed: int) -> Cover:
    """Lazy greedy without a reach relation: workers count what each node reaches in a world, and
    walk again from the candidates of a batch.  Under LT a world is a ``Forest``, in which all
    nodes are counted in one pass."""
    spark, model, factors = prep.sparkSession, g.model, g.factors
    forest = model == "LT"
    held = broadcast_graph(prep, model, forest)
    ids = spark.sparkContext.broadcast(_ids(g.nodes.distinct()))
    parts = 1 if forest else _parts(spark, worlds, len(ids.value))

    def walker(r: int):
        graph, known, memo = local_graph(held, model, factors, seed, forest), {}, {}
        return Forest(graph, r).reach if forest else lambda start: graph.reach(r, start, known, memo)

    def count(x: int):
        r, i = divmod(x, parts)
        if forest:
            return Forest(local_graph(held, model, factors, seed, True), r).counts(ids.value)
        reach = walker(r)
        return ((s, sum(1 for v in reach([s * 8]) if not v & 7)) for s in ids.value[i::parts].tolist())

    def evaluate(chosen: list[int], some: list[int]) -> dict[int, float]:
        def run(r: int):
            reach = walker(r)
            covered = reach([x * 8 for x in chosen])
            return [(s, sum(1 for v in reach([s * 8]) if not v & 7 and v not in covered)) for s in some]

        by = per_world(spark, 0, worlds, run, "node long, gain long").groupBy("node").agg(F.sum("gain").alias("gain"))
        return {x.node: x.gain for x in by.collect()}  # a row for each of a batch

    first = per_world(spark, 0, worlds * parts, count, "node long, gain long").groupBy("node").agg(F.sum("gain").alias("gain"))
    found = [(n, int(x)) for n, x in lazy_greedy(first, k, evaluate)[0]]
    return Cover(found, sum(x for _, x in found))


def lazy_cover(rel: DataFrame, nodes: DataFrame, k: int) -> Cover:
    """Lazy greedy over a stored ``rel(r, source, node)``: only the candidates whose last known
    gain could still be the largest are counted anew."""
    first = nodes.select(F.col("id").alias("node")).distinct().join(rel.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("gain")), "node", "left")

    def evaluate(chosen: list[int], some: list[int]) -> dict[int, float]:
        covered = rel.where(F.col("source").isin(chosen)).select("r", "node").distinct()
        mine = rel.where(F.col("source").isin(some)).join(covered, ["r", "node"], "left_anti")
        return {x.source: x["count"] for x in mine.groupBy("source").count().collect()}  # a row for each of a batch

    picks, _ = lazy_greedy(first.select("node", F.coalesce("gain", F.lit(0)).alias("gain")), k, evaluate)
    found = [(n, int(x)) for n, x in picks]
    return Cover(found, sum(x for _, x in found))


def gated_greedy(g: AuxGraph, k: int, worlds: int, seed: int = 43, strategy: str = "auto") -> Cover:
    """Greedy under the AND rule: each round tries every candidate in every world."""
    prep = stored(prepared(g), "prepared")
    spark, model, factors = prep.sparkSession, g.model, g.factors
    local = strategy == "local" or (strategy == "auto" and is_local(prep, model))
    nodes = stored(g.nodes.select("id").distinct(), "nodes")
    n = nodes.count()
    if local:
        held = broadcast_graph(prep, model, False)
        ids = spark.sparkContext.broadcast(_ids(nodes))
        parts = _parts(spark, worlds, n)
    out, total = Cover(), 0
    for _ in range(min(k, n)):
        chosen = out.seeds
        if local:

            def run(x: int, chosen=tuple(chosen)):
                graph, known, memo = local_graph(held, model, factors, seed, False), {}, {}
                r, i = divmod(x, parts)
                return [(c, and_reach(graph, r, [*chosen, c], factors, known, memo)) for c in ids.value[i::parts].tolist() if c not in chosen]

            by = per_world(spark, 0, worlds * parts, run, "node long, spread long")
        else:
            left = nodes.where(~F.col("id").isin(chosen)) if chosen else nodes
            seeds = left.select(F.col("id").alias("c"), F.explode(F.array(F.col("id") * 8, *(F.lit(x * 8).cast("long") for x in chosen))).alias("node"))
            reached = and_closure(in_worlds(seeds, worlds), prep, model, factors, seed, ("r", "c"))
            by = reached.groupBy(F.col("c").alias("node")).agg(F.count(F.lit(1)).alias("spread"))
        sums = by.groupBy("node").agg(F.sum("spread").alias("spread"))
        best = sums.orderBy(F.desc("spread"), "node").limit(1).collect()
        if not best or best[0].spread <= total:
            break
        out.picks.append((best[0].node, best[0].spread - total))
        total = out.covered = best[0].spread
    return out


def and_reach(graph, r: int, seeds: list[int], factors: int, known: dict | None = None, memo: dict | None = None) -> int:
    """Origins active in world r when gated targets need all their factors; ``known`` and
    ``memo`` keep what was drawn of that world, for more walks in it."""
    known, memo = {} if known is None else known, {} if memo is None else memo

    def behind(u: int) -> list[int]:
        if u not in known:
            known[u] = graph.neighbours(r, u, memo)
        return known[u]

    active = {s * 8 for s in seeds}
    met: dict[int, set[int]] = {}
    todo = list(active)
    while todo:
        for v in behind(todo.pop()):
            target, f = v & ~7, v & 7
            if target in active:
                continue
            if f:
                met.setdefault(target, set()).add(f)
                if len(met[target]) < factors or not all(target in behind(target + i) for i in range(1, factors + 1)):
                    continue
            active.add(target)
            todo.append(target)
    return len(active)


def reach_greedy(edges: DataFrame, nodes: DataFrame, k: int) -> Cover:
    """Greedy on plain reachability, without diffusion.

    Nodes that reach one another reach the same, so the largest such group is contracted to its
    smallest node, which counts for all of them; what reaches what is then listed for the rest
    only.  (Where no group is large, the listing is quadratic in the nodes that cycles leave.)
    """
    ids = nodes.select("id").distinct()
    rep = stored(hub_component(edges, ids), "component")
    size = F.broadcast(rep.agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep")))  # one row
    to = stored(ids.join(rep.withColumn("in", F.lit(True)), "id", "left").join(size).select("id", F.when(F.col("in"), F.col("rep")).otherwise(F.col("id")).alias("to"), F.when(F.col("in"), F.col("size")).otherwise(1).cast("long").alias("weight")), "contracted")
    of = lambda name: to.select(F.col("id").alias(name), F.col("to").alias(f"{name}_to"))
    short = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).where("src <> dst").distinct()
    short = stored(short, "short")
    start = to.select(F.col("to").alias("r"), F.col("to").alias("node")).distinct()
    rel = closure(start, lambda front: front.join(short, F.col("node") == F.col("src")).select("r", F.col("dst").alias("node")))
    weights = to.select(F.col("to").alias("node"), "weight").distinct()
    pairs = rel.join(weights, "node").select(F.col("node").alias("rr_id"), F.col("r").alias("node"), "weight")
    return greedy_cover(pairs, ids, k)


def hub_component(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): the nodes that the node of largest degree reaches and that reach it, itself included."""
    both = edges.select("src", "dst")
    hub = out_degree(both, ids).orderBy(F.desc("degree"), "id").limit(1).select(F.lit(0).cast("long").alias("r"), F.col("id").alias("node"))
    ahead = closure(hub, lambda front: front.join(both, F.col("node") == F.col("src")).select("r", F.col("dst").alias("node")))
    back = closure(hub, lambda front: front.join(both, F.col("node") == F.col("dst")).select("r", F.col("src").alias("node")))
    return ahead.join(back, ["r", "node"], "left_semi").select(F.col("node").alias("id"))
