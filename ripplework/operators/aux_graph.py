"""Expanded graphs: every tie acts through the factors of its target.

Each node with parents owns F factors; each parent points to each factor, and each factor
to its owner.  Models:

IC       a factor passes on with a probability of its own, drawn once in a fixed range
LT       factors share weight 1; one of them takes what the others leave
TRIGGER  one probability for the owner: the largest of its factors' draws
OLO      the same with the noisy-or of the draws
IC2      every factor has the same probability and all must pass on (all-factor)
IC2MIX   as IC2 for a share of the owners; the others keep their direct edges
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.functions.keyed import TWO32, u32, uniform

FACTORS = (2, 3, 5)
MODELS = ("IC", "LT", "TRIGGER", "OLO", "IC2", "IC2MIX")

# Ranges of the factors' draws, by model and number of factors; None takes
# what the others leave of 1.
RANGES: dict[tuple[str, int], tuple] = {
    ("IC", 2): ((0.0, 0.2), (0.2, 0.3)),
    ("IC", 3): ((0.0, 0.2), (0.2, 0.3), (0.0, 0.2)),
    ("IC", 5): ((0.0, 0.2), (0.2, 0.3), (0.0, 0.2), (0.0, 0.2), (0.0, 0.2)),
    ("LT", 2): ((0.0, 0.3), None),
    ("LT", 3): ((0.0, 0.3), None, (0.0, 0.3)),
    ("LT", 5): ((0.0, 0.2), None, (0.0, 0.2), (0.0, 0.2), (0.0, 0.2)),
    ("TRIGGER", 2): ((0.0, 0.3), (0.2, 0.3)),
    ("TRIGGER", 3): ((0.0, 0.3), (0.2, 0.4), (0.0, 0.3)),
    ("TRIGGER", 5): ((0.0, 0.2), (0.2, 0.4), (0.0, 0.2), (0.0, 0.2), (0.0, 0.2)),
}
# Ranges of the parents' gates under LT, by number of factors.
GATES = {
    2: ((0.10, 0.45), (0.55, 0.95)),
    3: ((0.05, 0.30), (0.35, 0.90), (0.15, 0.55)),
    5: ((0.02, 0.18), (0.45, 0.95), (0.12, 0.45), (0.05, 0.22), (0.02, 0.18)),
}


@dataclass(frozen=True)
class AuxGraph:
    """``nodes(id)``, ``edges(src, dst, prob)`` and ``node_prob(node, p)`` over expanded ids;
    ``alike`` if a node's factors are known to have the same edges into them."""

    nodes: DataFrame
    edges: DataFrame
    node_prob: DataFrame
    model: str
    factors: int
    alike: bool = False


def ranges(model: str, factors: int) -> tuple:
    key = ("TRIGGER" if model == "OLO" else model, factors)
    if key not in RANGES:
        raise ValueError(f"no ranges for {model} with {factors} factors")
    return RANGES[key]


def factor_draws(model: str, factors: int, seed: int, node: Column) -> list[Column]:
    """The weight of each factor of ``node``, as expressions."""
    out: list[Column | None] = []
    for i, r in enumerate(ranges(model, factors), 1):
        out.append(None if r is None else F.lit(r[0]) + F.lit(r[1] - r[0]) * uniform("factor_w", seed, node, F.lit(i)))
    rest = F.lit(1.0)
    for w in out:
        if w is not None:
            rest = rest - w
    return [rest if w is None else w for w in out]


def noisy_or(weights: list[Column]) -> Column:
    miss = F.lit(1.0)
    for w in weights:
        miss = miss * (F.lit(1.0) - w)
    return F.least(F.greatest(F.lit(1.0) - miss, F.lit(0.0)), F.lit(1.0))


def build(
    edges: DataFrame,
    model: str,
    factors: int,
    seed: int = 42,
    nodes: DataFrame | None = None,
    p: float = 0.778,
    ratio: float = 0.10,
    parent_gate: str = "original",
    dedup: bool = True,
) -> AuxGraph:
    """The expanded graph.  ``p`` and ``ratio`` are for IC2 and IC2MIX; ``parent_gate`` is
    ``original`` (1 / in-degree) or ``factor_aware`` (times a gate drawn for each tie, LT)."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {', '.join(MODELS)}")
    if factors not in FACTORS:
        raise ValueError("factors must be 2, 3 or 5")
    if parent_gate not in ("original", "factor_aware"):
        raise ValueError("parent_gate must be original or factor_aware")
    edges = edges.select("src", "dst")
    edges = edges.distinct() if dedup else edges
    indeg = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    v = F.col("id")
    gated = (u32("mix", seed, v) < F.lit(ratio * TWO32)) if model == "IC2MIX" else F.lit(True)
    indeg = indeg.withColumn("gated", gated)
    if model in ("IC2", "IC2MIX"):
        weights = [F.lit(float(p))] * factors
    else:
        weights = factor_draws(model, factors, seed, v)
    one = F.greatest(*weights) if model == "TRIGGER" else noisy_or(weights) if model == "OLO" else None
    each = weights if one is None else [one] * factors
    down = indeg.where("gated").select(v, F.posexplode(F.array(*each)).alias("k", "prob"))
    down = down.select((v * 8 + F.col("k") + 1).alias("src"), (v * 8).alias("dst"), "prob")
    ties = edges.join(indeg.withColumnRenamed("id", "dst"), "dst")
    spread = ties.where("gated").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(factors))))
    share = F.lit(1.0) / F.col("d")
    if model == "LT" and parent_gate == "factor_aware":
        gate = None
        for i, (lo, hi) in enumerate(GATES[factors], 1):
            g = F.lit(lo) + F.lit(hi - lo) * uniform("gate", seed, F.col("src"), F.col("dst"), F.col("i"))
            gate = F.when(F.col("i") == i, g) if gate is None else gate.when(F.col("i") == i, g)
        share = gate / F.col("d")
    up = spread.select((F.col("src") * 8).alias("src"), (F.col("dst") * 8 + F.col("i")).alias("dst"), share.alias("prob"))
    out = down.unionByName(up)
    if model == "IC2MIX":
        direct = ties.where("NOT gated").select((F.col("src") * 8).alias("src"), (F.col("dst") * 8).alias("dst"), (F.lit(1.0) / F.col("d")).alias("prob"))
        out = out.unionByName(direct)
    if model in ("TRIGGER", "OLO"):
        per = indeg.select(v, F.posexplode(F.array(one, *[F.lit(1.0) / F.col("d")] * factors)).alias("k", "p"))
        node_prob = per.select((v * 8 + F.col("k")).alias("node"), "p")
    else:
        node_prob = out.groupBy(F.col("dst").alias("node")).agg(F.max("prob").alias("p"))
    if nodes is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return AuxGraph(nodes.select("id"), out, node_prob, model, factors, alike=model != "LT" or parent_gate == "original")


def build_fixed(edges: DataFrame, model: str, factors: int, p: float, seed: int = 42) -> AuxGraph:
    """The same shape with one constant probability for factors and owners (for checks)."""
    g = build(edges, "IC2" if model in ("IC", "IC2", "TRIGGER", "OLO") else model, factors, seed, p=p)
    own = g.edges.where("(src & 7) > 0").select(F.col("dst").alias("node"), F.lit(p).alias("p")).distinct()
    fac = g.edges.where("(dst & 7) > 0").groupBy(F.col("dst").alias("node")).agg(F.max("prob").alias("p"))
    return AuxGraph(g.nodes, g.edges, own.unionByName(fac), model, factors)


def sizes(g: AuxGraph) -> tuple[int, int]:
    """Nodes and edges of the expanded graph."""
    n = g.nodes.count() + g.edges.where("(src & 7) > 0").select("src").distinct().count()
    return n, g.edges.count()
