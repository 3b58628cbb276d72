"""Experiments: budgets by algorithms on shared worlds, as a long or a wide table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.scratch import stored
from ripplework.operators import baselines, select
from ripplework.operators.aux_graph import FACTORS, AuxGraph, build
from ripplework.operators.spread import all_factor_spread, mean_spread, spread_by_world

#: Names as users write them, and the label of the result column.
LABELS = {"greedy": "Greedy", "lfg": "LFG", "gwdm": "GWDM", "maxdegree": "MaxDegree", "random": "Random", "mf-rr": "MF-RR", "mf-imm": "MF-IMM", "opim-c": "OPIM-C"}
MODELS = {"MFIC": "IC", "MFLT": "LT", "MFTRIGGER": "TRIGGER", "MFOLO": "OLO", "MFIC2": "IC2", "MFIC2MIX": "IC2MIX"}
GRAPH_BUILDERS: dict[tuple[str, int], Callable[..., AuxGraph]] = {
    (m, f): (lambda edges, m=m, f=f, **kw: build(edges, m, f, **kw)) for m in MODELS.values() for f in FACTORS
}


def algorithm_name(text: str) -> str:
    name = text.strip().lower().replace("_", "-")
    name = {"mfrr": "mf-rr", "mfimm": "mf-imm", "opimc": "opim-c", "max-degree": "maxdegree", "lfgreedy": "lfg"}.get(name, name)
    if name not in LABELS:
        raise ValueError(f"unknown algorithm {text}; there are {', '.join(LABELS)}")
    return name


def model_name(text: str) -> str:
    name = MODELS.get(text.strip().upper(), text.strip().upper())
    if name not in MODELS.values():
        raise ValueError(f"unknown model {text}; there are {', '.join(MODELS)}")
    return name


def budgets(max_k: int, step: int) -> list[int]:
    if max_k < 0 or step <= 0:
        raise ValueError("max_k must not be negative and step must be positive")
    return list(range(0, max_k + 1, step))


def seeds_by_algorithm(name: str, edges: DataFrame, g: AuxGraph, k: int, theta: int, worlds: int, seed: int) -> Callable[[int], list[int]]:
    """A function from a budget to its seeds.  All but IMM give nested seeds, so one pass at
    the largest budget serves every smaller one."""
    if name == "mf-imm":
        return lambda b: select.imm(g, b, seed=seed, max_theta=theta).cover.seeds
    if name == "maxdegree":
        found = [r.id for r in baselines.max_degree(edges, g.nodes, k).collect()]
    elif name == "random":
        found = [r.id for r in baselines.random_seeds(g.nodes, k, seed).collect()]
    elif name == "gwdm":
        found = baselines.reach_greedy(edges, g.nodes, k).seeds
    elif name in ("greedy", "lfg"):
        found = baselines.world_greedy(g, k, worlds, seed + 1, lazy=name == "lfg").seeds
    elif name == "opim-c":
        found = select.opimc(g, k, seed=seed, total=theta).cover.seeds
    else:
        found = select.rr_greedy(g, k, theta, seed).seeds
    return lambda b: found[:b]


def run_experiment(
    edges: DataFrame,
    algorithms: list[str],
    ks: list[int],
    model: str = "MFIC",
    factors: int = 2,
    worlds: int = 200,
    theta: int = 2000,
    seed: int = 42,
    greedy_from_lfg: bool = False,
    on_budget: Callable[[DataFrame], None] | None = None,
    **graph_args,
) -> DataFrame:
    """(size, algorithm, influence); every algorithm is scored on the same worlds.

    ``on_budget`` gets the rows of each budget as they are ready (a checkpoint).
    """
    name, ks = model_name(model), select.normalise_ks(ks)
    edges = stored(edges.select("src", "dst"), "edges")
    g = build(edges, name, factors, seed, **graph_args)
    g = AuxGraph(stored(g.nodes, "nodes"), stored(g.edges, "aux_edges"), stored(g.node_prob, "node_prob"), name, factors)
    wanted = list(dict.fromkeys(map(algorithm_name, algorithms)))
    run = [a for a in wanted if not (a == "greedy" and greedy_from_lfg)]
    if greedy_from_lfg and "greedy" in wanted and "lfg" not in run:
        run.append("lfg")
    spark = edges.sparkSession
    choose = {a: seeds_by_algorithm(a, edges, g, max(ks, default=0), theta, min(worlds, 50), seed) for a in run if max(ks, default=0) > 0}
    rows: list[tuple] = []
    for k in ks:
        here = []
        for a in run:
            seeds = choose[a](k) if k else []
            value = 0.0
            if seeds:
                table = spark.createDataFrame([(s,) for s in seeds], "id long")
                score = all_factor_spread if name in baselines.GATED else spread_by_world
                value = mean_spread(score(g, table, worlds, seed + 1)).first()[0]
            here.append((k, LABELS[a], float(value)))
        if greedy_from_lfg and "greedy" in wanted:
            here.append((k, LABELS["greedy"], next(v for _, label, v in here if label == "LFG")))
        here = [x for x in here if x[1] in {LABELS[a] for a in wanted}]
        rows += here
        if on_budget:
            on_budget(spark.createDataFrame(here, "size int, algorithm string, influence double"))
    return spark.createDataFrame(rows, "size int, algorithm string, influence double")


def wide(results: DataFrame, algorithms: list[str] | None = None) -> DataFrame:
    """A row for each budget and a column for each algorithm."""
    labels = [LABELS[algorithm_name(a)] for a in algorithms] if algorithms else None
    p = results.groupBy("size").pivot("algorithm", labels) if labels else results.groupBy("size").pivot("algorithm")
    return p.agg(F.first("influence")).orderBy("size")
