"""Command line: build an expanded graph, select seeds, run an experiment.

    python -m ripplework.cli build   --edges PATH --model MFIC --factors 2 --out DIR
    python -m ripplework.cli select  --graph DIR --algorithm opim-c --k 50 --out DIR
    python -m ripplework.cli experiment --edges PATH --model MFLT --algorithms MF-RR,LFG --max-k 20 --step 5 --out DIR
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from ripplework.operators import experiment, select
from ripplework.operators.aux_graph import build, sizes
from ripplework.sources import sinks
from ripplework.sources.edges import read_edges

log = logging.getLogger("ripplework")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ripplework")
    sub = p.add_subparsers(dest="command", required=True)
    graph = argparse.ArgumentParser(add_help=False)
    graph.add_argument("--edges", required=True)
    graph.add_argument("--undirected", action="store_true")
    graph.add_argument("--skip-header", action="store_true")
    graph.add_argument("--keep-duplicates", action="store_true")
    graph.add_argument("--model", default="MFIC")
    graph.add_argument("--factors", type=int, default=2)
    graph.add_argument("--p", type=float, default=0.778, help="probability of a factor, all-factor models")
    graph.add_argument("--ratio", type=float, default=0.10, help="share of gated nodes, MFIC2MIX")
    graph.add_argument("--parent-gate", default="original", choices=["original", "factor_aware"])
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--seed", type=int, default=42)
    common.add_argument("--out", required=True)
    b = sub.add_parser("build", parents=[graph, common])
    b.add_argument("--format", default="parquet", choices=["parquet", "text", "binary"])
    s = sub.add_parser("select", parents=[common])
    s.add_argument("--graph", required=True)
    s.add_argument("--algorithm", default="opim-c", choices=["rr", "imm", "opim", "opim-c", "all-factor"])
    s.add_argument("--k", type=int, default=50)
    s.add_argument("--ks", default="", help="budgets of a prefix table, like 1,5,10")
    s.add_argument("--eps", type=float, default=0.1)
    s.add_argument("--delta", type=float)
    s.add_argument("--ell", type=float, default=1.0)
    s.add_argument("--sets", type=int, default=10_000)
    s.add_argument("--mode", type=int, default=2, choices=[0, 1, 2])
    s.add_argument("--pool", type=int, default=0)
    s.add_argument("--final-delta", type=float, default=1e-3, help="of the stopping rule that measures OPIM's seeds")
    s.add_argument("--final-eps", type=float, default=0.1)
    e = sub.add_parser("experiment", parents=[graph, common])
    e.add_argument("--algorithms", default="MF-RR,MF-IMM,MaxDegree,Random")
    e.add_argument("--max-k", type=int, default=50)
    e.add_argument("--step", type=int, default=5)
    e.add_argument("--worlds", type=int, default=2000)
    e.add_argument("--sets", type=int, default=5000)
    e.add_argument("--greedy-from-lfg", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("build", "experiment"):
        edges = read_edges(spark, a.edges, not a.undirected, not a.keep_duplicates, a.skip_header)
        how = {"p": a.p, "ratio": a.ratio, "parent_gate": a.parent_gate, "dedup": not a.keep_duplicates}
    if a.command == "build":
        g = build(edges, experiment.model_name(a.model), a.factors, a.seed, **how)
        if a.format == "parquet":
            sinks.save_graph(g, a.out)
        elif a.format == "text":
            sinks.write_graph_text(g, a.out, header=True)
        else:
            sinks.write_graph_binary(g, a.out)
        log.info("nodes and edges: %s", sizes(g))
    elif a.command == "select":
        run_select(spark, a)
    else:
        ks = experiment.budgets(a.max_k, a.step)
        rows = experiment.run_experiment(
            edges, a.algorithms.split(","), ks, a.model, a.factors, a.worlds, a.sets, a.seed, a.greedy_from_lfg,
            lambda df: sinks.append_results(df, f"{a.out}/budgets"), **how,
        )
        sinks.write_results_csv(rows, f"{a.out}/results")
    return 0


def run_select(spark: SparkSession, a: argparse.Namespace) -> None:
    g = sinks.load_graph(spark, a.graph)
    facts: dict = {"algorithm": a.algorithm, "k": a.k, "model": g.model}
    sets, found = a.sets, None
    if a.algorithm == "rr":
        cover = select.rr_greedy(g, a.k, sets, a.seed)
    elif a.algorithm == "imm":
        r = select.imm(g, a.k, a.eps, a.ell, a.seed)
        cover, sets = r.cover, r.theta
        facts |= {"lower": r.lower, "influence": r.influence}
    elif a.algorithm == "all-factor":
        cover, _ = select.all_factor_greedy(g, a.k, sets, a.seed, a.pool)
    else:
        if a.algorithm == "opim":
            r = select.opim(g, a.k, sets, a.delta, a.mode, a.seed, a.pool, final=(a.final_delta, a.final_eps))
        else:
            r = select.opimc(g, a.k, a.eps, a.delta, a.mode, a.seed, pool=a.pool)
        cover, sets, found = r.cover, r.sets, r
        facts |= {"ratio": r.ratio, "influence": r.influence, "accepted": r.accepted}
    sinks.write_summary(spark, f"{a.out}/summary", facts | {"sets": sets, "covered": cover.covered}, cover.seeds)
    log.info("seeds: %s", " ".join(map(str, cover.seeds)))
    log.info("%s", ", ".join(f"{k} {v}" for k, v in facts.items()))
    if a.ks:
        ks = select.parse_ks(a.ks)
        rows = select.prefix_rows(g, found, ks) if found else select.prefixes(cover.table(spark), ks, g.nodes.count(), sets)
        sinks.write_prefixes(rows, a.out, sinks.output_name("graph", a.algorithm, g.model, a.k), sets)


if __name__ == "__main__":
    raise SystemExit(main())
