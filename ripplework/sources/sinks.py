"""Outputs: result tables, prefix files, summaries and graphs in text, binary and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.operators.aux_graph import AuxGraph
from ripplework.operators.experiment import wide


def write_results_csv(results: DataFrame, path: str) -> None:
    """The wide table of an experiment as CSV with a header."""
    wide(results).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row for each budget


def append_results(results: DataFrame, path: str) -> None:
    """Checkpoint of one budget: Parquet, partitioned by size."""
    results.write.mode("append").partitionBy("size").parquet(path)


def output_name(graph: str, algorithm: str, model: str, k: int, **extra) -> str:
    return "_".join([graph, algorithm, model, f"k{k}", *(f"{a}{b}" for a, b in extra.items() if b not in (None, ""))])


def write_prefixes(rows: DataFrame, path: str, name: str, budget: int = 0) -> None:
    """A CSV with a line for each k, and the seeds of each k as lines of text by k.

    ``rows`` has k, seeds, covered_rr and self_influence; what else the CSV names is null
    where it is missing.
    """
    have = set(rows.columns)
    col = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    csv = rows.select(
        "k", col("approximation_for_kmax", "double"), col("time_sec", "double"), F.col("self_influence").alias("self_estimated_influence"),
        col("validation_influence", "double"), "covered_rr", col("rr_sets", "bigint"), F.lit(budget).alias("rr_sets_total_budget"),
        F.concat(F.lit(f"{path}/seed/k="), F.col("k")).alias("seed_file"), F.array_join("seeds", " ").alias("seeds"),
    )
    csv.orderBy("k").coalesce(1).write.mode("overwrite").csv(f"{path}/{name}_prefix", header=True)
    rows.select("k", F.explode("seeds").alias("s")).select("k", F.col("s").cast("string").alias("value")).write.mode("overwrite").partitionBy("k").text(f"{path}/seed")


def write_summary(spark: SparkSession, path: str, facts: dict, seeds: list[int]) -> None:
    """One JSON row of facts, and the seeds in order."""
    spark.createDataFrame([{**{k: str(v) for k, v in facts.items()}, "seeds": " ".join(map(str, seeds))}]).coalesce(1).write.mode("overwrite").json(path)


def write_graph_text(g: AuxGraph, path: str, header: bool = False) -> None:
    """``src dst prob`` with 12 significant digits; a header file has nodes and edges."""
    g.edges.select(F.format_string("%d %d %s", "src", "dst", significant("prob")).alias("value")).write.mode("overwrite").text(f"{path}/edges")
    if header:
        from ripplework.operators.aux_graph import sizes

        n, m = sizes(g)
        g.edges.sparkSession.createDataFrame([(f"{n} {m}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def significant(name: str, digits: int = 12):
    """A double with this many significant digits, without an exponent for usual sizes."""
    v = F.col(name)
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))).cast("int"))
    return F.when(v == 0, F.lit("0")).otherwise(F.round(v * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places)).cast("string")


def write_attributes(spark: SparkSession, path: str, **facts) -> None:
    """``name=value`` lines."""
    rows = [(f"{k}={v}",) for k, v in facts.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph_binary(g: AuxGraph, path: str) -> None:
    """Records (int32, int32, float32) in one binary column a partition; ids are checked."""
    import numpy as np
    import pyarrow as pa

    from ripplework.sources.edges import RECORD

    def pack(batches):
        for b in batches:
            a = np.zeros(b.num_rows, RECORD)
            for c in ("src", "dst"):
                v = b.column(c).to_numpy(zero_copy_only=False)
                if len(v) and (v.min() < -(1 << 31) or v.max() >= 1 << 31):
                    raise ValueError("an id does not fit in 32 bits")
                a[c] = v
            a["prob"] = b.column("prob").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["records"])

    g.edges.select("src", "dst", "prob").mapInArrow(pack, "records binary").write.mode("overwrite").parquet(path)


def save_graph(g: AuxGraph, path: str) -> None:
    for name in ("nodes", "edges", "node_prob"):
        getattr(g, name).write.mode("overwrite").parquet(f"{path}/{name}")
    write_attributes(g.edges.sparkSession, f"{path}/attributes", model=g.model, factors=g.factors)


def load_graph(spark: SparkSession, path: str) -> AuxGraph:
    from ripplework.sources.edges import read_attributes

    facts = read_attributes(spark, f"{path}/attributes")
    return AuxGraph(*(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "node_prob")), facts["model"], int(facts["factors"]))
