"""Accessors of the original and the expanded graph.

An expanded node is ``id * 8 + f``: f = 0 is the node itself (an origin), 1 to 5 its factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aux_id(id_: Column, factor: Column | int = 0) -> Column:
    return id_ * 8 + (F.lit(factor) if isinstance(factor, int) else factor)


def owner(aux: Column) -> Column:
    return F.shiftright(aux, 3)


def factor_of(aux: Column) -> Column:
    return aux.bitwiseAND(F.lit(7)).cast("int")


def is_origin(aux: Column) -> Column:
    return aux.bitwiseAND(F.lit(7)) == 0


def nodes_of(edges: DataFrame) -> DataFrame:
    """id of every node that an edge touches.  Isolated nodes need a table of their own."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def children(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, child) for the nodes in ``of(id)``; nothing for those without out-edges."""
    return of.select("id").join(edges, F.col("id") == F.col("src")).select("id", F.col("dst").alias("child")).distinct()


def parents(edges: DataFrame, of: DataFrame) -> DataFrame:
    return of.select("id").join(edges, F.col("id") == F.col("dst")).select("id", F.col("src").alias("parent")).distinct()


def in_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return _degree(edges, "dst", nodes)


def out_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return _degree(edges, "src", nodes)


def _degree(edges: DataFrame, side: str, nodes: DataFrame | None) -> DataFrame:
    d = edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return d
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def origins(aux_nodes: DataFrame, column: str = "node") -> DataFrame:
    return aux_nodes.where(is_origin(F.col(column)))


def only_factor_parents(aux_edges: DataFrame) -> DataFrame:
    """(node, gated) for targets: whether all their parents are factors."""
    return aux_edges.groupBy(F.col("dst").alias("node")).agg(F.bool_and(~is_origin(F.col("src"))).alias("gated"))


def factor_metadata(aux_edges: DataFrame) -> DataFrame:
    """(node, owner, factor) of every factor node."""
    f = aux_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().where(~is_origin(F.col("node")))
    return f.select("node", owner(F.col("node")).alias("owner"), factor_of(F.col("node")).alias("factor"))


def reach_counts(edges: DataFrame, seeds: DataFrame, together: bool = False) -> DataFrame:
    """(id, reached): nodes that each seed reaches in the plain graph, itself included; with
    ``together`` one row for what all seeds reach."""
    from ripplework.operators.spread import closure

    start = seeds.select((F.lit(0) if together else F.col("id")).cast("long").alias("r"), F.col("id").alias("node")).distinct()
    reached = closure(start, lambda front: front.join(edges, F.col("node") == F.col("src")).select("r", F.col("dst").alias("node")))
    return reached.groupBy(F.col("r").alias("id")).agg(F.count(F.lit(1)).alias("reached"))
