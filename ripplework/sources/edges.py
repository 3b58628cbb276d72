"""Graph sources: text, binary and table inputs to edges(src, dst[, prob])."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplework.functions.keyed import u32

# ---------------------------------------------------------------- text


def parse_edge_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst of every line that starts with two integers.

    Blank lines, comments (``#``, indented or not), short lines and lines whose first two
    fields are no integers are skipped; what follows the second field is ignored.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    pair = lines.where(~F.trim(F.col(column)).startswith("#")).select(
        F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("dst")
    )
    return pair.where("src IS NOT NULL AND dst IS NOT NULL")


def skipped_lines(lines: DataFrame, column: str = "value") -> int:
    return lines.count() - parse_edge_lines(lines, column).count()


def read_edges(spark: SparkSession, path: str, directed: bool = True, dedup: bool = True, skip_header: bool = False) -> DataFrame:
    """An edge list from text files; ``skip_header`` drops the first line of each file."""
    lines = spark.read.text(path)
    if skip_header:
        at = lines.select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
        first = at.where("__b = 0").groupBy("__f").agg(F.min("__i").alias("__first"))
        lines = at.join(F.broadcast(first), "__f", "left").where("__first IS NULL OR __i <> __first")
    edges = parse_edge_lines(lines)
    edges = edges if directed else undirected(edges)
    return edges.distinct() if dedup else edges


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def remap_ids(edges: DataFrame, position: Column) -> tuple[DataFrame, DataFrame]:
    """Dense ids in order of first appearance: (edges, ids(id, dense)).

    ``position`` orders the edges; an edge's source appears before its target.  The one
    ordering over all ids is a range-partitioned sort: ranks come from counts of the sorted
    partitions, so no single task sees all ids.
    """
    ends = edges.select(F.explode(F.array(F.struct(position.alias("p"), F.lit(0).alias("e"), F.col("src").alias("id")), F.struct(position.alias("p"), F.lit(1).alias("e"), F.col("dst").alias("id")))).alias("x"))
    first = ends.groupBy("x.id").agg(F.min(F.struct("x.p", "x.e")).alias("at"))
    ids = dense_rank_by(first, ["at"]).select("id", F.col("rank").alias("dense"))
    out = edges.join(ids.withColumnRenamed("id", "src").withColumnRenamed("dense", "s"), "src").join(ids.withColumnRenamed("id", "dst").withColumnRenamed("dense", "d"), "dst")
    return out.select(F.col("s").alias("src"), F.col("d").alias("dst")), ids


def dense_rank_by(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` and rank (from 0) in this order, by a global sort and per-partition offsets."""
    from ripplework.functions.scratch import stored

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return held.withColumn("__row", inside).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + F.col("__row") - 1).drop("__part", "__row", "__start")


def check_compact(edges: DataFrame, n: int) -> DataFrame:
    """Edges, with an error at run time for ids outside 0..n-1."""
    ok = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    return edges.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("id out of range: "), F.col("src").cast("string"), F.lit(" "), F.col("dst").cast("string")))))


def read_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """``name=value`` lines; origin_n is n where it is absent."""
    rows = spark.read.text(path).where("value LIKE '%=%'").select(F.trim(F.substring_index("value", "=", 1)).alias("k"), F.trim(F.regexp_replace("value", "^[^=]*=", "")).alias("v"))
    found = {r.k: r.v for r in rows.limit(1000).collect()}
    if "n" in found:
        found.setdefault("origin_n", found["n"])
    return found


def read_weighted(spark: SparkSession, path: str, header: bool = False, expected: int | None = None) -> DataFrame:
    """``src dst prob`` text; with a header the first line is ``n m`` and m is checked."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(parts.alias("p"))
    if header and expected is None:
        heads = lines.where(F.size("p") == 2).agg(F.sum(F.col("p")[1].cast("bigint"))).first()[0]
        expected = int(heads) if heads is not None else None
    out = lines.where(F.size("p") == 3).select(F.col("p")[0].cast("bigint").alias("src"), F.col("p")[1].cast("bigint").alias("dst"), F.col("p")[2].cast("double").alias("prob"))
    if expected is not None and (found := out.count()) != expected:
        raise ValueError(f"{path} has {found} edges, not {expected}")
    return out


# ---------------------------------------------------------------- binary


def _blocks(content: DataFrame, decode: Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges of each row of one binary column."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                src, dst, prob = decode(content.as_py())
                for a in range(0, len(src), 1 << 20):
                    z = slice(a, a + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array(src[z].astype(np.int64)), pa.array(dst[z].astype(np.int64)), pa.array(prob[z].astype(np.float64))], names=["src", "dst", "prob"])

    return content.mapInArrow(run, "src long, dst long, prob double")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


RECORD = np.dtype([("src", "<i4"), ("dst", "<i4"), ("prob", "<f4")])


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """Records (int32, int32, float32); a file is decoded as a whole in one task."""
    return _blocks(_files(spark, path), _records)


def read_packed_edges(spark: SparkSession, path: str) -> DataFrame:
    """The same records in the table that ``sinks.write_graph_binary`` writes."""
    return _blocks(spark.read.parquet(path).select("records"), _records)


def _records(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(raw) % RECORD.itemsize:
        raise ValueError("the file is no whole number of records")
    a = np.frombuffer(raw, RECORD)
    return a["src"], a["dst"], a["prob"]


def read_reverse_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """uint64 n, then for each target uint64 degree and (uint32 source, float32 prob) pairs."""

    def decode(raw: bytes):
        (n,), at = struct.unpack_from("<Q", raw), 8
        src, dst, prob = [], [], []
        pair = np.dtype([("src", "<u4"), ("prob", "<f4")])
        for v in range(n):
            (d,) = struct.unpack_from("<Q", raw, at)
            a = np.frombuffer(raw, pair, d, at + 8)
            at += 8 + d * pair.itemsize
            src.append(a["src"])
            prob.append(a["prob"])
            dst.append(np.full(d, v))
        none = np.zeros(0)
        return tuple(np.concatenate([none, *x]) for x in (src, dst, prob))

    return _blocks(_files(spark, path), decode)


# ---------------------------------------------------------------- weights


def weighted(edges: DataFrame, how: str = "WC", p: float = 0.1, seed: int = 0) -> DataFrame:
    """edges with prob: WC 1 / in-degree, UNI a constant, TR one of 0.1, 0.01 and 0.001.

    Semantics from the literature; not verified against a concrete implementation.
    """
    if how == "WC":
        deg = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("__d"))
        return edges.join(deg, "dst").select("src", "dst", (F.lit(1.0) / F.col("__d")).alias("prob"))
    if how == "UNI":
        return edges.select("src", "dst", F.lit(float(p)).alias("prob"))
    if how == "TR":
        one_of = F.array(F.lit(0.1), F.lit(0.01), F.lit(0.001))
        return edges.select("src", "dst", F.element_at(one_of, (u32("tri", seed, F.col("src"), F.col("dst")) % 3 + 1).cast("int")).alias("prob"))
    raise ValueError("weights are WC, UNI or TR")


# ---------------------------------------------------------------- tables

DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def dataset(name: str):
    def put(f):
        DATASETS[name] = f
        return f

    return put


@dataset("user_seq")
def user_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who follow one another in the event stream.

    ``lead`` over all events is one global order: it is dealt by ranges, each of which has its own
    ``lead``, and the last row of a range is paired with the first of the next range that has rows.
    """
    from ripplework.functions.scratch import stored

    order = ["ts", "event_id"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(*order, "user_id")
    ranges = e.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(*order)
    rows = ranges.select("part", F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.row_number().over(w) == 1).alias("first"), F.lead(F.lit(True)).over(w).isNull().alias("last"))
    rows = stored(rows.where("src <> dst OR first OR last"), "pairs")
    ends = rows.where("first OR last").groupBy("part").agg(F.max(F.when(F.col("first"), F.col("src"))).alias("first"), F.max(F.when(F.col("last"), F.col("src"))).alias("src"))
    across = ends.select("src", F.lead("first").over(Window.orderBy("part")).alias("dst"))  # a row for each range
    return rows.select("src", "dst").unionByName(across).where("src <> dst").distinct()


@dataset("part_seq")
def part_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow one another in an order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.where("dst IS NOT NULL AND src <> dst").distinct()


def load(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown graph {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, sf_dir)
