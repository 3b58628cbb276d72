"""K-d tree partitioning of documents into shards of near equal bytes.

A node is split at the weighted median (more generally, at the weighted quantile of the
shards on its left side) along its widest metadata dimension, until a leaf is one shard.
Weights are row sizes in bytes; widths are taken relative to the whole table's range.

All nodes of a level are split at once: the node is a column of the slim points, the nodes'
widest dimensions come from one aggregation, and their medians from ``cuts``, exact and
without sorting a node.  The driver sees no rows of either, so the number of shards is
bounded by neither the driver nor an expression.

All dimensions are properties of the text, so equal texts are one point.  Rows that tie on
the dimension are told apart by the text's CRC-32; a group of equal texts moves as a whole
to the nearer side if that misses the goal by less than ``GROUP_SLACK`` of a shard, else the
group (a third of all rows, say) is split by the row's stored number.

Defined cases: null text has 0 bytes and is a group with the empty text; null doc_ids and
repeated rows are rows like any other and are split like them; an empty table gives no rows;
shards that get no row are allowed when there are fewer rows than shards.  Slots are gapless
for each shard; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize, release
from .cuts import cuts, with_keys

#: Share of a shard's bytes by which a cut may miss its goal to keep equal texts together.
GROUP_SLACK = 0.01
#: Bytes, bytes beyond one a character, and lines; in the order that breaks ties of width.
DIMENSIONS = ("size", "wide_bytes", "lines")
#: Parts of a shard in which rows are numbered.
SLOT_PARTS = 256


def points(docs: DataFrame) -> DataFrame:
    """A slim row for each document: id, size, integer coordinates and a number."""
    text = F.coalesce("text", F.lit(""))
    return columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text) - F.length(text)).cast("long").alias("wide_bytes"),
        (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long").alias("lines"),
        F.monotonically_increasing_id().alias("row"),
    )


def split_level(data: DataFrame, spread: dict[str, int]) -> DataFrame:
    """``data`` (points with first and count: the node's shards) with every node split once."""
    data = data.withColumn("key", F.col("first").cast("string"))
    ends = [f(c).alias(f"{t}_{c}") for c in DIMENSIONS for t, f in (("lo", F.min), ("hi", F.max))]
    nodes = data.where("count > 1").groupBy("key", "count").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("__n"), *ends)
    widths = [(F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(spread[c]) for c in DIMENSIONS]
    widest = F.array_position(F.array(*widths), F.greatest(*widths)).cast("int")
    half = F.floor(F.col("count") / 2)
    nodes = nodes.select(
        "key", "__n", widest.alias("dim"), (F.col("bytes") * half / F.col("count")).alias("goal"), (F.lit(GROUP_SLACK) * F.col("bytes") / F.col("count")).alias("slack")
    )
    nodes = materialize(nodes, "nodes")
    rows = with_keys(data.where("count > 1").select("key", "size", "text_crc32", "row", *(c for c in DIMENSIONS if c != "size")), nodes.select("key", "__n", "dim"))
    place = F.array(F.element_at(F.array(*DIMENSIONS), F.col("dim")), "text_crc32", "row")
    found = cuts(rows.select("key", place.alias("w"), F.col("size").alias("weight")), nodes.select("key", "goal", "slack"), 3, 2)
    found = materialize(nodes.join(found, "key").select("key", "__n", "dim", "cut"), "cuts")
    split = with_keys(data.where("count > 1"), found)
    left = place <= F.col("cut")
    split = split.withColumn("first", F.when(left, F.col("first")).otherwise(F.col("first") + half)).withColumn("count", F.when(left, half).otherwise(F.col("count") - half))
    names = [c for c in data.columns if c != "key"]
    return split.select(names).unionByName(data.where("count = 1").select(names))


def assign(data: DataFrame, shards: int) -> DataFrame:
    """Stored ``points`` (with first 0 and count ``shards``) with the column shard."""
    ends = data.agg(*(F.max(c) - F.min(c) for c in DIMENSIONS)).first()
    spread = {c: max(1, x or 0) for c, x in zip(DIMENSIONS, ends)}
    most = shards
    while most > 1:
        new = materialize(split_level(data, spread), "level")
        release(data)
        data, most = new, -(-most // 2)
    return data.withColumn("shard", F.col("first").cast("int")).drop("first", "count")


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    root = points(docs).withColumn("first", F.lit(0).cast("long")).withColumn("count", F.lit(shards).cast("long"))
    data = assign(materialize(root, "points"), shards)
    tagged = data.select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(SLOT_PARTS)).alias("part"))
    # a slot is the rows in earlier parts of the shard and the rank in its own: no shard is sorted in one task
    counts = tagged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row"))
    return (
        tagged.withColumn("rank", rank)
        .join(starts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
