"""What the text operators share: tables, scratch tables in the shared folder, Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplework.functions.scratch import clear as clear
from ripplework.functions.scratch import own_folder

#: A word is a maximal run of characters other than these six white-space code points.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that this process has stored and not yet released, in order.
_stored: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never the work above, and any
    number of later jobs share the result.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression="zstd")
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def kept(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, stored; every table that it has stored on the way is deleted."""
    before = len(_stored)
    out = materialize(make(), name)
    for path in _stored[before:-1]:
        _delete(out.sparkSession, path)
    del _stored[before:-1]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing unread depends on any more."""
    path = getattr(df, "_scratch_path", None)
    if path in _stored:
        _stored.remove(path)
        _delete(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores more as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``__doc``, a struct of all columns, and the columns ``names`` beside it, so that no name
    of an operator's own can clash with one of ``df``; ``unpacked`` undoes it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__doc"), *(F.col(f"`{n}`") for n in names))


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col("__doc")[c].alias(c) for c in names))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that a clashing name in an extra column can do no harm."""
    return df.select(*(F.col(f"`{n}`") for n in names))


#: Keys that are broadcast because they have many rows are fewer than this.
HOT_SHARE = 2_000


def join_split(rows: DataFrame, per_key: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``, a row for each key with the count ``__n`` of its rows.

    Keys with more than 1 in ``HOT_SHARE`` of all ``total`` rows, of which there are fewer than
    ``HOT_SHARE``, are broadcast, so that their rows stay where they are; the rows of the other
    keys meet by shuffle.
    """
    least = max(1, total // HOT_SHARE)
    hot = per_key.where(F.col("__n") > least).drop("__n")
    names = [c for c in hot.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__{c}") for c in names))), F.col(key) == F.col("__hot"), "left")
    found = marked.where("__hot IS NOT NULL").select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in names))
    rest = marked.where("__hot IS NULL").select(*rows.columns)
    return found.unionByName(rest.join(per_key.where(F.col("__n") <= least).drop("__n"), key, how).select(*rows.columns, *names))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """Arrow map by batch: ``make()`` runs once in each task and gives a function from the
    batch's columns (lists) to the output columns (lists).

    Memory is bounded by one Arrow batch; batches are cut again by ``SLICE_BYTES`` so that a
    run of very long texts does not become one huge Python list.
    """
    small_batches(df.sparkSession)
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                out = step(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        free_memory()

    return df.mapInArrow(run, target)


SLICE_BYTES = 4 << 20


#: Sizes of batches to Python where the session sets none: whole texts are long, and the
#: JVM and the worker of a task each hold a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def small_batches(spark: SparkSession) -> None:
    """Set the session's batch sizes, unless they have been set already."""
    for key, size in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)


def free_memory() -> None:
    """Give what is free back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_BYTES`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, int(n * SLICE_BYTES / max(batch.nbytes, 1))))
    for at in range(0, n, step):
        yield batch.slice(at, step)
