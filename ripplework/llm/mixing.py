"""Mixing sources to target weights: capped water-filling, DataFrame operations only.

Targets: the sources share ``epochs`` times the words of all sources by weight; a target
stops at ``cap`` times its source's words and what is above goes to the other sources by
weight until none is above.  Each round clamps the sources above the common level and
raises the level for the rest; it is one sum over the table of sources.

Sampling: a source whose target is e = whole + rest times its words gives every document
``whole`` times and once more the documents that come first by a seeded hash, up to
``rest`` times the source's words, to within half a document.  Equal hashes are told apart
by a second one and then by the row's stored number, so ties and repeated rows are cut like
any others.  The cut is found by ``cuts``, so no source, however large, meets in one task.

Defined cases: null text has 0 words; a null source is a source of its own and comes last;
sources without words get target 0 and their documents no repetition; of rows that are equal
in doc_id and size as many as fit are taken once more, in the order stored; null doc_ids
share a hash.  Extra columns of the input are left alone; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.sources.edges import dense_rank_by

from .common import WORD, materialize, packed, release, unpacked
from .cuts import BROADCAST_KEYS, cuts, with_keys


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(seed: int, doc_id: Column, size: Column, at: int = 0) -> Column:
    """A uniform 32-bit integer that any engine with MD5 can recompute, the first or second."""
    key = F.concat_ws("|", F.lit(f"mix{seed}"), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1 + 8 * at, 8), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and orders like the source, nulls last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def places(rows: DataFrame, seed: int) -> DataFrame:
    """``rows(source, doc_id, text, __row, ...)`` and key, weight (words) and w, the place."""
    d = rows.withColumn("key", source_key(F.col("source"))).withColumn("weight", n_words(F.col("text")))
    return d.withColumn("w", F.array(keyed(seed, F.col("doc_id"), F.col("weight")), keyed(seed, F.col("doc_id"), F.col("weight"), 1), F.col("__row")))


def water_fill(sources: DataFrame, pattern: tuple[int, ...], epochs: float, cap: float) -> DataFrame:
    """``sources(key, source_size)`` with the columns target, whole and rest_words.

    The shares of the free sources follow from one level, which rises as sources above it are
    clamped, until none is above; a round is one sum over all sources.
    """
    weights = F.array(*(F.lit(float(w)) for w in pattern))
    if sources.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    else:
        ranked = dense_rank_by(sources, ["key"])
    s = ranked.select("key", "source_size", F.element_at(weights, (F.col("rank") % len(pattern) + 1).cast("int")).alias("share"))
    s = materialize(s.withColumn("most", F.lit(float(cap)) * F.col("source_size")), "shares")
    words = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        above = F.col("most") / F.col("share") < F.lit(level)
        sums = s.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("share"))), F.lit(0.0)), F.count(F.when(above, 1))).first()
        if sums[2] == clamped or not sums[1]:
            break
        level, clamped = (epochs * words - sums[0]) / sums[1], sums[2]
    target = F.least("most", F.lit(level) * F.col("share")) if sums[1] else F.col("most")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("target", target).withColumn("whole", whole)
    return s.select("key", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest_words"))


def decisions(rows: DataFrame, pattern=(5, 2, 1), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source: target, whole and the cut of the one more time.

    ``rows`` are stored ``places`` (key, weight, w) and read a few times.
    """
    sources = rows.groupBy("key").agg(F.sum("weight").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    sources = materialize(sources, "sources")
    filled = materialize(water_fill(sources.select("key", "source_size"), pattern, epochs, cap), "targets")
    goals = filled.where("source_size > 0").select("key", F.col("rest_words").alias("goal"), F.lit(None).cast("double").alias("slack"))
    cut = cuts(rows, goals, 3)
    out = filled.join(cut, "key", "left").join(sources.select("key", "__n"), "key")
    return materialize(out.select("key", "__n", "source_size", "target", "whole", "cut"), "decisions")


def repetitions(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` and its source's columns and times, the repetitions that the mix takes."""
    once_more = F.coalesce(F.col("w") <= F.col("cut"), F.lit(False)).cast("long")
    return with_keys(rows, per_source).withColumn("times", F.col("whole") + once_more)


def mix_table(docs: DataFrame, seed: int = 42, pattern=(5, 2, 1), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    rows = places(docs.select("doc_id", "source", "text").withColumn("__row", F.monotonically_increasing_id()), seed).drop("text")
    rows = materialize(rows, "sizes")
    out = repetitions(rows, decisions(rows.select("key", "w", "weight"), pattern, epochs, cap))
    return out.select("doc_id", F.col("weight").alias("size"), "source_size", "target", (F.col("times") * F.col("weight")).alias("taken"), "source", "times")


def mix_documents(docs: DataFrame, seed: int = 42, pattern=(5, 2, 1), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Documents are numbered in a stored copy.  The texts are not shuffled while the sources are
    few enough to broadcast: a document's repetitions follow from its own row and its source's
    row.  Documents without words follow the rule of their source like any other.
    """
    stored = materialize(packed(docs, "source", "doc_id", "text").withColumn("__row", F.monotonically_increasing_id()).select("__doc", "__row"), "numbered")
    rows = places(stored.select(*(F.col("__doc")[c].alias(c) for c in ("source", "doc_id", "text")), "__row", "__doc"), seed)
    slim = materialize(rows.select("key", "w", "weight"), "sizes")
    out = repetitions(rows.select("__doc", "key", "w"), decisions(slim, pattern, epochs, cap))
    release(slim)
    out = out.where("times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return unpacked(out, docs.columns)


#: The same rules for an independent engine; the hash is MD5, so both draw alike.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), hashed AS (
  SELECT *, md5('mix42|' || COALESCE(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR) AS h FROM sized
), s0 AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, (CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap FROM s0
), s2 AS (
  SELECT *, cap / w AS ratio FROM s1
), s3 AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2
), s4 AS (
  SELECT *, (SELECT arg_min(lvl, ratio) FROM s3 WHERE lvl <= ratio) AS level FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN cap ELSE level * w END AS target FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END::BIGINT AS whole FROM s5
), ordered AS (
  SELECT hashed.*, source_size, target, whole,
         SUM(size) OVER (PARTITION BY hashed.source ORDER BY substr(h, 1, 16), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM hashed JOIN s6 ON hashed.source IS NOT DISTINCT FROM s6.source
), timed AS (
  SELECT *, (whole + CASE WHEN source_size > 0 AND upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS times FROM ordered
)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, source, times FROM timed
"""
