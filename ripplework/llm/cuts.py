"""Weighted quantiles of many groups at once, exact, without sorting a group.

Each row has a key, a place (an array of integers, compared word by word) and a weight; each
key a goal.  A key's cut is the place up to which its rows weigh as near to the goal as whole
rows allow.  A pass sums the weights of ``BINS`` equal intervals of the current word for all
keys; the interval that holds the goal is cut again, or, when it is one value, the next word
is searched.  Once no key has more than ``FEW`` rows in its interval, those rows are ordered.
So no task holds more than ``BINS`` sums or ``FEW`` rows of a key, and the driver gets one
row for each pass.

DataFrame operations only.  The last word must tell all rows of a key apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, materialize, release

BINS, FEW = 2048, 5_000
#: Keys up to which the table of their states is broadcast.
BROADCAST_KEYS = 20_000
_MOST = (1 << 63) - 1
_STATE = ("key", "__n", "prefix", "lo", "hi", "left", "here", "slack", "ranges", "cut")


def with_keys(rows: DataFrame, per_key: DataFrame, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (key, __n: the key's rows, ...).

    A table of many keys is not broadcast; then rows meet it by shuffle, but for the keys with
    many rows, whose part of the table is."""
    if per_key.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(per_key.drop("__n")), "key")
    return join_split(rows, per_key, "key", rows.count() if total is None else total)


def _full(prefix: Column, last: Column, words: int) -> Column:
    """The largest place that begins with ``prefix`` and ``last``."""
    return F.concat(prefix, F.array(last), F.array_repeat(F.lit(_MOST), words - 1 - F.size(prefix)))


def cuts(rows: DataFrame, goals: DataFrame, words: int, group_words: int = 0) -> DataFrame:
    """key, cut for every key of ``goals(key, goal, slack)`` with rows: a row is on the near
    side if its place ``w <= cut``.

    ``rows(key, w, weight)`` is read once for each pass.  With ``group_words``, rows that share
    so many first words go together if the cut then misses the goal by ``slack`` or less.
    A key whose rows all together do not exceed the goal has all of them on the near side.
    """
    ends = [f(F.col("w")[i]).alias(f"{t}{i}") for i in range(words) for t, f in (("a", F.min), ("z", F.max))]
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), *ends)
    ranges = F.array(*(F.struct(F.col(f"a{i}").alias("lo"), F.col(f"z{i}").alias("hi")) for i in range(words)))
    state = found.join(goals, "key").select(
        "key", "__n", F.array().cast("array<long>").alias("prefix"), F.col("a0").alias("lo"), F.col("z0").alias("hi"), F.col("goal").cast("double").alias("left"),
        F.col("__n").alias("here"), F.coalesce("slack", F.lit(-1.0)).cast("double").alias("slack"), ranges.alias("ranges"), F.lit(None).cast("array<long>").alias("cut"),
    )
    state = materialize(state, "cut_state")
    total = state.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    while (state.where("cut IS NULL").agg(F.max("here")).first()[0] or 0) > FEW:
        new = materialize(_narrow(rows, state, words, group_words, total), "cut_state")
        release(state)
        state = new
    done = state.where("cut IS NOT NULL").select("key", "cut")
    return done.unionByName(_finish(_open(rows, state, total), state, words, group_words))


def _open(rows: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """The rows inside the open interval of their key, with the value of the word searched."""
    s = state.where("cut IS NULL").select("key", "__n", "prefix", "lo", "hi", "left", "slack")
    at = F.size("prefix") + 1
    d = with_keys(rows, s, total).where(F.slice("w", F.lit(1), F.size("prefix")) == F.col("prefix"))
    return d.withColumn("v", F.element_at("w", at)).where("v BETWEEN lo AND hi")


def _narrow(rows: DataFrame, state: DataFrame, words: int, group_words: int, total: int) -> DataFrame:
    width = F.expr(f"greatest(1, (hi - lo) div {BINS} + 1)")
    binned = _open(rows, state, total).withColumn("bin", F.expr(f"(v - lo) div greatest(1, (hi - lo) div {BINS} + 1)"))
    sums = binned.groupBy("key", "bin").agg(F.sum("weight").alias("b"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    upto = F.sum("b").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    pick = over.groupBy("key").agg(F.min_by(F.struct("bin", "b", "n", (F.col("upto") - F.col("b")).alias("below")), "bin").alias("pick"))
    s = state.join(pick, "key", "left").withColumn("width", width)
    s = s.withColumn("lo1", F.col("lo") + F.col("pick.bin") * F.col("width")).withColumn("hi1", F.least(F.col("lo1") + F.col("width") - 1, "hi"))
    s = s.withColumn("left1", F.col("left") - F.col("pick.below"))
    one, at = F.col("lo1") == F.col("hi1"), F.size("prefix")
    b, left1 = F.col("pick.b"), F.col("left1")
    together = (at == group_words - 1) & (F.least(b - left1, left1) <= F.col("slack"))
    side = lambda near: _full(F.col("prefix"), F.when(near, F.col("lo1")).otherwise(F.col("lo1") - 1), words)
    cut = (
        F.when(F.col("cut").isNotNull(), F.col("cut"))
        .when(F.col("pick").isNull(), F.array_repeat(F.lit(_MOST), words))
        .when(one & together, side(b - left1 < left1))
        .when(one & (at == words - 1), side(b / 2 <= left1))
    )
    following = F.element_at("ranges", F.least(at + 2, F.lit(words)))
    return s.select(
        "key", "__n", F.when(one, F.concat("prefix", F.array("lo1"))).otherwise(F.col("prefix")).alias("prefix"),
        F.when(one, following["lo"]).otherwise(F.col("lo1")).alias("lo"), F.when(one, following["hi"]).otherwise(F.col("hi1")).alias("hi"),
        F.coalesce("left1", "left").alias("left"), F.coalesce("pick.n", F.lit(0).cast("long")).alias("here"), "slack", "ranges", cut.alias("cut"),
    ).select(*_STATE)


def _finish(few: DataFrame, state: DataFrame, words: int, group_words: int) -> DataFrame:
    """The cuts of the keys whose open intervals have few rows, by putting these in order."""
    few = materialize(few.select("key", "w", "weight", "left", "slack"), "cut_rows")
    first = state.where("cut IS NULL").select("key", "prefix", "lo")
    if group_words:
        g = few.groupBy("key", F.slice("w", 1, group_words).alias("g")).agg(F.sum("weight").alias("b"), F.first("left").alias("left"), F.first("slack").alias("slack"))
        g = g.withColumn("upto", F.sum("b").over(Window.partitionBy("key").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))
        g = g.where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min_by(F.struct("g", "b", (F.col("left") - F.col("upto") + F.col("b")).alias("left"), "slack"), "g").alias("x")).select("key", "x.*")
        near = F.col("b") - F.col("left") < F.col("left")
        tail = F.element_at("g", group_words)
        whole = g.where(F.least(F.col("b") - F.col("left"), F.col("left")) <= F.col("slack"))
        whole = whole.select("key", _full(F.slice("g", 1, group_words - 1), F.when(near, tail).otherwise(tail - 1), words).alias("whole"))
    upto = F.sum("weight").over(Window.partitionBy("key").orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    near = few.withColumn("upto", upto).where(F.col("upto") - F.col("weight") / 2 <= F.col("left"))
    last = near.groupBy("key").agg(F.max("w").alias("last"))
    out = first.join(last, "key", "left").withColumn("by_row", F.coalesce("last", _full(F.col("prefix"), F.col("lo") - 1, words)))
    if not group_words:
        return out.select("key", F.col("by_row").alias("cut"))
    return out.join(whole, "key", "left").select("key", F.coalesce("whole", "by_row").alias("cut"))
