"""Live-edge worlds and the spread of seeds in them.

A world is never stored to be sampled: whether an edge is live in world r is a predicate
over the edge's row and r (keyed draws), so worlds, forward spread and reverse sets all see
the same edges.  The physical strategies share it:

local       edges fit in a worker (their count is checked): the graph is broadcast and each
            task walks its own worlds
forest      LT alone, nodes fit in a worker (counted): what each node picked is drawn where its
            edges lie, and a task walks the picks of a world
relational  any size: all worlds in one frontier loop of joins, a stored step each round
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.functions.keyed import TWO32, draw, u32
from ripplework.functions.scratch import stored
from ripplework.operators.aux_graph import AuxGraph
from ripplework.operators.graph import owner

#: Edges up to which a graph is broadcast (8 bytes each in a worker).
LOCAL_EDGES = 24_000_000
#: Different weights up to which it is (8 or 16 bytes each).
LOCAL_WEIGHTS = 4_000_000
#: Nodes up to which a task holds what all of them picked in a world (about 60 bytes each).
LOCAL_NODES = 4_000_000
#: Edges that the driver fetches at a time, about (12 to 28 bytes each).
SLICE = 1_000_000
MAX_ROUNDS = 10_000
#: Rows of a frontier up to which it is broadcast, so that the edges need not move (32 bytes each).
SMALL_FRONT = 200_000


# ---------------------------------------------------------------- live edges


def prepared(g: AuxGraph, normalise: bool = True, by_owner: bool = False) -> DataFrame:
    """The edges with what their model's predicate needs: src, dst, prob, a, b.

    TRIGGER and OLO: a is the target's probability.  LT: the target's draw must fall into
    [a, b), the edge's part of the weights in order of src; without ``normalise`` weights
    are not scaled to 1 and nobody may be picked; ``by_owner`` deals the edges into a node and
    its factors to one partition, in order of dst and src.  The others need prob alone.
    """
    e = g.edges
    if g.model in ("TRIGGER", "OLO"):
        q = g.node_prob.select(F.col("node").alias("dst"), F.col("p").alias("a"))
        joined = e.join(q, "dst", "left")
        fallback = e.groupBy("dst").agg(F.max("prob").alias("m"))
        joined = joined.join(fallback, "dst")
        return joined.select("src", "dst", "prob", F.coalesce("a", "m").alias("a"), F.lit(0.0).alias("b"))
    if g.model == "LT":
        # one order for all three sums, so that the rows are sorted and passed once
        if by_owner:
            e = e.withColumn("__o", owner(F.col("dst"))).repartition("__o")
        w = Window.partitionBy(*["__o"] * by_owner, "dst").orderBy("src")
        upto = lambda end: F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, end))
        t = upto(Window.unboundedFollowing) if normalise else F.lit(1.0)
        c = e.select("src", "dst", "prob", upto(0).alias("__c"), F.coalesce(upto(-1), F.lit(0.0)).alias("__p"), t.alias("__t"))
        return c.select("src", "dst", "prob", (F.col("__p") / F.col("__t")).alias("a"), (F.col("__c") / F.col("__t")).alias("b"))
    return e.select("src", "dst", "prob", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))


def live(model: str, factors: int, seed: int, r: Column, src: Column, dst: Column) -> Column:
    """Whether the edge of a ``prepared`` row is live in world r."""
    prob, a, b = F.col("prob"), F.col("a"), F.col("b")
    if model in ("TRIGGER", "OLO"):
        return u32("node", seed, r, dst) < a * F.lit(TWO32)
    if model == "LT":
        h = u32("pick", seed, r, dst) / F.lit(TWO32)
        return (a <= h) & (h < b)
    fires = u32("edge", seed, r, src, dst) < prob * F.lit(TWO32)
    if model in ("IC2", "IC2MIX"):
        gate = F.lit(True)
        for i in range(1, factors + 1):
            gate = gate & (u32("edge", seed, r, dst + i, dst) < prob * F.lit(TWO32))
        return F.when(src.bitwiseAND(F.lit(7)) > 0, gate).otherwise(fires)
    return fires


def worlds(g: AuxGraph, count: int, seed: int = 43, first: int = 0) -> DataFrame:
    """live(r, src, dst) of worlds first .. first + count - 1."""
    e = prepared(g).withColumn("r", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))
    return e.where(live(g.model, g.factors, seed, F.col("r"), F.col("src"), F.col("dst"))).select("r", "src", "dst")


def _deciding(model: str) -> tuple[str, ...]:
    """The columns that decide on an edge: its probability, its target's, or both ends of a part."""
    return {"LT": ("a", "b"), "TRIGGER": ("a",), "OLO": ("a",)}.get(model, ("prob",))


class Packed(NamedTuple):
    """A prepared graph by one end: nodes and weights are stored once, an edge has two numbers."""

    ids: np.ndarray  # expanded ids, ascending
    start: np.ndarray  # where the edges of each node begin, and the end
    other: np.ndarray  # the other end, a place in ``ids``
    code: np.ndarray  # a place in ``weights``
    weights: np.ndarray  # parts (LT) are complex: from the real to the imaginary part


class Local:
    """A prepared graph inside a worker: adjacency by index and the same predicate."""

    def __init__(self, packed: Packed, model: str, factors: int, seed: int, reverse: bool):
        self.model, self.factors, self.seed, self.reverse = model, factors, seed, reverse
        self.packed = packed
        self.at = {u: i for i, u in enumerate(packed.ids.tolist())}

    def neighbours(self, r: int, u: int, memo: dict) -> list[int]:
        """Nodes behind u's live edges in world r."""
        i = self.at.get(u)
        if i is None:
            return []
        p = self.packed
        lo, hi = p.start[i], p.start[i + 1]
        if lo == hi:
            return []
        others, w = p.ids[p.other[lo:hi]], p.weights[p.code[lo:hi]]
        if self.reverse and self.model in ("TRIGGER", "OLO", "LT"):
            h = self.drawn(r, u, memo)
            hit = (w.real <= h / TWO32) & (h / TWO32 < w.imag) if self.model == "LT" else h < w * TWO32
            return others[hit].tolist()
        pairs = zip(others.tolist(), w.tolist())
        if self.reverse:
            return [v for v, x in pairs if self.is_live(r, v, u, x, memo)]
        return [v for v, x in pairs if self.is_live(r, u, v, x, memo)]

    def drawn(self, r: int, dst: int, memo: dict) -> int:
        h = memo.get(dst)
        if h is None:
            h = memo[dst] = draw(f"{'pick' if self.model == 'LT' else 'node'}|{self.seed}|{r}|{dst}")
        return h

    def is_live(self, r: int, src: int, dst: int, weight, memo: dict) -> bool:
        if self.model in ("TRIGGER", "OLO"):
            return self.drawn(r, dst, memo) < weight * TWO32
        if self.model == "LT":
            return weight.real <= self.drawn(r, dst, memo) / TWO32 < weight.imag
        if self.model in ("IC2", "IC2MIX") and src & 7:
            gate = memo.get(dst)
            if gate is None:
                gate = memo[dst] = all(draw(f"edge|{self.seed}|{r}|{dst + i}|{dst}") < weight * TWO32 for i in range(1, self.factors + 1))
            return gate
        return draw(f"edge|{self.seed}|{r}|{src}|{dst}") < weight * TWO32

    def reach(self, r: int, start: list[int], known: dict | None = None, memo: dict | None = None) -> set[int]:
        """``known`` and ``memo`` keep what was drawn of one world, for more walks in it."""
        seen, todo = set(start), list(start)
        memo = {} if memo is None else memo
        while todo:
            u = todo.pop()
            behind = None if known is None else known.get(u)
            if behind is None:
                behind = self.neighbours(r, u, memo)
                if known is not None:
                    known[u] = behind
            for v in behind:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen


class Forest:
    """World r of an LT graph packed by target.

    A node has at most one live edge into it, so what a node reaches is the tree below it, and
    nodes on a cycle reach the same.
    """

    def __init__(self, graph: Local, r: int):
        p = self.packed = graph.packed
        size = np.diff(p.start)
        some = np.flatnonzero(size)
        h = np.zeros(len(p.ids))
        h[some] = [draw(f"pick|{graph.seed}|{r}|{u}") / TWO32 for u in p.ids[some].tolist()]
        self.above = np.full(len(p.ids), -1, np.int64)  # the place that leads to each, -1 for none
        lo = 0
        while lo < len(p.ids):  # the edges of some nodes at a time
            hi = max(lo + 1, int(np.searchsorted(p.start, p.start[lo] + SLICE, "right")) - 1)
            edges = slice(p.start[lo], p.start[hi])
            to, w = np.repeat(np.arange(lo, hi), size[lo:hi]), p.weights[p.code[edges]]
            hit = (w.real <= h[to]) & (h[to] < w.imag)
            self.above[to[hit]] = p.other[edges][hit]
            lo = hi
        self.below = np.argsort(self.above, kind="stable")
        self.first = np.searchsorted(self.above[self.below], np.arange(len(p.ids) + 1))

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Where ``nodes`` are in the graph, -1 for those without an edge."""
        ids = self.packed.ids
        if not len(ids):
            return np.full(len(nodes), -1, np.int64)
        at = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
        return np.where(ids[at] == nodes, at, -1)

    def reach(self, start: list[int]) -> set[int]:
        """All that the nodes ``start`` reach, themselves included."""
        todo = [i for i in self.places(np.array(start, np.int64)).tolist() if i >= 0]
        seen = set(todo)
        while todo:
            i = todo.pop()
            for j in self.below[self.first[i] : self.first[i + 1]].tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return set(start).union(self.packed.ids[list(seen)].tolist())

    def counts(self, origins: np.ndarray) -> list[tuple[int, int]]:
        """(origin, origins that it reaches): added up from the leaves, then around each cycle."""
        above, left = self.above.tolist(), np.diff(self.first).tolist()
        total = ((self.packed.ids & 7) == 0).astype(np.int64).tolist()
        todo = [i for i, n in enumerate(left) if not n]
        for i in todo:  # grows as nodes have all below them added up
            up = above[i]
            if up >= 0:
                total[up] += total[i]
                left[up] -= 1
                if not left[up]:
                    todo.append(up)
        for i, n in enumerate(left):
            if n:  # on a cycle that was not met before
                ring, up = [i], above[i]
                while up != i:
                    ring.append(up)
                    up = above[up]
                every = sum(total[j] for j in ring)
                for j in ring:
                    total[j], left[j] = every, 0
        at = self.places(origins * 8)
        return [(s, total[i] if i >= 0 else 1) for s, i in zip(origins.tolist(), at.tolist())]


def lt_picks(g: AuxGraph, count: int, seed: int, first: int = 0) -> DataFrame:
    """(r, node, above): ids of origins of an LT graph and of the origin that each picked in
    world r through the factor that it picked, as arrays, a row for a world and a share of the edges.

    Edges into factors count only where the factor was picked, so a node needs two draws a world;
    where factors are alike, those into the first stand for those into any.
    """
    if g.alike:
        g = replace(g, edges=g.edges.where("(dst & 7) < 2"))

    def step(batches):
        last, kept = None, np.full(count, -1)  # the owner of the rows before, and its picks
        for src, dst, a, b in _slices(batches, size):
            own = dst >> 3
            new = np.concatenate(([True], own[1:] != own[:-1]))
            owners, place = own[new], np.cumsum(new) - 1
            top, low = np.flatnonzero(dst & 7 == 0), np.flatnonzero(dst & 7)

            def hits(r, rows, nodes):
                h = np.array([draw(f"pick|{seed}|{r}|{u}") / TWO32 if u != -1 else 2.0 for u in nodes.tolist()])[place[rows]]
                return rows[(a[rows] <= h) & (h < b[rows])]

            for i in range(count):
                picks = np.full(len(owners), -1)  # no expanded id ends in 7
                if owners[0] == last:
                    picks[0] = kept[i]
                hit = hits(first + i, top, owners * 8)
                picks[place[hit]] = src[hit]
                kept[i] = picks[-1]
                direct = hit[src[hit] & 7 == 0]
                by = np.where(picks & 7, picks, -1)
                rows = low[by[place[low]] != -1] if alike else low[dst[low] == by[place[low]]]
                under = hits(first + i, rows, by)
                found = np.concatenate((direct, under))
                yield _batch([(first + i, own[found].tobytes(), (src[found] >> 3).tobytes())], schema)
            last = owners[-1]

    alike, size = g.alike, SLICE // 4
    schema = pa.schema([("r", pa.int64()), ("node", pa.binary()), ("above", pa.binary())])
    return prepared(g, by_owner=True).select("src", "dst", "a", "b").mapInArrow(step, "r long, node binary, above binary")


def _slices(batches, size: int):
    """The columns of about ``size`` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if rows:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def below(node: np.ndarray, above: np.ndarray, start: np.ndarray) -> int:
    """How many nodes are in ``start``, distinct, or below it, where each has one above it at most."""
    order = np.argsort(above, kind="stable")
    node, above = node[order], above[order]
    free = ~np.isin(node, start)  # those of the start are counted, also where one is below another
    node, above = node[free], above[free]
    total, front = 0, start
    while len(front):
        total += len(front)
        lo, hi = np.searchsorted(above, front), np.searchsorted(above, front, "right")
        size = hi - lo
        front = node[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return total


def forest_spread(g: AuxGraph, seeds: DataFrame, count: int, seed: int = 43, first: int = 0) -> DataFrame:
    """``spread_by_world`` of an LT graph whose nodes fit in a worker."""
    start = np.array([r.node >> 3 for r in seeds_table(g, seeds).collect()], np.int64)  # seeds are the caller's list

    def run(table: pa.Table) -> pa.Table:
        node, above = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("node", "above"))
        return pa.table({"r": table["r"][:1], "spread": pa.array([below(node, above, start)], pa.int64())})

    reached = lt_picks(g, count, seed, first).groupBy("r").applyInArrow(run, "r long, spread long")
    every = g.edges.sparkSession.range(first, first + count).select(F.col("id").alias("r"))
    return every.join(reached, "r", "left").select("r", F.coalesce("spread", F.lit(len(start)).cast("long")).alias("spread"))


def is_local(prep: DataFrame, model: str = "IC") -> bool:
    """Whether a stored prepared graph is small enough, by counts, to be held in each worker."""
    if prep.count() > LOCAL_EDGES:
        return False
    return prep.select(*_deciding(model)).distinct().count() <= LOCAL_WEIGHTS


class Held(NamedTuple):
    """A broadcast graph and the name under which workers keep what they build of it."""

    name: str
    packed: Broadcast


def pack(prep: DataFrame, model: str, reverse: bool) -> Packed:
    """The arrays of a prepared graph: each task sorts and encodes the edges of a share of the
    nodes, and the driver fetches these one at a time: it holds 8 bytes an edge beside one share."""
    key, other = ("dst", "src") if reverse else ("src", "dst")
    sizes = prep.select(F.col(key).alias("id"), F.lit(1).alias("n")).unionByName(prep.select(F.col(other).alias("id"), F.lit(0).alias("n")))
    table = sizes.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, size = (c.to_numpy() for c in table.columns)
    order = np.argsort(ids)
    ids, size = ids[order], size[order]
    start = np.concatenate(([0], np.cumsum(size)))
    count = int(start[-1])
    edge, code, weights, base = np.empty(count, np.int32), np.empty(count, np.int32), [np.zeros(0)], 0
    slices = max(1, -(-count // SLICE))
    known = prep.sparkSession.sparkContext.broadcast(ids)

    def encode(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        cols = [c.to_numpy() for c in pa.Table.from_batches(batches).columns]
        at, to = (np.searchsorted(known.value, c).astype(np.int32) for c in cols[:2])
        weight = cols[2] if model != "LT" else cols[2] + 1j * cols[3]
        order = np.lexsort((to, at))
        values, place = np.unique(weight[order], return_inverse=True)
        row = (np.unique(at), to[order], place.astype(np.int32), values)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["share", "nodes", "other", "code", "weights"])

    dealt = prep.select(key, other, *_deciding(model)).repartition(slices, key)  # a node's edges are in one share
    shares = stored(dealt.mapInArrow(encode, "share int, nodes binary, other binary, code binary, weights binary"), "shares")
    for i in range(slices):
        for row in shares.where(F.col("share") == i).toArrow().to_pylist():
            nodes = np.frombuffer(row["nodes"], np.int32)
            behind = size[nodes]
            to = np.repeat(start[nodes] - (np.cumsum(behind) - behind), behind) + np.arange(behind.sum())
            edge[to] = np.frombuffer(row["other"], np.int32)
            code[to] = np.frombuffer(row["code"], np.int32) + base
            weights.append(np.frombuffer(row["weights"], complex if model == "LT" else float))
            base += len(weights[-1])
        pa.default_memory_pool().release_unused()
    known.destroy()
    return Packed(ids, start, edge, code, np.concatenate(weights))


def broadcast_graph(prep: DataFrame, model: str, reverse: bool) -> Held:
    """A prepared graph whose size ``is_local`` has checked, by target if ``reverse``."""
    return Held(uuid.uuid4().hex, prep.sparkSession.sparkContext.broadcast(tuple(pack(prep, model, reverse))))


_graphs: dict = {}


def local_graph(held: Held, model: str, factors: int, seed: int, reverse: bool) -> Local:
    """Built once for each worker process; the last graph only is kept."""
    key = (held.name, seed, reverse)
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = Local(Packed(*held.packed.value), model, factors, seed, reverse)
    return _graphs[key]


def per_world(spark, first: int, count: int, run: Callable, schema: str) -> DataFrame:
    """run(r) gives rows (tuples) for a world; one partition holds a range of worlds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def step(batches):
        for batch in batches:
            rows = (row for r in batch.column(0).to_pylist() for row in run(r))
            while some := list(islice(rows, 200_000)):
                yield _batch(some, arrow)

    parts = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(first, first + count, 1, parts).mapInArrow(step, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


# ---------------------------------------------------------------- closures


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(r, node) that ``step`` reaches from ``start(r, node)``: a frontier loop to the fixpoint.

    Each round stores its frontier, so lineage and recomputation stay one round deep.
    """
    front = stored(start.select("r", "node").distinct(), "front")
    seen = front
    for k in range(max_rounds):
        new = step(small(front)).select("r", "node").distinct().join(seen, ["r", "node"], "left_anti")
        front = stored(new, "front")
        if front.isEmpty():
            return seen
        seen = stored(seen.unionByName(front), "seen") if k % 8 == 7 else seen.unionByName(front)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def small(front: DataFrame) -> DataFrame:
    """A stored frontier, broadcast if a count shows that it is small."""
    return F.broadcast(front) if front.limit(SMALL_FRONT + 1).count() <= SMALL_FRONT else front


def and_closure(start: DataFrame, prep: DataFrame, model: str, factors: int, seed: int, keys: tuple[str, ...] = ("r",), max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(*keys, node): origins active under the AND rule from ``start``; r is the world.

    A tie to a factor meets it, a direct tie activates its target, and a gated target
    activates when its gate fires and all its factors have been met.
    """
    key = [*keys, "node"]
    fires = live(model, factors, seed, F.col("r"), F.col("src"), F.col("dst"))
    front = stored(start.select(*key).distinct(), "front")
    active, met = front, None
    for k in range(max_rounds):
        out = small(front).join(prep, F.col("node") == F.col("src")).where(fires).select(*keys, F.col("dst").alias("node")).distinct()
        out = stored(out, "reached")
        direct = out.where("(node & 7) = 0")
        gate = out.where("(node & 7) > 0").join(prep, F.col("node") == F.col("src")).where(fires).select(*keys, F.col("dst").alias("target"), F.col("node").alias("factor"))
        met = gate if met is None else stored(met.unionByName(gate).distinct(), "met")
        full = met.groupBy(*keys, F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == factors).select(*key)
        front = stored(direct.unionByName(full).distinct().join(active, key, "left_anti"), "front")
        if front.isEmpty():
            return active
        active = stored(active.unionByName(front), "active") if k % 8 == 7 else active.unionByName(front)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def in_worlds(rows: DataFrame, count: int, first: int = 0) -> DataFrame:
    """``rows`` once for each world r from ``first`` on."""
    return rows.withColumn("r", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))


def seeds_table(g: AuxGraph, seeds: DataFrame) -> DataFrame:
    """Known seeds as expanded ids; unknown ones are ignored."""
    return seeds.select("id").join(g.nodes, "id", "left_semi").select((F.col("id") * 8).alias("node")).distinct()


def spread_by_world(g: AuxGraph, seeds: DataFrame, count: int, seed: int = 43, strategy: str = "auto", first: int = 0) -> DataFrame:
    """(r, spread): origins that the seeds reach in each world; worlds without any have 0."""
    spark = g.edges.sparkSession
    model, factors = g.model, g.factors
    if strategy == "forest" or (strategy == "auto" and model == "LT" and g.nodes.count() <= LOCAL_NODES):
        return forest_spread(g, seeds, count, seed, first)
    prep = stored(prepared(g), "prepared")
    if strategy == "local" or (strategy == "auto" and is_local(prep, model)):
        held = broadcast_graph(prep, model, False)
        start = [r.node for r in seeds_table(g, seeds).collect()]  # seeds are the caller's list

        def run(r: int):
            seen = local_graph(held, model, factors, seed, False).reach(r, start)
            return [(r, sum(1 for v in seen if not v & 7))]

        return per_world(spark, first, count, run, "r long, spread long")
    all_r = spark.range(first, first + count).select(F.col("id").alias("r"))
    start = seeds_table(g, seeds).withColumn("r", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))

    def step(front: DataFrame) -> DataFrame:
        j = front.join(prep, F.col("node") == F.col("src"))
        return j.where(live(model, factors, seed, F.col("r"), F.col("src"), F.col("dst"))).select("r", F.col("dst").alias("node"))

    reached = closure(start, step).where("(node & 7) = 0").groupBy("r").agg(F.count(F.lit(1)).alias("spread"))
    return all_r.join(reached, "r", "left").select("r", F.coalesce("spread", F.lit(0)).alias("spread"))


def mean_spread(by_world: DataFrame) -> DataFrame:
    return by_world.agg((F.sum("spread") / F.count(F.lit(1))).alias("influence"))


def spread_on_worlds(live_edges: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """The same from a stored live(r, src, dst): mean origins reached, over ``count`` worlds."""
    start = seeds.select((F.col("id") * 8).alias("node")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))

    def step(front: DataFrame) -> DataFrame:
        l = live_edges.select(F.col("r").alias("__r"), "src", "dst")
        return front.join(l, (F.col("r") == F.col("__r")) & (F.col("node") == F.col("src"))).select("r", F.col("dst").alias("node"))

    reached = closure(start, step).where("(node & 7) = 0")
    return reached.agg((F.count(F.lit(1)) / F.lit(float(count))).alias("influence"))


def all_factor_spread(g: AuxGraph, seeds: DataFrame, count: int, seed: int = 43, first: int = 0, strategy: str = "auto") -> DataFrame:
    """(r, spread) under the AND rule: a gated target activates when its gate fires and every
    one of its factors has a live active parent."""
    spark = g.edges.sparkSession
    prep = stored(prepared(g), "prepared")
    factors, model = g.factors, g.model
    if strategy == "relational" or (strategy == "auto" and not is_local(prep, model)):
        reached = and_closure(in_worlds(seeds_table(g, seeds), count, first), prep, model, factors, seed)
        reached = reached.groupBy("r").agg(F.count(F.lit(1)).alias("spread"))
        every = spark.range(first, first + count).select(F.col("id").alias("r"))
        return every.join(reached, "r", "left").select("r", F.coalesce("spread", F.lit(0)).alias("spread"))
    held = broadcast_graph(prep, model, False)
    start = [r.node >> 3 for r in seeds_table(g, seeds).collect()]  # seeds are the caller's list

    def run(r: int):
        from ripplework.operators.baselines import and_reach

        return [(r, and_reach(local_graph(held, model, factors, seed, False), r, start, factors))]

    return per_world(spark, first, count, run, "r long, spread long")
