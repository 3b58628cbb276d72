"""Social factor graphs from users and interactions, and selectors over them.

A user is node ``vertex * 8``; its interaction factor is ``+ 1`` and its interest factor
``+ 2``.  All ties weigh 1.  Tables: users(user_id, user_followers, user_interests),
interactions(user_id, interact_id), vertices(user_id, vertex), seeds(user_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplework.functions.keyed import draw, u32
from ripplework.functions.scratch import stored
from ripplework.operators.aux_graph import AuxGraph
from ripplework.operators.rrsets import Sampler
from ripplework.operators.select import lazy_greedy
from ripplework.operators.spread import broadcast_graph, in_worlds, is_local, live, local_graph, per_world, prepared

HUB_FOLLOWERS, SAMPLE = 100_000, 100


@dataclass(frozen=True)
class SocialGraph:
    nodes: DataFrame  # node, node_type, factor_type, target, sources
    edges: DataFrame  # src, dst, weight

    def aux(self, model: str = "IC") -> AuxGraph:
        """The same graph for the samplers: users are origins, weights are probabilities."""
        users = self.nodes.where("node_type = 'user'").select(F.shiftright("node", 3).alias("id"))
        e = self.edges.select("src", "dst", F.col("weight").alias("prob"))
        return AuxGraph(users, e, e.groupBy(F.col("dst").alias("node")).agg(F.max("prob").alias("p")), model, 2)


def selected_interactions(users: DataFrame, interactions: DataFrame, seeds: DataFrame, seed: int = 48) -> DataFrame:
    """(user_id, interact_id), each once: of each seed user, interactions with known users of
    more than 100,000 followers, a keyed sample of up to 100 others, and all with seeds."""
    known = users.select(F.col("user_id").alias("interact_id"), "user_followers")
    pairs = interactions.select("user_id", F.col("interact_id").cast("string").alias("interact_id")).distinct()
    pairs = pairs.join(seeds.select("user_id").distinct(), "user_id", "left_semi").join(known, "interact_id")
    pairs = pairs.join(seeds.select(F.col("user_id").alias("interact_id"), F.lit(True).alias("to_seed")).distinct(), "interact_id", "left")
    hub = F.col("user_followers") > HUB_FOLLOWERS
    order = Window.partitionBy("user_id", hub).orderBy(u32("interact", seed, F.col("user_id"), F.col("interact_id")), "interact_id")
    ranked = pairs.withColumn("n", F.row_number().over(order))
    return ranked.where(hub | (F.col("n") <= SAMPLE) | F.col("to_seed")).select("user_id", "interact_id")


def factor_graph(users: DataFrame, selected: DataFrame, vertices: DataFrame) -> SocialGraph:
    """One interaction and one interest factor for each target.

    Interest factors are driven by the selected pairs (an equi-join), never by all pairs.
    """
    of = lambda name: vertices.select(F.col("user_id").alias(name), F.col("vertex").alias(f"{name}_v"))
    pairs = selected.join(of("user_id"), "user_id").join(of("interact_id"), "interact_id")
    acted = pairs.select(F.col("user_id_v").alias("a"), F.col("interact_id_v").alias("b")).distinct()
    likes = lambda name: users.select(F.col("user_id").alias(name), F.coalesce("user_interests", F.array()).cast("array<string>").alias(f"{name}_i"))
    shared = pairs.join(likes("user_id"), "user_id").join(likes("interact_id"), "interact_id")
    shared = shared.where((F.col("user_id_v") != F.col("interact_id_v")) & F.arrays_overlap("user_id_i", "interact_id_i"))
    shared = shared.select(F.col("user_id_v").alias("a"), F.col("interact_id_v").alias("b"))
    shared = shared.unionByName(shared.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = acted.withColumn("f", F.lit(1)).unionByName(shared.withColumn("f", F.lit(2)))
    factors = both.groupBy("b", "f").agg(F.array_sort(F.collect_set("a")).alias("sources"))
    fnodes = factors.select(
        (F.col("b") * 8 + F.col("f")).alias("node"), F.lit("factor").alias("node_type"),
        F.when(F.col("f") == 1, "interaction").otherwise("interest").alias("factor_type"), F.col("b").alias("target"), "sources",
    )
    unodes = acted.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    none = F.lit(None)
    unodes = unodes.select((F.col("v") * 8).alias("node"), F.lit("user").alias("node_type"), none.cast("string").alias("factor_type"), none.cast("bigint").alias("target"), none.cast("array<bigint>").alias("sources"))
    up = both.select((F.col("a") * 8).alias("src"), (F.col("b") * 8 + F.col("f")).alias("dst"), F.lit(1.0).alias("weight"))
    down = factors.select((F.col("b") * 8 + F.col("f")).alias("src"), (F.col("b") * 8).alias("dst"), F.lit(1.0).alias("weight"))
    return SocialGraph(unodes.unionByName(fnodes), up.unionByName(down))


# ---------------------------------------------------------------- centralities


def _without(df: DataFrame, gone: list[int], *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(~F.col(c).isin(gone)) if gone else df
    return df


def _adaptive(g: SocialGraph, k: int, score) -> list[tuple[int, float]]:
    """Top user by ``score(nodes, edges)``, removed, and again; (vertex, score)."""
    nodes, edges = stored(g.nodes.select("node", "node_type"), "nodes"), stored(g.edges, "edges")
    out: list[tuple[int, float]] = []
    gone: list[int] = []
    for _ in range(min(k, nodes.where("node_type = 'user'").count())):
        n, e = _without(nodes, gone, "node"), _without(edges, gone, "src", "dst")
        users = n.where("node_type = 'user'").select("node")
        best = users.join(score(n.select("node"), e), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
        top = best.orderBy(F.desc(F.round("score", 9)), "node").limit(1).collect()
        if not top:
            break
        gone.append(top[0].node)
        out.append((top[0].node >> 3, top[0].score))
    return out


def degree_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree over one less than the number of nodes."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    n = nodes.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n"))
    return d.join(F.broadcast(n)).select("node", (F.col("d") / F.col("n")).alias("score"))  # n is one row


def pi_score(nodes: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """Sum over out-ties of 1 - prod (1 - w^i), i = 1 .. hops."""
    miss = F.lit(1.0)
    for i in range(1, hops + 1):
        miss = miss * (F.lit(1.0) - F.pow(F.col("weight"), F.lit(i)))
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum(F.lit(1.0) - miss).alias("score"))


def sigma_score(nodes: DataFrame, edges: DataFrame, hops: int = 5, plain: bool = False) -> DataFrame:
    """x <- x + W^(i) x with element-wise powers, from ones; ``plain`` sums W^(i) 1 instead."""
    x = nodes.select("node", F.lit(1.0).alias("x"))
    start = x
    for i in range(1, hops + 1):
        of = start if plain else x
        moved = edges.join(of.select(F.col("node").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.pow("weight", F.lit(i)) * F.col("x")).alias("m"))
        x = x.join(moved, "node", "left").select("node", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x"))
    return x.select("node", F.col("x").alias("score"))


def eigen_score(nodes: DataFrame, edges: DataFrame, rounds: int = 24) -> DataFrame:
    """Power iteration of x <- x + W' x (in-ties), scaled to length 1."""
    x = nodes.select("node", F.lit(1.0).alias("x"))
    for i in range(rounds):
        moved = edges.join(x.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("m"))
        x = x.join(moved, "node", "left").select("node", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x"))
        if i % 6 == 5 or i == rounds - 1:
            x = stored(x, "eigen")
            norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
            x = x.select("node", (F.col("x") / F.lit(norm)).alias("x"))
    return x.select("node", F.col("x").alias("score"))


def degree_seeds(g: SocialGraph, k: int):
    return _adaptive(g, k, degree_score)


def pi_seeds(g: SocialGraph, k: int):
    return _adaptive(g, k, pi_score)


def sigma_seeds(g: SocialGraph, k: int):
    return _adaptive(g, k, sigma_score)


def eigen_seeds(g: SocialGraph, k: int, rounds: int = 24):
    return _adaptive(g, k, lambda n, e: eigen_score(n, e, rounds))


# ---------------------------------------------------------------- diffusion


def with_weights(g: SocialGraph, thresholds: DataFrame) -> SocialGraph:
    """The graph with the weights of ``thresholds(src, dst, threshold)``, a configuration that
    must name every tie."""
    joined = g.edges.select("src", "dst").join(thresholds.select("src", "dst", "threshold"), ["src", "dst"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no threshold for the tie"), "src", "dst"))
    return SocialGraph(g.nodes, joined.select("src", "dst", F.when(F.col("threshold").isNotNull(), F.col("threshold")).otherwise(missing).cast("double").alias("weight")))


def user_spread(g: SocialGraph, seeds: list[list[int]], rounds: int, model: str = "IC", steps: int = 5, seed: int = 49, strategy: str = "auto") -> DataFrame:
    """(candidate, spread): mean over rounds for each list of user vertices.

    IC: users newly active at each of ``steps`` observations, the first being the seeds,
    summed.  LT: users active after ``steps`` observations when a node follows once the share
    of its active in-neighbours reaches its threshold, drawn from 0.01 .. 0.19.  Semantics of
    the steps from public documentation; not verified against a concrete implementation.
    """
    if model not in ("IC", "LT"):
        raise ValueError("model must be IC or LT")
    aux = g.aux("IC")
    prep = stored(prepared(aux), "prepared")
    if strategy == "relational" or (strategy == "auto" and not is_local(prep)):
        return _user_spread_by_joins(aux, prep, seeds, rounds, model, steps, seed)
    held = broadcast_graph(prep, "IC", model == "LT")
    spark = prep.sparkSession
    lists = spark.sparkContext.broadcast(_known(aux, seeds))

    def cascade(r: int, start: list[int]) -> int:
        graph, memo = local_graph(held, "IC", 2, seed, False), {}
        seen, front, total = set(start), list(set(start)), 0
        for step in range(steps):
            total += sum(1 for v in front if not v & 7)
            if step == steps - 1 or not front:
                break
            new = {v for u in front for v in graph.neighbours(r, u, memo)} - seen
            seen |= new
            front = list(new)
        return total

    def threshold(r: int, start: list[int]) -> int:
        p = local_graph(held, "IC", 2, seed, True).packed
        active = set(start)
        for _ in range(steps - 1):
            new = set()
            for v, lo, hi in zip(p.ids.tolist(), p.start[:-1].tolist(), p.start[1:].tolist()):
                if lo < hi and v not in active:
                    share = sum(u in active for u in p.ids[p.other[lo:hi]].tolist()) / (hi - lo)
                    if share >= (draw(f"threshold|{seed}|{r}|{v}") % 19 + 1) / 100:
                        new.add(v)
            if not new:
                break
            active |= new
        return sum(1 for v in active if not v & 7)

    one = cascade if model == "IC" else threshold

    def run(r: int):
        return [(c, one(r, s)) for c, s in enumerate(lists.value)]

    return per_world(spark, 0, rounds, run, "candidate long, spread long").groupBy("candidate").agg((F.sum("spread") / F.lit(float(rounds))).alias("spread"))


def _known(aux: AuxGraph, seeds: list[list[int]]) -> list[list[int]]:
    """The caller's lists as expanded ids, without vertices that are no users."""
    wanted = aux.edges.sparkSession.createDataFrame([(v,) for v in sorted({v for s in seeds for v in s})], "id long")
    known = {r.id for r in aux.nodes.join(F.broadcast(wanted), "id", "left_semi").collect()}
    return [[v * 8 for v in s if v in known] for s in seeds]


def _user_spread_by_joins(aux: AuxGraph, prep: DataFrame, seeds: list[list[int]], rounds: int, model: str, steps: int, seed: int) -> DataFrame:
    """``user_spread`` on graphs of any size, a join for each observation."""
    spark = prep.sparkSession
    start = spark.createDataFrame([(c, v) for c, s in enumerate(_known(aux, seeds)) for v in s], "c long, node long").distinct()
    key = ["r", "c", "node"]
    front = stored(in_worlds(start, rounds).select(*key), "front")
    active = front
    into = prep.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ties"))
    for _ in range(steps - 1):
        if model == "IC":
            new = front.join(prep, F.col("node") == F.col("src")).where(live("IC", 2, seed, F.col("r"), F.col("src"), F.col("dst"))).select("r", "c", F.col("dst").alias("node")).distinct()
        else:
            met = active.join(prep, F.col("node") == F.col("src")).groupBy("r", "c", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("on"))
            follows = F.col("on") / F.col("ties") >= (u32("threshold", seed, F.col("r"), F.col("node")) % 19 + 1) / 100
            new = met.join(into, "node").where(follows).select(*key)
        front = stored(new.join(active, key, "left_anti"), "front")
        if front.isEmpty():
            break
        active = stored(active.unionByName(front), "active")
    sums = active.where("(node & 7) = 0").groupBy("c").agg((F.count(F.lit(1)) / F.lit(float(rounds))).alias("spread"))
    every = spark.range(len(seeds)).select(F.col("id").alias("c"))
    return every.join(sums, "c", "left").select(F.col("c").alias("candidate"), F.coalesce("spread", F.lit(0.0)).alias("spread"))


def _user_ids(g: SocialGraph) -> list[int]:
    """All users, who are the candidates that each selector by simulation must try one by one."""
    return sorted(r.v for r in g.nodes.where("node_type = 'user'").select(F.shiftright("node", 3).alias("v")).collect())


def greedy_seeds(g: SocialGraph, k: int, rounds: int = 1, model: str = "IC", seed: int = 49) -> list[tuple[int, float]]:
    """(vertex, spread so far): tries every user in each round and stops without spread."""
    users = _user_ids(g)
    out: list[tuple[int, float]] = []
    for _ in range(min(k, len(users))):
        chosen = [v for v, _ in out]
        left = [u for u in users if u not in chosen]
        best = user_spread(g, [[*chosen, u] for u in left], rounds, model, seed=seed).orderBy(F.desc("spread"), "candidate").limit(1).collect()
        if not best or best[0].spread <= 0:
            break
        out.append((left[best[0].candidate], best[0].spread))
    return out


def celf_seeds(g: SocialGraph, k: int, rounds: int = 1, model: str = "IC", seed: int = 49, batch: int = 64, ahead: bool = False) -> list[tuple[int, float]]:
    """(vertex, spread so far) by lazy evaluation: a round simulates only the users whose last
    known gain could still be the largest, ``batch`` of them at a time."""
    users = _user_ids(g)
    spark = g.edges.sparkSession
    alone = user_spread(g, [[u] for u in users], rounds, model, seed=seed).collect() if users else []
    first = spark.createDataFrame([(users[r.candidate], float(r.spread)) for r in alone], "node long, gain double")
    spreads: dict[tuple[int, ...], float] = {(): 0.0, **{(users[r.candidate],): float(r.spread) for r in alone}}

    def evaluate(chosen: list[int], some: list[int]) -> dict[int, float]:
        wanted = [(*chosen, u) for u in some]
        if ahead:
            wanted += [(*chosen, some[0], u) for u in some[1:]]
        wanted = [w for w in wanted if w not in spreads]
        if wanted:
            rows = user_spread(g, [list(w) for w in wanted], rounds, model, seed=seed).collect()
            spreads.update({wanted[r.candidate]: float(r.spread) for r in rows})
        return {u: spreads[(*chosen, u)] - spreads[tuple(chosen)] for u in some}

    picks, _ = lazy_greedy(first, min(k, len(users)), evaluate, batch)
    out = [(v, spreads[tuple(n for n, _ in picks[: i + 1])]) for i, (v, _) in enumerate(picks)]
    return [x for x in out if x[1] > 0]


def celfpp_seeds(g: SocialGraph, k: int, rounds: int = 1, model: str = "IC", seed: int = 49, batch: int = 64) -> list[tuple[int, float]]:
    """CELF++: with each gain the one is simulated that the user would have once the most
    promising user of the batch were chosen, so that the round after that needs no simulation."""
    return celf_seeds(g, k, rounds, model, seed, batch, ahead=True)


def ris_seeds(g: SocialGraph, k: int, rounds: int = 100, model: str = "IC", seed: int = 50, exclude_chosen: bool = True) -> list[tuple[int, int]]:
    """(vertex, sets): the most frequent user, whose sets are replaced by fresh ones, again."""
    s = Sampler(g.aux(model), seed)
    rr = stored(s.take(0, rounds), "rr")
    drawn, out = rounds, []
    for _ in range(min(k, s.n)):
        counts = rr.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
        if exclude_chosen and out:
            counts = counts.where(~F.col("node").isin([v for v, _ in out]))
        top = counts.orderBy(F.desc("c"), "node").limit(1).collect()
        if not top:
            break
        out.append((top[0].node, top[0].c))
        hit = rr.where(F.col("node") == top[0].node).select("rr_id")
        rr = stored(rr.join(hit, "rr_id", "left_anti").unionByName(s.take(drawn, top[0].c)), "rr")
        drawn += top[0].c
    return out
