"""Named queries of the engine and the SQL that an independent engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.keyed import TWO32, sql_u32, sql_uniform, u32, uniform
from ripplework.functions.scratch import own_folder, stored
from ripplework.operators import baselines, graph, rrsets, select, social, spread
from ripplework.operators.aux_graph import AuxGraph, build
from ripplework.operators.experiment import run_experiment, wide
from ripplework.plans import oracle as o
from ripplework.sources import edges as src
from ripplework.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORLDS, SETS, SEEDS = 20, 200, 10
MODELS = ("IC", "LT", "TRIGGER", "OLO", "IC2", "IC2MIX")


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["spread_ic_2"](spark, sf_dir)


def users(spark: SparkSession, d: str) -> DataFrame:
    return stored(src.load(spark, "user_seq", d), "edges")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return src.load(spark, "part_seq", d)


def built(e: DataFrame, model: str, factors: int, **args) -> AuxGraph:
    """The expanded graph of stored edges, which are distinct.  Its own edges are stored where
    ``prepared``, which is stored by all that use it, reads them more than once."""
    g = build(e, model, factors, dedup=False, **args)
    edges = stored(g.edges, "aux_edges") if model in ("TRIGGER", "OLO") else g.edges
    return AuxGraph(stored(g.nodes, "nodes"), edges, g.node_prob, model, factors, g.alike)


# ---------------------------------------------------------------- sources

register("edges_user_seq", o.query([o.USER_SEQ], "SELECT src, dst FROM e"))(users)
register("edges_part_seq", o.query([o.PART_SEQ], "SELECT src, dst FROM e"))(parts)


@register(
    "edge_list_parse",
    "SELECT user_id AS src, event_id AS dst, COUNT(*) AS n FROM events WHERE event_id % 7 NOT IN (0, 1, 2) GROUP BY ALL",
)
def edge_list_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ok = F.concat_ws("\t ", F.lit(" "), "user_id", "event_id", F.lit("more"))
    k = F.col("event_id") % 7
    lines = e.select(F.when(k == 0, F.concat(F.lit("  # "), ok)).when(k == 1, F.col("user_id").cast("string")).when(k == 2, F.lit("a b")).otherwise(ok).alias("value"))
    return src.parse_edge_lines(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@register("edges_undirected", o.query([o.USER_SEQ], "SELECT src, dst FROM e UNION SELECT dst, src FROM e"))
def edges_undirected(spark, d):
    return src.undirected(users(spark, d)).distinct()


@register(
    "id_remap",
    o.query(
        [o.USER_SEQ, "f AS (SELECT id, MIN(p) AS p FROM (SELECT src AS id, [src, dst, 0] AS p FROM e UNION ALL SELECT dst, [src, dst, 1] FROM e) GROUP BY id)",
         "m AS (SELECT id, ROW_NUMBER() OVER (ORDER BY p) - 1 AS k FROM f)"],
        "SELECT a.k AS src, b.k AS dst FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst",
    ),
)
def id_remap(spark, d):
    return src.remap_ids(users(spark, d), F.struct("src", "dst"))[0]


@register("edges_compact_checked", o.query([o.USER_SEQ], "SELECT src, dst FROM e"))
def edges_compact_checked(spark, d):
    return src.check_compact(users(spark, d), 1 << 31)


for _how, _sql in (
    ("WC", "1.0::DOUBLE / COUNT(*) OVER (PARTITION BY dst)"),
    ("UNI", "0.1::DOUBLE"),
    ("TR", f"[0.1::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE][{sql_u32('tri', 0, 'src', 'dst')} % 3 + 1]"),
):
    register(f"weights_{_how.lower()}", o.query([o.USER_SEQ], f"SELECT src, dst, round({_sql}, 9) AS prob FROM e"))(
        lambda spark, d, how=_how: src.weighted(users(spark, d), how).select("src", "dst", F.round("prob", 9).alias("prob"))
    )

# ---------------------------------------------------------------- accessors


@register("in_degree", o.query([o.PART_SEQ, o.NODES], "SELECT id, COUNT(dst) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id"))
def in_degree(spark, d):
    e = stored(parts(spark, d), "edges")
    return graph.in_degree(e, graph.nodes_of(e))


@register("out_degree", o.query([o.PART_SEQ, o.NODES], "SELECT id, COUNT(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id"))
def out_degree(spark, d):
    e = stored(parts(spark, d), "edges")
    return graph.out_degree(e, graph.nodes_of(e))


@register("children_of", o.query([o.PART_SEQ], "SELECT src AS id, dst AS child FROM e"))
def children_of(spark, d):
    e = stored(parts(spark, d), "edges")
    return graph.children(e, graph.nodes_of(e))


@register("parents_of", o.query([o.PART_SEQ], "SELECT dst AS id, src AS parent FROM e"))
def parents_of(spark, d):
    e = stored(parts(spark, d), "edges")
    return graph.parents(e, graph.nodes_of(e))


@register("only_factor_parents", o.query([o.USER_SEQ, *o.aux("IC2MIX", 3)], "SELECT dst AS node, bool_and(src % 8 > 0) AS gated FROM aux GROUP BY dst"))
def only_factor_parents(spark, d):
    return graph.only_factor_parents(build(users(spark, d), "IC2MIX", 3).edges)


@register("factor_metadata", o.query([o.USER_SEQ, *o.aux("IC", 5)], "SELECT DISTINCT src AS node, src // 8 AS owner, (src % 8)::INTEGER AS factor FROM aux WHERE src % 8 > 0"))
def factor_metadata(spark, d):
    return graph.factor_metadata(build(users(spark, d), "IC", 5).edges)


@register(
    "top_degree_reach",
    o.query(
        [o.PART_SEQ, o.NODES, o.top_out(SEEDS), "reach(r, node) AS (SELECT id, id FROM top UNION SELECT r, dst FROM reach JOIN e ON src = node)"],
        "SELECT r AS id, COUNT(*) AS reached FROM reach GROUP BY r", True,
    ),
)
def top_degree_reach(spark, d):
    e = stored(parts(spark, d), "edges")
    return graph.reach_counts(e, baselines.max_degree(e, graph.nodes_of(e), SEEDS))


# ---------------------------------------------------------------- expanded graphs and worlds

_AUX_OUT = "SELECT src, dst, round(prob, 9) AS prob FROM aux"


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.round("prob", 9).alias("prob"))


for _m in MODELS:
    for _f in (2, 3, 5):
        register(f"aux_{_m.lower()}_{_f}", o.query([o.USER_SEQ, *o.aux(_m, _f)], _AUX_OUT))(lambda spark, d, m=_m, f=_f: _rounded(build(users(spark, d), m, f).edges))
    for _f in (2, 3, 5) if _m in ("TRIGGER", "OLO") else ():
        register(f"node_prob_{_m.lower()}_{_f}", o.query([o.USER_SEQ, *o.aux(_m, _f)], "SELECT node, round(p, 9) AS p FROM np"))(
            lambda spark, d, m=_m, f=_f: build(users(spark, d), m, f).node_prob.select("node", F.round("p", 9).alias("p"))
        )
for _f in (2, 3, 5):
    register(f"aux_lt_gate_{_f}", o.query([o.USER_SEQ, *o.aux("LT", _f, gate=True)], _AUX_OUT))(
        lambda spark, d, f=_f: _rounded(build(users(spark, d), "LT", f, parent_gate="factor_aware").edges)
    )

for _m in MODELS:
    _f = 3 if _m == "IC2MIX" else 2
    register(f"world_{_m.lower()}_{_f}", o.query([o.USER_SEQ, *o.aux(_m, _f), *o.live(_m, _f, o.world_range(3))], "SELECT r, src, dst FROM live"))(
        lambda spark, d, m=_m, f=_f: spread.worlds(built(users(spark, d), m, f), 3)
    )


def _spread(model: str, factors: int, worlds: int) -> Query:
    def run(spark, d):
        e = users(spark, d)
        g = built(e, model, factors)
        return spread.spread_by_world(g, baselines.max_degree(e, g.nodes, SEEDS), worlds)

    return run


for _m in MODELS:
    for _f in (2, 3, 5) if _m in ("IC", "LT", "TRIGGER", "OLO") else (3,):
        _start = f"SELECT r, id * 8 AS node FROM top CROSS JOIN (SELECT unnest(range({WORLDS})) AS r)"
        register(
            f"spread_{_m.lower()}_{_f}",
            o.query(
                [o.USER_SEQ, o.NODES, o.top_out(SEEDS), *o.aux(_m, _f), *o.live(_m, _f, o.world_range(WORLDS)), o.forward(_start)],
                "SELECT r, COUNT(*) AS spread FROM reach WHERE node % 8 = 0 GROUP BY r", True,
            ),
        )(_spread(_m, _f, WORLDS))


@register("spread_ic_2_relational", ORACLE_SQL["spread_ic_2"])
def spread_relational(spark, d):
    e = users(spark, d)
    g = built(e, "IC", 2)
    return spread.spread_by_world(g, baselines.max_degree(e, g.nodes, SEEDS), WORLDS, strategy="relational")


_MIX = {"p": 0.75, "ratio": 0.3}
#: Rounds after which the SQL of the AND rule takes its state for the fixpoint.
_ROUNDS = 24
_ALL_FACTOR_SQL = o.query(
    [o.USER_SEQ, o.NODES, o.top_out(SEEDS), *o.aux("IC2MIX", 3, **_MIX), *o.live("IC2MIX", 3, o.world_range(WORLDS)),
     *o.and_active(f"SELECT r, id * 8 AS node FROM top CROSS JOIN (SELECT unnest(range({WORLDS})) AS r)", 3, _ROUNDS)],
    f"SELECT r, COUNT(*) AS spread FROM a{_ROUNDS} GROUP BY r",
)


def _all_factor(strategy: str) -> Query:
    def run(spark, d):
        e = users(spark, d)
        g = built(e, "IC2MIX", 3, **_MIX)
        return spread.all_factor_spread(g, baselines.max_degree(e, g.nodes, SEEDS), WORLDS, strategy=strategy)

    return run


register("spread_all_factor_3", _ALL_FACTOR_SQL)(_all_factor("auto"))
register("spread_all_factor_3_relational", _ALL_FACTOR_SQL)(_all_factor("relational"))


# ---------------------------------------------------------------- reverse-reachable sets


def _sampler(spark, d, model: str, factors: int, **args) -> rrsets.Sampler:
    return rrsets.Sampler(built(users(spark, d), model, factors), **args)


for _m in MODELS:
    _f = 3 if _m.startswith("IC2") else 2
    register(f"rr_{_m.lower()}_{_f}", o.query([o.USER_SEQ, *o.rr(_m, _f, SETS)], "SELECT rr_id, node FROM rr", True))(
        lambda spark, d, m=_m, f=_f: _sampler(spark, d, m, f).take(0, SETS)
    )


@register("rr_ic_2_relational", ORACLE_SQL["rr_ic_2"])
def rr_relational(spark, d):
    return _sampler(spark, d, "IC", 2, strategy="relational").take(0, SETS)


@register("rr_extended", ORACLE_SQL["rr_ic_2"])
def rr_extended(spark, d):
    s = _sampler(spark, d, "IC", 2)
    return s.take(0, SETS // 2).unionByName(s.take(SETS // 2, SETS - SETS // 2))


@register(
    "cover_estimate",
    o.query([o.USER_SEQ, *o.rr("IC", 2, SETS), o.top_out(3)],
            f"SELECT COUNT(DISTINCT rr_id) AS covered, COUNT(DISTINCT rr_id) * (SELECT COUNT(*) FROM v)::DOUBLE / {SETS}.0::DOUBLE AS influence FROM rr WHERE node IN (SELECT id FROM top)", True),
)
def cover_estimate(spark, d):
    e = users(spark, d)
    s = rrsets.Sampler(built(e, "IC", 2))
    return rrsets.coverage(s.take(0, SETS), baselines.max_degree(e, s.g.nodes, 3), s.n, SETS)


@register("candidate_pool", o.query([o.USER_SEQ, *o.rr("IC", 2, SETS)], "SELECT node, COUNT(*) AS count FROM rr GROUP BY node ORDER BY count DESC, node LIMIT 20", True))
def candidate_pool(spark, d):
    return rrsets.candidate_pool(_sampler(spark, d, "IC", 2).take(0, SETS), 20)


# ---------------------------------------------------------------- selection


def _cover_sql(model: str, factors: int, k: int) -> str:
    ctes, rows = o.cover(k)
    return o.query([o.USER_SEQ, *o.rr(model, factors, SETS), *ctes], rows, True)


def _cover(model: str, factors: int, k: int) -> Query:
    def run(spark, d):
        s = _sampler(spark, d, model, factors)
        return select.greedy_cover(s.take(0, SETS), s.g.nodes, k).table(spark)

    return run


for _m, _f in (("IC", 2), ("LT", 2), ("TRIGGER", 2), ("OLO", 3), ("IC2", 3)):
    register(f"max_cover_{_m.lower()}_{_f}", _cover_sql(_m, _f, 4))(_cover(_m, _f, 4))

_ctes, _rows = o.cover(4)


@register(
    "max_cover_prefix",
    o.query(
        [o.USER_SEQ, *o.rr("IC", 2, SETS), *_ctes, f"sel AS ({_rows})"],
        f"""SELECT k::INTEGER AS k, COALESCE(MAX(covered), 0)::BIGINT AS covered_rr, round(COALESCE(MAX(covered), 0) * ((SELECT COUNT(*) FROM v) / {SETS}.0::DOUBLE), 6) AS self_influence,
        COALESCE(string_agg(node::VARCHAR, ' ' ORDER BY rank), '') AS seeds FROM (SELECT unnest([0, 1, 2, 4]) AS k) LEFT JOIN sel ON rank <= k GROUP BY k""", True,
    ),
)
def max_cover_prefix(spark, d):
    s = _sampler(spark, d, "IC", 2)
    sel = select.greedy_cover(s.take(0, SETS), s.g.nodes, 4).table(spark)
    return select.prefixes(sel, [4, 2, 0, 1, 2, -3], s.n, SETS).withColumn("self_influence", F.round("self_influence", 6)).withColumn("seeds", F.array_join("seeds", " "))


@register(
    "cover_upper_bound",
    o.query([o.USER_SEQ, *o.rr("IC", 2, SETS), *o.cover(1)[0],
             "g0 AS (SELECT COUNT(*) AS c FROM rr GROUP BY node ORDER BY c DESC LIMIT 1)",
             "g1 AS (SELECT COUNT(*) AS c FROM rr WHERE rr_id NOT IN (SELECT rr_id FROM rr WHERE node IN (SELECT node FROM p1)) GROUP BY node ORDER BY c DESC LIMIT 1)"],
            "SELECT gain AS covered, (gain + (SELECT SUM(c) FROM g1))::BIGINT AS bound_last, least((SELECT SUM(c) FROM g0), gain + (SELECT SUM(c) FROM g1))::BIGINT AS bound_min FROM p1", True),
)
def cover_upper_bound(spark, d):
    s = _sampler(spark, d, "IC", 2)
    c = select.greedy_cover(s.take(0, SETS), s.g.nodes, 1, bounds=True)
    return spark.createDataFrame([(c.covered, int(c.bound_last), int(c.bound_min))], "covered long, bound_last long, bound_min long")


@register("max_degree_seeds", o.query([o.PART_SEQ, o.NODES, o.top_out(50)], "SELECT id, degree FROM top"))
def max_degree_seeds(spark, d):
    e = stored(parts(spark, d), "edges")
    return baselines.max_degree(e, graph.nodes_of(e), 50)


@register("random_seeds", o.query([o.PART_SEQ, o.NODES], f"SELECT id FROM v ORDER BY {sql_u32('random', 47, 'id')}, id LIMIT 50"))
def random_seeds(spark, d):
    return baselines.random_seeds(graph.nodes_of(parts(spark, d)), 50)


_reach = "rel(rr_id, node, spot) AS (SELECT id, id, id FROM v UNION SELECT e.dst, rel.node, e.dst FROM rel JOIN e ON e.src = rel.spot)"
_gw, _gw_rows = o.cover(3, "rel")


@register("reach_greedy", o.query([o.PART_SEQ, o.NODES, _reach, *_gw], _gw_rows, True))
def reach_greedy(spark, d):
    e = stored(parts(spark, d), "edges")
    return baselines.reach_greedy(e, graph.nodes_of(e), 3).table(spark)


_W = 4
_rel = [
    f"walk(r, source, node) AS (SELECT r, id * 8, id * 8 FROM v CROSS JOIN (SELECT unnest(range({_W})) AS r) UNION SELECT walk.r, walk.source, live.dst FROM walk JOIN live ON live.r = walk.r AND live.src = walk.node)",
    "rel AS MATERIALIZED (SELECT r || '|' || node AS rr_id, source // 8 AS node FROM walk WHERE node % 8 = 0)",
]


def _greedy_sql(model: str) -> str:
    ctes, rows = o.cover(3, "rel")
    return o.query([o.USER_SEQ, o.NODES, *o.aux(model, 2), *o.live(model, 2, o.world_range(_W)), *_rel, *ctes], rows, True)


for _m in ("IC", "LT", "TRIGGER"):
    for _lazy in (False, True):
        register(f"{'lazy' if _lazy else 'world'}_greedy_{_m.lower()}_2", _greedy_sql(_m))(
            lambda spark, d, m=_m, lazy=_lazy: baselines.world_greedy(built(users(spark, d), m, 2), 3, _W, lazy=lazy).table(spark)
        )


def _and_greedy_sql() -> str:
    """Two picks under the AND rule; the candidate is part of the world's number."""
    base = [o.USER_SEQ, o.NODES, *o.aux("IC2MIX", 3, **_MIX), *o.live("IC2MIX", 3, o.world_range(_W), tag="0")]
    ctes, earlier = [], "FALSE"
    for i in (1, 2):
        start = f"SELECT w.r * 1000000000 + v.id AS r, v.id * 8 AS node FROM v CROSS JOIN w0 w WHERE NOT ({earlier.replace('$', 'v.id')})"
        if i == 2:
            start += f" UNION SELECT w.r * 1000000000 + v.id, (SELECT node FROM s1) * 8 FROM v CROSS JOIN w0 w WHERE NOT ({earlier.replace('$', 'v.id')})"
        steps = [x.replace(f"a{j} AS", f"b{i}_{j} AS").replace(f"FROM a{j - 1} a", f"FROM b{i}_{j - 1} a").replace(f"FROM a{j - 1} UNION", f"FROM b{i}_{j - 1} UNION") for j, x in enumerate(o.and_active(start, 3, 12))]
        steps = [x.replace("JOIN live l ON l.r = a.r AND", "JOIN live0 l ON l.r = a.r // 1000000000 AND").replace("JOIN live gate ON gate.r = a.r AND", "JOIN live0 gate ON gate.r = a.r // 1000000000 AND") for x in steps]
        ctes += [*steps, f"s{i} AS MATERIALIZED (SELECT r % 1000000000 AS node, COUNT(*) AS spread FROM b{i}_12 GROUP BY 1 ORDER BY spread DESC, node LIMIT 1)"]
        earlier = "$ IN (SELECT node FROM s1)"
    rows = "SELECT 1::INTEGER AS rank, node, spread AS gain, spread AS covered FROM s1 UNION ALL SELECT 2, s2.node, s2.spread - s1.spread, s2.spread FROM s1, s2 WHERE s2.spread > s1.spread"
    return o.query([*base, *ctes], rows)


def _and_greedy(strategy: str) -> Query:
    return lambda spark, d: baselines.world_greedy(built(users(spark, d), "IC2MIX", 3, **_MIX), 2, _W, strategy=strategy).table(spark)


register("world_greedy_all_factor_3", _and_greedy_sql())(_and_greedy("auto"))
register("world_greedy_all_factor_3_relational", ORACLE_SQL["world_greedy_all_factor_3"])(_and_greedy("relational"))


def _facts(spark, **facts) -> DataFrame:
    return spark.createDataFrame([tuple(facts.values())], list(facts))


def _joined(seeds: list[int]) -> str:
    return " ".join(map(str, seeds))


@register("imm_ic_2")
def imm_ic(spark, d):
    r = select.imm(built(users(spark, d), "IC", 2), 3, eps=0.5)
    return _facts(spark, seeds=_joined(r.cover.seeds), theta=r.theta, lower=r.lower, influence=r.influence)


_HALF = 2000


def _opim_sql(model: str, k: int, sets: int, ctes: list[str], rows: str) -> str:
    return o.query([o.USER_SEQ, *o.rr(model, 2, sets, 45), *o.sample(model, 2, sets, 46, "2"), *o.cover(k)[0], *o.opim(k, sets), f"sel AS ({o.cover(k)[1]})", *ctes], rows, True)


@register(
    "opim_ic_2",
    _opim_sql("IC", 3, _HALF, [], f"""SELECT (SELECT string_agg(node::VARCHAR, ' ' ORDER BY rank) FROM sel) AS seeds, {_HALF}::BIGINT AS sets, round(ratio, 9) AS ratio,
      round(covered2 * (SELECT COUNT(*) FROM v) / {_HALF}.0::DOUBLE, 6) AS influence FROM found"""),
)
def opim_ic(spark, d):
    r = select.opim(built(users(spark, d), "IC", 2), 3, 2 * _HALF)
    return _facts(spark, seeds=_joined(r.cover.seeds), sets=r.sets, ratio=round(r.ratio, 9), influence=round(float(r.influence), 6))


@register("opim_all_factor_3")
def opim_all_factor(spark, d):
    r = select.opim(_sampler_mix(spark, d).g, 2, 2 * SETS)
    return _facts(spark, seeds=_joined(r.cover.seeds), sets=r.sets, ratio=r.ratio, influence=float(r.influence))


@register("opimc_ic_2")
def opimc_ic(spark, d):
    r = select.opimc(built(users(spark, d), "IC", 2), 3, eps=0.4)
    return _facts(spark, seeds=_joined(r.cover.seeds), sets=r.sets, ratio=r.ratio, influence=float(r.influence), accepted=r.accepted)


def _prefix_out(rows: DataFrame) -> DataFrame:
    return rows.select(
        "k", "covered_rr", F.round("self_influence", 6).alias("self_influence"), F.array_join("seeds", " ").alias("seeds"),
        F.round("validation_influence", 6).alias("validation_influence"), F.round("approximation_for_kmax", 9).alias("approximation_for_kmax"), F.col("rr_sets").cast("long").alias("rr_sets"),
    )


@register("opimc_prefix_ic_3")
def opimc_prefix(spark, d):
    return _prefix_out(select.opimc_prefix(built(users(spark, d), "IC", 3), [1, 2, 4], eps=0.4)[1])


_share = "((SELECT COUNT(*) FROM v) / 1000.0::DOUBLE)"


@register(
    "opim_prefix_lt_2",
    _opim_sql("LT", 3, 1000, ["ks AS (SELECT unnest([0, 1, 3])::INTEGER AS k)"], f"""SELECT k, (SELECT COALESCE(MAX(covered), 0) FROM sel WHERE rank <= k)::BIGINT AS covered_rr,
      round((SELECT COALESCE(MAX(covered), 0) FROM sel WHERE rank <= k) * {_share}, 6) AS self_influence, COALESCE((SELECT string_agg(node::VARCHAR, ' ' ORDER BY rank) FROM sel WHERE rank <= k), '') AS seeds,
      round((SELECT COUNT(DISTINCT rr_id) FROM rr2 WHERE node IN (SELECT node FROM sel WHERE rank <= k)) * {_share}, 6) AS validation_influence, (SELECT round(ratio, 9) FROM found) AS approximation_for_kmax, 1000::BIGINT AS rr_sets FROM ks"""),
)
def opim_prefix(spark, d):
    return _prefix_out(select.opim_prefix(built(users(spark, d), "LT", 2), [0, 1, 3], 2000)[1])


@register("imm_prefix_trigger_2")
def imm_prefix(spark, d):
    return select.imm_prefix(built(users(spark, d), "TRIGGER", 2), [1, 3], eps=0.5)[1].withColumn("seeds", F.array_join("seeds", " "))


@register("stopping_rule_ic_2")
def stopping_rule(spark, d):
    e = users(spark, d)
    s = rrsets.Sampler(built(e, "IC", 2))
    found = rrsets.stopping_rule(s, [r.id for r in baselines.max_degree(e, s.g.nodes, 3).collect()], eps=0.2)
    return _facts(spark, influence=found.influence, sets=found.sets, reached=found.reached)


_USES = [
    "tie AS MATERIALIZED (SELECT r, dst AS target, src AS parent, -1 AS factor FROM live WHERE dst % 8 = 0 AND src % 8 = 0 UNION ALL SELECT g.r, g.dst, u.src, (g.src % 8)::INTEGER FROM live g JOIN live u ON u.r = g.r AND u.dst = g.src WHERE g.dst % 8 = 0 AND g.src % 8 > 0)",
    f"root AS MATERIALIZED ({o.root_query(44, SETS)})",
    "ob(r, node) AS (SELECT r, node FROM root UNION SELECT ob.r, tie.parent FROM ob JOIN tie ON tie.r = ob.r AND tie.target = ob.node)",
]
_USES_SQL = o.query(
    [o.USER_SEQ, o.NODES, *o.aux("IC2MIX", 3, **_MIX), *o.live("IC2MIX", 3, o.world_range(SETS), 44), *_USES],
    """SELECT r AS rr_id, node // 8 AS root, NULL::BIGINT AS parent, node // 8 AS target, NULL::INTEGER AS factor FROM root UNION ALL
    SELECT ob.r, root.node // 8, tie.parent // 8, tie.target // 8, tie.factor FROM ob JOIN tie ON tie.r = ob.r AND tie.target = ob.node JOIN root ON root.r = ob.r""", True,
)


@register("stateful_samples_3", _USES_SQL)
def stateful_samples(spark, d):
    return _sampler_mix(spark, d).uses(0, SETS)


@register("stateful_samples_3_relational", _USES_SQL)
def stateful_samples_relational(spark, d):
    return rrsets.Sampler(built(users(spark, d), "IC2MIX", 3, **_MIX), strategy="relational").uses(0, SETS)


def _sampler_mix(spark, d) -> rrsets.Sampler:
    return rrsets.Sampler(built(users(spark, d), "IC2MIX", 3, **_MIX))


@register("all_factor_greedy_3")
def all_factor_greedy(spark, d):
    return select.all_factor_greedy(built(users(spark, d), "IC2MIX", 3, **_MIX), 3, SETS)[0].table(spark)


# ---------------------------------------------------------------- social


def social_tables(spark, d):
    """users, interactions, vertices and seeds derived from the event stream."""
    events = spark.read.parquet(f"{d}/events.parquet")
    ids = F.col("user_id").cast("string")
    u = events.groupBy(ids.alias("user_id")).agg(F.array_sort(F.collect_set("event_type")).alias("user_interests"))
    u = u.select("user_id", (u32("followers", 1, F.col("user_id")) % 200_000).alias("user_followers"), F.filter("user_interests", lambda x: u32("likes", 1, F.col("user_id"), x) < TWO32 / 4).alias("user_interests"))
    u = stored(u, "users")
    e = users(spark, d)
    inter = e.select(F.col("src").cast("string").alias("user_id"), F.col("dst").cast("string").alias("interact_id"))
    vertices = u.select("user_id", F.col("user_id").cast("long").alias("vertex"))
    seeds = u.where(u32("seed", 1, F.col("user_id")) < TWO32 / 2).select("user_id")
    return u, inter, vertices, seeds


_SOCIAL = [
    o.USER_SEQ,
    f"""u AS (SELECT user_id, {sql_u32('followers', 1, 'user_id')} % 200000 AS user_followers,
      list_filter(ints, lambda x: {sql_u32('likes', 1, 'user_id', 'x')} < {TWO32 / 4!r}) AS user_interests
      FROM (SELECT user_id::VARCHAR AS user_id, list(DISTINCT event_type) AS ints FROM events GROUP BY 1))""",
    f"s AS (SELECT user_id FROM u WHERE {sql_u32('seed', 1, 'user_id')} < {TWO32 / 2!r})",
    f"""sel AS MATERIALIZED (SELECT a AS user_id, b AS interact_id FROM (SELECT a, b, user_followers, ROW_NUMBER() OVER (PARTITION BY a, user_followers > 100000 ORDER BY {sql_u32('interact', 48, 'a', 'b')}, b) AS n
      FROM (SELECT src::VARCHAR AS a, dst::VARCHAR AS b FROM e) JOIN u ON u.user_id = b WHERE a IN (SELECT user_id FROM s)) WHERE user_followers > 100000 OR n <= 100 OR b IN (SELECT user_id FROM s))""",
    """tie AS (SELECT user_id::BIGINT AS a, interact_id::BIGINT AS b, 1 AS f FROM sel UNION
      SELECT unnest([a, b]), unnest([b, a]), 2 FROM (SELECT sel.user_id::BIGINT AS a, interact_id::BIGINT AS b FROM sel JOIN u x ON x.user_id = sel.user_id JOIN u y ON y.user_id = interact_id
      WHERE sel.user_id <> interact_id AND list_has_any(x.user_interests, y.user_interests)))""",
    "ge AS MATERIALIZED (SELECT a * 8 AS src, b * 8 + f AS dst FROM tie UNION SELECT b * 8 + f, b * 8 FROM tie)",
    "gn AS (SELECT DISTINCT unnest([a, b]) * 8 AS node FROM tie WHERE f = 1 UNION SELECT DISTINCT b * 8 + f FROM tie)",
]


def social_graph(spark, d) -> social.SocialGraph:
    u, inter, vertices, seeds = social_tables(spark, d)
    g = social.factor_graph(u, stored(social.selected_interactions(u, inter, seeds), "selected"), vertices)
    return social.SocialGraph(stored(g.nodes, "nodes"), stored(g.edges, "edges"))


def weighted_social(spark, d) -> social.SocialGraph:
    """The same with thresholds of a configuration as weights, here drawn from 0.05 .. 0.95."""
    g = social_graph(spark, d)
    drawn = F.lit(0.05) + F.lit(0.9) * uniform("tie", 51, F.col("src"), F.col("dst"))
    g = social.with_weights(g, g.edges.select("src", "dst", drawn.alias("threshold")))
    return social.SocialGraph(g.nodes, stored(g.edges, "edges"))


_WEIGHTED = [*_SOCIAL, f"gw AS MATERIALIZED (SELECT src, dst, {o.num(0.05)} + {o.num(0.9)} * {sql_uniform('tie', 51, 'src', 'dst')} AS weight FROM ge)"]


@register("social_selected", o.query(_SOCIAL, "SELECT user_id, interact_id FROM sel"))
def social_selected(spark, d):
    u, inter, _, seeds = social_tables(spark, d)
    return social.selected_interactions(u, inter, seeds)


@register("social_edges", o.query(_SOCIAL, "SELECT src, dst, 1.0::DOUBLE AS weight FROM ge"))
def social_edges(spark, d):
    return social_graph(spark, d).edges


@register(
    "social_nodes",
    o.query(_SOCIAL, """SELECT node, CASE WHEN node % 8 = 0 THEN 'user' ELSE 'factor' END AS node_type, CASE node % 8 WHEN 1 THEN 'interaction' WHEN 2 THEN 'interest' END AS factor_type,
      CASE WHEN node % 8 > 0 THEN node // 8 END AS target, (SELECT string_agg(a::VARCHAR, ' ' ORDER BY a) FROM tie WHERE b = node // 8 AND f = node % 8 AND node % 8 > 0) AS sources FROM gn"""),
)
def social_nodes(spark, d):
    return social_graph(spark, d).nodes.withColumn("sources", F.array_join("sources", " "))


@register("social_degree_scores", o.query(_SOCIAL, "SELECT node, round(COUNT(*)::DOUBLE / ((SELECT COUNT(*) FROM gn) - 1), 9) AS score FROM (SELECT unnest([src, dst]) AS node FROM ge) GROUP BY node"))
def social_degree_scores(spark, d):
    g = social_graph(spark, d)
    return social.degree_score(g.nodes.select("node"), g.edges).select("node", F.round("score", 9).alias("score"))


_PI = " * ".join(f"(1.0::DOUBLE - power(weight, {i}))" for i in range(1, 6))


@register("social_edges_weighted", o.query(_WEIGHTED, "SELECT src, dst, round(weight, 9) AS weight FROM gw"))
def social_edges_weighted(spark, d):
    return weighted_social(spark, d).edges.select("src", "dst", F.round("weight", 9).alias("weight"))


@register("social_pi_scores", o.query(_WEIGHTED, f"SELECT src AS node, round(SUM(1.0::DOUBLE - {_PI}), 9) AS score FROM gw GROUP BY src"))
def social_pi_scores(spark, d):
    g = weighted_social(spark, d)
    return social.pi_score(g.nodes.select("node"), g.edges).select("node", F.round("score", 9).alias("score"))


def _sigma_sql(tag: str, nodes: str, ties: str) -> list[str]:
    steps = [
        f"x{tag}{i} AS MATERIALIZED (SELECT a.node, a.x + COALESCE(m, 0) AS x FROM x{tag}{i - 1} a LEFT JOIN (SELECT src, SUM(power(weight, {i}) * x) AS m FROM {ties} JOIN x{tag}{i - 1} ON node = dst GROUP BY src) ON src = a.node)"
        for i in range(1, 6)
    ]
    return [f"x{tag}0 AS (SELECT node, 1.0::DOUBLE AS x FROM {nodes})", *steps, f"sc{tag} AS (SELECT node, x AS score FROM x{tag}5)"]


def _eigen_sql(tag: str, nodes: str, ties: str, rounds: int = 24) -> list[str]:
    out = [f"x{tag}0 AS (SELECT node, 1.0::DOUBLE AS x FROM {nodes})"]
    for i in range(1, rounds + 1):
        step = f"SELECT a.node, a.x + COALESCE(m, 0) AS x FROM x{tag}{i - 1} a LEFT JOIN (SELECT dst, SUM(weight * x) AS m FROM {ties} JOIN x{tag}{i - 1} ON node = src GROUP BY dst) ON dst = a.node"
        if i % 6 == 0 or i == rounds:
            step = f"SELECT node, x / sqrt(SUM(x * x) OVER ()) AS x FROM ({step})"
        out.append(f"x{tag}{i} AS MATERIALIZED ({step})")
    return [*out, f"sc{tag} AS (SELECT node, x AS score FROM x{tag}{rounds})"]


def _degree_sql(tag: str, nodes: str, ties: str) -> list[str]:
    return [f"sc{tag} AS (SELECT node, COUNT(*)::DOUBLE / greatest((SELECT COUNT(*) FROM {nodes}) - 1, 1) AS score FROM (SELECT unnest([src, dst]) AS node FROM {ties}) GROUP BY node)"]


def _pi_sql(tag: str, nodes: str, ties: str) -> list[str]:
    return [f"sc{tag} AS (SELECT src AS node, SUM(1.0::DOUBLE - {_PI}) AS score FROM {ties} GROUP BY src)"]


def _adaptive_sql(score) -> str:
    """Two picks: the best user, and the best one once that is taken out."""
    top = "SELECT n.node, round(COALESCE(score, 0.0), 9) AS score FROM {0} n LEFT JOIN sc{1} s ON s.node = n.node WHERE n.node % 8 = 0 ORDER BY 2 DESC, 1 LIMIT 1"
    ctes = [
        *score("a", "gn", "gw"), f"t1 AS MATERIALIZED ({top.format('gn', 'a')})", "gn2 AS (SELECT node FROM gn WHERE node <> (SELECT node FROM t1))",
        "gw2 AS (SELECT * FROM gw WHERE (SELECT node FROM t1) NOT IN (src, dst))", *score("b", "gn2", "gw2"), f"t2 AS MATERIALIZED ({top.format('gn2', 'b')})",
    ]
    return o.query([*_WEIGHTED, *ctes], "SELECT 1::INTEGER AS rank, node // 8 AS vertex, score FROM t1 UNION ALL SELECT 2, node // 8, score FROM t2")


@register("social_sigma_scores", o.query([*_WEIGHTED, *_sigma_sql("a", "gn", "gw")], "SELECT node, round(score, 6) AS score FROM sca"))
def social_sigma_scores(spark, d):
    g = weighted_social(spark, d)
    return social.sigma_score(g.nodes.select("node"), g.edges).select("node", F.round("score", 6).alias("score"))


_ROUNDS_SOCIAL = 20
_GLIVE = f"glive AS MATERIALIZED (SELECT r, src, dst FROM gw CROSS JOIN (SELECT unnest(range({_ROUNDS_SOCIAL})) AS r) WHERE {sql_u32('edge', 49, 'r', 'src', 'dst')} < weight * {TWO32!r}::DOUBLE)"
_FIRST3 = "st AS (SELECT node FROM gn WHERE node % 8 = 0 ORDER BY node LIMIT 3)"
_EVERY = f"(SELECT unnest(range({_ROUNDS_SOCIAL})) AS r)"


def _first3(g: social.SocialGraph) -> list[int]:
    return [r.node >> 3 for r in g.nodes.where("node_type = 'user'").orderBy("node").limit(3).collect()]


_IC_SPREAD_SQL = o.query(
    [*_WEIGHTED, _GLIVE, _FIRST3, f"hop(r, node, h) AS (SELECT r, node, 0 FROM st CROSS JOIN {_EVERY} UNION SELECT hop.r, dst, h + 1 FROM hop JOIN glive ON glive.r = hop.r AND src = node WHERE h < 4)"],
    f"SELECT 0::BIGINT AS candidate, COUNT(*) / {_ROUNDS_SOCIAL}.0::DOUBLE AS spread FROM (SELECT DISTINCT r, node FROM hop WHERE node % 8 = 0)", True,
)
_LT = [f"l0 AS MATERIALIZED (SELECT r, node FROM st CROSS JOIN {_EVERY})", "ind AS (SELECT dst, COUNT(*) AS d FROM gw GROUP BY dst)"] + [
    f"l{i} AS MATERIALIZED (SELECT r, node FROM l{i - 1} UNION SELECT r, m.dst FROM (SELECT r, dst, COUNT(*) AS n FROM l{i - 1} JOIN gw ON src = node GROUP BY r, dst) m JOIN ind ON ind.dst = m.dst WHERE n::DOUBLE / d >= ({sql_u32('threshold', 49, 'r', 'm.dst')} % 19 + 1) / 100.0::DOUBLE)"
    for i in range(1, 5)
]
_LT_SPREAD_SQL = o.query([*_WEIGHTED, _FIRST3, *_LT], f"SELECT 0::BIGINT AS candidate, COUNT(*) / {_ROUNDS_SOCIAL}.0::DOUBLE AS spread FROM l4 WHERE node % 8 = 0")
for _m, _sql in (("ic", _IC_SPREAD_SQL), ("lt", _LT_SPREAD_SQL)):
    for _s in ("auto", "relational"):

        def _social_spread(spark, d, m=_m.upper(), s=_s):
            g = weighted_social(spark, d)
            return social.user_spread(g, [_first3(g)], _ROUNDS_SOCIAL, m, strategy=s)

        register(f"social_spread_{_m}" + ("_relational" if _s == "relational" else ""), _sql)(_social_spread)


def _picks(spark, rows) -> DataFrame:
    return spark.createDataFrame([(k, int(v), round(float(s), 9)) for k, (v, s) in enumerate(rows, 1)], "rank int, vertex long, score double")


_RIS = [
    f"rlive AS MATERIALIZED (SELECT r, src, dst FROM gw CROSS JOIN (SELECT unnest(range(200)) AS r) WHERE {sql_u32('edge', 50, 'r', 'src', 'dst')} < weight * {TWO32!r}::DOUBLE)",
    "gu AS (SELECT node // 8 AS id FROM gn WHERE node % 8 = 0)",
    f"rb(r, node) AS ({o.root_query(50, 200, 'gu')} UNION SELECT rb.r, rlive.src FROM rb JOIN rlive ON rlive.r = rb.r AND rlive.dst = rb.node)",
    "rs AS MATERIALIZED (SELECT r, node // 8 AS node FROM rb WHERE node % 8 = 0)",
    "t1 AS MATERIALIZED (SELECT node, COUNT(*) AS c FROM rs WHERE r < 100 GROUP BY node ORDER BY c DESC, node LIMIT 1)",
    "rs2 AS (SELECT r, node FROM rs WHERE (r < 100 AND r NOT IN (SELECT r FROM rs WHERE node = (SELECT node FROM t1))) OR (r >= 100 AND r < 100 + (SELECT c FROM t1)))",
    "t2 AS (SELECT node, COUNT(*) AS c FROM rs2 WHERE node <> (SELECT node FROM t1) GROUP BY node ORDER BY c DESC, node LIMIT 1)",
]
_RIS_SQL = o.query([*_WEIGHTED, *_RIS], "SELECT 1::INTEGER AS rank, node AS vertex, c::DOUBLE AS score FROM t1 UNION ALL SELECT 2, node, c::DOUBLE FROM t2", True)
for _name, _f, _sql in (
    ("degree", social.degree_seeds, _adaptive_sql(_degree_sql)), ("pi", social.pi_seeds, _adaptive_sql(_pi_sql)), ("sigma", social.sigma_seeds, _adaptive_sql(_sigma_sql)),
    ("eigen", social.eigen_seeds, _adaptive_sql(_eigen_sql)), ("ris", social.ris_seeds, _RIS_SQL),
):
    register(f"social_{_name}_seeds", _sql)(lambda spark, d, f=_f: _picks(spark, f(weighted_social(spark, d), 2)))

_GREEDY = [
    _GLIVE.replace(f"range({_ROUNDS_SOCIAL})", "range(3)"),
    "hop(r, c, node, h) AS (SELECT r, node, node, 0 FROM gn CROSS JOIN (SELECT unnest(range(3)) AS r) WHERE node % 8 = 0 UNION SELECT hop.r, c, dst, h + 1 FROM hop JOIN glive ON glive.r = hop.r AND src = node WHERE h < 4)",
    "ball AS MATERIALIZED (SELECT DISTINCT c, r, node FROM hop WHERE node % 8 = 0)",
    "t1 AS MATERIALIZED (SELECT c, COUNT(*) AS n FROM ball GROUP BY c ORDER BY n DESC, c LIMIT 1)",
    "have AS MATERIALIZED (SELECT r, node FROM ball WHERE c = (SELECT c FROM t1))",
    "more AS (SELECT b.c, COUNT(*) FILTER (h.r IS NULL) AS n FROM ball b LEFT JOIN have h ON h.r = b.r AND h.node = b.node WHERE b.c <> (SELECT c FROM t1) GROUP BY b.c ORDER BY n DESC, b.c LIMIT 1)",
]
_GREEDY_SQL = o.query([*_WEIGHTED, *_GREEDY], "SELECT 1::INTEGER AS rank, c // 8 AS vertex, round(n / 3.0::DOUBLE, 9) AS score FROM t1 UNION ALL SELECT 2, more.c // 8, round((more.n + t1.n) / 3.0::DOUBLE, 9) FROM more, t1", True)
for _name, _f in (("greedy", social.greedy_seeds), ("celf", social.celf_seeds), ("celfpp", social.celfpp_seeds)):
    register(f"social_{_name}_seeds", _GREEDY_SQL)(lambda spark, d, f=_f: _picks(spark, f(weighted_social(spark, d), 2, 3)))


# ---------------------------------------------------------------- experiments and outputs


_chosen = " UNION ALL ".join([
    "SELECT 'MaxDegree' AS a, ROW_NUMBER() OVER (ORDER BY degree DESC, id) AS rank, id FROM top",
    f"SELECT 'Random', ROW_NUMBER() OVER (ORDER BY {sql_u32('random', 42, 'id')}, id), id FROM v",
    "SELECT 'MF-RR', rank, node FROM sel",
])
_EXPERIMENT_SQL = o.query(
    [o.USER_SEQ, *o.rr("IC", 2, 400, 42), *o.cover(4)[0], f"sel AS ({o.cover(4)[1]})", o.top_out(4), f"chosen AS MATERIALIZED ({_chosen})", *o.live("IC", 2, o.world_range(20), 43, "w"),
     "fwd(a, size, r, node) AS (SELECT a, size, r, id * 8 FROM chosen JOIN (SELECT unnest([2, 4]) AS size) ON rank <= size CROSS JOIN ww UNION SELECT a, size, fwd.r, livew.dst FROM fwd JOIN livew ON livew.r = fwd.r AND livew.src = fwd.node)",
     "score AS (SELECT a, size, COUNT(*) / 20.0::DOUBLE AS i FROM fwd WHERE node % 8 = 0 GROUP BY a, size)"],
    """SELECT s::INTEGER AS size, COALESCE(MAX(i) FILTER (a = 'MaxDegree'), 0.0) AS "MaxDegree", COALESCE(MAX(i) FILTER (a = 'Random'), 0.0) AS "Random", COALESCE(MAX(i) FILTER (a = 'MF-RR'), 0.0) AS "MF-RR"
    FROM (SELECT unnest([0, 2, 4]) AS s) LEFT JOIN score ON size = s GROUP BY s""", True,
)


@register("experiment_wide", _EXPERIMENT_SQL)
def experiment_wide(spark, d):
    return wide(run_experiment(users(spark, d), ["MaxDegree", "Random", "MF-RR"], [0, 2, 4], "MFIC", 2, worlds=20, theta=400))


def _folder(spark) -> str:
    import uuid

    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


@register("graph_saved", ORACLE_SQL["aux_ic_2"])
def graph_saved(spark, d):
    path = _folder(spark)
    sinks.save_graph(build(users(spark, d), "IC", 2), path)
    return _rounded(sinks.load_graph(spark, path).edges)


@register("graph_text", ORACLE_SQL["aux_ic_2"].replace("round(prob, 9)", "round(prob, 6)"))
def graph_text(spark, d):
    path = _folder(spark)
    sinks.write_graph_text(build(users(spark, d), "IC", 2), path)
    return src.read_weighted(spark, f"{path}/edges").select("src", "dst", F.round("prob", 6).alias("prob"))
