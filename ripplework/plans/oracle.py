"""The engine's definitions as plain SQL, for an independent engine to check against.

Each function gives the text of common table expressions; ``query`` puts them together.
"""

from __future__ import annotations

from ripplework.functions.keyed import TWO32, sql_u32, sql_uniform
from ripplework.operators.aux_graph import GATES, ranges

USER_SEQ = """e AS (SELECT DISTINCT s AS src, d AS dst FROM (SELECT user_id s, lead(user_id) OVER (ORDER BY ts, event_id) d FROM events) WHERE d IS NOT NULL AND s <> d)"""
PART_SEQ = """e AS (SELECT DISTINCT s AS src, d AS dst FROM (SELECT l_partkey s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) d FROM lineitem) WHERE d IS NOT NULL AND s <> d)"""
NODES = "v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM e)"


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def weights(model: str, factors: int, seed: int, node: str, p: float) -> list[str]:
    if model in ("IC2", "IC2MIX"):
        return [num(p)] * factors
    out: list[str | None] = [None if r is None else f"({num(r[0])} + {num(r[1] - r[0])} * {sql_uniform('factor_w', seed, node, str(i))})" for i, r in enumerate(ranges(model, factors), 1)]
    rest = num(1.0)
    for w in out:
        if w is not None:
            rest = f"({rest} - {w})"
    return [rest if w is None else w for w in out]


def aux(model: str, factors: int, seed: int = 42, p: float = 0.778, ratio: float = 0.1, gate: bool = False) -> list[str]:
    """CTEs d, aux(src, dst, prob) and np(node, p) over e(src, dst)."""
    w = weights(model, factors, seed, "id", p)
    if model == "TRIGGER":
        w = [f"greatest({', '.join(w)})"] * factors
    elif model == "OLO":
        miss = num(1.0)
        for x in w:
            miss = f"({miss} * ({num(1.0)} - {x}))"
        w = [f"least(greatest({num(1.0)} - {miss}, 0.0::DOUBLE), 1.0::DOUBLE)"] * factors
    gated = f"{sql_u32('mix', seed, 'id')} < {ratio * TWO32!r}" if model == "IC2MIX" else "TRUE"
    share = "1.0::DOUBLE / d"
    if gate:
        cases = " ".join(f"WHEN {i} THEN {num(lo)} + {num(hi - lo)} * {sql_uniform('gate', seed, 'src', 'dst', str(i))}" for i, (lo, hi) in enumerate(GATES[factors], 1))
        share = f"(CASE i {cases} END) / d"
    down = " UNION ALL ".join(f"SELECT id * 8 + {i} AS src, id * 8 AS dst, {x} AS prob FROM d WHERE gated" for i, x in enumerate(w, 1))
    up = f"SELECT src * 8 AS src, dst * 8 + i AS dst, {share} AS prob FROM e JOIN d ON dst = id CROSS JOIN (SELECT unnest(range(1, {factors + 1})) AS i) WHERE gated"
    direct = " UNION ALL SELECT src * 8, dst * 8, 1.0::DOUBLE / d FROM e JOIN d ON dst = id WHERE NOT gated" if model == "IC2MIX" else ""
    out = [f"d AS (SELECT *, {gated} AS gated FROM (SELECT dst AS id, COUNT(*) AS d FROM e GROUP BY dst))", f"aux AS MATERIALIZED ({down} UNION ALL {up}{direct})"]
    if model in ("TRIGGER", "OLO"):
        facs = " UNION ALL ".join(f"SELECT id * 8 + {i}, 1.0::DOUBLE / d FROM d" for i in range(1, factors + 1))
        out.append(f"np AS (SELECT id * 8 AS node, {w[0]} AS p FROM d UNION ALL {facs})")
    else:
        out.append("np AS (SELECT dst AS node, MAX(prob) AS p FROM aux GROUP BY dst)")
    return out


def live(model: str, factors: int, worlds: str, seed: int = 43, tag: str = "") -> list[str]:
    """CTE live(r, src, dst) over aux and np; ``worlds`` is a query of the column r, ``tag`` an
    ending of all names."""
    if model in ("TRIGGER", "OLO"):
        prep = "SELECT src, dst, prob, p AS a FROM aux JOIN np ON node = dst"
        test = f"{sql_u32('node', seed, 'r', 'dst')} < a * {TWO32!r}::DOUBLE"
    elif model == "LT":
        prep = """SELECT src, dst, prob, (c - prob) / t AS a, c / t AS b FROM (SELECT *, SUM(prob) OVER (PARTITION BY dst ORDER BY src ROWS UNBOUNDED PRECEDING) AS c, SUM(prob) OVER (PARTITION BY dst) AS t FROM aux)"""
        h = sql_uniform("pick", seed, "r", "dst")
        test = f"a <= {h} AND {h} < b"
    else:
        prep = "SELECT * FROM aux"
        test = f"{sql_u32('edge', seed, 'r', 'src', 'dst')} < prob * {TWO32!r}::DOUBLE"
        if model in ("IC2", "IC2MIX"):
            gate = " AND ".join(f"{sql_u32('edge', seed, 'r', f'(dst + {i})', 'dst')} < prob * {TWO32!r}::DOUBLE" for i in range(1, factors + 1))
            test = f"CASE WHEN src % 8 > 0 THEN {gate} ELSE {test} END"
    return [f"prep{tag} AS MATERIALIZED ({prep})", f"w{tag} AS ({worlds})", f"live{tag} AS MATERIALIZED (SELECT r, src, dst FROM prep{tag} CROSS JOIN w{tag} WHERE {test})"]


def world_range(count: int) -> str:
    return f"SELECT unnest(range({count})) AS r"


def top_out(k: int) -> str:
    return f"top AS (SELECT id, degree FROM (SELECT id, COUNT(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id) ORDER BY degree DESC, id LIMIT {k})"


def forward(start: str, seeded: str = "r, node") -> str:
    return f"reach({seeded}) AS ({start} UNION SELECT reach.r, live.dst FROM reach JOIN live ON live.r = reach.r AND live.src = reach.node)"


def root_query(seed: int, count: int, nodes: str = "v") -> str:
    place = f"{sql_u32('root', seed, 'q')} * (SELECT COUNT(*) FROM {nodes}) // 4294967296"
    return f"SELECT q AS r, id * 8 AS node FROM (SELECT unnest(range({count})) AS q) JOIN (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS k FROM {nodes}) ON k = {place}"


def sample(model: str, factors: int, count: int, seed: int = 44, tag: str = "") -> list[str]:
    """CTE rr(rr_id, node) of ``count`` sets over v and aux."""
    back = f"back{tag}(r, node) AS ({root_query(seed, count)} UNION SELECT back{tag}.r, live{tag}.src FROM back{tag} JOIN live{tag} ON live{tag}.r = back{tag}.r AND live{tag}.dst = back{tag}.node)"
    return [*live(model, factors, world_range(count), seed, tag), back, f"rr{tag} AS MATERIALIZED (SELECT r AS rr_id, node // 8 AS node FROM back{tag} WHERE node % 8 = 0)"]


def rr(model: str, factors: int, count: int, seed: int = 44, **args) -> list[str]:
    """CTE rr(rr_id, node) of ``count`` sets over e."""
    return [NODES, *aux(model, factors, **args), *sample(model, factors, count, seed)]


def opim(k: int, sets: int) -> list[str]:
    """CTE found(ratio, covered, covered2) of greedy cover on rr (p1 .. pk) judged on rr2."""
    bounds = []
    for i in range(k + 1):
        chosen = " UNION ALL ".join(f"SELECT node FROM p{j}" for j in range(1, i + 1))
        gone = f" WHERE rr_id NOT IN (SELECT rr_id FROM rr WHERE node IN ({chosen}))" if i else ""
        have = " + ".join(["0", *(f"(SELECT gain FROM p{j})" for j in range(1, i + 1))])
        bounds.append(f"SELECT {have} + (SELECT COALESCE(SUM(c), 0) FROM (SELECT COUNT(*) AS c FROM rr{gone} GROUP BY node ORDER BY c DESC LIMIT {k})) AS b")
    seeds = " UNION ALL ".join(f"SELECT node FROM p{j}" for j in range(1, k + 1))
    a = "(SELECT ln(2.0 * ((SELECT COUNT(*) FROM v) + (SELECT COUNT(DISTINCT src) FROM aux WHERE src % 8 > 0))))"
    return [
        f"bound AS (SELECT MIN(b)::DOUBLE AS b FROM ({' UNION ALL '.join(bounds)}))",
        f"judged AS (SELECT {a} AS a, (SELECT COUNT(DISTINCT rr_id) FROM rr2 WHERE node IN ({seeds}))::DOUBLE AS c2, b FROM bound)",
        "found AS (SELECT c2 AS covered2, (power(sqrt(c2 + 2 * a / 9) - sqrt(a / 2), 2) - a / 18) / power(sqrt(b + a / 2) + sqrt(a / 2), 2) AS ratio FROM judged)",
    ]


def and_active(start: str, factors: int, rounds: int) -> list[str]:
    """CTEs a0 .. a(rounds)(r, node): origins active under the AND rule after so many rounds
    over live, from a query of (r, node); the last is the fixpoint if there are rounds enough."""
    out = [f"a0 AS MATERIALIZED ({start})"]
    for i in range(1, rounds + 1):
        out.append(
            f"""a{i} AS MATERIALIZED (SELECT r, node FROM a{i - 1} UNION
  SELECT a.r, l.dst FROM a{i - 1} a JOIN live l ON l.r = a.r AND l.src = a.node WHERE l.dst % 8 = 0 UNION
  SELECT r, node FROM (SELECT DISTINCT a.r, l.dst AS f, gate.dst AS node FROM a{i - 1} a JOIN live l ON l.r = a.r AND l.src = a.node JOIN live gate ON gate.r = a.r AND gate.src = l.dst WHERE l.dst % 8 > 0)
    GROUP BY r, node HAVING COUNT(*) = {factors})"""
        )
    return out


def cover(k: int, sets: str = "rr", element: str = "rr_id", candidates: str = "v") -> tuple[list[str], str]:
    """Unrolled greedy cover: CTEs p1 .. pk(node, gain) and a query of the selection."""
    ctes = []
    for i in range(1, k + 1):
        earlier = [f"SELECT node FROM p{j}" for j in range(1, i)]
        gone = f" WHERE {element} NOT IN (SELECT {element} FROM {sets} WHERE node IN ({' UNION ALL '.join(earlier)}))" if earlier else ""
        skip = f" WHERE c.id NOT IN ({' UNION ALL '.join(earlier)})" if earlier else ""
        ctes.append(f"p{i} AS MATERIALIZED (SELECT c.id AS node, COUNT(g.node) AS gain FROM {candidates} c LEFT JOIN (SELECT node FROM {sets}{gone}) g ON g.node = c.id{skip} GROUP BY c.id ORDER BY gain DESC, c.id LIMIT 1)")
    rows = " UNION ALL ".join(f"SELECT {i} AS rank, node, gain FROM p{i}" for i in range(1, k + 1))
    return ctes, f'SELECT rank::INTEGER AS rank, node, gain, CAST(SUM(gain) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered FROM ({rows})'
