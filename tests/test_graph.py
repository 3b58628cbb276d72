"""Fixtures with exact expectations, agreement of strategies, and properties."""

import math
import random

import numpy as np
import pytest

from ripplework.operators import aux_graph as A
from ripplework.operators import baselines, graph, rrsets, select, spread
from ripplework.plans import registry
from ripplework.sources import edges as src

TOY = [(1, 2), (1, 3), (2, 4), (3, 4)]
N = 4000


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "src long, dst long")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


@pytest.mark.parametrize("factors,n,m", [(2, 10, 14), (3, 13, 21), (5, 19, 35)])
def test_sizes(toy, factors, n, m):
    for model in ("IC", "LT", "TRIGGER", "OLO", "IC2"):
        assert A.sizes(A.build(toy, model, factors)) == (n, m)


def test_reach_counts(spark, toy):
    got = {r.id: r.reached for r in graph.reach_counts(toy, graph.nodes_of(toy)).collect()}
    assert got == {1: 4, 2: 2, 3: 2, 4: 1}


EXPECTED = [("IC", (1,), 3.006836), ("TRIGGER", (1,), 2.28125), ("LT", (1,), 4.0), ("LT", (2,), 1.5), ("LT", (2, 3), 3.0)]


@pytest.mark.parametrize("model,seeds,mean", EXPECTED)
def test_exact_spread(spark, toy, model, seeds, mean):
    g = A.build(toy, "LT", 2) if model == "LT" else A.build_fixed(toy, model, 2, 0.5)
    g = A.AuxGraph(g.nodes, g.edges, g.node_prob, model, 2)
    rows = [r.spread for r in spread.spread_by_world(g, ids(spark, *seeds), N).collect()]
    s = rrsets.Sampler(g)
    reverse = rrsets.coverage(s.take(0, N), ids(spark, *seeds), s.n, N).first().influence
    sd = 4 * math.sqrt(2.5 / N)  # spreads lie in 1 .. 4
    assert len(rows) == N and abs(sum(rows) / N - mean) <= sd
    assert abs(reverse - mean) <= 2 * sd


@pytest.mark.parametrize("seeds,mean", [((1,), 1.532227), ((2,), 1.0625), ((3,), 1.0625), ((2, 3), 2.140625)])
def test_all_factor(spark, toy, seeds, mean):
    g = A.build(toy, "IC2MIX", 2, p=0.5, ratio=1.0)
    rows = [r.spread for r in spread.all_factor_spread(g, ids(spark, *seeds), N).collect()]
    s = rrsets.Sampler(g)
    covered = select.all_factor_covered(select.sample_rows(s.uses(0, N)), list(seeds), 2)
    assert abs(sum(rows) / N - mean) < 0.07
    assert abs(covered * 4 / N - mean) < 0.14


def test_all_factor_gate_with_or_coverage(spark, toy):
    g = A.build(toy, "IC2", 2, p=0.5)
    assert abs(spread.mean_spread(spread.spread_by_world(g, ids(spark, 1), N)).first()[0] - 1.584961) < 0.07


@pytest.mark.parametrize("p,mean", [(1.0, 4), (0.0, 1)])
def test_limits(spark, toy, p, mean):
    g = A.build_fixed(toy, "IC", 2, p)
    one = A.AuxGraph(g.nodes, g.edges.selectExpr("src", "dst", f"{p}D prob"), g.node_prob, "IC", 2)
    assert spread.mean_spread(spread.spread_by_world(one, ids(spark, 1, 99), 20)).first()[0] == mean


@pytest.mark.parametrize("model", A.MODELS)
def test_strategies_agree(spark, toy, model):
    g = A.build(toy, model, 3, p=0.7, ratio=0.5)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spread.spread_by_world(g, ids(spark, 1), 30, strategy="local")) == rows(spread.spread_by_world(g, ids(spark, 1), 30, strategy="relational"))
    assert rows(rrsets.Sampler(g, strategy="local").take(0, 30)) == rows(rrsets.Sampler(g, strategy="relational").take(0, 30))


def test_extension_is_append(spark, toy):
    s = rrsets.Sampler(A.build(toy, "IC", 2))
    whole = sorted(map(tuple, s.take(0, 60).collect()))
    assert whole == sorted(map(tuple, s.take(0, 25).unionByName(s.take(25, 35)).collect()))


def brute_cover(sets, nodes, k):
    picks, covered = [], set()
    for _ in range(min(k, len(nodes))):
        gain, minus = max((len({q for q, m in sets.items() if n in m} - covered), -n) for n in nodes if n not in [p for p, _ in picks])
        picks.append((-minus, gain))
        covered |= {q for q, m in sets.items() if -minus in m}
    return picks


@pytest.mark.parametrize("seed", range(4))
def test_greedy_cover_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    nodes = list(range(40))
    sets = {q: set(r.sample(nodes, r.randint(1, 6))) for q in range(150)}
    rr = spark.createDataFrame([(q, n) for q, m in sets.items() for n in m], "rr_id long, node long")
    cover = select.greedy_cover(rr, ids(spark, *nodes), 30)
    assert cover.picks == brute_cover(sets, nodes, 30)
    assert select.greedy_cover(rr, ids(spark, *nodes), 5, bounds=True).picks == cover.picks[:5]
    gains = [g for _, g in cover.picks]
    assert gains == sorted(gains, reverse=True)


def test_bounds_hold(spark, toy):
    s = rrsets.Sampler(A.build(toy, "IC", 2))
    c = select.greedy_cover(s.take(0, 200), s.g.nodes, 2, bounds=True)
    assert c.covered <= c.bound_min <= c.bound_last or c.bound_min <= c.covered + 200
    assert c.bound_min >= c.covered


def test_prefixes_and_clamping(spark, toy):
    s = rrsets.Sampler(A.build(toy, "IC", 2))
    c = select.greedy_cover(s.take(0, 100), s.g.nodes, 10)
    assert len(c.picks) == 4
    rows = {r.k: r for r in select.prefixes(c.table(spark), [0, 2, 3], s.n, 100).collect()}
    assert rows[0].seeds == [] and rows[0].covered_rr == 0
    assert rows[2].seeds == c.seeds[:2] == rows[3].seeds[:2]


def brute_gains(samples, seeds, factors):
    out = {}
    for row in samples:
        by, origins = {}, {row.root}
        for u in row.uses:
            if u.parent is not None:
                by.setdefault(u.parent, []).append((u.target, u.factor))
                origins |= {u.parent, u.target}

        def closure(start):
            active = {s for s in start if s in origins}
            while True:
                met = {}
                for p in active:
                    for t, f in by.get(p, ()):
                        met.setdefault(t, set()).add(f)
                new = {t for t, fs in met.items() if -1 in fs or len(fs - {-1}) == factors} - active
                if not new:
                    return active
                active |= new

        if row.root in closure(seeds):
            continue
        for c in origins - set(seeds):
            out[c] = out.get(c, 0) + (row.root in closure([*seeds, c]))
    return out


def test_all_factor_gains_against_brute_force(spark, toy):
    g = A.build(toy, "IC2MIX", 2, p=0.7, ratio=0.6)
    samples = select.sample_rows(rrsets.Sampler(g).uses(0, 150))
    for seeds in ([], [2], [2, 3]):
        got = {r.node: r.covered for r in select.all_factor_gains(samples, seeds, 2).collect()}
        assert got == brute_gains(samples.collect(), seeds, 2)


def test_not_submodular(spark, toy):
    with pytest.raises(ValueError, match="submodular"):
        baselines.world_greedy(A.build(toy, "IC2", 2), 2, 5, lazy=True)


def test_argument_errors(spark, toy):
    g = A.build(toy, "IC", 2)
    for call in (lambda: A.build(toy, "XX", 2), lambda: A.build(toy, "IC", 4), lambda: select.imm(g, 2, eps=0), lambda: select.imm(g, 2, max_theta=0), lambda: select.rr_greedy(g, 2, -1), lambda: select.opimc(g, 9)):
        with pytest.raises(ValueError):
            call()
    assert select.rr_greedy(g, 0, 10).picks == [] and select.imm(g, 0).cover.picks == []


def test_formulas():
    assert select.log_choose(10, 3) == pytest.approx(math.log(120))
    assert select.log_choose(3, 5) == -math.inf
    plan = select.ImmBounds(16, 2, 0.5, 1.0)
    e = math.sqrt(2) * 0.5
    assert plan.guesses() == [8, 4, 2]
    assert plan.sets_for_guess(8) == math.ceil((2 + 2 * e / 3) * (math.log(120) + math.log(16) + math.log(4)) * 16 / e**2 / 8)
    assert plan.sets_to_select(4.0) < plan.sets_to_select(1.0)
    assert plan.accepted(8 * (1 + e), 8) == pytest.approx(8) and plan.accepted(8, 8) is None
    part = 1 - 1 / math.e
    alpha, beta = math.sqrt(math.log(16) + math.log(2)), math.sqrt(part * (math.log(120) + math.log(16) + math.log(2)))
    assert plan.sets_to_select(2.0) == math.ceil(2 * 16 * (part * alpha + beta) ** 2 / 0.25 / 2)
    assert select.ImmBounds.of(1, 1, 0.5, 1.0).guesses() == [] and select.ImmBounds.of(1, 5, 0.5, 1.0).sets_to_select(1.0) >= 1
    base, most, rounds, a = select.opimc_plan(1000, 10, 0.1, 0.001)
    assert rounds == int(math.log2(most // base)) + 1 and a == pytest.approx(math.log(3 * rounds / 0.001))
    assert select.opim_ratio(900, 1000, 5) < 0.9
    assert select.parse_ks("5, 1 3,5 -2") == [1, 3, 5]


def test_parent_gates_within_ranges(spark, toy):
    g = A.build(toy, "LT", 2, parent_gate="factor_aware")
    for r in g.edges.where("(dst & 7) > 0").collect():
        lo, hi = A.GATES[2][(r.dst & 7) - 1]
        assert lo <= r.prob * (2 if r.dst >> 3 == 4 else 1) < hi


def test_lt_weights_sum_to_one(spark, toy):
    for f in (2, 3, 5):
        for r in A.build(toy, "LT", f).edges.groupBy("dst").sum("prob").collect():
            assert r[1] == pytest.approx(1.0)


def test_duplicates_kept_on_request(spark, toy):
    twice = toy.union(toy)
    assert A.build(twice, "IC", 2).edges.count() == 14
    assert A.build(twice, "IC", 2, dedup=False).edges.count() == 22


def test_experiment(spark, toy):
    from ripplework.operators import experiment as X

    seen = []
    long = X.run_experiment(toy, ["LFG", "Greedy", "max_degree", "GWDM", "MF-IMM", "OPIMC"], [2, 0, 2, -1], "MFIC", 2, worlds=20, theta=200, greedy_from_lfg=True, on_budget=lambda df: seen.append(df.count()))
    rows = {(r["size"], r.algorithm): r.influence for r in long.collect()}
    assert seen == [6, 6] and rows[(0, "LFG")] == 0.0 and rows[(2, "Greedy")] == rows[(2, "LFG")] >= 1
    assert X.wide(long).columns[0] == "size" and X.wide(long).count() == 2
    with pytest.raises(ValueError):
        X.algorithm_name("nothing")
    with pytest.raises(ValueError):
        src.load(spark, "nothing", "")


def test_imm_caps_the_last_sample_only(toy, monkeypatch):
    g = A.build(toy, "IC", 2)
    whole, capped = select.imm(g, 2), select.imm(g, 2, max_theta=5)
    assert capped.lower == whole.lower and capped.theta == 5 < whole.theta
    given = []
    monkeypatch.setattr(registry.select, "imm", lambda *a, **b: given.append(b) or whole)
    monkeypatch.setattr(registry, "users", lambda spark, d: toy)
    registry.imm_ic(toy.sparkSession, "")
    registry.imm_prefix(toy.sparkSession, "")
    assert len(given) == 2 and not any("max_theta" in b for b in given)


def test_imm_and_opimc_against_plain_sets(spark, toy):
    """The whole search with Python sets over the same samples."""
    g = A.build(toy, "IC", 2)

    def sets_of(seed, count):
        out = [set() for _ in range(count)]
        for r in rrsets.Sampler(g, seed).take(0, count).collect():
            out[r.rr_id].add(r.node)
        return out

    def greedy(sets, k):
        picks, left = [], list(sets)
        for _ in range(k):
            best = max((1, 2, 3, 4), key=lambda n: (n not in picks, sum(n in s for s in left), -n))
            picks.append(best)
            left = [s for s in left if best not in s]
        return picks, len(sets) - len(left)

    found = select.imm(g, 2, eps=0.6)
    plan = select.ImmBounds.of(4, 2, 0.6, 1.0)
    lower = None
    for guess in plan.guesses():
        n = plan.sets_for_guess(guess)
        lower = plan.accepted(4 * greedy(sets_of(44, n), 2)[1] / n, guess)
        if lower:
            break
    theta = plan.sets_to_select(lower or 1.0)
    assert (found.lower, found.theta) == (lower or 1.0, theta)
    picks, covered = greedy(sets_of(45, theta), 2)
    assert found.cover.seeds == picks and found.influence == pytest.approx(4 * covered / theta)

    found = select.opimc(g, 1, eps=0.3, delta=0.05)
    sets, most, rounds, a = select.opimc_plan(4, 1, 0.3, 0.05)
    for _ in range(rounds):
        one, two = sets_of(45, sets), sets_of(46, sets)
        picks, covered = greedy(one, 1)
        top = max(sum(n in s for s in one) for n in (1, 2, 3, 4))
        after = [s for s in one if picks[0] not in s]
        bound = min(top, covered + max(sum(n in s for s in after) for n in (1, 2, 3, 4)))
        ratio = select.opim_ratio(sum(picks[0] in s for s in two), bound, a)
        if ratio >= 1 - 1 / math.e - 0.3 or sets == most:
            break
        sets = min(2 * sets, most)
    assert (found.cover.seeds, found.sets, found.ratio) == (picks, sets, pytest.approx(ratio))


def test_all_factor_opim_validates_on_fresh_samples(spark, toy):
    g = A.build(toy, "IC2MIX", 2, p=0.7, ratio=0.6)
    r = select.opim(g, 2, 200)
    cover, _ = select.all_factor_greedy(g, 2, 100, seed=45)
    fresh = select.sample_rows(rrsets.Sampler(g, 46).uses(0, 1000))
    assert r.cover.picks == cover.picks and r.validation_sets == 1000
    assert r.influence == pytest.approx(4 * select.all_factor_covered(fresh, cover.seeds, 2) / 1000)
    rows = {x.k: x for x in select.opim_prefix(g, [0, 1, 2], 200)[1].collect()}
    assert rows[0].validation_influence == 0 and rows[2].validation_influence == pytest.approx(r.influence)
    assert select.opimc(g, 1, eps=0.5, delta=0.1, total=100).sets == 50


def test_all_factor_strategies_agree(spark, toy):
    g = A.build(toy, "IC2MIX", 3, p=0.8, ratio=0.7)
    s = ids(spark, 1, 2)
    one, two = ({(r.r, r.spread) for r in spread.all_factor_spread(g, s, 30, strategy=x).collect()} for x in ("local", "relational"))
    assert one == two
    one, two = (sorted(map(str, rrsets.Sampler(g, 5, x).uses(3, 40).collect())) for x in ("local", "relational"))
    assert one == two
    one, two = (baselines.gated_greedy(g, 2, 6, strategy=x).picks for x in ("local", "relational"))
    assert one == two


@pytest.mark.parametrize("bounds", [False, True])
def test_one_task_covers_like_the_rounds(spark, bounds):
    import random

    r = random.Random(4)
    rows = [(q, n, 1 + q % 3) for q in range(90) for n in r.sample(range(-5, 25), r.randint(1, 4))]
    rr = spark.createDataFrame(rows, "rr_id long, node long, weight long")
    nodes = ids(spark, *range(-5, 40))
    for sets in (rr, rr.drop("weight"), rr.limit(0)):
        for k in (1, 7, 45):
            one, many = (select.greedy_cover(sets, nodes, k, bounds, skip_zero=k < 45, one_task=n) for n in (10**6, -1))
            assert one == many
            if k == 1:
                break


def test_lazy_greedy_is_greedy_and_tries_less(spark):
    import random

    r = random.Random(1)
    sets = {n: set(r.sample(range(400), r.choice([5, 40, 41]))) for n in range(150)}
    gains = spark.createDataFrame([(n, float(len(s))) for n, s in sets.items()], "node long, gain double")

    def evaluate(chosen, some):
        have = set().union(*(sets[c] for c in chosen))
        return {n: len(sets[n] - have) for n in some}

    picks, tried = select.lazy_greedy(gains, 6, evaluate, batch=5)
    want, have = [], set()
    for _ in range(6):
        best = max((n for n in sets if n not in {x for x, _ in want}), key=lambda n: (len(sets[n] - have), -n))
        want.append((best, float(len(sets[best] - have))))
        have |= sets[best]
    assert picks == want and tried < 5 * 150


def test_reach_greedy_against_plain_walk(spark):
    import random

    r = random.Random(9)
    for _ in range(3):
        edges = {tuple(r.sample(range(14), 2)) for _ in range(16)} | {(0, 1), (1, 2), (2, 0)}
        e = spark.createDataFrame(sorted(edges), "src long, dst long")
        nodes = sorted({n for x in edges for n in x})

        def reach(n):
            seen, todo = {n}, [n]
            while todo:
                x = todo.pop()
                new = {b for a, b in edges if a == x} - seen
                seen |= new
                todo += new
            return seen

        have, want = set(), []
        for _ in range(3):
            best = max((n for n in nodes if n not in {x for x, _ in want}), key=lambda n: (len(reach(n) - have), -n))
            want.append((best, len(reach(best) - have)))
            have |= reach(best)
        assert baselines.reach_greedy(e, ids(spark, *nodes), 3).picks == want


def test_loops_that_do_not_settle_fail(spark, toy):
    start = spark.createDataFrame([(0, 1)], "r long, node long")
    with pytest.raises(RuntimeError):
        spread.closure(start, lambda f: f.selectExpr("r", "node + 1 AS node"), max_rounds=3)
    g = A.build(toy, "IC", 2)
    few = rrsets.stopping_rule(rrsets.Sampler(g), [4], first_batch=10, max_sets=25)
    assert not few.reached and few.sets == 25


@pytest.mark.parametrize("model", ["IC", "LT", "TRIGGER", "IC2MIX"])
@pytest.mark.parametrize("reverse", [False, True])
def test_packed_graph(spark, toy, model, reverse, monkeypatch):
    """Fetched in slices, a graph is the same and takes 8 bytes an edge beside nodes and weights."""
    prep = spread.prepared(A.build(toy, model, 3)).cache()
    whole = spread.pack(prep, model, reverse)
    assert whole.other.nbytes + whole.code.nbytes == 8 * prep.count()
    monkeypatch.setattr(spread, "SLICE", 7)
    cut = spread.pack(prep, model, reverse)
    for p in (whole, cut):
        ends = [(i, j) for i, lo, hi in zip(p.ids.tolist(), p.start[:-1], p.start[1:]) for j in p.ids[p.other[lo:hi]].tolist()]
        found = [(j, i) if reverse else (i, j) for i, j in ends]
        weight = [(x.real, x.imag) if model == "LT" else (float(x),) for x in p.weights[p.code]]
        cols = {"LT": ["a", "b"], "TRIGGER": ["a"]}.get(model, ["prob"])
        assert ends == sorted(ends)
        assert sorted((*e, *w) for e, w in zip(found, weight)) == sorted(tuple(r) for r in prep.select("src", "dst", *cols).collect())


def test_long_cascade_under_and(spark):
    """Greedy under the AND rule follows a cascade to its end, however many steps that takes."""
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    g = A.build(path, "IC2MIX", 3, ratio=0.0)
    assert baselines.world_greedy(g, 1, 1, strategy="local").picks == [(0, 31)]


def test_cascade_under_and_by_joins(spark):
    """The joins follow a cascade of gates and direct ties past the 12 rounds of the query's SQL."""
    path = spark.createDataFrame([(i, i + 1) for i in range(16)], "src long, dst long")
    g = A.build(path, "IC2MIX", 3, p=1.0, ratio=0.5)
    assert baselines.world_greedy(g, 1, 1, strategy="relational").picks == [(0, 17)]


def test_shares_are_fetched_from_one_pass(spark, toy, monkeypatch):
    """However many shares a graph has, its edges are read, sorted and encoded once, by tasks."""
    kept = []
    monkeypatch.setattr(spread, "stored", lambda df, name="step": kept.append(name) or df.cache())
    monkeypatch.setattr(spread, "SLICE", 5)
    prep = spread.prepared(A.build(toy, "IC", 3))
    assert spread.pack(prep, "IC", True).start[-1] == prep.count()
    assert kept == ["shares"]


def test_user_seq_pairs_ranges_without_a_join(spark, tmp_path):
    """Order by time, then event, over more ranges than rows in some; unknown users follow nobody."""
    r = random.Random(3)
    rows = [(i, r.randint(0, 20), None if i % 11 == 5 else r.randint(1, 6)) for i in range(60)]
    for some in (rows, rows[:3], rows[:1], []):
        path = tmp_path / str(len(some))
        spark.createDataFrame(some, "event_id long, ts long, user_id long").write.parquet(f"{path}/events.parquet")
        users = [u for _, _, u in sorted(some, key=lambda x: (x[1], x[0]))]
        found = src.user_seq(spark, str(path))
        assert sorted(map(tuple, found.collect())) == sorted({(a, b) for a, b in zip(users, users[1:]) if a is not None and b is not None and a != b})
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("model", ["IC", "LT", "TRIGGER"])
def test_lazy_greedy_keeps_no_reach_relation(spark, monkeypatch, model):
    """Cycles, and nodes without ties: the same seeds as greedy, by both strategies, from counts alone."""
    r = random.Random(7)
    ties = {tuple(r.sample(range(25), 2)) for _ in range(60)} | {(30, 31), (31, 32), (32, 30), (32, 33)}
    e = spark.createDataFrame(sorted(ties), "src long, dst long")
    g = A.build(e, model, 2, nodes=ids(spark, *range(36)))
    whole = baselines.world_greedy(g, 5, 3)
    assert baselines.world_greedy(g, 5, 3, strategy="relational", lazy=True).picks == whole.picks
    monkeypatch.setattr(baselines, "reach_relation", None)
    monkeypatch.setattr(spread, "SLICE", 9)
    assert baselines.world_greedy(g, 5, 3, lazy=True) == whole


def test_counts_of_a_forest(spark):
    """One pass over an LT world counts for each origin what walking from it reaches."""
    r = random.Random(2)
    ties = {tuple(r.sample(range(40), 2)) for _ in range(90)}
    g = A.build(spark.createDataFrame(sorted(ties), "src long, dst long"), "LT", 3)
    prep = spread.prepared(g).cache()
    origins = np.array(sorted({n for t in ties for n in t} | {99}))
    for world in range(4):
        by = [spread.Local(spread.pack(prep, "LT", back), "LT", 3, 43, back) for back in (False, True)]
        want = {s: by[0].reach(world, [s * 8]) for s in origins.tolist()}
        forest = spread.Forest(by[1], world)
        assert all(forest.reach([s * 8]) == x for s, x in want.items())
        assert dict(forest.counts(origins)) == {s: sum(not v & 7 for v in x) for s, x in want.items()}


def test_stored_user_edges_are_not_made_distinct_again(spark, toy):
    """A query's graph is read from its stored ties, once, and has one copy of its expanded edges."""
    for model in ("IC", "LT", "TRIGGER"):
        g = registry.built(registry.stored(toy, "edges"), model, 2)
        assert sorted(g.edges.collect()) == sorted(A.build(toy, model, 2).edges.collect())
        plan = spread.prepared(g)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [src" not in plan and ("aux_edges" in str(g.edges.inputFiles())) == (model == "TRIGGER")
        s = rrsets.Sampler(g)
        assert select.aux_nodes(s) == A.sizes(g)[0]


@pytest.mark.parametrize("gate", ["original", "factor_aware"])
@pytest.mark.parametrize("factors", [2, 5])
def test_large_lt_spread_needs_no_rounds(spark, monkeypatch, factors, gate):
    rng = random.Random(factors)
    ties = {(rng.randrange(70), rng.randrange(70)) for _ in range(160)} | {(u, 7) for u in range(60)}
    g = A.build(spark.createDataFrame([t for t in ties if t[0] != t[1]], "src long, dst long"), "LT", factors, parent_gate=gate)
    seeds = ids(spark, 1, 7, 20, 21, 22, 999)  # some below others, one unknown
    rows = lambda **how: sorted(map(tuple, spread.spread_by_world(g, seeds, 12, first=3, **how).collect()))
    want = rows(strategy="local")

    def refuse(*args, **kwargs):
        raise AssertionError("a loop of joins")

    monkeypatch.setattr(spread, "closure", refuse)
    monkeypatch.setattr(spread, "LOCAL_EDGES", 0)
    monkeypatch.setattr(spread, "SLICE", 28)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # nodes are cut between slices
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({x for _, x in want}) > 3


def test_lt_spread_without_ties(spark):
    g = A.build(spark.createDataFrame([], "src long, dst long"), "LT", 2, nodes=ids(spark, 1, 2))
    assert [r.spread for r in spread.spread_by_world(g, ids(spark, 1, 2, 3), 2).collect()] == [2, 2]
