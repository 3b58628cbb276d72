"""Social factor graphs on hand-made tables."""

import pytest

from ripplework.operators import social


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([("a", 5, ["x"]), ("b", 200_000, ["x", "y"]), ("c", 1, ["z"]), ("d", 2, None)], "user_id string, user_followers long, user_interests array<string>")
    inter = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "ghost"), ("c", "a"), ("d", "a")], "user_id string, interact_id string")
    vertices = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "user_id string, vertex long")
    seeds = spark.createDataFrame([("a",), ("c",)], "user_id string")
    return users, inter, vertices, seeds


def test_graph(spark, tables):
    users, inter, vertices, seeds = tables
    sel = social.selected_interactions(users, inter, seeds)
    assert sorted(map(tuple, sel.collect())) == [("a", "b"), ("a", "c"), ("c", "a")]
    g = social.factor_graph(users, sel, vertices)
    edges = {(r.src, r.dst) for r in g.edges.collect()}
    # interaction: a -> b, a -> c, c -> a; interest: a and b share x, both ways
    assert edges == {(8, 17), (17, 16), (8, 25), (25, 24), (24, 9), (9, 8), (8, 18), (18, 16), (16, 10), (10, 8)}
    nodes = {r.node: r for r in g.nodes.collect()}
    assert nodes[17].factor_type == "interaction" and nodes[17].sources == [1] and nodes[10].sources == [2]
    assert nodes[8].node_type == "user" and 32 not in nodes


def test_selectors(spark, tables):
    users, inter, vertices, seeds = tables
    g = social.factor_graph(users, social.selected_interactions(users, inter, seeds), vertices)
    assert [v for v, _ in social.degree_seeds(g, 2)] == [1, 2]
    assert social.pi_seeds(g, 1) == [(1, 3.0)]
    assert social.sigma_seeds(g, 1)[0][0] == 1
    assert len(social.eigen_seeds(g, 1, rounds=6)) == 1
    assert len({v for v, _ in social.ris_seeds(g, 3, 20)}) == 3
    assert social.greedy_seeds(g, 1)[0][0] == social.celf_seeds(g, 1)[0][0] == 1
    spread = {r.candidate: r.spread for r in social.user_spread(g, [[1], [3], [99]], 3).collect()}
    assert spread == {0: 3.0, 1: 3.0, 2: 0.0}
    assert social.user_spread(g, [[1]], 3, "LT").first().spread == 3.0
    with pytest.raises(ValueError):
        social.user_spread(g, [[1]], 1, "SI")
