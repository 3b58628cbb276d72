"""The engine's queries against DuckDB, and the entry module's contract."""

import pytest

import __spark_entry__ as entry
from ripplework.plans import registry

from .oracle_util import check

#: One of each kind; the driver runs all of them.
SOME = [
    "edges_user_seq", "edge_list_parse", "edges_undirected", "id_remap", "weights_wc", "weights_tr", "in_degree", "out_degree",
    "only_factor_parents", "factor_metadata", "top_degree_reach", "aux_ic_3", "aux_lt_5", "aux_trigger_2", "aux_olo_5", "aux_ic2mix_3",
    "aux_lt_gate_3", "node_prob_olo_3", "world_ic_2", "world_lt_2", "world_trigger_2", "world_ic2mix_3", "spread_ic_2", "spread_lt_3",
    "spread_olo_2", "spread_ic2_3", "rr_ic_2", "rr_lt_2", "cover_estimate", "candidate_pool", "max_cover_ic_2", "max_cover_prefix",
    "cover_upper_bound", "reach_greedy", "world_greedy_lt_2", "social_selected", "social_edges", "social_nodes", "social_sigma_scores",
    "social_spread_ic", "graph_saved", "graph_text", "children_of", "spread_all_factor_3", "stateful_samples_3", "opim_ic_2", "opim_prefix_lt_2",
    "world_greedy_all_factor_3", "social_pi_scores", "social_sigma_seeds", "social_ris_seeds", "social_celf_seeds", "social_celfpp_seeds", "social_spread_lt",
    "experiment_wide", "lazy_greedy_ic_2", "rr_trigger_2",
]


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, sf, name):
    check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["r", "spread"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["imm_ic_2", "opimc_ic_2", "opimc_prefix_ic_3", "imm_prefix_trigger_2", "stopping_rule_ic_2", "all_factor_greedy_3", "opim_all_factor_3"])
def test_rows_only(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
