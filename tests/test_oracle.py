"""Queries against their SQL. ASOFLOOM_ALL=1 takes every one."""

import os

import pytest

from asofloom.queries import QUERIES, SQL

from .conftest import SF, rows_of

CHOSEN = """
spine_customer_orders spine_exclusive_boundary spine_depth_3 join_direct join_named_parallel join_diamond join_asof join_asof_grace one_hot graph_degree graph_reciprocity
graph_k_hop_2 graph_clustering graph_jaccard peers_timed spatial_suppliers_near spatial_same_entity neighbours_undirected impute manifest
agg_skewness agg_mode agg_nunique agg_gap_cv agg_entropy agg_gini agg_ngram_3_freq agg_markov_conditional_entropy agg_longest_streak agg_trimmed_mean_10 agg_time_in_current_state
agg_recurrence_interval agg_acf_1 agg_cosinor_amplitude_weekly agg_kl_drift agg_wasserstein_drift agg_cross_type_latency agg_distance_travelled
xf_cumprod xf_rolling_iqr_7 xf_ema_7 xf_holt_winters_trend_7 xf_cross_entity_percentile xf_cross_entity_zscore xf_cusum xf_unique_word_ratio xf_week_of_year xf_cyclic_day xf_in_array bin_mod
bridge_markov_surprisal bridge_change_point bridge_periodicity bridge_embedding_trajectory bridge_readability bridge_language_id bridge_co_mention_edges
""".split()


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("ASOFLOOM_ALL") else CHOSEN)
def test_matches_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of(duck.sql(SQL[name]))


def test_every_primitive_has_a_query():
    from asofloom.functions.registry import AGGREGATIONS, TRANSFORMATIONS

    assert len(AGGREGATIONS.names()) == 67 and len(TRANSFORMATIONS.names()) == 83
    assert {f"agg_{n}" for n in AGGREGATIONS.names()} | {f"xf_{n}" for n in TRANSFORMATIONS.names()} <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 450
    assert set(e.oracle_sql()) <= set(e.queries())
