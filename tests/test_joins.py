import pytest

from trailweave.operators import matching
from trailweave.plans import catalogue, derived

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_graph_is_built_without_broadcasts(spark):
    g = catalogue._graph(spark, SMALL)
    assert "BroadcastExchange" not in plan(g.edges) + plan(g.nodes)


@pytest.mark.parametrize(
    "name",
    """agg_02_control_counts agg_04_surface_stats agg_20_coverage agg_24_percentile agg_07_speed_fusion agg_10_boolean_fusion agg_06_surface_fusion
    agg_11_numeric_fusion agg_08_point_fusion gra_17_enriched_edges agg_15_way_rollup agg_17_name_share agg_18_homogeneity agg_22_corridor_shares
    agg_23_connector_report agg_27_network_stats join_20_location_filter""".split(),
)
def test_no_table_of_edges_is_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(catalogue.queries()[name](spark, SMALL))


def test_observed_ways_and_cells_are_not_broadcast(spark):
    e = catalogue._graph(spark, SMALL).edges
    assert "BroadcastHashJoin" not in plan(matching.nearest_edges(catalogue._spots(spark, SMALL), e, 43.0))
    o = derived.observations(spark, SMALL).withColumnRenamed("seq", "obs_id")
    assert "BroadcastHashJoin" not in plan(matching.way_edges(o, e))
