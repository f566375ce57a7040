"""Registered queries against their SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = [
    "graph_edges_flow", "sssp_flow", "sssp_flow_relational", "p2p_distance", "bidirectional_meet", "sssp_tree_parent", "subtree_sizes", "increase_repair",
    "decrease_repair", "update_classification", "trace_sha256", "trace_validation_errors", "trace_replay_answers", "oracle_mismatches", "engine_profiles",
    "engine_counters", "telemetry_reconciles", "policy_clocks", "lru_hits_misses", "cooldown_blocks", "byte_accounting", "resident_score", "budget_eviction_plan",
    "reuse_gap_stream", "latency_nearest_rank", "percentile_rounded_index", "metric_summary", "campaign_medians", "stage_ratios", "material_counts", "valid_run_rows",
    "repeated_traces", "geomean_ci", "fastest_profile", "next_filled_cell", "zipf_inverse", "update_schedule", "workload_counts", "generated_logs", "eligible_edge",
    "tree_edge_regimes", "grid_generator", "graph_generators", "log_round_trip", "answers_round_trip", "graph_round_trip", "legacy_round_trip",
    "measurements_round_trip", "file_sums", "sql_functions", "value_functions", "accounted_bytes",
    "zero_weight_tree_parent", "zero_weight_subtree_sizes", "tree_edge_affected_sets", "sssp_supply_delta", "batch_repair", "batch_repair_parents",
    "asof_out_weights", "trace_replay_intervals", "stack_distances", "hits_by_capacity", "eviction_by_bytes", "streamed_counters", "preflight_budget",
    "byte_accounting_records", "probation_by_work", "strict_numbers", "cache_counters_reconcile",
]


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def test_queries_without_sql():
    """Heap counters, costs by work units, and a stream whose answers another test holds against the batch's."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"kernel_work_counters", "engine_counters_adaptive", "streaming_trace_replay"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_answers_equal_the_batch(spark):
    got = sorted(map(tuple, catalog.QUERIES["streaming_trace_replay"](spark, SF).collect()))
    assert got == sorted((r.op_seq, r.answer) for r in catalog.QUERIES["trace_replay_answers"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_arcs_of_the_supply_graph_are_not_numbered(spark):
    from pathloom.sources import views

    arcs = views.supply_arcs(spark, "/root/testdata/sf0.001")
    assert "Window" not in arcs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, arcs.collect())) == sorted(map(tuple, views.supply(spark, "/root/testdata/sf0.001").select("src", "dst", "weight").collect()))
