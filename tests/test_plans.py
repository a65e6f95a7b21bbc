"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import impute, ordered, rank, scenario, select, stats
from quillpanel.plans import queries as Q
from quillpanel.session import stage
from quillpanel.sources.tables import customer_panel, customer_years, nation_panel


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, pattern) -> int:
    return len(re.findall(pattern, plan(df)))


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return stage(customer_panel(spark, sf_dir))


LAZY = ["exclude_members_anti", "gap_fill", "outcome_labels", "archetypes", "column_null_pct", "corr_matrix", "sector_split", "shock_table"]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_rows_and_no_products(spark, sf_dir, name):
    text = plan(Q.QUERIES[name](spark, sf_dir))
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_panel_scan_reads_only_what_it_needs(spark, sf_dir):
    text = plan(nation_panel(spark, sf_dir).select("entity", "period", "base"))
    line = next(x for x in text.splitlines() if "lineitem.parquet" in x)
    read = re.search(r"ReadSchema: struct<([^>]*)", line).group(1)
    assert set(c.split(":")[0] for c in read.split(",")) == {"l_orderkey", "l_quantity"}


def test_line_items_are_combined_before_each_shuffle(spark, sf_dir):
    text = plan(customer_years(spark, sf_dir))
    for before, key in re.findall(r"(\S+)\(keys=\[(?:l_orderkey|o_custkey)[^\n]*\n[^\n]*Exchange hashpartitioning\((\w+)", text):
        assert before.endswith("HashAggregate") and key in ("l_orderkey", "o_custkey")


def test_period_filter_reaches_the_scan(panel):
    assert "PushedFilters: [IsNotNull(period), EqualTo(period,2000)]" in plan(Q.at_last_full(panel))


def test_gap_fill_is_one_shuffle_by_entity(panel):
    filled = impute.gap_fill(panel, "entity", "period", ["target", "base", "fossil_pct"])
    assert count(filled, r"Exchange ") == 1 and "Exchange hashpartitioning(entity" in plan(filled)


def test_outcomes_are_one_shuffle(panel):
    assert count(Q.outcome_frame(panel), r"Exchange ") == 1


def test_snapshot_maximum_is_a_scalar_subquery(panel):
    text = plan(select.snapshot(panel, "period"))
    assert "Subquery" in text and "Join" not in text


def test_sensitivity_neither_multiplies_nor_shuffles_rows(panel):
    rows = panel.select("entity", F.col("s_urgent"), "target", F.lit(100.0).alias("grid_intensity"), F.lit(0.02).alias("current_rate"))
    totals = scenario.scenario_totals(rows, scenario.scenario_rows(), Q.IMPACT)
    text = plan(totals)
    below = text[text.index("Exchange SinglePartition") :]
    assert "Generate" not in below and "partial_sum" in below and text.count("Exchange") == 1


def test_top_k_keeps_k_rows_per_task(panel):
    assert "TakeOrderedAndProject" in plan(rank.top_k(panel, "target", 5, "entity"))


def test_ranks_never_put_the_column_into_one_task(panel):
    """Only boundary lists, one row per group or range, meet in a single partition."""
    ranked = ordered.percent_rank_average(panel, {"target": True}, ["entity", "period"])
    ranked.collect()
    text = plan(ranked)
    for part in text.split("Exchange SinglePartition")[1:]:
        assert "collect_list" in part.split("Exchange")[0]
    for window in re.findall(r"Window \[(?:row_number|sum)[^\n]*", text):
        assert not window.rstrip().endswith("[]")


def test_all_pairs_of_the_matrix_come_from_one_scan(panel):
    assert count(stats.correlation_matrix(panel, Q.METRICS), r"FileScan") == 1


def test_value_counts_shuffle_is_shared(panel):
    quantile = ordered.quantiles(panel, "target", {"m": 0.5})
    quantile.collect()
    final = plan(quantile).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1 or final.count("FileScan") == 1


def test_ungrouped_ranks_stay_a_keyed_join(panel):
    text = plan(ordered.quantiles(panel, "target", {"m": 0.5}))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
