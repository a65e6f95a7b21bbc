"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma list.  Every query runs from the tables to its last row (no-op sink), after
one untimed start of the session on a small scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillpanel.plans.queries import QUERIES  # noqa: E402
from quillpanel.session import get_session  # noqa: E402
from quillpanel.sources.tables import customer_years  # noqa: E402

HEADLINE = [
    "topk_cumulative_share", "panel_profile", "row_loss_audit", "panel_pivot", "panel_outer_merge", "entity_missingness",
    "gap_fill", "gap_fill_blocks", "clean_panel", "describe_numeric", "corr_matrix", "class_mean_diff", "topk_per_sector",
    "pct_rank_avg", "potential_score", "endpoint_change", "quick_wins", "outcome_labels", "feature_matrix", "archetypes",
    "archetype_actions", "sector_split", "scenario_base", "scenario_grid", "scenario_entity_grid", "tornado_ranges",
    "scenario_by_bin", "ridge_two_feature", "ridge_cv", "shock_table", "counterfactual_distribution", "regression_metrics",
    "median_impute", "auc_rank", "roc_points", "flagship",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_session(
        "quillpanel-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    customer_years(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    result = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
