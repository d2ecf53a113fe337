"""Time the headline queries once each and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_MODELS (1: also the queries
that fit full stacked models, many minutes each).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pavilion.session import local_session
from pavilion.workload import QUERIES

HEADLINE = [
    "scorecard_top_bowlers", "scorecard_matches", "scorecard_deliveries",
    "batting_feature_rows", "bowling_feature_rows", "innings_phase_totals", "ball_running_totals",
    "head_to_head", "venue_win_rate", "team_form", "season_position", "match_feature_table",
    "pre_match_team_strength", "top_batters", "economy_by_phase", "partnership_summary",
    "pressure_grid", "scoring_zones", "score_distribution", "correlation_matrix",
    "par_scores", "venue_batting_stats", "roc_curve", "fixture_inputs",
    "prepared_inputs", "out_of_fold_cover", "stacking_meta", "model_importances",
]
MODELS = ["winner_model", "score_model", "fixture_predictions", "score_cross_validation"]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the clock
    took = {}
    for name in names or HEADLINE + MODELS * (os.environ.get("BENCH_MODELS") == "1"):
        start = time.time()
        # Every row and column is produced and dropped: no pruning, no collect.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
