"""Times the headline queries and prints one JSON line.

The first entries time the stage tables (the build of the reference); the questions after them
read those tables, as the reference's service reads its marts. Every question is timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from geodemand.session import build_session  # noqa: E402

HEADLINE = [
    "drill_region_nation", "drill_nation_block", "level_rollup_reconciled", "sku_rank_in_node", "place_rank_scoped", "season_scaled_drill",
    "factor_index", "propensity_scores", "driver_waterfall", "exec_kpis", "finder_range_filter", "insight_ranks", "headline",
    "nearest_facility", "knn_spatial_lag", "point_in_polygon", "spatial_majority", "uplift_attribution", "panel_betas", "panel_backtest",
    "choice_shares", "contest_grading", "market_summary", "internal_displacement", "scenario_reweight", "scenario_shock", "scenario_rival_move",
    "kmeans_segments", "segment_cards", "product_mentions", "bounded_history",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from geodemand.plans import QUERIES
    from geodemand.plans import insight as IN
    from geodemand.plans import levels as LV
    from geodemand.plans import market as MK
    from geodemand.plans import place_role as PR
    from geodemand.plans import scoring as SC
    from geodemand.plans.panel_plan import fits
    from geodemand.plans.panel_role import panel
    from geodemand.sources import roles

    stages = {
        "build_fact": roles.fact, "build_items": LV.items, "build_nodes": LV.nodes, "build_panel": panel, "build_features": PR.features, "build_peers": PR.peers, "build_fits": fits,
        "build_factors": SC.factors, "build_scores": SC.scores, "build_insights": IN.insights, "build_contests": MK.contests,
    }
    times: dict[str, float] = {}

    def clock(name, run):
        t = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t, 3)

    for name, build in stages.items():
        clock(name, lambda: build(spark, sf))
    for name in HEADLINE:
        clock(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    build = round(sum(v for k, v in times.items() if k.startswith("build_")), 3)
    print(json.dumps({
        "metric": "full build plus headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "build_sec": build,
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), "scored_rows": SC.scores(spark, sf).count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
