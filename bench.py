"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores. Every result is computed in full through the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from canopyframe.queries import QUERIES  # noqa: E402
from canopyframe.session import with_recommended_conf  # noqa: E402

HEADLINE = [
    "j3_size_abundance", "a1_weighted_mean", "j6_analysis_table", "o2_f11_sample_tree_visits",
    "w5_o1_plot_numbers", "m1_pareto_fit_all_visits", "m3_two_part_fit_fine_grid",
    "m6_two_part_thinned_slopes", "a9_w6_draw_summaries", "g1_connected_components",
    "x3_tree_identity", "j17_event_trees", "a11_residual_quartiles", "a14_kernel_density_full_grid",
    "m9_cross_products", "m9_disturbance_type_model", "m10_time_since_model",
    "m7_measured_slopes",      # 12,000 draws of every plot
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = with_recommended_conf(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["j1_plots_with_conditions"].run(spark, sf_dir).write.format("noop").mode(
        "overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
