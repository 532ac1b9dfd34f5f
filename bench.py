"""Wall seconds of the headline queries.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) select the data and
the local parallelism.  Every query is run once to warm the JVM and then timed on a full
materialisation of its result without collecting it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    # composite jobs
    "p1_station_clean", "p2_station_grids", "p4_network_clean", "p5_network_grids", "p6_geostationary_series", "p8_model_series",
    "p9_forecast_series", "p11_weather_series", "p15_polar_series", "p16_training_inputs", "p18_forecast_report",
    # single operators, one or two per family
    "f6_min_uptime_rows", "f22_trim_outliers", "j1_hour_scaffold", "j8_nearest_reindex", "g4_same_cell_mean", "g6_idw", "g14_point_cloud_to_grid",
    "g17_resize_half_pixel", "g20_gaussian_half", "g22_semivariogram", "g23_residual_kriging", "t4_hourly_mean_labelled_by_end", "t9_dead_hour_fill",
    "t12_carry_frames", "t18_smooth_hold_empty", "t20_nowcast", "t22_hourly_climatology", "a4_describe_per_sensor", "a10_box_statistics", "s1_sliding_windows",
    "s10_standard_scaling", "x12_variant_union", "m8_sensor_hour_table", "m10_persistence_baseline", "m12_extreme_weeks", "st1_tumbling_hour_mean",
)


def main() -> None:
    from hourgrid.session import build_session
    from hourgrid.workload import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = build_session(f"local[{cpus}]", "hourgrid-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    out = {"metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
