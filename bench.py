"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from gridwake.queries import QUERIES  # noqa: E402
from gridwake.session import build_session  # noqa: E402

HEADLINE = (
    "d4_resample_linear", "c7_interval_label", "e1_window_descriptors", "minimum_slice", "e2_fit_scaler", "f1_split_chrono",
    "g1_average_precision", "g6_event_f1_log_aware", "g8_class_metrics", "h1_quantile_higher", "h10_sustained_gate_events",
    "h12_predict_paired", "h17_predict_channels", "i2_rollup", "c15_propagate", "j10_extract_edges", "l3_macro_f1_bootstrap",
    "l4_ap_bootstrap", "a10_seal", "h20_reassess", "l6_pooled_ci", "l7_two_way_bootstrap", "m1_stream_gate",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["h1_quantile_higher"](spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = Path(path).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
