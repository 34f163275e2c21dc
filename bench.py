"""Time the headline queries on local cores and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from profilar.plans.catalogue import QUERIES  # noqa: E402
from profilar.session import build_session  # noqa: E402

HEADLINE = [
    "profile_preparation", "share_of_sample", "by_product_report", "area_share_report", "share_across_samples",
    "hellinger_profiles", "long_to_wide_zero", "annotated_spectrum", "control_baseline", "cell_statistics",
    "outer_label_merge", "time_alignment", "box_statistics", "running_total", "running_total_lines",
    "equal_frequency_bins", "sequence_over_table", "effect_table", "gram_entries", "partial_inertia",
    "ordination_by_site", "row_scores", "permutation_overall", "vector_fit", "anchor_distance_bray",
    "principal_coordinates", "ordination_stress", "site_random_effects", "candidate_models", "quadratic_nested",
    "linear_model", "mixed_model", "additive_model", "regression_tree", "box_cox_profile", "line_per_group",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["grouped_sum"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and readers
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
