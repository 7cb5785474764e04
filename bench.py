"""Times the headline queries; prints one JSON line. Each result is computed in full (a noop write)."""

from __future__ import annotations

import json
import os
import time

from tessella.plans import catalog
from tessella.session import get_session

HEADLINE = [
    "feature_panel", "monthly_ic", "incremental_ic", "quantile_ls", "ic_decay", "asof_lagged", "first_filed", "pit_membership",
    "risk_features", "high_volume_event", "freq_z_monthly", "sue", "cluster_onset", "calendar_time_book", "ew_book", "ls_book",
    "crypto_ls", "customer_momentum", "neighbor_signal", "tfidf_cosine", "edit_ratio", "tick_bins", "interval_identity", "member_day_coverage",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["monthly_ic"](spark, d).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        t = time.time()
        found[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
