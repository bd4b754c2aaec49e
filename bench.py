"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query is fully computed with the ``noop`` sink (no driver collect) and
timed; one warm-up query runs first so JVM start-up is not charged to any
query.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans.pipeline import run_pipeline  # noqa: E402
from vigil.plans.queries import QUERIES, RULE_PARAMS, STREAM_STATS, _model  # noqa: E402
from vigil.session import build_session  # noqa: E402
from vigil.sources.tables import load_events  # noqa: E402

HEADLINE = [
    "time_features", "rolling_user_features", "rolling_hot_user", "rolling_dense_user", "window_summary_1m", "window_summary_1h",
    "window_metrics", "top_locations", "count_windows", "metrics_rollup",
    "alert_events", "alert_payloads", "alert_digest", "quarantine", "idempotent_insert",
    "latest_per_user", "recent_events", "insights", "ml_features", "auc",
    "fraud_scores", "stream_tumbling", "stream_rolling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="vigil-bench-")
    os.environ.setdefault("VIGIL_SCRATCH", scratch)
    spark = build_session(f"local[{cpus}]", app="vigil-bench", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    n_events = load_events(spark, sf_dir).count()  # warm-up
    QUERIES["window_summary_1h"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # report and keep measuring the rest
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    from vigil.operators.alerts import default_rules
    t0 = time.perf_counter()
    try:
        model = _model(spark, sf_dir)  # fitted by fraud_scores above; the job scores every event with it
        t0 = time.perf_counter()
        counters = run_pipeline(spark, load_events(spark, sf_dir), f"{scratch}/pipeline", model=model,
                                window_minutes=60, failed_type="error",
                                rules=default_rules(**RULE_PARAMS),
                                validate_kw={"event_types": ["click", "error", "purchase", "signup", "view"]})
        counters.collect()
        times["pipeline_e2e"] = round(time.perf_counter() - t0, 3)
    except Exception as exc:
        errors["pipeline_e2e"] = f"{type(exc).__name__}: {str(exc)[:200]}"

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "events": n_events,
        "pipeline_events_per_sec": round(n_events / times["pipeline_e2e"], 1) if "pipeline_e2e" in times else None,
        "stream_batches": {k: {"batches": v["batches"], "avg_batch_ms": v["avg_batch_ms"],
                               "max_batch_ms": v["max_batch_ms"]} for k, v in STREAM_STATS.items()},
        "cpus": int(cpus),
        "errors": errors,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
