"""Benchmark the headline queries: V22, R1, W1, A30, M20, M22, V23.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1). Each query is
run once to warm up, then timed $BENCH_REPEATS times (default 2) and the best time is kept,
because wall times on a shared machine vary by tens of percent between runs. A query is
executed to completion with the ``noop`` sink (every row computed, nothing collected).
Spark's event log is written to a fresh scratch folder and the shuffle bytes written by the last
timed run of each query are reported too (``shuffle_mb``). Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vistaspark.plans.catalog import REGISTRY  # noqa: E402
from vistaspark.session import build_session  # noqa: E402

HEADLINE = {
    "v22": "v22_open_attention_report",
    "r1": "r1_relapse_risk",
    "w1": "w1_sigma_outliers",
    "a30": "a30_iqr_summary",
    "m20": "m20_patient_features",
    "m22": "m22_kmeans_sweep",
    "v23": "v23_dashboard",
}


def run(spark, key: str, sf_dir: str, tag: str = "warmup") -> float:
    spark.sparkContext.setJobDescription(tag)
    t0 = time.perf_counter()
    df = REGISTRY[key](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def shuffle_mb(log_dir: str) -> dict[str, float]:
    """Shuffle bytes written per job description, from the event log (MB)."""
    stage_tag: dict[int, str] = {}
    out: dict[str, float] = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path, errors="replace") as f:
            for line in f:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    tag = (ev.get("Properties") or {}).get("spark.job.description", "")
                    for sid in ev.get("Stage IDs", []):
                        stage_tag[sid] = tag
                elif kind == "SparkListenerTaskEnd":
                    tag = stage_tag.get(ev.get("Stage ID"), "")
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    out[tag] = out.get(tag, 0.0) + m.get("Shuffle Bytes Written", 0) / 1e6
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_dir = tempfile.mkdtemp(prefix="vistaspark-eventlog-", dir="/tmp")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "vistaspark-bench",
                          {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                           "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    times = {}
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    for name, key in HEADLINE.items():
        if only and name not in only:
            continue
        run(spark, key, sf_dir)  # warm-up
        times[name] = round(min(run(spark, key, sf_dir, f"bench:{name}:{i}") for i in range(repeats)), 3)
    spark.stop()
    try:
        mb = shuffle_mb(log_dir)
        shuffle = {name: round(mb.get(f"bench:{name}:{repeats - 1}", 0.0), 3) for name in times}
    except Exception:  # noqa: BLE001 - the measurement is optional
        shuffle = {}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "repeats": repeats,
        "shuffle_mb": shuffle,
    }))


if __name__ == "__main__":
    main()
