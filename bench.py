"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "c_01_classify_paths", "c_04_worst_input", "c_07_manifest_diff", "c_09_disclosure",
    "t_01_label_join", "t_03_effects", "t_04_rollup", "t_06_running_state", "p_02_decision",
    "p_06_replay", "k_01_risk_score", "k_04_frequency_guard", "l_02_verify", "l_04_append",
    "v_02_tier_a", "r_01_reconcile", "r_03_alert_classes", "e_07_claim_status",
    "q_02_regime_rollup", "q_05_answers", "x_02_prov_relations", "x_04_spans", "m_01_call_sites",
    "st_05_frequency_guard",
)


def main() -> None:
    from provlake.plans.catalog import QUERIES
    from provlake.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-shared-"),
        "spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/events.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total wall time of the headline queries",
                      "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
