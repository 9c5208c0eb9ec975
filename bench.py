"""Times the headline queries on local cores and prints one JSON line."""

import json
import os
import time

from ledgerloom import plans
from ledgerloom.session import session

HEADLINES = ["scr_relative_strength", "ta_compute_windows", "ta_ema_rsi_macd", "best_source_bar", "pit_statement_source", "series_asof", "adj_closes", "pf_consolidate", "mf_overlap", "rk_beta", "scr_screen", "sc_cohort_scores", "led_score_call", "card_build", "al_hygiene", "ta_compute", "st_classify_setup", "mf_rolling_windows", "rk_volatility", "fs_screen", "fd_diagnose", "sc_score_universe", "cr_committee", "cal_bootstrap", "st_quarterise", "fa_general_metrics", "val_history", "mx_metric_values", "led_survivors"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # the start of Spark isn't timed
    plans.QUERIES["st_quarterise"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
