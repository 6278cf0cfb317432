"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from fraylens import session
from fraylens.plans import load_all
from fraylens.plans.catalog import QUERIES, Tables
from fraylens.plans.logs import log_lines
from fraylens.sources import log

HEADLINE = [
    "a03_character_metrics", "w01_combat_periods", "j02_assign_encounter", "w06_death_recap", "w08_unified_fights", "w10_activity_bursts",
    "w17_activity", "j01_resolve_owner", "a04_damage_abilities", "a06_encounter_metrics", "j04_metrics_characters_encounters",
    "a18_class_balance", "a20_spell_usage", "a23_attendance", "a27_custom_aggregation", "a28_percentiles", "w12_rankings", "t02_top_performers",
    "t09_build_timeline", "q01_text_search", "q06_popular_terms", "s05_project_events", "s09_gear_snapshots", "s14_dedupe_files", "s16_export_encounter",
]
COPIES = 20


#: Warm runs of each query, as long as the whole benchmark has taken less than this many seconds.
WARM, WARM_UNTIL = 3, 300


def run(make) -> float:
    """Seconds for building the query, including whatever it writes on the way, and for computing all its rows."""
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    began = time.perf_counter()
    run(lambda: QUERIES["a01_combatant_metrics"](spark, folder))
    wanted = os.environ.get("BENCH_QUERIES")
    times = {}  # seconds per query
    for name in wanted.split(",") if wanted else HEADLINE:
        times[name] = round(run(lambda: QUERIES[name](spark, folder)), 3)
    rate = None
    if not wanted:
        # raw text to typed events: the log is written once, then read and parsed from files
        path = session.work_folder(spark, "bench-log")
        lines = log_lines(Tables(spark, folder)).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        lines.repartition(int(cpus) * 2).select("line").write.text(path)
        times["parse_log_files"] = round(run(lambda: log.project_events(log.tokenize(log.read_log(spark, path)))), 3)
        size = spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes")).first()
        rate = round(size["lines"] / times["parse_log_files"])
        speed = round(size["bytes"] / 1e6 / times["parse_log_files"], 1)
    warm = {}  # median of the runs after the first
    for name in [n for n in times if n in QUERIES]:
        again = []
        while len(again) < WARM and time.perf_counter() - began < WARM_UNTIL:
            again.append(run(lambda: QUERIES[name](spark, folder)))
        if again:
            warm[name] = round(statistics.median(again), 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}
    if rate:
        out |= {"parsed_events_per_sec": rate, "parsed_mb_per_sec": speed}
    if warm:
        out["warm_queries"] = warm
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
