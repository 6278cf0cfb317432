"""Totals of windows of one length against brute force, and without a row per pair of point and window."""

import math
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fraylens.operators.intervals import span_totals

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_span_totals(spark):
    rng = random.Random(7)
    points = [(BASE + timedelta(milliseconds=rng.randrange(-4000, 60000, 250)), rng.choice([None, 1.5, 2.25, -3.0])) for _ in range(300)]
    points += [(None, 1.0), (BASE + timedelta(seconds=90), None), (BASE + timedelta(seconds=120), float("nan")), (BASE + timedelta(seconds=121), 1.0)]
    windows = [(i % 70, BASE + timedelta(milliseconds=rng.randrange(-9000, 70000, 250))) for i in range(90)]
    windows += [(None, BASE), (100, None), (101, BASE + timedelta(seconds=89)), (102, BASE + timedelta(seconds=121)), (103, BASE + timedelta(seconds=114))]
    got = {r.k: (r.events, r.total) for r in span_totals(
        spark.createDataFrame(points, "ts timestamp, v double"), spark.createDataFrame(windows, "k long, start_ts timestamp"), ["k"], "ts", "v", 7.0).collect()}
    want = {}
    for k, s in windows:
        for ts, v in points:
            if s is not None and ts is not None and s <= ts <= s + timedelta(seconds=7):
                n, total = want.get(k, (0, None))
                want[k] = (n + 1, total if v is None else (total or 0.0) + v)
    assert got.keys() == want.keys()
    assert want[101] == (1, None) and want[102] == (1, 1.0) and math.isnan(want[103][1])
    for k in want:
        same = got[k][1] == want[k][1] or math.isnan(got[k][1]) and math.isnan(want[k][1])
        assert got[k][0] == want[k][0] and same, k


def test_query_forms_no_pairs(spark, tmp_path):
    """20,000 windows that hold all of 20,000 events: 400 million pairs."""
    from fraylens.plans import load_all
    from fraylens.plans.catalog import QUERIES
    load_all()
    n = 20_000
    spark.range(n).select((F.col("id") * 720).alias("o_orderkey"), (F.col("id") * 24).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).select(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("id") % 7201).alias("ts"),
                          F.lit(0.25).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["j02_encounter_totals_by_range"](spark, str(tmp_path))
    assert "__way" in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.agg(F.count("*").alias("rows"), F.min("events").alias("least"), F.max("events").alias("most"), F.min("total").alias("low"), F.max("total").alias("high")).first()
    assert tuple(r) == (n, n, n, n / 4, n / 4)
