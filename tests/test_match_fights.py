"""Nearest encounters against brute force, and without a row per pair of fight and encounter."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fraylens.operators.segments import match_fights

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_match_fights(spark):
    rng = random.Random(11)
    some = lambda n: [(rng.choice([0, 0, 0, 1, None]), i, BASE + timedelta(seconds=rng.randrange(0, 900, 5))) for i in range(n)]
    fights = some(60) + [(0, 3, BASE), (0, None, BASE + timedelta(seconds=40)), (0, 500, None), (2, 501, BASE)]
    enc = some(40) + [(0, 99, None), (0, None, BASE + timedelta(seconds=300)), (2, 900, BASE + timedelta(seconds=31)), (0, 7, BASE), (0, 5, BASE)]
    kind = "boss long, {} long, start_ts timestamp"
    got = {r.fight_id: (r.offset_us, r.encounter_id) for r in match_fights(
        spark.createDataFrame(fights, kind.format("fight_id")), spark.createDataFrame(enc, kind.format("encounter_id")), "boss", 30.0).collect()}
    want = {}
    for boss, fight, at in fights:
        for other, i, start in enc:
            if boss is not None and boss == other and at is not None and start is not None and abs(at - start) <= timedelta(seconds=30):
                offer = (abs(at - start) // timedelta(microseconds=1), -1 if i is None else i)
                want[fight] = min(want.get(fight, offer), offer)
    assert 501 not in got and len(want) > 30
    assert {k: (o, -1 if i is None else i) for k, (o, i) in got.items()} == want


def test_no_pairs_are_formed(spark):
    """20,000 fights near 20,000 encounters of one id: 400 million pairs."""
    n = 20_000
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / n)
    fights = spark.range(n).select(F.lit(1).alias("boss"), F.col("id").alias("fight_id"), at.alias("start_ts"))
    enc = spark.range(n).select(F.lit(1).alias("boss"), F.col("id").alias("encounter_id"), at.alias("start_ts"))
    found = match_fights(fights, enc, "boss", 60.0)
    assert "__next" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("fight_id = encounter_id AND offset_us = 0").count() == n
