"""Bucketed operators against brute force; one key holds most rows and buckets are tiny."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fraylens.operators import ordered as O
from fraylens.operators.intervals import locate, overlap_seconds, range_join

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        out.append((key, BASE + timedelta(seconds=rng.randrange(0, 600)), i, rng.choice([None, rng.randrange(50)])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("width", [7.0, 100000.0])
def test_carry_equals_plain_order(spark, seed, width):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, ts timestamp, i long, v long")
    got = {r.i: r for r in O.carry(
        df, ["k"], ["ts", "i"], O.time_bucket("ts", width), b=O.before(F.col("v")), u=O.upto(F.col("v")), a=O.after(F.col("v")),
        s=O.running_sum(F.coalesce("v", F.lit(0))), n=O.row_number()).collect()}
    assert len(got) == len(data)
    for key in {r[0] for r in data}:
        line = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        seen, total = None, 0
        for pos, r in enumerate(line):
            g = got[r[2]]
            assert g.b == seen
            seen = r[3] if r[3] is not None else seen
            total += r[3] or 0
            assert (g.u, g.s, g.n) == (seen, total, pos + 1)
            assert g.a == next((x[3] for x in line[pos + 1:] if x[3] is not None), None)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("gap", [0.0, 3.0])
def test_islands(spark, seed, gap):
    rng = random.Random(seed)
    data = [(k, BASE + timedelta(seconds=(s := rng.randrange(0, 900))), BASE + timedelta(seconds=s + rng.choice([0, 1, 2, 40])))
            for k in ["hot"] * 120 + ["x"] * 20]
    df = spark.createDataFrame(data, "k string, s timestamp, e timestamp")
    got = sorted((r.k, r.period_index, r.start_ts, r.end_ts, r.n) for r in O.islands(
        df, ["k"], "s", "e", gap, 10.0, {"n": F.lit(1).cast("long")}).collect())
    want = []
    for k in ("hot", "x"):
        merged = []
        for _, s, e in sorted(r for r in data if r[0] == k):
            if merged and (s - merged[-1][1]).total_seconds() <= gap:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([s, e, 1])
        want += [(k, i, s.replace(tzinfo=None), e.replace(tzinfo=None), n) for i, (s, e, n) in enumerate(merged)]
    assert got == want


def windows(spark):
    data = [("hot", 1, 0, 50), ("hot", 2, 60, 61), ("hot", 3, 100, 590), ("a", 4, 10, 300)]
    return spark.createDataFrame([(k, i, BASE + timedelta(seconds=s), BASE + timedelta(seconds=e)) for k, i, s, e in data],
                                 "k string, w long, start_ts timestamp, end_ts timestamp"), data


def test_range_join_and_locate_agree(spark):
    w, raw = windows(spark)
    data = rows(9)
    p = spark.createDataFrame(data, "k string, ts timestamp, i long, v long")
    want = {r[2]: next((x[1] for x in raw if x[0] == r[0] and x[2] <= (r[1] - BASE).total_seconds() <= x[3]), None) for r in data}
    found = {r.i: r.w for r in range_join(p, w, ["k"], "ts", slice_seconds=13.0, how="left").collect()}
    assert found == want
    assert {r.i: r.w for r in locate(p, w, ["k"], "ts", ["w"], bucket_seconds=13.0).collect()} == want


def test_overlap(spark):
    w, raw = windows(spark)
    left = spark.createDataFrame([("hot", 1, BASE + timedelta(seconds=40), BASE + timedelta(seconds=120)), ("a", 2, BASE, BASE)],
                                 "k string, d long, start_ts timestamp, end_ts timestamp")
    got = {r.d: r.overlap_seconds for r in overlap_seconds(left, w, ["k"], ["k", "d"], 7.0).collect()}
    assert got == {1: 10.0 + 1.0 + 20.0, 2: 0.0}


def test_halo_window(spark):
    data = rows(11)
    df = spark.createDataFrame(data, "k string, ts timestamp, i long, v long")
    got = {r.i: r.n for r in O.halo_window(df, ["k"], "ts", 10.0, 15.0, n=F.count(F.lit(1))).collect()}
    want = {r[2]: sum(1 for x in data if x[0] == r[0] and 0 <= (x[1] - r[1]).total_seconds() <= 10) for r in data}
    assert got == want


@pytest.mark.parametrize("name,most", [("j02_assign_encounter", 2), ("w08_unified_fights", 2)])
def test_carry_reads_its_input_once(spark, name, most):
    """Scans in the plan that ran: rows and summaries share an exchange, however often carries are nested."""
    from fraylens.plans import load_all
    from fraylens.plans.catalog import QUERIES

    load_all()
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan") <= most
