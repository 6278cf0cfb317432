"""Exact percentiles and ranks; one value is shared by a third of the rows."""

import random

import numpy as np
import pytest

from fraylens.operators import analytics, distribution


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [("g" if i % 3 else "h", 0.0 if i % 3 == 1 else rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(0, 6)) for i in range(900)]


def test_percentiles(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in distribution.percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for g in "gh":
        values = [v for k, v in data if k == g]
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert got[g][f"v_p{round(p * 100)}"] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-12)


def test_rank(spark, data):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v double, i long")
    for r in distribution.with_rank(df, ["g"], "v", "rank", "pct").collect():
        same = [v for k, v in data if k == r.g]
        assert r["rank"] == 1 + sum(v > r.v for v in same)
        assert r.pct == pytest.approx(100 * sum(v < r.v for v in same) / (len(same) - 1))


def test_bad_arguments(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    with pytest.raises(ValueError):
        analytics.custom_aggregation(df, ["nope"], ["g"])
    with pytest.raises(ValueError):
        analytics.composite(df, {"v": 0.5}, "v")


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r.g: r for r in analytics.custom_aggregation(df, ["v"], ["g"], ["avg"], [0.5]).collect()}
    assert (got[None].v_avg, got[None].v_p50, got["a"].v_p50) == (2.0, 2.0, 5.0)
    ranks = sorted((r.v, r["rank"]) for r in distribution.with_rank(df, ["g"], "v", "rank").collect())
    assert ranks == [(1.0, 2), (3.0, 1), (5.0, 1)]


def test_ranks_of_all_scopes(spark):
    """Ties, a hot group, null groups and values, microsecond stamps; the input is read twice, not once per scope."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["a"] * 6 + ["b", None]), rng.choice([1, 2, None]), rng.choice([None, 1.7e15 + rng.randrange(300), 0.25])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").repartition(3)
    scopes = {"all": [], "g": ["g"], "gh": ["g", "h"]}
    got = {r.id: r for r in distribution.with_ranks(df, scopes, "v").collect()}
    assert len(got) == 600
    for i, g, h, v in rows:
        for name, same in (("all", rows), ("g", [r for r in rows if r[1] == g]), ("gh", [r for r in rows if r[1:3] == (g, h)])):
            values = [r[3] for r in same if r[3] is not None]
            rank, percentile = got[i][f"{name}_rank"], got[i][f"{name}_percentile"]
            if v is None:
                assert rank is None and percentile is None
            else:
                assert rank == 1 + sum(x > v for x in values)
                assert percentile == pytest.approx(100.0 * sum(x < v for x in values) / (len(values) - 1) if len(values) > 1 else 100.0)
