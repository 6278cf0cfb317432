"""Combat period rules."""

from datetime import datetime, timedelta

import pytest

from fraylens.operators import ordered, sequence as S

T0 = datetime(2024, 1, 1, 20, 0, 0)


def events(spark, seconds, kind="SPELL_DAMAGE"):
    data = [(1, T0 + timedelta(seconds=s), kind if isinstance(kind, str) else kind[i]) for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, "k int, ts timestamp, event_type string")


def periods(spark, seconds, gap=5.0, kind="SPELL_DAMAGE"):
    out = S.combat_periods(events(spark, seconds, kind), ["k"], gap, 3.0).orderBy("period_index").collect()
    return [((r.start_ts - T0).total_seconds(), (r.end_ts - T0).total_seconds(), r.event_count) for r in out]


@pytest.mark.parametrize("seconds, gap, want", [
    ([], 5.0, []),
    ([3], 5.0, [(3, 3, 1)]),
    ([0, 2, 4, 6, 8], 5.0, [(0, 8, 5)]),
    ([0, 2, 12, 14], 5.0, [(0, 2, 2), (12, 14, 2)]),
    ([0, 5, 10.001], 5.0, [(0, 5, 2), (10.001, 10.001, 1)]),
    ([0, 4, 8], 3.0, [(0, 0, 1), (4, 4, 1), (8, 8, 1)]),
    ([14, 0, 12, 2], 5.0, [(0, 2, 2), (12, 14, 2)]),
])
def test_gap_rule(spark, seconds, gap, want):
    assert periods(spark, seconds, gap) == want


def test_other_events_do_not_count(spark):
    kinds = ["SPELL_DAMAGE", "ZONE_CHANGE", "UNIT_DIED", "SPELL_AURA_BROKEN"]
    assert periods(spark, [0, 1, 2, 3], kind=kinds) == [(0, 2, 2)]


def test_share_with_zero_duration(spark):
    p = S.combat_periods(events(spark, [0, 2]), ["k"])
    spans = spark.createDataFrame([(1, 0.0), (2, 10.0)], "k int, duration double")
    got = {r.k: (r.combat_time, r.combat_percent) for r in S.combat_share(p, ["k"], spans).collect()}
    assert got == {1: (2.0, 0.0), 2: (0.0, 0.0)}


def test_adaptive_gap_floor(spark):
    g = S.adaptive_gap(events(spark, [0, 0.1, 0.2, 9]), ["k"], bucket_seconds=3.0).first()
    assert g.gap == 1.0


def test_merge_close(spark):
    p = S.combat_periods(events(spark, [0, 7, 20]), ["k"])
    merged = ordered.islands(p, ["k"], "start_ts", "end_ts", 7.0, 5.0).count()
    assert merged == 2
