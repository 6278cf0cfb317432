"""Stateful streams against plain Python over the same rows, in any order of files, over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from fraylens.operators import segments
from fraylens.operators.ordered import newest
from fraylens.streaming import live, stateful

SCHEMA = "guild_id long, us long, line_no long, event_type string, boss_id long, success boolean"
S, E, RS, RE = segments.START, segments.END, segments.RUN_START, segments.RUN_END


def run(spark, tmp_path, parts, schema, make, keys):
    """Each part is one file and one batch; the newest revision of each row."""
    src = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    frame = spark.createDataFrame([], schema)
    stream = live.stream_table(spark, src, frame.schema, 1)
    live.run_available(make(stream), "update", live.batch_writer(f"{tmp_path}/out"), f"{tmp_path}/state")
    rows = live.stored(spark, f"{tmp_path}/out")
    return rows.collect(), newest(rows, keys, ["revision"]).collect()


def replay(rows):
    """Encounters and runs of ordered boundary rows, in plain Python."""
    out, current, pulls = [], None, {}
    for _, us, line, kind, boss, success in sorted(rows, key=lambda r: (r[1], r[2])):
        boss = -1 if boss is None else boss
        in_run = current is not None and current[0] == "mythic_plus"
        if kind == RS or kind == S and not in_run:
            if current:
                out.append((*current, None, None, "replaced"))
            pulls[boss] = pulls.get(boss, 0) + (kind == S)
            current = ("raid" if kind == S else "mythic_plus", line, boss, pulls[boss] if kind == S else 0, us)
        elif kind == RE and in_run or kind == E and current and not in_run and current[2] == boss:
            out.append((*current, us, bool(success), "closed"))
            current = None
    return out + ([(*current, None, None, "in_progress")] if current else [])


def boundary_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in (1, 2, 3):
        for i in range(60):
            kind = rng.choices([S, E, RS, RE], [5, 5, 1, 1])[0]
            rows.append((g, (i * 20 + g) * 1_000_000, i, kind, rng.choice([None, 7, 8]), rng.random() < 0.5))
    return rows


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_encounters_runs_and_open_rows(spark, tmp_path, order):
    rows = boundary_rows(3)
    parts = [[r for r in rows if r[2] // 20 == k] for k in order]
    # a last row far ahead moves the watermark past everything else; it opens nothing
    parts.append([(9, 10 ** 13, 0, E, 1, True)])
    make = lambda s: stateful.live_encounters(s.withColumn("ts", F.timestamp_micros("us")), "3000 seconds")
    every, last = run(spark, tmp_path, parts, SCHEMA, make, ["guild_id", "encounter_id"])
    got = sorted((r.guild_id, r.encounter_type, r.encounter_id, r.boss_id, r.pull_number, r.start_us, r.end_us, r.success, r.status) for r in last)
    want = sorted((g, *e) for g in (1, 2, 3) for e in replay([r for r in rows if r[0] == g]))
    assert got == want
    assert {"raid", "mythic_plus"} == {w[1] for w in want} and {"closed", "replaced", "in_progress"} == {w[-1] for w in want}
    if order == [0, 1, 2]:
        assert len(every) >= len(last)


def test_batch_and_stream_agree(spark, tmp_path):
    """The stream's closed rows are those of the batch operator."""
    rows = boundary_rows(4)
    make = lambda s: stateful.live_encounters(s.withColumn("ts", F.timestamp_micros("us")), "0 seconds")
    _, last = run(spark, tmp_path, [rows, [(9, 10 ** 13, 0, E, 1, True)]], SCHEMA, make, ["guild_id", "encounter_id"])
    got = {(r.guild_id, r.encounter_type, r.encounter_id, r.boss_id, r.pull_number, r.start_us, r.end_us, r.success) for r in last}
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"ts": F.timestamp_micros("us"), "boss_name": F.lit("b")})
    batch = segments.unified_encounters(frame.withColumn("boss_id", F.coalesce("boss_id", F.lit(-1))), ["guild_id"]).withColumns(
        {"s": F.unix_micros("start_ts"), "e": F.unix_micros("end_ts")})
    assert got == {(r.guild_id, r.encounter_type, r.encounter_id, r.boss_id, r.pull_number, r.s, r.e, r.success) for r in batch.collect()}


def test_idle_encounters_end(spark, tmp_path):
    rows = [(1, 10 ** 9, 0, S, 7, None), (1, 6 * 10 ** 9, 1, E, 7, True), (2, 10 ** 9, 0, RS, 7, None), (2, 1_050_000_000, 1, RE, 7, True)]
    make = lambda s: stateful.live_encounters(s.withColumn("ts", F.timestamp_micros("us")), "0 seconds", idle_seconds=100)
    _, last = run(spark, tmp_path, [rows, [(9, 10 ** 13, 0, E, 1, True)]], SCHEMA, make, ["guild_id", "encounter_id"])
    assert sorted((r.guild_id, r.status, r.end_us) for r in last) == [(1, "idle", None), (2, "closed", 1_050_000_000)]


EVENTS = "encounter_key long, source_guid string, us long, event_type string, amount long, overhealing long"


def test_top_lists_over_midnight(spark, tmp_path):
    rng = random.Random(5)
    rows = [(e, f"P{rng.randrange(9)}", (86_000 + e * 50 + i) * 1_000_000, rng.choice(["SPELL_DAMAGE", "SPELL_HEAL"]), rng.randrange(1000), 0) for e in (1, 2) for i in range(900)]
    parts = [[r for r in rows if (r[2] // 300_000_000) % 3 == k] for k in (1, 0, 2)]
    make = lambda s: stateful.live_top(s.withColumn("ts", F.timestamp_micros("us")), 5, "1 day")
    every, last = run(spark, tmp_path, parts + [parts[0][:0] + [(1, "P0", 86_100_000_000, "SPELL_HEAL", 1, 0)]], EVENTS, make, ["encounter_key", "rank"])
    rows.append((1, "P0", 86_100_000_000, "SPELL_HEAL", 1, 0))
    for e in (1, 2):
        own = [r for r in rows if r[0] == e]
        damage = {}
        for r in own:
            damage[r[1]] = damage.get(r[1], 0) + (r[4] if r[3] == "SPELL_DAMAGE" else 0)
        seconds = (max(r[2] for r in own) - min(r[2] for r in own)) / 1e6
        want = [(k + 1, g, d, d / seconds, seconds, 9) for k, (g, d) in enumerate(sorted(damage.items(), key=lambda x: (-x[1], x[0]))[:5])]
        got = sorted((r["rank"], r.guid, r.damage, r.dps, r.duration_seconds, r.participants) for r in last if r.encounter_key == e)
        assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want] and all(abs(g[3] - w[3]) < 1e-9 and g[4] == w[4] for g, w in zip(got, want))
    assert max(r.revision for r in every) <= 4


def test_delivery_with_losses_and_repeats(spark, tmp_path):
    rng = random.Random(6)
    sent = {c: [n for n in range(1, 301) if rng.random() > lost] for c, lost in (("a", 0.0), ("b", 0.15), ("c", 0.6))}
    rows = [(c, n) for c, seqs in sent.items() for n in seqs for _ in range(rng.choice([1, 2, 3]))]
    rng.shuffle(rows)
    parts = [rows[k::3] for k in range(3)]
    _, last = run(spark, tmp_path, parts, "client_id string, seq long", lambda s: stateful.live_delivery(s, first=1), ["client_id"])
    assert len(last) == 3
    for r in last:
        have = set(sent[r.client_id])
        holes = [n for n in range(1, max(have) + 1) if n not in have]
        contiguous = holes[0] - 1 if holes else max(have)
        assert (r.acked, r.received, r.missing, r.contiguous) == (max(have), len(have), len(holes), contiguous)
        assert r.pending == sum(n > contiguous for n in have) and r.duplicates == sum(c == r.client_id for c, _ in rows) - len(have)
        assert [n for g in r.gaps for n in range(g.low, g.high + 1)] == holes


def test_given_up_numbers_stay_missing(spark, tmp_path):
    parts = [[("a", n) for n in range(1, 100) if n not in (5, 6)], [("a", 5), ("a", 100)]]
    _, last = run(spark, tmp_path, parts, "client_id string, seq long", lambda s: stateful.live_delivery(s, first=1, lost_after=50), ["client_id"])
    r = last[0]
    assert (r.acked, r.missing, r.received, r.duplicates, r.gaps, r.pending) == (100, 2, 98, 1, [], 0)


def test_ranges():
    assert stateful.merged([(5, 6), (1, 2), (3, 3), (9, 9), (6, 7)]) == [(1, 3), (5, 7), (9, 9)]
