"""Encounter and fight boundaries. Only boundary rows take part, the bulk stays untouched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.operators.intervals import locate, range_join
from fraylens.operators.ordered import after, carry, islands, row_number, running_sum, time_bucket, upto

DAY = 86400.0
START, END = "ENCOUNTER_START", "ENCOUNTER_END"
RUN_START, RUN_END = "CHALLENGE_MODE_START", "CHALLENGE_MODE_END"
BOUNDARIES = [START, END, RUN_START, RUN_END]


def _segments(boundaries: DataFrame, keys: Sequence[str], bucket_seconds: float) -> DataFrame:
    """One row per start row with what closes it.

    Input columns: keys, ts, line_no, event_type, boss_id, boss_name, success.
    """
    kind = F.col("event_type")
    starts = kind.isin(START, RUN_START)
    order = ["ts", "line_no"]
    bucket = time_bucket("ts", bucket_seconds)
    rows = carry(
        boundaries.filter(kind.isin(BOUNDARIES)), keys, order, bucket,
        mode=upto(F.when(kind.isin(RUN_START, RUN_END), kind)),
        segment=running_sum(starts.cast("long")),
        run=running_sum((kind == RUN_START).cast("long")),
        open_id=upto(F.when(starts, F.coalesce("boss_id", F.lit(-1)))))
    mark = F.struct("ts", "line_no", "success")
    closes = (kind == END) & (F.col("boss_id") == F.col("open_id"))
    segments = rows.filter("segment > 0").groupBy(*keys, "segment").agg(
        F.max_by(F.struct("ts", "line_no", "event_type", "boss_id", "boss_name", "mode", "run"),
                 F.when(starts, F.struct(*order))).alias("s"),
        F.min(F.when(closes, mark)).alias("boss_end"),
        F.min(F.when(kind == RUN_END, mark)).alias("run_end"))
    in_run = F.coalesce(F.col("s.mode") == RUN_START, F.lit(False))
    first = F.col("boss_end").isNotNull() & (
        ~in_run | F.col("run_end").isNull() | (F.col("boss_end") <= F.col("run_end")))
    ended = F.when(first & (F.col("s.event_type") == START), F.col("boss_end"))
    flat = segments.select(
        *keys, "segment", "s.*", in_run.alias("in_run"),
        ended.alias("boss_end"), F.when(in_run, F.col("run_end")).alias("run_end"))
    upcoming = F.struct(F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return carry(flat, keys, order, bucket, next_start=after(upcoming))


def unified_encounters(boundaries: DataFrame, keys: Sequence[str], bucket_seconds: float = DAY) -> DataFrame:
    """Raid encounters and keystone runs with start, end (null when replaced while open) and success."""
    seg = _segments(boundaries, keys, bucket_seconds)
    raid = seg.filter("NOT in_run").withColumn("boss_id", F.coalesce("boss_id", F.lit(-1)))
    raid = carry(raid, [*keys, "boss_id"], ["ts", "line_no"], time_bucket("ts", bucket_seconds), pull_number=row_number())
    raid = raid.select(
        *keys, F.lit("raid").alias("encounter_type"), "boss_id", F.col("boss_name").alias("name"),
        F.col("pull_number").cast("long").alias("pull_number"), F.col("line_no").alias("encounter_id"),
        F.col("ts").alias("start_ts"), F.col("boss_end.ts").alias("end_ts"), F.col("boss_end.success").alias("success"))
    first = F.struct("ts", "line_no")
    runs = seg.filter("in_run").groupBy(*keys, "run").agg(
        F.min_by(F.struct("ts", "line_no", "boss_id", "boss_name"), first).alias("s"), F.min("run_end").alias("e"))
    runs = runs.select(
        *keys, F.lit("mythic_plus").alias("encounter_type"), "s.boss_id", F.col("s.boss_name").alias("name"),
        F.lit(0).cast("long").alias("pull_number"), F.col("s.line_no").alias("encounter_id"),
        F.col("s.ts").alias("start_ts"), F.col("e.ts").alias("end_ts"), F.col("e.success").alias("success"))
    return raid.unionByName(runs)


def unified_fights(boundaries: DataFrame, keys: Sequence[str], bucket_seconds: float = DAY) -> DataFrame:
    """Fights of raids (one pull each) and runs (entrance trash, bosses, numbered trash)."""
    seg = _segments(boundaries, keys, bucket_seconds)
    raid = seg.filter("NOT in_run").withColumn("boss_id", F.coalesce("boss_id", F.lit(-1)))
    raid = carry(raid, [*keys, "boss_id"], ["ts", "line_no"], time_bucket("ts", bucket_seconds), pull=row_number())
    raid = raid.select(
        *keys, F.col("line_no").alias("start_line"), F.lit(0).alias("part"), F.lit("normal").alias("fight_type"),
        F.concat("boss_name", F.lit(" - Pull "), F.col("pull").cast("string")).alias("fight_name"),
        F.col("ts").alias("start_ts"), F.col("boss_end.ts").alias("end_ts"), F.col("boss_end.success").alias("success"))

    run = seg.filter("in_run")
    zones = run.filter(F.col("event_type") == RUN_START).select(*keys, "run", F.col("boss_name").alias("zone"))
    run = carry(run, [*keys, "run"], ["ts", "line_no"], time_bucket("ts", bucket_seconds),
                trash=running_sum(F.col("boss_end").isNotNull().cast("long"))).join(zones, [*keys, "run"])
    # what ends an open fight: the run's end, else the next boss; a new run leaves it open
    next_boss = F.when(F.col("next_start.kind") == START, F.col("next_start.at"))
    closing = F.struct(F.coalesce(F.col("run_end.ts"), next_boss).alias("ts"), F.col("run_end.success").alias("success"))
    entrance = F.col("event_type") == RUN_START
    boss = F.col("boss_end").isNotNull()
    first = F.struct(
        F.lit(0).alias("part"), F.when(entrance, "trash").otherwise("boss").alias("fight_type"),
        F.when(entrance, F.concat("zone", F.lit(" - Trash (Entrance)")))
        .otherwise(F.concat(F.lit("Boss: "), F.col("boss_name"))).alias("fight_name"),
        F.col("ts").alias("start_ts"), F.when(boss, F.col("boss_end.ts")).otherwise(closing["ts"]).alias("end_ts"),
        F.when(boss, F.col("boss_end.success")).otherwise(closing["success"]).alias("success"))
    second = F.struct(
        F.lit(1).alias("part"), F.lit("trash").alias("fight_type"),
        F.concat("zone", F.lit(" - Trash ("), (F.col("trash") + 1).cast("string"), F.lit(")")).alias("fight_name"),
        F.col("boss_end.ts").alias("start_ts"), closing["ts"].alias("end_ts"), closing["success"].alias("success"))
    pieces = F.filter(F.array(first, F.when(boss, second)), lambda x: x.isNotNull())
    runs = run.select(*keys, F.col("line_no").alias("start_line"), F.explode(pieces).alias("f")).select(*keys, "start_line", "f.*")
    return raid.unionByName(runs.select(raid.columns))


def pair_boundaries(boundaries: DataFrame, keys: Sequence[str], bucket_seconds: float = DAY) -> tuple[DataFrame, DataFrame]:
    """(windows, issues): each start with the first end before the next start; ends with no open start are issues."""
    order, kind = ["ts", "line_no"], F.col("event_type")
    rows = carry(boundaries.filter(kind.isin(START, END)), keys, order, time_bucket("ts", bucket_seconds),
                 segment=running_sum((kind == START).cast("long")))
    grouped = rows.groupBy(*keys, "segment").agg(
        F.min(F.when(kind == START, F.struct(*order))).alias("s"), F.min(F.when(kind == END, F.struct(*order))).alias("e"))
    windows = grouped.filter(F.col("s").isNotNull()).select(
        *keys, F.col("s.line_no").alias("encounter_id"), F.col("s.ts").alias("start_ts"), F.col("e.ts").alias("end_ts"))
    used = grouped.filter(F.col("s").isNotNull() & F.col("e").isNotNull()).select(
        *keys, "segment", F.col("e.line_no").alias("line_no"))
    issues = (rows.filter(kind == END).join(used, [*keys, "segment", "line_no"], "left_anti")
              .select(*keys, "line_no", "ts", F.lit("end without start").alias("issue")))
    open_ = windows.filter(F.col("end_ts").isNull()).select(
        *keys, F.col("encounter_id").alias("line_no"), F.col("start_ts").alias("ts"), F.lit("start without end").alias("issue"))
    return windows, issues.unionByName(open_)


def assign_encounter(
    events: DataFrame, windows: DataFrame, keys: Sequence[str], payload: Sequence[str] = ("encounter_id",),
    bucket_seconds: float = 3600.0,
) -> DataFrame:
    """Encounter of each event (closed ends); windows of one key must not overlap. Open ends reach to the end."""
    far = F.coalesce(F.col("end_ts"), F.lit("9999-12-31").cast("timestamp"))
    return locate(events, windows.withColumn("end_ts", far), keys, "ts", list(payload), bucket_seconds=bucket_seconds)


def trash_segments(
    events: DataFrame, windows: DataFrame, keys: Sequence[str], gap_seconds: float = 10.0, bucket_seconds: float = 3600.0,
) -> DataFrame:
    """Islands of events that lie in no encounter window, split on inactivity."""
    placed = locate(events, windows.filter(F.col("end_ts").isNotNull()), keys, "ts", ["encounter_id"], bucket_seconds=bucket_seconds)
    return islands(placed.filter(F.col("encounter_id").isNull()), keys, "ts", "ts", gap_seconds, bucket_seconds,
                   {"event_count": F.lit(1).cast("long")}, index="segment_index")


def top_level_windows(encounters: DataFrame, runs: DataFrame, keys: Sequence[str], slice_seconds: float = 3600.0) -> DataFrame:
    """Encounters that no run contains."""
    e = encounters.withColumn("__end", F.col("end_ts"))
    r = runs.select(*keys, F.col("start_ts").alias("run_start"), F.col("end_ts").alias("run_end"))
    inside = range_join(e, r, keys, "start_ts", "run_start", "run_end", slice_seconds).filter(F.col("__end") <= F.col("run_end"))
    return encounters.join(inside.select("encounter_id").distinct(), "encounter_id", "left_anti")


def match_fights(
    fights: DataFrame, encounters: DataFrame, key: str, tolerance_seconds: float = 60.0
) -> DataFrame:
    """Nearest encounter of the same id whose start differs by at most the tolerance; of equally near ones the least encounter_id.

    Along time each fight sees the last encounter that starts no later and the first one that starts later, so nothing is paired.
    """
    known = F.col(key).isNotNull() & F.col("start_ts").isNotNull()
    # encounters that start together are equally near: the least of their ids stands for all
    e = encounters.filter(known).groupBy(key, "start_ts").agg(F.min(F.struct("encounter_id")).alias("__e"))
    e = e.select(key, "start_ts", F.lit(0).alias("__rank"), F.struct(F.unix_micros("start_ts").alias("at"), "__e.encounter_id").alias("__enc"))
    f = fights.filter(known).select(key, "start_ts", F.lit(1).alias("__rank"), "fight_id")
    near = carry(f.unionByName(e, allowMissingColumns=True), [key], ["start_ts", "__rank"], time_bucket("start_ts", tolerance_seconds),
                 __last=upto(F.col("__enc")), __next=after(F.col("__enc"))).filter(F.col("__rank") == 1)

    def offered(x: str) -> Column:
        off = F.abs(F.unix_micros("start_ts") - F.col(f"{x}.at"))
        return F.when(off <= int(tolerance_seconds * 1e6), F.struct(off.alias("offset_us"), F.col(f"{x}.encounter_id")))

    best = near.select("fight_id", F.least(offered("__last"), offered("__next")).alias("__best")).filter(F.col("__best").isNotNull())
    return best.groupBy("fight_id").agg(F.min("__best").alias("__best")).select("fight_id", "__best.encounter_id", "__best.offset_us")


def phase_at(points: DataFrame, phases: DataFrame, keys: Sequence[str], payload: Sequence[str], bucket_seconds: float = DAY) -> DataFrame:
    """Phase or segment in force at each point; an open end lasts until the next phase, the last for ever."""
    follow = carry(phases, keys, ["start_ts"], time_bucket("start_ts", bucket_seconds), next_start=after(F.col("start_ts")))
    closed = follow.withColumn("end_ts", F.coalesce("end_ts", "next_start")).drop("next_start")
    return assign_encounter(points, closed, keys, payload, bucket_seconds)
