"""Operators along time: combat periods, bursts, ownership, auras, deaths, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.operators import distribution
from fraylens.operators.intervals import locate, overlap_seconds, range_join
from fraylens.operators.ordered import (
    after, before, carry, halo_window, islands, max_before, row_number, running_sum, time_bucket, upto)

HOUR = 3600.0


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


# --- combat periods ----------------------------------------------------------------------

def combat_periods(
    events: DataFrame, keys: Sequence[str], gap_seconds: float | str = 5.0, bucket_seconds: float = HOUR,
    combat: Column | None = None,
) -> DataFrame:
    """Spans of combat events in which no silence exceeds the gap (equal does not split).

    The end is the last event, so one event is a period of duration 0.
    """
    test = C.is_combat(F.col("event_type")) if combat is None else combat
    spans = islands(events.filter(test), keys, "ts", "ts", gap_seconds, bucket_seconds,
                    {"event_count": F.lit(1).cast("long")})
    return spans.withColumn("duration", seconds_between("start_ts", "end_ts"))


def adaptive_gap(
    events: DataFrame, keys: Sequence[str], factor: float = 2.0, least: float = 1.0, bucket_seconds: float = HOUR,
) -> DataFrame:
    """Per key: ``max(median silence x factor, least)`` seconds, with an exact median."""
    gaps = carry(events.select(*keys, "ts"), keys, ["ts"], time_bucket("ts", bucket_seconds),
                 prev=before(F.col("ts"))).select(*keys, seconds_between("prev", "ts").alias("silence"))
    median = distribution.percentiles(gaps, keys, "silence", [0.5])
    return median.select(*keys, F.greatest(F.col("silence_p50") * factor, F.lit(least)).alias("gap"))


def combat_share(periods: DataFrame, keys: Sequence[str], spans: DataFrame) -> DataFrame:
    """Total combat time and its percentage of each key's ``duration`` in ``spans``."""
    total = periods.groupBy(*keys).agg(F.sum("duration").alias("combat_time"), F.count("*").alias("periods"))
    return (spans.join(total, list(keys), "left")
            .withColumn("combat_time", F.coalesce("combat_time", F.lit(0.0)))
            .withColumn("periods", F.coalesce("periods", F.lit(0)))
            .withColumn("combat_percent", C.ratio(F.col("combat_time") * 100, F.col("duration"))))


def overlapping(windows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_seconds: float = HOUR) -> DataFrame:
    """Windows that start before an earlier one of the key has ended (none when valid)."""
    checked = carry(windows, keys, order, time_bucket("start_ts", bucket_seconds), prev_end=max_before(F.col("end_ts")))
    return checked.filter(F.col("start_ts") < F.col("prev_end"))


def combat_gaps(
    periods: DataFrame, events: DataFrame, keys: Sequence[str], bucket_seconds: float = HOUR
) -> DataFrame:
    """Silences between consecutive periods with the number of events in them (ends included)."""
    nexts = carry(periods, keys, ["start_ts"], time_bucket("start_ts", bucket_seconds), next_start=after(F.col("start_ts")))
    gaps = nexts.filter(F.col("next_start").isNotNull()).select(
        *keys, "period_index", F.col("end_ts").alias("start_ts"), F.col("next_start").alias("end_ts"))
    inside = (range_join(events.select(*keys, "ts"), gaps, keys, "ts", slice_seconds=bucket_seconds)
              .groupBy(*keys, "period_index").agg(F.count("*").alias("events_during_gap")))
    return (gaps.join(inside, [*keys, "period_index"], "left")
            .withColumn("events_during_gap", F.coalesce("events_during_gap", F.lit(0)))
            .withColumn("duration", seconds_between("start_ts", "end_ts")))


def activity_bursts(
    events: DataFrame, keys: Sequence[str], span_seconds: float = 10.0, least: int = 10, bucket_seconds: float = HOUR,
) -> DataFrame:
    """Merged windows in which ``least`` events follow within ``span_seconds``; events counted once."""
    dense = halo_window(events.select(*keys, "ts"), keys, "ts", span_seconds, bucket_seconds, n=F.count(F.lit(1)))
    dense = dense.filter(F.col("n") >= least).withColumn(
        "until", F.col("ts") + F.make_dt_interval(secs=F.lit(span_seconds)))
    bursts = islands(dense, keys, "ts", "until", 0.0, bucket_seconds, index="burst_index")
    hit = locate(events, bursts, keys, "ts", ["burst_index"], bucket_seconds=bucket_seconds)
    counts = (hit.filter(F.col("burst_index").isNotNull()).groupBy(*keys, "burst_index")
              .agg(F.count("*").alias("event_count"), F.count_distinct("category").alias("categories")))
    return (bursts.join(counts, [*keys, "burst_index"])
            .withColumn("events_per_second", F.col("event_count") / seconds_between("start_ts", "end_ts")))


# --- duplicates, numbering, ownership ----------------------------------------------------------

def dedupe_swings(events: DataFrame, upload: Sequence[str] = ("guild_id", "file_id")) -> DataFrame:
    """Of SWING_DAMAGE and _LANDED rows with equal (ts, source, dest) in one upload keep the first line.

    Two guilds, or two members of one, may have logged the same raid: their rows never meet. ``upload`` columns that the table lacks
    are left out.

    The copies meet in an aggregation, so even a huge group of copies is reduced map-side.
    """
    swing = F.col("event_type").isin("SWING_DAMAGE", "SWING_DAMAGE_LANDED")
    keys = [*(c for c in upload if c in events.columns), "ts", "source_guid", "dest_guid"]
    rest = [c for c in events.columns if c not in keys]
    first = (events.filter(swing).groupBy(*keys)
             .agg(F.min_by(F.struct(*rest), "line_no").alias("__row")).select(*keys, "__row.*"))
    return events.filter(~swing).unionByName(first)


def pull_numbers(starts: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_seconds: float = 86400.0) -> DataFrame:
    """Number the starts of the same boss (``keys``) in time order."""
    return carry(starts, keys, order, time_bucket(order[0], bucket_seconds), pull_number=row_number())


def resolve_owner(rows: DataFrame, summons: DataFrame, bucket_seconds: float = HOUR, upload: Sequence[str] = ()) -> DataFrame:
    """Replace pet, creature and vehicle guids by the owner known at that time.

    ``summons``: guid, owner_guid, ts, line_no. Both have the ``upload`` columns, and owners hold inside one upload.
    Player rows pass through without a shuffle.
    """
    owned = C.entity_kind(F.col("guid")).isin("Pet", "Creature", "Vehicle")
    body = rows.columns
    keys = [*upload, "guid"]
    stacked = rows.filter(owned).select(*keys, "ts", "line_no", F.struct(*body).alias("__row")).unionByName(
        summons.select(*keys, "ts", "line_no", F.col("owner_guid").alias("__owner")), allowMissingColumns=True)
    filled = carry(stacked, keys, ["ts", "line_no"], time_bucket("ts", bucket_seconds),
                   owner_guid=upto(F.col("__owner"))).filter(F.col("__row").isNotNull())
    pets = filled.select("__row.*", "owner_guid")
    out = rows.filter(~owned | owned.isNull()).withColumn("owner_guid", F.lit(None).cast("string")).unionByName(pets)
    return out.withColumn("resolved_guid", F.coalesce("owner_guid", "guid"))


# --- auras ----------------------------------------------------------------------------------------

def aura_intervals(changes: DataFrame, keys: Sequence[str], bucket_seconds: float = HOUR) -> DataFrame:
    """Merged active spans per aura from rows with ``gained`` true/false; open ones end with the guid's last row."""
    ends = changes.groupBy(keys[0]).agg(F.max("ts").alias("__last"))
    marked = carry(changes, keys, ["ts", "line_no"], time_bucket("ts", bucket_seconds),
                   lost=after(F.when(~F.col("gained"), F.col("ts"))))
    spans = (marked.filter("gained").join(ends, keys[0])
             .withColumn("until", F.coalesce("lost", "__last")))
    return islands(spans, keys, "ts", "until", 0.0, bucket_seconds,
                   {"applications": F.lit(1).cast("long")}, index="aura_index")


def aura_uptime(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return intervals.groupBy(*keys).agg(
        F.sum(seconds_between("start_ts", "end_ts")).alias("uptime"), F.sum("applications").alias("applications"))


# --- deaths ------------------------------------------------------------------------------------------

def death_intervals(rows: DataFrame, keys: Sequence[str], bucket_seconds: float = HOUR) -> DataFrame:
    """From each death to the next resurrection, or to the last event of that character."""
    last = rows.groupBy(*keys).agg(F.max("ts").alias("__last"))
    marked = carry(rows, keys, ["ts", "line_no"], time_bucket("ts", bucket_seconds),
                   raised=after(F.when(F.col("category") == "resurrected", F.col("ts"))),
                   next_death=after(F.when(F.col("category") == "death", F.col("ts"))))
    own = F.col("raised").isNotNull() & (F.col("next_death").isNull() | (F.col("raised") <= F.col("next_death")))
    return (marked.filter(F.col("category") == "death").join(last, list(keys))
            .select(*keys, F.col("line_no").alias("death_id"), F.col("ts").alias("start_ts"),
                    F.when(own, F.col("raised")).otherwise(F.col("__last")).alias("end_ts"),
                    own.alias("resurrected")))


def death_recap(
    rows: DataFrame, keys: Sequence[str], n: int = 10, within_seconds: float | None = None,
    bucket_seconds: float = HOUR,
) -> DataFrame:
    """The last ``n`` hits taken and ``n`` heals received before every death.

    Hits and heals are numbered along time per character; a death that has seen H hits asks
    for numbers H-n+1..H, which is an equality join with n rows per death.
    """
    kind = F.when(F.col("category") == "damage_taken", "damage").when(F.col("category") == "healing_received", "healing")
    useful = rows.filter(F.col("category").isin("damage_taken", "healing_received", "death")).withColumn("kind", kind)
    numbered = carry(useful, keys, ["ts", "line_no"], time_bucket("ts", bucket_seconds),
                     damage_no=running_sum((F.col("kind") == "damage").cast("long")),
                     healing_no=running_sum((F.col("kind") == "healing").cast("long")))
    steps = F.sequence(F.lit(0), F.lit(n - 1))

    def asked(word: str) -> Column:
        return F.transform(steps, lambda i: F.struct(F.lit(word).alias("kind"), (F.col(f"{word}_no") - i).alias("number")))

    deaths = (numbered.filter(F.col("category") == "death")
              .select(*keys, F.col("line_no").alias("death_id"), F.col("ts").alias("death_ts"),
                      F.explode(F.concat(asked("damage"), asked("healing"))).alias("want"))
              .select(*keys, "death_id", "death_ts", "want.kind", "want.number").filter("number > 0"))
    hits = numbered.filter(F.col("kind").isNotNull()).withColumn(
        "number", F.when(F.col("kind") == "damage", F.col("damage_no")).otherwise(F.col("healing_no")))
    payload = ["ts", "line_no", "source_name", "spell_name", "amount", "overhealing"]
    out = deaths.join(hits.select(*keys, "kind", "number", *payload), [*keys, "kind", "number"])
    if within_seconds is not None:
        out = out.filter(seconds_between("ts", "death_ts") <= within_seconds)
    cause = F.concat(F.coalesce("source_name", F.lit("Unknown")), F.lit(": "), F.coalesce("spell_name", F.lit("Melee")))
    value = F.when(F.col("kind") == "healing", C.effective_healing(F.col("amount"), F.col("overhealing"))).otherwise(F.col("amount"))
    return out.withColumn("cause", cause).withColumn("value", value)


# --- activity ------------------------------------------------------------------------------------------

def activity(
    rows: DataFrame, periods: DataFrame, durations: DataFrame, keys: Sequence[str], guid: str = "guid",
    gcd: float = 1.5, bucket_seconds: float = HOUR,
) -> DataFrame:
    """Time alive and activity percentage per character within its encounter (``keys``).

    possible actions = (combat time - dead time inside combat) / gcd;
    activity = min(100, active events inside combat / possible x 100).
    """
    who = [*keys, guid]
    placed = locate(rows, periods, keys, "ts", ["period_index"], bucket_seconds=bucket_seconds)
    active = F.col("category").isin("damage_done", "healing_done") | F.col("category").contains("cast")
    counts = placed.groupBy(*who).agg(
        F.count_if(active & F.col("period_index").isNotNull()).alias("active_events"),
        F.count("*").alias("total_events"))
    combat = periods.groupBy(*keys).agg(F.sum("duration").alias("combat_time"))
    deaths = death_intervals(rows, who, bucket_seconds)
    shared = overlap_seconds(deaths, periods, keys, [*who, "death_id"], bucket_seconds, "dead_in_combat")
    dead = shared.groupBy(*who).agg(
        F.sum(seconds_between("start_ts", "end_ts")).alias("dead_time"),
        F.sum("dead_in_combat").alias("dead_in_combat"), F.count("*").alias("deaths"))
    zero = F.lit(0.0)
    joined = (counts.join(combat, list(keys), "left").join(durations, list(keys), "left").join(dead, who, "left")
              .withColumns({"combat_time": F.coalesce("combat_time", zero), "deaths": F.coalesce("deaths", F.lit(0)),
                            "dead_time": F.coalesce("dead_time", zero),
                            "dead_in_combat": F.coalesce("dead_in_combat", zero)}))
    possible = F.greatest(zero, F.col("combat_time") - F.col("dead_in_combat")) / gcd
    return joined.select(
        *who, "active_events", "total_events", "deaths", "combat_time",
        (F.col("duration") - F.col("dead_time")).alias("time_alive"),
        F.least(F.lit(100.0), C.ratio(F.col("active_events") * 100.0, possible)).alias("activity_percentage"))


def spikes(rows: DataFrame, keys: Sequence[str], value: str, least: float) -> DataFrame:
    """Rows in the top tenth of their key (threshold at index ``min(n div 10, n-1)``) above ``least``."""
    total = F.col("total")
    limit = distribution.value_at(rows, keys, value, F.least(F.floor(total / 10), total - 1), "threshold")
    return (rows.join(limit.drop("threshold_of"), list(keys))
            .filter((F.col(value) >= F.col("threshold")) & (F.col(value) > least)))


def history(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket_seconds: float = 86400.0) -> DataFrame:
    """Each row with the key's previous value and the change."""
    out = carry(rows, keys, order, time_bucket(order[0], bucket_seconds), previous=before(F.col(value)),
                position=row_number())
    return out.withColumn("change", F.col(value) - F.col("previous"))
