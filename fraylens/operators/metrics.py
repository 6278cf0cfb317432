"""Combat metrics: per character, ability, encounter, run, enemy and guild.

All of these are hash aggregations with map-side combine; a hot encounter or character is
reduced before the shuffle. Input ``rows`` are the (guid, category) rows of ``categorize``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.functions import lookups as L
from fraylens.operators.ordered import join_keys
from fraylens.operators.sequence import seconds_between


def _sum(category: str, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(F.col("category") == category, value)), F.lit(0))


def _count(*categories: str) -> Column:
    return F.count_if(F.col("category").isin(*categories))


def effective() -> Column:
    return C.effective_healing(F.col("amount"), F.col("overhealing"))


def combatant_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and counts per key from role rows."""
    over = F.when(F.col("overkill") > 0, F.col("overkill"))
    return rows.groupBy(*keys).agg(
        _sum("damage_done", "amount").alias("damage_done"), _sum("damage_done", over).alias("overkill_done"),
        _sum("healing_done", effective()).alias("healing_done"), _sum("healing_done", "overhealing").alias("overhealing"),
        _sum("damage_taken", "amount").alias("damage_taken"),
        _sum("healing_received", effective()).alias("healing_received"),
        _count("cast_succeeded").alias("casts"), _count("interrupt_done").alias("interrupts"),
        _count("dispel_done").alias("dispels"), _count("death").alias("deaths"), F.count("*").alias("total_events"))


def character_metrics(
    rows: DataFrame, spans: DataFrame, keys: Sequence[str], per: str = "duration", guid: str = "guid"
) -> DataFrame:
    """Totals plus rates. ``spans`` holds ``duration``, ``combat_time`` and, for per='alive', ``time_alive``.

    dps and hps are rounded half-even to 2 digits, dtps is not; a span of 0 gives rate 0.
    """
    base = combatant_metrics(rows, [*keys, guid])
    by = [c for c in spans.columns if c in (*keys, guid)]
    d = base.join(spans, by, "left")
    span = F.col("duration") if per == "duration" else F.greatest(F.col("time_alive"), F.lit(1.0))
    rate = C.ratio
    return d.select(
        *base.columns, F.bround(rate(F.col("damage_done"), span), 2).alias("dps"),
        F.bround(rate(F.col("healing_done"), span), 2).alias("hps"), rate(F.col("damage_taken"), span).alias("dtps"),
        F.bround(rate(F.col("damage_done"), F.col("combat_time")), 2).alias("combat_dps"),
        F.bround(rate(F.col("healing_done"), F.col("combat_time")), 2).alias("combat_hps"))


def spell_totals(events: DataFrame, keys: Sequence[str] = ("spell_id",)) -> DataFrame:
    kind = F.col("event_type")
    damage, heal = kind.isin(C.DAMAGE_LIKE), kind.isin(C.HEAL_LIKE)
    return events.groupBy(*keys).agg(
        F.count_if(kind == "SPELL_CAST_SUCCESS").alias("casts"), F.count_if(damage | heal).alias("hits"),
        F.coalesce(F.sum(F.when(damage, F.col("amount"))), F.lit(0)).alias("damage"),
        F.coalesce(F.sum(F.when(heal, effective())), F.lit(0)).alias("healing"))


def ability_breakdown(rows: DataFrame, category: str, keys: Sequence[str]) -> DataFrame:
    """Per spell: total, hits, crits, share of the character's total, average hit, crit rate.

    Healing carries both the raw sum and the effective sum; the share uses the effective one.
    """
    value = effective() if category.startswith("healing") else F.col("amount")
    per_spell = (rows.filter(F.col("category") == category)
                 .withColumn("spell_id", F.coalesce("spell_id", F.lit(0)))
                 .groupBy(*keys, "spell_id")
                 .agg(F.sum(value).alias("total"), F.sum("amount").alias("raw_total"), F.count("*").alias("hits"),
                      F.count_if("critical").alias("crits"), F.max(value).alias("max_hit")))
    whole = Window.partitionBy(*keys)
    return per_spell.select(
        "*", C.ratio(F.col("total") * 100.0, F.sum("total").over(whole)).alias("percentage"),
        (F.col("raw_total") / F.col("hits")).alias("average_hit"),
        (F.col("crits") * 100.0 / F.col("hits")).alias("crit_rate"))


def spell_summary(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    kind = F.col("event_type")
    damage, heal = kind.isin(C.DAMAGE_LIKE), kind.isin(C.HEAL_LIKE)
    zero = F.lit(0)
    return events.groupBy(*keys, "spell_id").agg(
        F.count_if(kind == "SPELL_CAST_SUCCESS").alias("cast_count"), F.count_if(damage | heal).alias("hit_count"),
        F.count_if((damage | heal) & F.col("critical")).alias("crit_count"),
        F.coalesce(F.sum(F.when(damage, F.col("amount"))), zero).alias("total_damage"),
        F.coalesce(F.sum(F.when(heal, effective())), zero).alias("total_healing"),
        F.coalesce(F.max(F.when(damage, F.col("amount"))), zero).alias("max_damage"),
        F.coalesce(F.max(F.when(heal, effective())), zero).alias("max_healing"))


def encounter_metrics(characters: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second-level roll-up of character metrics (``role``, ``activity_percentage``, ``item_level`` optional)."""
    extra = []
    if "role" in characters.columns:
        extra += [F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("tank", "healer", "dps")]
    if "activity_percentage" in characters.columns:
        active = F.when(F.col("activity_percentage") > 0, F.col("activity_percentage"))
        extra.append(F.coalesce(F.avg(active), F.lit(0.0)).alias("avg_activity"))
    if "item_level" in characters.columns:
        extra.append(F.avg(F.when(F.col("item_level") > 0, F.col("item_level"))).alias("avg_item_level"))
    total = characters.groupBy(*keys).agg(
        F.sum("damage_done").alias("total_damage"), F.sum("healing_done").alias("total_healing"),
        F.sum("overhealing").alias("total_overhealing"), F.sum("deaths").alias("total_deaths"),
        F.count("*").alias("player_count"), *extra)
    d, c = F.col("duration"), F.col("combat_time")
    return total.join(spans, list(keys), "left").select(
        *total.columns, C.ratio(F.col("total_damage"), d).alias("raid_dps"),
        C.ratio(F.col("total_healing"), d).alias("raid_hps"),
        C.ratio(F.col("total_damage"), c).alias("combat_raid_dps"),
        C.ratio(F.col("total_healing"), c).alias("combat_raid_hps"),
        C.ratio(c * 100, d).alias("combat_percentage"))


def participants(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last sighting, name and kind of every unit per fight."""
    sides = F.array(F.struct(F.col("source_guid").alias("guid"), F.col("source_name").alias("name")),
                    F.struct(F.col("dest_guid").alias("guid"), F.col("dest_name").alias("name")))
    seen = events.select(*keys, "ts", F.explode(sides).alias("u")).select(*keys, "ts", "u.*")
    kind = C.entity_kind(F.col("guid"))
    return (seen.filter(kind != "None").groupBy(*keys, "guid")
            .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("name").alias("name"))
            .withColumns({"is_player": kind == "Player", "is_pet": kind == "Pet"}))


def npc_metrics(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per enemy: damage done and taken, healing done, abilities used against it or by it, deaths."""
    sides = F.array(F.struct(F.col("source_guid").alias("guid"), F.lit("source").alias("side")),
                    F.struct(F.col("dest_guid").alias("guid"), F.lit("dest").alias("side")))
    e = events.withColumn("u", F.explode(sides)).select("*", "u.*").filter(
        C.entity_kind(F.col("guid")).isin("Creature", "Vehicle"))
    kind, src = F.col("event_type"), F.col("side") == "source"
    damage, heal = kind.isin(C.DAMAGE_LIKE), kind.isin(C.HEAL_LIKE)

    def total(test: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0))

    return e.groupBy(*keys, "guid").agg(
        total(damage & src, F.col("amount")).alias("damage_done"), total(damage & ~src, F.col("amount")).alias("damage_taken"),
        total(heal & src, effective()).alias("healing_done"), F.count_distinct("spell_id").alias("abilities"),
        F.count_if(~src & (kind == "UNIT_DIED")).alias("deaths"))


def mplus_run(segments: DataFrame, runs: DataFrame, key: str, penalty: float = 5.0) -> DataFrame:
    """Run summary from segments (start_ts, end_ts, deaths, damage) and runs (start_ts, end_ts, last_combat_ts, time_limit).

    An unfinished run ends with its last combat within two hours, else its last segment,
    else one minute after the start, and counts as abandoned.
    """
    total = segments.groupBy(key).agg(
        F.count("*").alias("segments"), F.sum("deaths").alias("deaths"), F.sum("damage").alias("damage"),
        F.max("end_ts").alias("last_segment"))
    d = runs.join(total, key, "left")
    near = seconds_between("start_ts", "last_combat_ts") < 7200
    guess = (F.when(near, F.col("last_combat_ts"))
             .otherwise(F.coalesce("last_segment", F.col("start_ts") + F.make_dt_interval(mins=F.lit(1)))))
    actual = seconds_between(F.col("start_ts"), F.coalesce(F.col("end_ts"), guess))
    deaths = F.coalesce("deaths", F.lit(0))
    return d.select(
        key, F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("damage", F.lit(0)).alias("damage"),
        deaths.alias("deaths"), actual.alias("actual_seconds"), (F.col("time_limit") - actual).alias("time_remaining"),
        (F.col("time_limit") - actual >= 0).alias("in_time"), (deaths * penalty).alias("penalty_seconds"),
        F.col("end_ts").isNull().alias("abandoned"))


def segment_mobs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Enemy deaths and enemy forces gained per segment (``forces`` = running percentage)."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("enemy_death")).alias("mobs"), (F.max("forces") - F.min("forces")).alias("forces_gained"))


def raid_mechanics(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    cast = F.col("event_type") == "SPELL_CAST_SUCCESS"
    lust = cast & F.col("spell_id").isin(L.BLOODLUST)
    return events.groupBy(*keys).agg(
        F.coalesce(F.bool_or(lust), F.lit(False)).alias("bloodlust_used"), F.min(F.when(lust, F.col("ts"))).alias("bloodlust_ts"),
        F.count_if(cast & F.col("spell_id").isin(L.BATTLE_RES)).alias("battle_res_count"))


def raid_composition(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct players per role (``guid``, ``role``), pets left out."""
    people = members.filter(C.entity_kind(F.col("guid")) != "Pet").select(*keys, "guid", "role").distinct()
    out = people.groupBy(*keys).pivot("role", ["tank", "healer", "dps"]).count().na.fill(0, ["tank", "healer", "dps"])
    return out.withColumn("raid_size", F.col("tank") + F.col("healer") + F.col("dps"))


def survival_stats(characters: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = characters.groupBy(*keys).agg(
        F.sum("deaths").alias("total_deaths"), F.count("*").alias("players"), F.count_if(F.col("deaths") > 0).alias("players_died"))
    n = F.col("players")
    return d.select(*keys, "total_deaths", "players_died", (F.col("total_deaths") / n).alias("death_rate"),
                    ((n - F.col("players_died")) / n).alias("survival_rate"))


def fight_trends(fights: DataFrame) -> DataFrame:
    """Counts by type, by difficulty and overall in one pass (grouping sets)."""
    rows = fights.groupingSets([["encounter_type"], ["difficulty"], []], "encounter_type", "difficulty").agg(
        F.count("*").alias("fights"), F.count_if("success").alias("kills"),
        F.avg(F.when(F.col("success") & (F.col("duration") > 0), F.col("duration"))).alias("avg_duration_success"),
        F.avg(F.when(~F.col("success") & (F.col("duration") > 0), F.col("duration"))).alias("avg_duration_wipe"))
    return rows.withColumn("success_rate", F.col("kills") / F.col("fights"))


def fight_efficiency(characters: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    dealers = F.count_if(F.col("damage_done") > 0)
    active = F.when(F.col("activity_percentage") > 0, F.col("activity_percentage"))
    total = characters.groupBy(*keys).agg(
        F.sum("damage_done").alias("__d"), dealers.alias("__n"), F.sum("healing_done").alias("__h"),
        F.sum("overhealing").alias("__o"), F.sum("deaths").alias("__x"), F.count("*").alias("__p"),
        F.coalesce(F.avg(active), F.lit(0.0)).alias("avg_activity"))
    span = F.when(F.col("combat_time") > 0, F.col("combat_time")).otherwise(F.col("duration"))
    return total.join(spans, list(keys), "left").select(
        *keys, C.ratio(F.col("__d"), F.col("__n") * span).alias("avg_dps_per_player"),
        C.ratio(F.col("__h"), F.col("__h") + F.col("__o")).alias("healing_efficiency"), "avg_activity",
        ((F.col("__p") - F.col("__x")) / F.col("__p")).alias("survival_rate"))


def outcome_stats(fights: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fights.groupBy(*keys).agg(
        F.count("*").alias("fights"), F.count_if("success").alias("kills"), F.count_if(~F.col("success")).alias("wipes"),
        F.count_if(F.col("success").isNull()).alias("incomplete"))


def player_totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Across encounters: averages, deaths, success rate, item level over encounters that have gear."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("encounters"), F.avg("dps").alias("avg_dps"), F.avg("hps").alias("avg_hps"), F.max("dps").alias("best_dps"),
        F.sum("deaths").alias("deaths"), (F.count_if("success") / F.count("*")).alias("success_rate"),
        F.avg(F.when(F.col("item_level") > 0, F.col("item_level"))).alias("avg_item_level"))


# --- deaths --------------------------------------------------------------------------------------

# ``keys`` of a recap name its guild and encounter; without them all deaths of a table are taken together.

def death_causes(recap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Damage per death and cause, one row per pair."""
    return (recap.filter(F.col("kind") == "damage").groupBy(*keys, "guid", "death_id", "death_ts", "cause")
            .agg(F.sum("value").alias("damage")))


def top_killers(recap: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` causes with the most deaths, in each guild and encounter if ``keys`` are given."""
    c = death_causes(recap, keys).groupBy(*keys, "cause").agg(F.count("*").alias("deaths"), F.sum("damage").alias("damage"))
    best = [F.desc("deaths"), F.desc("damage"), F.asc("cause")]
    return top_per_group(c, list(keys), best, n) if keys else c.orderBy(*best).limit(n)


def death_spikes(recap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest damage within one clock second before each death, healing coverage and a label."""
    death = [*keys, "guid", "death_id"]
    second = recap.filter(F.col("kind") == "damage").groupBy(*death, F.floor(F.unix_micros("ts") / 1000000).alias("__s")).agg(F.sum("value").alias("__v"))
    spike = second.groupBy(*death).agg(F.max("__v").alias("damage_spike"))
    sums = recap.groupBy(*death).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "damage", F.col("value"))), F.lit(0)).alias("damage"),
        F.coalesce(F.sum(F.when(F.col("kind") == "healing", F.col("value"))), F.lit(0)).alias("healing"))
    coverage = F.col("healing") * 100.0 / F.col("damage")
    return (sums.join(spike, death, "left").filter("damage > 0")
            .withColumn("healing_coverage", coverage)
            .withColumn("preventable", F.when(coverage < 50, "Low healing coverage")
                        .when(F.col("damage_spike") > 100000, "One-shot mechanic").otherwise("Sustained damage")))


def wipe_mechanics(recap: DataFrame, raids: DataFrame, keys: Sequence[str], seconds: float = 5, share: float = 0.5) -> DataFrame:
    """Slices of an encounter, counted from its start, in which at least ``share`` of its players died, with the cause that took part in most deaths.

    ``raids`` has keys, start_ts and players. A player who dies twice in a slice is one dead player.
    """
    since = F.unix_micros("death_ts") - F.unix_micros("start_ts")
    placed = recap.join(raids, list(keys)).withColumn("bucket", F.floor(since / F.lit(seconds * 1e6)))
    slice_ = [*keys, "bucket"]
    dead = placed.groupBy(*slice_).agg(F.count_distinct("guid").alias("dead"), F.max("players").alias("players"))
    common = (death_causes(placed, slice_).groupBy(*slice_, "cause").agg(F.count_distinct("guid").alias("killed"))
              .groupBy(*slice_).agg(F.max(F.struct("killed", "cause")).alias("m")))
    return dead.filter(F.col("dead") >= F.col("players") * share).join(common, slice_).select(
        *slice_, "dead", "players", F.col("m.cause").alias("cause"), F.col("m.killed").alias("killed"))


def survival_issues(recap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per character: damage and healing before its deaths, averages, deficit and the worst cause."""
    who = [*keys, "guid"]
    totals = recap.groupBy(*who).agg(
        F.count_distinct("death_id").alias("deaths"),
        F.coalesce(F.sum(F.when(F.col("kind") == "damage", F.col("value"))), F.lit(0)).alias("damage"),
        F.coalesce(F.sum(F.when(F.col("kind") == "healing", F.col("value"))), F.lit(0)).alias("healing"))
    worst = (recap.filter(F.col("kind") == "damage").groupBy(*who, "cause").agg(F.sum("value").alias("v"))
             .groupBy(*who).agg(F.max(F.struct("v", "cause")).alias("w")))
    return totals.join(worst, who, "left").select(
        *who, "deaths", "damage", "healing", (F.col("damage") / F.col("deaths")).alias("avg_damage"),
        (F.col("healing") / F.col("deaths")).alias("avg_healing"),
        ((F.col("damage") - F.col("healing")) / F.col("deaths")).alias("deficit"), F.col("w.cause").alias("top_cause"))


# --- time buckets and rankings ---------------------------------------------------------------------

def timeline_buckets(rows: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Damage, healing and deaths per character and time bucket since the encounter start."""
    bucket = F.floor(F.col("relative_time") / seconds).alias("bucket")
    return rows.groupBy(*keys, bucket, "guid").agg(
        _sum("damage_done", "amount").alias("damage"), _sum("healing_done", effective()).alias("healing"),
        _count("death").alias("deaths"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark keeps at most ``n`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def rate_rankings(characters: DataFrame, total: str, rate: str, combat_rate: str) -> DataFrame:
    """Characters with a positive total, by combat rate when combat time exists, else by plain rate."""
    value = F.when(F.col(combat_rate) > 0, F.col(combat_rate)).otherwise(F.col(rate))
    efficiency = C.ratio(F.col("healing_done") * 100.0, F.col("healing_done") + F.col("overhealing"))
    return (characters.filter(F.col(total) > 0)
            .withColumn("value", value).withColumn("heal_efficiency", efficiency))


def player_statistics(events: DataFrame, metric: str) -> DataFrame:
    kind = F.col("event_type")
    who, test, value = {
        "damage": ("source_name", kind.isin(C.DAMAGE_LIKE), F.sum("amount")),
        "healing": ("source_name", kind.isin(C.HEAL_LIKE), F.sum(effective())),
        "deaths": ("dest_name", kind == "UNIT_DIED", F.count("*")),
    }[metric]
    return events.filter(test).groupBy(F.col(who).alias("player")).agg(value.alias("value"))


def window_width(first: Column, last: Column) -> Column:
    """Seconds of a bucket chosen from the span: 0 (raw) up to a day, 10 minutes up to a week, else an hour."""
    days = seconds_between(first, last) / 86400.0
    return F.when(days > 7, 3600).when(days > 1, 600).otherwise(0)


def aggregate_window(events: DataFrame, every: str, keys: Sequence[str], value: str) -> DataFrame:
    """Sum, mean and count per tumbling window; empty windows are absent."""
    return (events.groupBy(F.window("ts", every).alias("w"), *keys)
            .agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), *keys, "total", "mean", "n"))


def aggregate_auto(events: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """Mean and count of ``value`` per key in windows whose width follows the key's own time span; rows of a short span stay single.

    Spans are one row per key, joined to the events; a busy key is split by the adaptive skew join and summed up before the shuffle.
    """
    spans = events.groupBy(*keys).agg(window_width(F.min("ts"), F.max("ts")).alias("width"))
    at, width = F.unix_micros("ts"), F.col("width").cast("long") * 1_000_000
    placed = join_keys(events, spans, keys).withColumns({
        "window_us": F.when(F.col("width") == 0, at).otherwise(at - F.pmod(at, F.greatest(width, F.lit(1)))), "row_id": F.when(F.col("width") == 0, F.col(row_id))})
    return placed.groupBy(*keys, "width", "window_us", "row_id").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def encounter_totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Damage, healing and distinct players for any grouping (players of either side)."""
    kind = F.col("event_type")
    damage, heal = kind.isin(C.DAMAGE_LIKE), kind.isin(C.HEAL_LIKE)
    total = events.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(damage, F.col("amount"))), F.lit(0)).alias("damage"),
        F.coalesce(F.sum(F.when(heal, effective())), F.lit(0)).alias("healing"))
    people = (events.select(*keys, F.explode(F.array("source_guid", "dest_guid")).alias("guid"))
              .filter(C.entity_kind(F.col("guid")) == "Player").distinct()
              .groupBy(*keys).agg(F.count("*").alias("players")))
    return total.join(people, list(keys), "left").withColumn("players", F.coalesce("players", F.lit(0)))


def resource_usage(events: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Resource gained and drained per power type and time bucket."""
    gain = F.col("event_type").contains("_ENERGIZE")
    drain = F.col("event_type").contains("_DRAIN") | F.col("event_type").contains("_LEECH")
    bucket = F.floor(F.unix_micros("ts") / F.lit(seconds * 1e6)).alias("bucket")
    return (events.filter(gain | drain).groupBy(*keys, bucket, C.label(F.col("power_type"), L.POWER_TYPES, "Unknown Power").alias("power"))
            .agg(F.coalesce(F.sum(F.when(gain, F.col("amount"))), F.lit(0)).alias("gained"),
                 F.coalesce(F.sum(F.when(drain, F.col("amount"))), F.lit(0)).alias("drained"), F.count("*").alias("uses")))


def cooldown_usage(rows: DataFrame, spells: dict[int, str], keys: Sequence[str]) -> DataFrame:
    """Uses of listed spells per player with first and last time."""
    hit = rows.filter(F.col("spell_id").isin(list(spells)))
    return hit.groupBy(*keys, C.label(F.col("spell_id"), spells, "Unknown").alias("cooldown")).agg(
        F.count("*").alias("uses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
