"""Row-level classification as Catalyst expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import lookups as L


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def label(value: Column, names: Mapping[int, str], unknown: str) -> Column:
    """Name of an id from a fixed table, or ``<unknown> (id)``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value.cast("int")),
                      F.concat(F.lit(f"{unknown} ("), value.cast("string"), F.lit(")")))


def difficulty_name(value: Column) -> Column:
    return label(value, L.DIFFICULTY_NAMES, "Unknown")


def spec_name(value: Column) -> Column:
    return label(value, {k: v[1] for k, v in L.SPECS.items()}, "Unknown Spec")


def class_name(value: Column) -> Column:
    return label(value, {k: v[0] for k, v in L.SPECS.items()}, "Unknown Class")


def affix_name(value: Column) -> Column:
    return label(value, L.AFFIXES, "Unknown Affix")


def slot_name(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in L.SLOTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value.cast("int")),
                      F.concat(F.lit("Unknown_"), value.cast("string")))


def entity_kind(guid: Column) -> Column:
    """Player, Pet, Creature or Vehicle from the guid prefix; None for the null guid."""
    prefix = F.substring_index(guid, "-", 1)
    empty = guid.isNull() | (guid == "") | (guid == "0000000000000000")
    return (F.when(empty, "None")
            .when(prefix.isin("Player", "Pet", "Creature", "Vehicle"), prefix)
            .otherwise("Other"))


def name_parts(full: Column) -> Column:
    """Struct(name, server, region) of ``Name[-Server[-Region]]``; extra dashes stay in the name."""
    parts = F.split(full, "-")
    n = F.size(parts)
    empty = F.lit(None).cast("string")
    return F.struct(
        F.when(n <= 1, full).when(n <= 3, parts[0])
        .otherwise(F.concat_ws("-", F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))))).alias("name"),
        F.when(n == 2, F.element_at(parts, -1)).when(n >= 3, F.try_element_at(parts, F.lit(-2)))
        .otherwise(empty).alias("server"),
        F.when(n >= 3, F.element_at(parts, -1)).otherwise(empty).alias("region"))


def full_name(name: Column, server: Column, region: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws("-", name, F.when(server != blank, server),
                       F.when((server != blank) & (region != blank), region))


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(F.trim(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def is_region(code: Column) -> Column:
    return F.upper(code).isin(L.REGIONS)


def effective_healing(amount: Column, overhealing: Column) -> Column:
    return F.greatest(F.lit(0), amount - F.coalesce(overhealing, F.lit(0)))


def is_buff(aura_type: Column, spell_id: Column, source: Column, dest: Column) -> Column:
    players = source.startswith("Player-") & dest.startswith("Player-")
    return (F.when(aura_type.isNotNull() & (aura_type != ""), aura_type == "BUFF")
            .when(spell_id.isin(L.MAJOR_BUFFS), True)
            .otherwise(F.coalesce(players, F.lit(False))))


def detect_role(spec_id: Column, damage: Column, healing: Column) -> Column:
    return (F.when(spec_id.isin(L.TANK_SPECS), "tank")
            .when(spec_id.isin(L.HEALER_SPECS), "healer")
            .when(healing > damage * 2, "healer").otherwise("dps"))


def fight_type(difficulty_id: Column, threshold: int | None = None) -> Column:
    """raid or dungeon boss. ``threshold`` treats every id at or above it as raid."""
    raid = difficulty_id >= threshold if threshold is not None else difficulty_id.isin(L.RAID_DIFFICULTIES)
    return F.when(raid, "raid_boss").otherwise("dungeon_boss")


def has_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def is_combat(event_type: Column, types: Sequence[str] = L.COMBAT_TYPES,
              suffixes: Sequence[str] = L.COMBAT_SUFFIXES) -> Column:
    return event_type.isin(list(types)) | has_any(event_type, suffixes)


def timeline_category(event_type: Column, spell_name: Column) -> Column:
    spell = F.lower(F.coalesce(spell_name, F.lit("")))
    return (F.when(event_type.isin("UNIT_DIED", "UNIT_DESTROYED"), "death")
            .when(has_any(event_type, ["ENCOUNTER_", "CHALLENGE_MODE_", "BOSS_", "MECHANIC_"]), "boss_mechanic")
            .when(has_any(spell, L.COOLDOWN_WORDS), "major_cooldown")
            .when(event_type.contains("_DAMAGE"), "damage")
            .when(event_type.contains("_HEAL"), "healing")
            .when(event_type.contains("_AURA_"), "buff_debuff")
            .when(event_type.contains("_CAST_"), "cast")
            .when(event_type.contains("INTERRUPT"), "interrupt")
            .when(has_any(event_type, ["DISPEL", "STOLEN"]), "dispel")
            .when(has_any(event_type, ["MOVE", "POSITION"]), "movement")
            .otherwise("other"))


def importance(event_type: Column, amount: Column, source_guid: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in L.IMPORTANCE.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, event_type), F.lit(1))
    scaled = has_any(event_type, ["_DAMAGE", "_HEAL"])
    size = F.when(scaled & (amount > 50000), 2).when(scaled & (amount > 20000), 1).otherwise(0)
    player = F.coalesce(source_guid.startswith("Player-").cast("int"), F.lit(0))
    return F.least(F.lit(5), base + size + player)


def describe(event_type: Column, source: Column, dest: Column, spell: Column, amount: Column) -> Column:
    """A sentence about the event, amounts with thousands separators."""
    number = F.format_number(amount, 0)
    known = F.coalesce((spell != "") & (spell != "Unknown"), F.lit(False))
    who, whom = F.coalesce(source, F.lit("Unknown")), F.coalesce(dest, F.lit("Unknown"))
    w = F.concat
    s = F.lit
    return (F.when(event_type == "UNIT_DIED", w(whom, s(" died")))
            .when(event_type.contains("_DAMAGE"),
                  w(who, s(" dealt "), number, s(" damage to "), whom, F.when(known, w(s(" with "), spell)).otherwise("")))
            .when(event_type.contains("_HEAL"),
                  w(who, s(" healed "), whom, s(" for "), number, F.when(known, w(s(" with "), spell)).otherwise("")))
            .when(event_type.contains("AURA_APPLIED"), w(F.when(known, spell).otherwise("Buff"), s(" applied to "), whom))
            .when(event_type.contains("AURA_REMOVED"), w(F.when(known, spell).otherwise("Buff"), s(" removed from "), whom))
            .when(event_type.contains("CAST_SUCCESS"), w(who, s(" cast "), F.when(known, spell).otherwise("spell")))
            .when(event_type.contains("INTERRUPT"), w(who, s(" interrupted "), whom))
            .otherwise(w(event_type, s(": "), who, s(" -> "), whom)))


def clock(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), (whole % 60))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, or 0 when the divisor is zero, negative or missing."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def encounter_key(guild: Column, start: Column, name: Column) -> Column:
    """Deterministic key, so a rerun writes the same rows."""
    return F.concat_ws("_", guild.cast("string"), F.unix_millis(start).cast("string"),
                       F.substring(F.sha2(name, 256), 1, 8))


# --- one row per affected character (role expansion) ------------------------------------------

DAMAGE_LIKE = ["SWING_DAMAGE", "SWING_DAMAGE_LANDED", "SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE",
               "RANGE_DAMAGE", "ENVIRONMENTAL_DAMAGE", "SPELL_BUILDING_DAMAGE", "DAMAGE_SPLIT", "DAMAGE_SHIELD"]
HEAL_LIKE = ["SPELL_HEAL", "SPELL_PERIODIC_HEAL", "SPELL_BUILDING_HEAL"]


def categorize(events: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Unfold each event to (guid, category) rows for every character it concerns.

    ``tracked`` (column ``guid``, unique) keeps known participants only. Source and dest
    columns should already hold owners instead of pets (see ``sequence.resolve_owner``).
    """
    t = F.col("event_type")
    good = is_buff(F.col("aura_type"), F.col("spell_id"), F.col("source_guid"), F.col("dest_guid"))
    kind = F.when(good, "buff").otherwise("debuff")
    src = (F.when(t.isin(DAMAGE_LIKE), "damage_done")
           .when(t.isin(HEAL_LIKE), "healing_done")
           .when(t == "SPELL_CAST_START", "cast_started")
           .when(t == "SPELL_CAST_SUCCESS", "cast_succeeded")
           .when(t == "SPELL_CAST_FAILED", "cast_failed")
           .when(t == "SPELL_INTERRUPT", "interrupt_done")
           .when(t == "SPELL_DISPEL", "dispel_done"))
    dst = (F.when(t.isin(DAMAGE_LIKE), "damage_taken")
           .when(t.isin(HEAL_LIKE), "healing_received")
           .when(t == "SPELL_AURA_REFRESH", F.concat(kind, F.lit("_refreshed")))
           .when(t.isin("SPELL_AURA_APPLIED", "SPELL_AURA_APPLIED_DOSE"), F.concat(kind, F.lit("_gained")))
           .when(t.isin("SPELL_AURA_REMOVED", "SPELL_AURA_REMOVED_DOSE"), F.concat(kind, F.lit("_lost")))
           .when(t == "UNIT_DIED", "death")
           .when(t == "SPELL_RESURRECT", "resurrected")
           .when(t == "SPELL_INTERRUPT", "interrupt_received")
           .when((t == "SPELL_ABSORBED") & (F.col("amount") > 0), "damage_absorbed_for_me"))
    pairs = [F.struct(F.col("source_guid").alias("guid"), src.alias("category")),
             F.struct(F.col("dest_guid").alias("guid"), dst.alias("category"))]
    if "absorber_guid" in events.columns:
        shield = F.when((t == "SPELL_ABSORBED") & (F.col("amount") > 0), "damage_absorbed_by_shield")
        pairs.append(F.struct(F.col("absorber_guid").alias("guid"), shield.alias("category")))
    rows = (events.withColumn("__role", F.explode(F.array(*pairs)))
            .select("*", "__role.guid", "__role.category").drop("__role")
            .filter(F.col("category").isNotNull() & F.col("guid").isNotNull() & (F.col("guid") != "")))
    return rows.join(tracked.select("guid"), "guid", "left_semi") if tracked is not None else rows
