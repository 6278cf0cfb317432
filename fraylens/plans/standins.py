"""Maps the given tables to the canonical combat schema, so one implementation serves both.

events: user = actor, purchase = damage, view = heal, click = cast, error = death,
signup = resurrection, ``props.k`` = spell id, value x 100 = amount, calendar day = encounter.
customer = character (segment = class, nation = guild), orders = encounter, lineitem = metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.plans.catalog import Tables


def spell_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def combat_events(t: Tables) -> DataFrame:
    return combat_view(t.events)


def combat_view(e: DataFrame) -> DataFrame:
    raw, user, k = F.col("event_type"), F.col("user_id"), F.col("spell_id")
    e = e.withColumn("spell_id", spell_of(F.col("props"))).withColumn(
        "amount", F.round(F.col("value") * 100).cast("long"))
    own = raw.isin("error", "signup")
    creature = (raw == "purchase") & (k % 2 == 0)
    other = ((user + k) % 40).cast("string")

    def target(player: str, npc: str) -> Column:
        return (F.when(own, F.concat(F.lit(player), user.cast("string")))
                .when(creature, F.concat(F.lit(npc), (k % 7).cast("string")))
                .otherwise(F.concat(F.lit(player), other)))

    return e.select(
        F.col("event_id").alias("line_no"), "ts", "user_id", (user % 5 + 1).alias("guild_id"),
        "spell_id", "amount", F.concat(F.lit("Spell "), k.cast("string")).alias("spell_name"),
        F.when(raw == "purchase", "SPELL_DAMAGE").when(raw == "view", "SPELL_HEAL")
        .when(raw == "click", "SPELL_CAST_SUCCESS").when(raw == "error", "UNIT_DIED")
        .otherwise("SPELL_RESURRECT").alias("event_type"),
        F.concat(F.lit("Player-"), user.cast("string")).alias("source_guid"),
        F.concat(F.lit("P"), user.cast("string")).alias("source_name"),
        target("Player-", "Creature-").alias("dest_guid"), target("P", "C").alias("dest_name"),
        F.when((raw == "view") & (k % 3 == 0), F.floor(F.col("amount") / 5)).otherwise(F.lit(0)).alias("overhealing"),
        F.when((raw == "purchase") & (k % 5 == 0), F.floor(F.col("amount") / 10)).otherwise(F.lit(0)).alias("overkill"),
        (k % 4 == 0).alias("critical"), F.lit(None).cast("string").alias("aura_type"),
        F.floor(F.unix_micros("ts") / F.lit(86400000000.0)).alias("encounter_key"))


def us(column: str | Column) -> Column:
    return F.unix_micros(column)
