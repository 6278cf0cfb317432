"""Combat metrics over the stand-in event stream and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.functions import lookups as L
from fraylens.operators import metrics as M
from fraylens.operators import sequence as S
from fraylens.plans.catalog import Tables, query
from fraylens.plans.rows import ENC, encounters, numbers, timeline_columns, CATEGORY_SQL, IMPORTANCE_SQL, DESCRIBE_SQL, description
from fraylens.plans.sequences import COMBAT_SQL, RECAP, ROLES, role_rows, user_recap
from fraylens.plans.standins import combat_events, us

KEY = ["encounter_key"]

CHARS = f"""r0 AS (
  SELECT *, source_guid AS guid, CASE event_type WHEN 'SPELL_DAMAGE' THEN 'damage_done' WHEN 'SPELL_HEAL' THEN 'healing_done'
    WHEN 'SPELL_CAST_SUCCESS' THEN 'cast_succeeded' END AS category FROM ev
  UNION ALL
  SELECT *, dest_guid, CASE event_type WHEN 'SPELL_DAMAGE' THEN 'damage_taken' WHEN 'SPELL_HEAL' THEN 'healing_received'
    WHEN 'UNIT_DIED' THEN 'death' WHEN 'SPELL_RESURRECT' THEN 'resurrected' END FROM ev),
rr AS (SELECT * FROM r0 WHERE category IS NOT NULL AND guid LIKE 'Player-%'),
cb AS (SELECT encounter_key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY encounter_key ORDER BY ts)) <= 300000000 THEN 0 ELSE 1 END AS opens FROM ev WHERE {COMBAT_SQL}),
cn AS (SELECT encounter_key, ts, sum(opens) OVER (PARTITION BY encounter_key ORDER BY ts) AS idx FROM cb),
pr AS (SELECT encounter_key, idx, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM cn GROUP BY 1, 2),
spans AS (SELECT encounter_key, duration, combat_time FROM (SELECT encounter_key, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM ev GROUP BY 1)
   JOIN (SELECT encounter_key, sum(d) AS combat_time FROM pr GROUP BY 1) USING (encounter_key)),
cm0 AS (SELECT encounter_key, guid,
   CAST(coalesce(sum(amount) FILTER (category = 'damage_done'), 0) AS BIGINT) AS damage_done,
   CAST(coalesce(sum(overkill) FILTER (category = 'damage_done' AND overkill > 0), 0) AS BIGINT) AS overkill_done,
   CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (category = 'healing_done'), 0) AS BIGINT) AS healing_done,
   CAST(coalesce(sum(overhealing) FILTER (category = 'healing_done'), 0) AS BIGINT) AS overhealing,
   CAST(coalesce(sum(amount) FILTER (category = 'damage_taken'), 0) AS BIGINT) AS damage_taken,
   CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (category = 'healing_received'), 0) AS BIGINT) AS healing_received,
   count(*) FILTER (category = 'cast_succeeded') AS casts, CAST(0 AS BIGINT) AS interrupts, CAST(0 AS BIGINT) AS dispels,
   count(*) FILTER (category = 'death') AS deaths, count(*) AS total_events FROM rr GROUP BY 1, 2),
cm AS (SELECT cm0.*, round_even(damage_done / duration, 2) AS dps, round_even(healing_done / duration, 2) AS hps, damage_taken / duration AS dtps,
   CASE WHEN combat_time > 0 THEN round_even(damage_done / combat_time, 2) ELSE 0 END AS combat_dps,
   CASE WHEN combat_time > 0 THEN round_even(healing_done / combat_time, 2) ELSE 0 END AS combat_hps,
   CASE WHEN healing_done > 2 * damage_done THEN 'healer' ELSE 'dps' END AS role FROM cm0 JOIN spans USING (encounter_key))"""


def spans(t: Tables):
    e = combat_events(t)
    whole = e.groupBy(*KEY).agg(S.seconds_between(F.min("ts"), F.max("ts")).alias("duration"))
    fought = S.combat_periods(e, KEY, 300.0, 3600.0).groupBy(*KEY).agg(F.sum("duration").alias("combat_time"))
    return whole.join(fought, KEY, "left")


def characters(t: Tables):
    c = M.character_metrics(role_rows(t), spans(t), KEY)
    none = F.lit(None).cast("int")
    return c.withColumn("role", C.detect_role(none, F.col("damage_done"), F.col("healing_done")))


@query("a01_combatant_metrics", f"""WITH {{EV}}, {CHARS}
SELECT guid, CAST(sum(damage_done) AS BIGINT) AS damage_done, CAST(sum(healing_done) AS BIGINT) AS healing_done, CAST(sum(damage_taken) AS BIGINT) AS damage_taken,
  CAST(sum(healing_received) AS BIGINT) AS healing_received, CAST(sum(casts) AS BIGINT) AS casts, CAST(sum(deaths) AS BIGINT) AS deaths FROM cm0 GROUP BY 1""")
def _(t: Tables):
    m = M.combatant_metrics(role_rows(t), ["guid"])
    return m.select("guid", "damage_done", "healing_done", "damage_taken", "healing_received", "casts", "deaths")


@query("a02_spell_totals", """WITH {EV}
SELECT spell_id, count(*) FILTER (event_type = 'SPELL_CAST_SUCCESS') AS casts, count(*) FILTER (event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL')) AS hits,
  CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS damage,
  CAST(coalesce(sum(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS healing FROM ev GROUP BY 1""")
def _(t: Tables):
    return M.spell_totals(combat_events(t))


@query("a02_summary", """WITH {EV}
SELECT count(*) AS events, count(DISTINCT spell_id) AS unique_spells, count(DISTINCT source_guid) AS sources,
  CAST(sum(amount) FILTER (event_type = 'SPELL_DAMAGE') AS BIGINT) AS damage FROM ev""")
def _(t: Tables):
    e = combat_events(t)
    return e.agg(F.count("*").alias("events"), F.count_distinct("spell_id").alias("unique_spells"),
                 F.count_distinct("source_guid").alias("sources"),
                 F.sum(F.when(F.col("event_type") == "SPELL_DAMAGE", F.col("amount"))).alias("damage"))


@query("a03_character_metrics", f"""WITH {{EV}}, {CHARS}
SELECT encounter_key, guid, damage_done, overkill_done, healing_done, overhealing, damage_taken, healing_received, casts, interrupts, dispels, deaths, total_events,
  dps, hps, round(dtps, 6) AS dtps, combat_dps, combat_hps FROM cm""")
def _(t: Tables):
    return characters(t).drop("role").withColumn("dtps", F.round("dtps", 6))


@query("a03_character_metrics_alive", f"""WITH {{EV}}, {CHARS}
SELECT encounter_key, guid, round_even(damage_done / greatest(total_events * 61.7::DOUBLE, 1), 2) AS dps, round_even(healing_done / greatest(total_events * 61.7::DOUBLE, 1), 2) AS hps FROM cm""")
def _(t: Tables):
    rows = role_rows(t)
    alive = rows.groupBy(*KEY, "guid").agg((F.count("*") * 61.7).alias("time_alive")).withColumn("combat_time", F.lit(0.0))
    return M.character_metrics(rows, alive, KEY, per="alive").select(*KEY, "guid", "dps", "hps")


def ability_sql(category: str, value: str) -> str:
    return f"""WITH {{EV}}, {CHARS},
ab AS (SELECT encounter_key, guid, spell_id, CAST(sum({value}) AS BIGINT) AS total, CAST(sum(amount) AS BIGINT) AS raw_total, count(*) AS hits,
   count(*) FILTER (critical) AS crits, max({value}) AS max_hit FROM rr WHERE category = '{category}' GROUP BY 1, 2, 3)
SELECT *, round(total * 100.0 / sum(total) OVER (PARTITION BY encounter_key, guid), 6) AS percentage, round(raw_total / hits, 6) AS average_hit,
  round(crits * 100.0 / hits, 6) AS crit_rate FROM ab"""


def abilities(t: Tables, category: str):
    a = M.ability_breakdown(role_rows(t), category, [*KEY, "guid"])
    return a.withColumns({c: F.round(c, 6) for c in ("percentage", "average_hit", "crit_rate")})


@query("a04_damage_abilities", ability_sql("damage_done", "amount"))
def _(t: Tables):
    return abilities(t, "damage_done")


@query("a04_healing_abilities", ability_sql("healing_done", "greatest(0, amount - overhealing)"))
def _(t: Tables):
    return abilities(t, "healing_done")


@query("a04_damage_taken_abilities", ability_sql("damage_taken", "amount"))
def _(t: Tables):
    return abilities(t, "damage_taken")


@query("a05_spell_summary", """WITH {EV}
SELECT encounter_key, source_guid, spell_id, count(*) FILTER (event_type = 'SPELL_CAST_SUCCESS') AS cast_count,
  count(*) FILTER (event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL')) AS hit_count, count(*) FILTER (critical AND event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL')) AS crit_count,
  CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS total_damage,
  CAST(coalesce(sum(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS total_healing,
  coalesce(max(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS max_damage, coalesce(max(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS max_healing
FROM ev GROUP BY 1, 2, 3""")
def _(t: Tables):
    return M.spell_summary(combat_events(t), [*KEY, "source_guid"])


@query("a06_encounter_metrics", f"""WITH {{EV}}, {CHARS}
SELECT encounter_key, CAST(sum(damage_done) AS BIGINT) AS total_damage, CAST(sum(healing_done) AS BIGINT) AS total_healing, CAST(sum(overhealing) AS BIGINT) AS total_overhealing,
  CAST(sum(deaths) AS BIGINT) AS total_deaths, count(*) AS player_count, CAST(0 AS BIGINT) AS tanks, count(*) FILTER (role = 'healer') AS healers, count(*) FILTER (role = 'dps') AS dpss,
  round(sum(damage_done) / any_value(duration), 6) AS raid_dps, round(sum(healing_done) / any_value(duration), 6) AS raid_hps,
  round(sum(damage_done) / any_value(combat_time), 6) AS combat_raid_dps, round(sum(healing_done) / any_value(combat_time), 6) AS combat_raid_hps,
  round(any_value(combat_time) * 100 / any_value(duration), 6) AS combat_percentage FROM cm JOIN spans USING (encounter_key) GROUP BY 1""")
def _(t: Tables):
    m = M.encounter_metrics(characters(t), spans(t), KEY)
    rates = ["raid_dps", "raid_hps", "combat_raid_dps", "combat_raid_hps", "combat_percentage"]
    return m.withColumns({c: F.round(c, 6) for c in rates})


@query("a07_participants", """WITH {EV}, u AS (SELECT encounter_key, ts, source_guid AS guid, source_name AS name FROM ev UNION ALL SELECT encounter_key, ts, dest_guid, dest_name FROM ev)
SELECT encounter_key, guid, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, max(name) AS name, guid LIKE 'Player-%' AS is_player, false AS is_pet FROM u GROUP BY 1, 2""")
def _(t: Tables):
    p = M.participants(combat_events(t), KEY)
    return p.select(*KEY, "guid", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "name", "is_player", "is_pet")


@query("a08_npc_metrics", """WITH {EV}
SELECT encounter_key, dest_guid AS guid, CAST(0 AS BIGINT) AS damage_done, CAST(sum(amount) AS BIGINT) AS damage_taken, CAST(0 AS BIGINT) AS healing_done,
  count(DISTINCT spell_id) AS abilities, CAST(0 AS BIGINT) AS deaths FROM ev WHERE dest_guid LIKE 'Creature-%' GROUP BY 1, 2""")
def _(t: Tables):
    return M.npc_metrics(combat_events(t), KEY)


@query("a09_mplus_run", """WITH s AS (SELECT l_orderkey, count(*) AS segments, CAST(sum(l_linenumber % 3) AS BIGINT) AS deaths, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS damage,
   max(o_orderdate + to_minutes(CAST(l_quantity AS BIGINT))) AS last_seg FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT o_orderkey, o_orderdate AS st, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_orderdate + to_minutes(o_orderkey % 45 + 5) END AS en,
   CASE o_orderkey % 8 WHEN 0 THEN o_orderdate + INTERVAL 3 HOUR WHEN 4 THEN o_orderdate + INTERVAL 50 MINUTE END AS lc FROM orders),
x AS (SELECT o_orderkey, coalesce(segments, 0) AS segments, coalesce(damage, 0) AS damage, coalesce(deaths, 0) AS deaths,
   (epoch_us(coalesce(en, CASE WHEN epoch_us(lc) - epoch_us(st) < 7200000000 THEN lc ELSE coalesce(last_seg, st + INTERVAL 1 MINUTE) END)) - epoch_us(st)) / 1e6 AS actual_seconds, en IS NULL AS abandoned
   FROM r LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, segments, damage, deaths, actual_seconds, 1800 - actual_seconds AS time_remaining, actual_seconds <= 1800 AS in_time, deaths * 5.0::DOUBLE AS penalty_seconds, abandoned FROM x""")
def _(t: Tables):
    def later(mins):
        return F.col("o_orderdate") + F.make_dt_interval(mins=mins.cast("int"))
    k = F.col("o_orderkey")
    o = t.orders
    seg = t.lineitem.join(o, F.col("l_orderkey") == k).select(
        "o_orderkey", later(F.col("l_quantity")).alias("end_ts"), (F.col("l_linenumber") % 3).alias("deaths"),
        F.col("l_quantity").cast("long").alias("damage"))
    runs = o.select(
        "o_orderkey", F.col("o_orderdate").alias("start_ts"), F.when(k % 4 != 0, later(k % 45 + 5)).alias("end_ts"),
        F.when(k % 8 == 0, later(F.lit(180))).when(k % 8 == 4, later(F.lit(50))).alias("last_combat_ts"), F.lit(1800.0).alias("time_limit"))
    return M.mplus_run(seg, runs, "o_orderkey")


@query("a10_segment_mobs", """WITH {EV} SELECT encounter_key, guild_id, count(*) FILTER (event_type = 'UNIT_DIED') AS mobs, max(spell_id) - min(spell_id) AS forces_gained FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    e = combat_events(t).withColumns({"enemy_death": F.col("event_type") == "UNIT_DIED", "forces": F.col("spell_id")})
    return M.segment_mobs(e, [*KEY, "guild_id"])


@query("a11_raid_mechanics", """WITH {EV}
SELECT encounter_key, guild_id, count(*) FILTER (spell_id % 20 = 0 AND event_type = 'SPELL_CAST_SUCCESS') > 0 AS bloodlust_used,
  epoch_us(min(ts) FILTER (spell_id % 20 = 0 AND event_type = 'SPELL_CAST_SUCCESS')) AS bloodlust_us,
  count(*) FILTER (spell_id % 20 = 1 AND event_type = 'SPELL_CAST_SUCCESS') AS battle_res_count FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    k = F.col("spell_id") % 20
    e = combat_events(t).withColumn("spell_id", F.when(k == 0, 2825).when(k == 1, 20484).otherwise(1))
    m = M.raid_mechanics(e, [*KEY, "guild_id"])
    return m.select(*KEY, "guild_id", "bloodlust_used", us("bloodlust_ts").alias("bloodlust_us"), "battle_res_count")


@query("a12_raid_composition", """WITH r AS (SELECT DISTINCT o_orderpriority, c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'tank' WHEN 'HOUSEHOLD' THEN 'healer' ELSE 'dps' END AS role FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderpriority, count(*) FILTER (role = 'tank') AS tank, count(*) FILTER (role = 'healer') AS healer, count(*) FILTER (role = 'dps') AS dps, count(*) AS raid_size FROM r GROUP BY 1""")
def _(t: Tables):
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "tank").when(F.col("c_mktsegment") == "HOUSEHOLD", "healer").otherwise("dps")
    members = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderpriority", F.concat(F.lit("Player-"), F.col("c_custkey").cast("string")).alias("guid"), role.alias("role"))
    return M.raid_composition(members, ["o_orderpriority"])


@query("a13_survival_stats", f"""WITH {{EV}}, {CHARS}
SELECT encounter_key, CAST(sum(deaths) AS BIGINT) AS total_deaths, count(*) FILTER (deaths > 0) AS players_died, round(sum(deaths) / count(*), 8) AS death_rate,
  round(count(*) FILTER (deaths = 0) / count(*), 8) AS survival_rate FROM cm0 GROUP BY 1""")
def _(t: Tables):
    s = M.survival_stats(M.combatant_metrics(role_rows(t), [*KEY, "guid"]), KEY)
    return s.withColumns({c: F.round(c, 8) for c in ("death_rate", "survival_rate")})


@query("a13_most_deaths", f"""WITH {{EV}}, {CHARS} SELECT guid, CAST(sum(deaths) AS BIGINT) AS deaths FROM cm0 GROUP BY 1 HAVING sum(deaths) > 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t: Tables):
    m = M.combatant_metrics(role_rows(t), ["guid"]).filter("deaths > 0")
    return m.orderBy(F.desc("deaths"), "guid").limit(10).select("guid", "deaths")


@query("a14_fight_trends", f"""WITH {ENC}
SELECT encounter_type, difficulty, count(*) AS fights, count(*) FILTER (success) AS kills, round(avg(duration) FILTER (success), 6) AS avg_duration_success,
  round(avg(duration) FILTER (NOT success), 6) AS avg_duration_wipe, round(count(*) FILTER (success) / count(*), 8) AS success_rate
FROM enc GROUP BY GROUPING SETS ((encounter_type), (difficulty), ())""")
def _(t: Tables):
    f = M.fight_trends(encounters(t))
    return f.withColumns({"avg_duration_success": F.round("avg_duration_success", 6), "avg_duration_wipe": F.round("avg_duration_wipe", 6),
                          "success_rate": F.round("success_rate", 8)})


@query("a15_fight_efficiency", f"""WITH {{EV}}, {CHARS}
SELECT encounter_key, round(sum(damage_done) / (count(*) FILTER (damage_done > 0) * any_value(combat_time)), 8) AS avg_dps_per_player,
  round(sum(healing_done) / sum(healing_done + overhealing), 8) AS healing_efficiency, round(avg(total_events * 2.0), 6) AS avg_activity,
  round((count(*) - sum(deaths)) / count(*), 8) AS survival_rate FROM cm JOIN spans USING (encounter_key) GROUP BY 1""")
def _(t: Tables):
    c = characters(t).withColumn("activity_percentage", F.col("total_events") * 2.0)
    e = M.fight_efficiency(c, spans(t), KEY)
    return e.select(*KEY, *[F.round(x, 8).alias(x) for x in ("avg_dps_per_player", "healing_efficiency", "survival_rate")],
                    F.round("avg_activity", 6).alias("avg_activity"))


@query("a16_segmentation_stats", """SELECT o_orderpriority AS encounter_type, count(*) AS fights, count(*) FILTER (o_orderstatus = 'F') AS kills,
  count(*) FILTER (o_orderstatus = 'O') AS wipes, count(*) FILTER (o_orderstatus = 'P') AS incomplete FROM orders GROUP BY 1""")
def _(t: Tables):
    s = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    f = t.orders.select(F.col("o_orderpriority").alias("encounter_type"), s.alias("success"))
    return M.outcome_stats(f, ["encounter_type"])


@query("a17_player_totals", """SELECT o_custkey, count(*) AS encounters, round(avg(o_totalprice), 4) AS avg_dps, round(avg(o_orderkey % 100), 4) AS avg_hps, max(o_totalprice) AS best_dps,
  CAST(sum(o_orderkey % 3) AS BIGINT) AS deaths, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 8) AS success_rate,
  round(avg(CASE WHEN o_orderkey % 5 > 0 THEN 600 + o_orderkey % 50 END), 4) AS avg_item_level FROM orders GROUP BY 1""", cents=True)
def _(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_custkey", F.col("o_totalprice").alias("dps"), (k % 100).alias("hps"), (k % 3).alias("deaths"),
                           (F.col("o_orderstatus") == "F").alias("success"), F.when(k % 5 > 0, 600 + k % 50).otherwise(0).alias("item_level"))
    p = M.player_totals(rows, ["o_custkey"])
    return p.withColumns({"avg_dps": F.round("avg_dps", 4), "avg_hps": F.round("avg_hps", 4), "success_rate": F.round("success_rate", 8),
                          "avg_item_level": F.round("avg_item_level", 4)})


@query("a33_player_damage", """WITH {EV} SELECT source_name AS player, CAST(sum(amount) AS BIGINT) AS value FROM ev WHERE event_type = 'SPELL_DAMAGE' GROUP BY 1""")
def _(t: Tables):
    return M.player_statistics(combat_events(t), "damage")


@query("a33_player_healing", """WITH {EV} SELECT source_name AS player, CAST(sum(amount - overhealing) AS BIGINT) AS value FROM ev WHERE event_type = 'SPELL_HEAL' GROUP BY 1""")
def _(t: Tables):
    return M.player_statistics(combat_events(t), "healing")


@query("a33_player_deaths", """WITH {EV} SELECT dest_name AS player, count(*) AS value FROM ev WHERE event_type = 'UNIT_DIED' GROUP BY 1""")
def _(t: Tables):
    return M.player_statistics(combat_events(t), "deaths")


@query("a34_guild_rankings", """WITH {EV}, s AS (SELECT guild_id, source_name, CAST(sum(amount) AS BIGINT) AS total FROM ev WHERE event_type = 'SPELL_DAMAGE' AND spell_id < 60 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY guild_id ORDER BY total DESC, source_name) AS rank FROM s) SELECT * FROM r WHERE rank <= 50""")
def _(t: Tables):
    e = combat_events(t).filter("spell_id < 60 AND event_type = 'SPELL_DAMAGE'")
    s = e.groupBy("guild_id", "source_name").agg(F.sum("amount").alias("total"))
    out = M.top_per_group(s, ["guild_id"], [F.desc("total"), "source_name"], 50)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("a35_aggregate_window", """WITH {EV} SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS window_us, event_type, CAST(sum(amount) AS BIGINT) AS total, round(avg(amount), 6) AS mean, count(*) AS n FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    w = M.aggregate_window(combat_events(t), "6 hours", ["event_type"], "amount")
    return w.select(us("window_start").alias("window_us"), "event_type", "total", F.round("mean", 6).alias("mean"), "n")


@query("a35_auto_width", """WITH {EV}, s AS (SELECT source_guid, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days FROM ev GROUP BY 1)
SELECT source_guid, CASE WHEN days > 7 THEN 3600 WHEN days > 1 THEN 600 ELSE 0 END AS width FROM s""")
def _(t: Tables):
    e = combat_events(t)
    return e.groupBy("source_guid").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "source_guid", M.window_width(F.col("a"), F.col("b")).alias("width"))


@query("a35_auto_windows", """WITH {EV}, s AS (SELECT source_guid, spell_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days FROM ev GROUP BY 1, 2),
x AS (SELECT ev.*, CAST(CASE WHEN days > 7 THEN 3600 WHEN days > 1 THEN 600 ELSE 0 END AS BIGINT) AS width, epoch_us(ts) AS us FROM ev JOIN s USING (source_guid, spell_id))
SELECT source_guid, spell_id, width, CASE WHEN width = 0 THEN us ELSE us // (width * 1000000) * width * 1000000 END AS window_us, CASE WHEN width = 0 THEN line_no END AS row_id,
  round(avg(amount), 6) AS mean, count(*) AS n FROM x GROUP BY ALL""", longs=("width",))
def _(t: Tables):
    return M.aggregate_auto(combat_events(t), ["source_guid", "spell_id"], "amount", "line_no").withColumn("mean", F.round("mean", 6))


@query("a36_encounter_totals", """WITH {EV}, p AS (SELECT guild_id, encounter_key, source_guid AS g FROM ev UNION SELECT guild_id, encounter_key, dest_guid FROM ev),
n AS (SELECT guild_id, encounter_key, count(DISTINCT g) AS players FROM p WHERE g LIKE 'Player-%' GROUP BY 1, 2)
SELECT guild_id, encounter_key, CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS damage,
  CAST(coalesce(sum(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS healing, any_value(players) AS players FROM ev JOIN n USING (guild_id, encounter_key) GROUP BY 1, 2""")
def _(t: Tables):
    return M.encounter_totals(combat_events(t), ["guild_id", "encounter_key"])


@query("a39_deaths_by_character", """WITH {EV} SELECT dest_guid AS guid, count(*) AS deaths FROM ev WHERE event_type = 'UNIT_DIED' GROUP BY 1""")
def _(t: Tables):
    d = role_rows(t).filter("category = 'death'")
    return d.groupBy("guid").agg(F.count("*").alias("deaths"))


@query("a39_top_death_causes", f"""WITH {{EV}}, {RECAP}, c AS (SELECT guid, death_id, cause, sum(value) AS damage FROM recap WHERE kind = 'damage' GROUP BY 1, 2, 3)
SELECT cause, count(*) AS deaths, CAST(sum(damage) AS BIGINT) AS damage FROM c GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def _(t: Tables):
    return M.top_killers(user_recap(t), 10)


@query("a39_death_timeline", f"""WITH {{EV}}, {RECAP}, l AS (SELECT guid, death_id, death_ts, arg_max(cause, (ts, line_no)) AS killing_blow FROM recap WHERE kind = 'damage' GROUP BY 1, 2, 3)
SELECT guid, death_id, epoch_us(death_ts) AS death_us, killing_blow FROM l""")
def _(t: Tables):
    hits = user_recap(t).filter("kind = 'damage'")
    last = hits.groupBy("guid", "death_id", "death_ts").agg(F.max_by("cause", F.struct("ts", "line_no")).alias("killing_blow"))
    return last.select("guid", "death_id", us("death_ts").alias("death_us"), "killing_blow")


BY_ENCOUNTER = ["guild_id", "encounter_key"]
# recaps inside one guild's encounter; ``sp`` has its players and start
ENC_RECAP = """rg AS (SELECT r.*, ev.guild_id FROM rl r JOIN ev USING (line_no)),
dg AS (SELECT guild_id, encounter_key, guid, line_no AS death_id, ts AS death_ts FROM rg WHERE category = 'death'),
pg AS (SELECT d.*, r.line_no, r.ts, CASE category WHEN 'damage_taken' THEN 'damage' ELSE 'healing' END AS kind, source_name || ': ' || spell_name AS cause,
   CASE category WHEN 'damage_taken' THEN amount ELSE greatest(0, amount - overhealing) END AS value,
   row_number() OVER (PARTITION BY d.guild_id, d.encounter_key, d.guid, death_id, category ORDER BY r.ts DESC, r.line_no DESC) AS rn
 FROM dg d JOIN rg r ON r.guild_id = d.guild_id AND r.encounter_key = d.encounter_key AND r.guid = d.guid AND (r.ts, r.line_no) < (d.death_ts, d.death_id) AND category IN ('damage_taken', 'healing_received')),
er AS (SELECT * FROM pg WHERE rn <= 10), sp AS (SELECT guild_id, encounter_key, count(DISTINCT guid) AS players, min(ts) AS start_ts FROM rg GROUP BY 1, 2)"""


def encounter_recap(t: Tables):
    return S.death_recap(role_rows(t), [*BY_ENCOUNTER, "guid"], 10)


@query("a39_top_causes_by_encounter", f"""WITH {{EV}}, {ROLES}, {ENC_RECAP}, c AS (SELECT guild_id, encounter_key, guid, death_id, cause, sum(value) AS damage FROM er WHERE kind = 'damage' GROUP BY ALL),
g AS (SELECT guild_id, encounter_key, cause, count(*) AS deaths, CAST(sum(damage) AS BIGINT) AS damage FROM c GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY guild_id, encounter_key ORDER BY deaths DESC, damage DESC, cause) AS rank FROM g QUALIFY rank <= 3""")
def _(t: Tables):
    return M.top_killers(encounter_recap(t), 3, BY_ENCOUNTER).withColumn("rank", F.col("rank").cast("long"))


@query("a40_wipe_mechanics", f"""WITH {{EV}}, {ROLES}, {ENC_RECAP}, x AS (SELECT er.*, players, CAST(floor((epoch_us(death_ts) - epoch_us(start_ts)) / 21600000000) AS BIGINT) AS bucket FROM er JOIN sp USING (guild_id, encounter_key)),
n AS (SELECT guild_id, encounter_key, bucket, count(DISTINCT guid) AS dead, max(players) AS players FROM x GROUP BY ALL),
k AS (SELECT guild_id, encounter_key, bucket, cause, count(DISTINCT guid) AS killed FROM x WHERE kind = 'damage' GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY guild_id, encounter_key, bucket ORDER BY killed DESC, cause DESC) AS rn FROM k)
SELECT guild_id, encounter_key, bucket, dead, players, cause, killed FROM n JOIN m USING (guild_id, encounter_key, bucket) WHERE rn = 1 AND dead >= 0.03 * players""")
def _(t: Tables):
    raids = role_rows(t).groupBy(*BY_ENCOUNTER).agg(F.count_distinct("guid").alias("players"), F.min("ts").alias("start_ts"))
    return M.wipe_mechanics(encounter_recap(t), raids, BY_ENCOUNTER, 21600, 0.03)


@query("a41_survival_by_encounter", f"""WITH {{EV}}, {ROLES}, {ENC_RECAP},
s AS (SELECT guild_id, encounter_key, guid, count(DISTINCT death_id) AS deaths, CAST(coalesce(sum(value) FILTER (kind = 'damage'), 0) AS BIGINT) AS damage,
  CAST(coalesce(sum(value) FILTER (kind = 'healing'), 0) AS BIGINT) AS healing FROM er GROUP BY ALL),
w AS (SELECT guild_id, encounter_key, guid, cause, row_number() OVER (PARTITION BY guild_id, encounter_key, guid ORDER BY sum(value) DESC, cause DESC) AS rn FROM er WHERE kind = 'damage' GROUP BY 1, 2, 3, 4)
SELECT s.guild_id, s.encounter_key, s.guid, deaths, damage, healing, cause AS top_cause FROM s LEFT JOIN w ON w.guild_id = s.guild_id AND w.encounter_key = s.encounter_key AND w.guid = s.guid AND rn = 1""")
def _(t: Tables):
    return M.survival_issues(encounter_recap(t), BY_ENCOUNTER).drop("avg_damage", "avg_healing", "deficit")


@query("w15_damage_spike_by_encounter", f"""WITH {{EV}}, {ROLES}, {ENC_RECAP},
sec AS (SELECT guild_id, encounter_key, guid, death_id, epoch_us(ts) // 1000000 AS s, sum(value) AS v FROM er WHERE kind = 'damage' GROUP BY ALL),
mx AS (SELECT guild_id, encounter_key, guid, death_id, CAST(max(v) AS BIGINT) AS damage_spike FROM sec GROUP BY ALL),
su AS (SELECT guild_id, encounter_key, guid, death_id, CAST(coalesce(sum(value) FILTER (kind = 'damage'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(value) FILTER (kind = 'healing'), 0) AS BIGINT) AS healing FROM er GROUP BY ALL)
SELECT su.*, damage_spike, CASE WHEN healing * 100.0 / damage < 50 THEN 'Low healing coverage' WHEN damage_spike > 100000 THEN 'One-shot mechanic' ELSE 'Sustained damage' END AS preventable
FROM su JOIN mx USING (guild_id, encounter_key, guid, death_id) WHERE damage > 0""")
def _(t: Tables):
    return M.death_spikes(encounter_recap(t), BY_ENCOUNTER).drop("healing_coverage")


@query("a41_survival_issues", f"""WITH {{EV}}, {RECAP},
s AS (SELECT guid, count(DISTINCT death_id) AS deaths, CAST(coalesce(sum(value) FILTER (kind = 'damage'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(value) FILTER (kind = 'healing'), 0) AS BIGINT) AS healing FROM recap GROUP BY 1),
w AS (SELECT guid, cause, row_number() OVER (PARTITION BY guid ORDER BY sum(value) DESC, cause DESC) AS rn FROM recap WHERE kind = 'damage' GROUP BY 1, 2)
SELECT s.guid, deaths, damage, healing, round(damage / deaths, 6) AS avg_damage, round(healing / deaths, 6) AS avg_healing, round((damage - healing) / deaths, 6) AS deficit, cause AS top_cause
FROM s LEFT JOIN w ON w.guid = s.guid AND rn = 1""")
def _(t: Tables):
    s = M.survival_issues(user_recap(t))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_damage", "avg_healing", "deficit")})


@query("w15_damage_spike", f"""WITH {{EV}}, {RECAP},
sec AS (SELECT guid, death_id, epoch_us(ts) // 1000000 AS s, sum(value) AS v FROM recap WHERE kind = 'damage' GROUP BY 1, 2, 3),
sp AS (SELECT guid, death_id, CAST(max(v) AS BIGINT) AS damage_spike FROM sec GROUP BY 1, 2),
su AS (SELECT guid, death_id, CAST(coalesce(sum(value) FILTER (kind = 'damage'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(value) FILTER (kind = 'healing'), 0) AS BIGINT) AS healing FROM recap GROUP BY 1, 2)
SELECT guid, death_id, damage, healing, damage_spike, round(healing * 100.0 / damage, 6) AS healing_coverage,
 CASE WHEN healing * 100.0 / damage < 50 THEN 'Low healing coverage' WHEN damage_spike > 100000 THEN 'One-shot mechanic' ELSE 'Sustained damage' END AS preventable
FROM su JOIN sp USING (guid, death_id) WHERE damage > 0""")
def _(t: Tables):
    return M.death_spikes(user_recap(t)).withColumn("healing_coverage", F.round("healing_coverage", 6))


REL = """st AS (SELECT encounter_key, min(ts) AS start_ts FROM ev GROUP BY 1)"""


def relative(rows, t: Tables):
    starts = combat_events(t).groupBy(*KEY).agg(F.min("ts").alias("start_ts"))
    return rows.join(starts, KEY).withColumn("relative_time", S.seconds_between("start_ts", "ts"))


@query("a45_timeline_buckets", f"""WITH {{EV}}, {CHARS}, {REL},
b AS (SELECT encounter_key, CAST(floor((epoch_us(ts) - epoch_us(start_ts)) / 1e6 / 3600) AS BIGINT) AS bucket, guid, CAST(coalesce(sum(amount) FILTER (category = 'damage_done'), 0) AS BIGINT) AS damage,
  CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (category = 'healing_done'), 0) AS BIGINT) AS healing, count(*) FILTER (category = 'death') AS deaths FROM rr JOIN st USING (encounter_key) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY encounter_key, bucket ORDER BY damage DESC, guid) AS rank FROM b) SELECT * FROM r WHERE rank <= 3""")
def _(t: Tables):
    b = M.timeline_buckets(relative(role_rows(t), t), KEY, 3600.0)
    out = M.top_per_group(b, [*KEY, "bucket"], [F.desc("damage"), "guid"], 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("a48_resource_usage", f"""WITH {{EV}}, x AS (SELECT *, CASE event_type WHEN 'SPELL_HEAL' THEN 'g' WHEN 'SPELL_DAMAGE' THEN 'd' END AS k FROM ev)
SELECT encounter_key, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS bucket, CASE spell_id % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in L.POWER_TYPES.items() if 0 <= k < 5)} END AS power,
  CAST(coalesce(sum(amount) FILTER (k = 'g'), 0) AS BIGINT) AS gained, CAST(coalesce(sum(amount) FILTER (k = 'd'), 0) AS BIGINT) AS drained, count(*) AS uses FROM x WHERE k IS NOT NULL GROUP BY 1, 2, 3""")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "SPELL_HEAL", "SPELL_ENERGIZE").when(F.col("event_type") == "SPELL_DAMAGE", "SPELL_DRAIN").otherwise("OTHER")
    e = combat_events(t).withColumns({"event_type": kind, "power_type": F.col("spell_id") % 5})
    return M.resource_usage(e, KEY, 3600.0)


@query("a49_cooldown_usage", """WITH {EV} SELECT source_guid AS guid, CASE spell_id % 30 WHEN 0 THEN 'Heroism' ELSE 'Bloodlust' END AS cooldown, count(*) AS uses,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM ev WHERE event_type = 'SPELL_CAST_SUCCESS' AND spell_id % 30 < 2 GROUP BY 1, 2""")
def _(t: Tables):
    k = F.col("spell_id") % 30
    e = combat_events(t).filter("event_type = 'SPELL_CAST_SUCCESS'").withColumns(
        {"guid": F.col("source_guid"), "spell_id": F.when(k == 0, 32182).when(k == 1, 2825).otherwise(1)})
    c = M.cooldown_usage(e, L.TRACKED_COOLDOWNS, ["guid"])
    return c.select("guid", "cooldown", "uses", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


# --- top-k ------------------------------------------------------------------------------------------

@query("t03_top_spells", """WITH {EV} SELECT spell_id, CAST(sum(amount) AS BIGINT) AS damage FROM ev WHERE event_type = 'SPELL_DAMAGE' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t: Tables):
    return M.spell_totals(combat_events(t)).orderBy(F.desc("damage"), "spell_id").limit(10).select("spell_id", "damage")


@query("t03_top_damage", f"""WITH {{EV}}, {CHARS} SELECT guid, CAST(sum(damage_done) AS BIGINT) AS damage_done FROM cm0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t: Tables):
    m = M.combatant_metrics(role_rows(t), ["guid"])
    return m.orderBy(F.desc("damage_done"), "guid").limit(10).select("guid", "damage_done")


@query("t03_top_healers", f"""WITH {{EV}}, {CHARS} SELECT guid, CAST(sum(healing_done) AS BIGINT) AS healing_done FROM cm0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t: Tables):
    m = M.combatant_metrics(role_rows(t), ["guid"])
    return m.orderBy(F.desc("healing_done"), "guid").limit(10).select("guid", "healing_done")


@query("t05_key_moments", f"""WITH {{EV}} SELECT line_no, {IMPORTANCE_SQL} AS importance FROM ev WHERE {IMPORTANCE_SQL} >= 4 ORDER BY 2 DESC, ts, line_no LIMIT 20""")
def _(t: Tables):
    e = timeline_columns(combat_events(t)).filter("importance >= 4")
    return e.orderBy(F.desc("importance"), "ts", "line_no").limit(20).select("line_no", "importance")


@query("t06_top_abilities", f"""WITH {{EV}}, {CHARS}, a AS (SELECT guid, spell_id, CAST(sum(amount) AS BIGINT) AS total FROM rr WHERE category = 'damage_done' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY total DESC, spell_id) AS rank FROM a) SELECT * FROM r WHERE rank <= 5""")
def _(t: Tables):
    a = M.ability_breakdown(role_rows(t), "damage_done", ["guid"]).select("guid", "spell_id", "total")
    return M.top_per_group(a, ["guid"], [F.desc("total"), "spell_id"], 5).withColumn("rank", F.col("rank").cast("long"))


@query("t06_top_name_spell", """WITH {EV} SELECT source_name, spell_name, CAST(sum(amount - overhealing) AS BIGINT) AS total FROM ev WHERE event_type = 'SPELL_HEAL' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _(t: Tables):
    e = combat_events(t).filter("event_type = 'SPELL_HEAL'")
    return e.groupBy("source_name", "spell_name").agg(F.sum(M.effective()).alias("total")).orderBy(
        F.desc("total"), "source_name", "spell_name").limit(20)


@query("t07_dps_rankings", f"""WITH {{EV}}, {CHARS}, v AS (SELECT *, CASE WHEN combat_dps > 0 THEN combat_dps ELSE dps END AS value FROM cm WHERE damage_done > 0),
r AS (SELECT encounter_key, guid, value, row_number() OVER (PARTITION BY encounter_key ORDER BY value DESC, guid) AS rank FROM v) SELECT * FROM r WHERE rank <= 20""")
def _(t: Tables):
    v = M.rate_rankings(characters(t), "damage_done", "dps", "combat_dps").select(*KEY, "guid", "value")
    return M.top_per_group(v, KEY, [F.desc("value"), "guid"], 20).withColumn("rank", F.col("rank").cast("long"))


@query("t07_hps_rankings", f"""WITH {{EV}}, {CHARS}, v AS (SELECT *, CASE WHEN combat_hps > 0 THEN combat_hps ELSE hps END AS value FROM cm WHERE healing_done > 0),
r AS (SELECT encounter_key, guid, value, round(healing_done * 100.0 / (healing_done + overhealing), 6) AS heal_efficiency,
  row_number() OVER (PARTITION BY encounter_key ORDER BY value DESC, guid) AS rank FROM v) SELECT * FROM r WHERE rank <= 20""")
def _(t: Tables):
    v = M.rate_rankings(characters(t), "healing_done", "hps", "combat_hps").select(
        *KEY, "guid", "value", F.round("heal_efficiency", 6).alias("heal_efficiency"))
    return M.top_per_group(v, KEY, [F.desc("value"), "guid"], 20).withColumn("rank", F.col("rank").cast("long"))


@query("t09_build_timeline", f"""WITH {{EV}}, {REL},
cb AS (SELECT encounter_key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY encounter_key ORDER BY ts)) <= 300000000 THEN 0 ELSE 1 END AS opens FROM ev WHERE {COMBAT_SQL}),
cn AS (SELECT encounter_key, ts, CAST(sum(opens) OVER (PARTITION BY encounter_key ORDER BY ts) AS BIGINT) - 1 AS idx FROM cb),
pr AS (SELECT encounter_key, idx, min(ts) AS ps, max(ts) AS pe FROM cn GROUP BY 1, 2)
SELECT line_no, (epoch_us(ts) - epoch_us(start_ts)) / 1e6 AS relative_time, {CATEGORY_SQL} AS category, {IMPORTANCE_SQL} AS importance, {DESCRIBE_SQL} AS description,
  idx AS combat_period, idx IS NOT NULL AS is_combat FROM ev JOIN st USING (encounter_key) LEFT JOIN pr ON pr.encounter_key = ev.encounter_key AND ts BETWEEN ps AND pe""")
def _(t: Tables):
    from fraylens.operators.intervals import locate
    e = timeline_columns(combat_events(t))
    periods = S.combat_periods(combat_events(t), KEY, 300.0, 3600.0)
    d = relative(locate(e, periods, KEY, "ts", ["period_index"], bucket_seconds=3600.0), t)
    return d.select("line_no", "relative_time", "category", "importance", description(d).alias("description"),
                    F.col("period_index").alias("combat_period"), F.col("period_index").isNotNull().alias("is_combat"))


@query("t09_damage_timeline", f"""WITH {{EV}}, {REL} SELECT encounter_key, CAST(floor((epoch_us(ts) - epoch_us(start_ts)) / 1e6 / 1800) AS BIGINT) AS bucket,
  CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS healing,
  count(*) FILTER (event_type = 'UNIT_DIED') AS deaths FROM ev JOIN st USING (encounter_key) GROUP BY 1, 2""")
def _(t: Tables):
    e = relative(combat_events(t), t).withColumn("bucket", F.floor(F.col("relative_time") / 1800))
    dead = e.groupBy(*KEY, "bucket").agg(F.count_if(F.col("event_type") == "UNIT_DIED").alias("deaths"))
    return M.spell_totals(e, [*KEY, "bucket"]).select(*KEY, "bucket", "damage", "healing").join(dead, [*KEY, "bucket"])
