"""Log text derived from the given tables by Spark, parsed back, compared with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.operators import segments
from fraylens.plans.catalog import Tables, query
from fraylens.plans.standins import combat_events, us
from fraylens.session import work_folder
from fraylens.sources import log

UNITS = ",".join(["Player-9-0A", "0000000000000000", "100", "200", "30", "40", "5", "0", "0", "1000", "1000", "0", "-12.5", "7.25", "2657", "1.57", "80", "0", "0"])


def log_lines(t: Tables):
    """One log line per event; every second damage line is advanced, spell 7 gives a broken line."""
    e = combat_events(t)
    kind, k = F.col("event_type"), F.col("spell_id")
    stamp = F.concat(F.date_format("ts", "M/d/yyyy HH:mm:ss.SSS"), F.lit("-4  "))
    units = F.concat_ws(
        ",", "source_guid", F.concat(F.lit('"'), "source_name", F.lit(', the \\"Bold\\""')), F.lit("0x512,0x0"),
        "dest_guid", F.concat(F.lit('"'), "dest_name", F.lit('"')), F.lit("0xa48,0x0"))
    spell = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "spell_name", F.lit(', Rank 2"')), F.lit("0x1"))
    crit = F.when(F.col("critical"), "1").otherwise("nil")
    block = F.when(k % 2 == 0, F.lit("," + UNITS)).otherwise("")
    hit = F.concat_ws(",", "amount", "overkill", F.lit("1,0,12,34"), crit, F.lit("nil,nil"))
    heal = F.concat_ws(",", "amount", "overhealing", F.lit("5"), crit)
    c = F.concat
    text = (F.when(k == 7, c(F.lit("broken line "), F.col("line_no").cast("string")))
            .when(kind == "SPELL_DAMAGE", c(stamp, F.lit("SPELL_DAMAGE,"), units, F.lit(","), spell, block, F.lit(","), hit))
            .when(kind == "SPELL_HEAL", c(stamp, F.lit("SPELL_HEAL,"), units, F.lit(","), spell, block, F.lit(","), heal))
            .when(kind == "SPELL_CAST_SUCCESS", c(stamp, F.lit("SPELL_CAST_SUCCESS,"), units, F.lit(","), spell))
            .when(kind == "UNIT_DIED", c(stamp, F.lit("UNIT_DIED,nil,nil,0x0,0x0,"), F.concat_ws(",", "dest_guid", F.concat(F.lit('"'), "dest_name", F.lit('"'))), F.lit(",0x512,0x0")))
            .otherwise(c(stamp, F.lit("SPELL_AURA_APPLIED_DOSE,"), units, F.lit(","), spell, F.lit(",BUFF,3"))))
    return e.select("guild_id", F.lit("derived").alias("file_id"), (F.col("line_no") % 1).alias("block"), "line_no", text.alias("line"))


MS = "epoch_us(ts) // 1000 * 1000"
TYPE = "CASE WHEN event_type = 'SPELL_RESURRECT' THEN 'SPELL_AURA_APPLIED_DOSE' ELSE event_type END"


@query("s01_read_log", """WITH {EV}, t AS (SELECT line_no, guild_id, spell_id, CASE WHEN line_no % 10 = 0 THEN 3 ELSE 1 END AS taken FROM ev)
SELECT line_no AS event_id, guild_id AS file, CAST(sum(taken) OVER (PARTITION BY guild_id ORDER BY line_no) AS BIGINT) AS line_no, spell_id = 7 AS broken FROM t""")
def _(t: Tables):
    path = work_folder(t.spark, "log")
    # one file per guild; a note and a blank line stand before every tenth line and are counted, not returned
    text = log_lines(t).select("guild_id", "line_no", F.concat(
        F.when(F.col("line_no") % 10 == 0, F.lit("# note\n   \n")).otherwise(""), F.col("line_no").cast("string"), F.lit("|"), "line").alias("value"))
    text.repartition("guild_id").sortWithinPartitions("guild_id", "line_no").select("guild_id", "value").write.partitionBy("guild_id").text(path)
    d = log.read_log(t.spark, path).drop("guild_id")
    return d.select(F.substring_index("line", "|", 1).cast("long").alias("event_id"), F.regexp_extract("file_id", "guild_id=([0-9]+)", 1).cast("long").alias("file"),
                    "line_no", F.col("line").contains("|broken").alias("broken"))


@query("s02_tokenize", f"""WITH {{EV}} SELECT line_no, CASE WHEN spell_id <> 7 THEN {MS} END AS ts_us, CASE WHEN spell_id <> 7 THEN -4 END AS tz_offset, CASE WHEN spell_id <> 7 THEN {TYPE} END AS event_type,
  CASE WHEN spell_id = 7 THEN NULL WHEN event_type = 'SPELL_DAMAGE' THEN 20 + 19 * (1 - spell_id % 2) WHEN event_type = 'SPELL_HEAL' THEN 15 + 19 * (1 - spell_id % 2)
    WHEN event_type = 'SPELL_CAST_SUCCESS' THEN 11 WHEN event_type = 'UNIT_DIED' THEN 8 ELSE 13 END AS n_params,
  CASE WHEN spell_id <> 7 AND event_type <> 'UNIT_DIED' THEN source_name || ', the \\"Bold\\"' END AS source_name FROM ev""", longs=("n_params", "tz_offset"))
def _(t: Tables):
    d = log.tokenize(log_lines(t))
    return d.select("line_no", us("ts").alias("ts_us"), "tz_offset", "event_type",
                    F.when(F.col("params").isNotNull(), F.size("params")).alias("n_params"), F.get("params", F.lit(1)).alias("source_name"))


@query("s03_convert", """WITH s AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value FROM events)
SELECT event_id, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN CAST(trunc(value) AS BIGINT) END AS as_long, CASE k % 5 WHEN 0 THEN k::DOUBLE WHEN 2 THEN value END AS as_double,
  k % 5 = 4 AS as_bool FROM s""")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    raw = (F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 5 == 2, F.col("value").cast("string"))
           .when(k % 5 == 3, "name").otherwise("true"))
    d = t.events.select("event_id", raw.alias("raw"))
    return d.select("event_id", log.to_long(F.col("raw")).alias("as_long"), log.to_double(F.col("raw")).alias("as_double"), log.to_bool(F.col("raw")).alias("as_bool"))


@query("s05_project_events", f"""WITH {{EV}} SELECT line_no, {MS} AS ts_us, {TYPE} AS event_type, CASE WHEN event_type <> 'UNIT_DIED' THEN source_guid END AS source_guid, dest_guid, dest_name,
  CASE WHEN event_type = 'UNIT_DIED' THEN 0 ELSE 1298 END AS source_flags, CASE WHEN event_type <> 'UNIT_DIED' THEN spell_id END AS spell_id,
  CASE WHEN event_type <> 'UNIT_DIED' THEN spell_name || ', Rank 2' END AS spell_name, CASE WHEN event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') THEN amount ELSE 0 END AS amount,
  CASE WHEN event_type = 'SPELL_DAMAGE' THEN overkill ELSE 0 END AS overkill, CASE WHEN event_type = 'SPELL_HEAL' THEN overhealing ELSE 0 END AS overhealing,
  CASE event_type WHEN 'SPELL_DAMAGE' THEN 12 ELSE 0 END AS blocked, CASE event_type WHEN 'SPELL_DAMAGE' THEN 34 WHEN 'SPELL_HEAL' THEN 5 ELSE 0 END AS absorbed,
  event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') AND critical AS critical, CASE event_type WHEN 'SPELL_RESURRECT' THEN 'BUFF' END AS aura_type, CASE event_type WHEN 'SPELL_RESURRECT' THEN 3 END AS stacks
FROM ev WHERE spell_id <> 7""", longs=("source_flags", "blocked", "absorbed", "stacks"))
def _(t: Tables):
    d = log.project_events(log.tokenize(log_lines(t)))
    return d.select("line_no", us("ts").alias("ts_us"), "event_type", "source_guid", "dest_guid", "dest_name", "source_flags", "spell_id", "spell_name",
                    "amount", "overkill", "overhealing", "blocked", "absorbed", "critical", "aura_type", "stacks")


@query("s06_parse_stats", """WITH {EV} SELECT guild_id, count(*) AS lines, count(*) FILTER (spell_id = 7) AS errors, round(1 - count(*) FILTER (spell_id = 7) / count(*), 8) AS success_rate,
  count(*) FILTER (spell_id <> 7 AND line_no % 50 = 0) AS unbalanced FROM ev GROUP BY 1""")
def _(t: Tables):
    torn = F.when(F.col("line_no") % 50 == 0, F.lit(",[(1,2),(3")).otherwise("")
    lines = log_lines(t).withColumn("line", F.concat("line", torn))
    return log.parse_stats(log.tokenize(lines), ["guild_id"]).withColumn("success_rate", F.round("success_rate", 8))


@query("s04_nested_any_depth", """WITH {EV} SELECT line_no, 3::BIGINT AS fields, spell_id * 2 + amount AS total, 'a, (b' AS quoted FROM ev WHERE spell_id <> 7""")
def _(t: Tables):
    # four levels: [(1,[("a, (b",[spell]),(x,[spell,amount])]),9]
    k, n = F.col("spell_id").cast("string"), F.col("amount").cast("string")
    nested = F.concat(F.lit('[(1,[("a, (b",['), k, F.lit("]),(x,["), k, F.lit(","), n, F.lit("])]),9]"))
    e = combat_events(t).where("spell_id <> 7")
    lines = e.select("guild_id", F.lit("n").alias("file_id"), F.lit(0).cast("long").alias("block"), "line_no", F.concat(
        F.date_format("ts", "M/d/yyyy HH:mm:ss.SSS"), F.lit("-4  NESTED,"), nested, F.lit(",7,"), F.lit("(1,(2,(3,(4))))")).alias("line"))
    d = log.tokenize(lines)
    pairs = log.members(F.get(log.members(F.get(log.members(F.get("params", F.lit(0))), F.lit(0))), F.lit(1)))
    lists = F.flatten(F.transform(pairs, lambda p: log.members(F.get(log.members(p), F.lit(1)))))
    numbers = F.aggregate(F.transform(lists, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.get(log.members(F.get(pairs, F.lit(0))), F.lit(0))
    return d.select("line_no", F.size("params").cast("long").alias("fields"), numbers.alias("total"), F.substring_index(F.substring_index(first, '"', 2), '"', -1).alias("quoted"))


@query("s06_parse_errors", "WITH {EV} SELECT line_no, 'broken line ' || line_no AS line FROM ev WHERE spell_id = 7")
def _(t: Tables):
    return log.parse_errors(log.tokenize(log_lines(t))).select("line_no", "line")


@query("s07_validate_events", """WITH {EV} SELECT line_no, spell_id % 3 > 0 AS valid, CASE WHEN spell_id % 3 = 0 THEN 'expected at least ' || CASE event_type WHEN 'SPELL_DAMAGE' THEN 17 WHEN 'SPELL_HEAL' THEN 14
  WHEN 'SPELL_CAST_SUCCESS' THEN 11 WHEN 'UNIT_DIED' THEN 8 ELSE 13 END || ' parameters, got 2' END AS issue FROM ev WHERE spell_id <> 7""")
def _(t: Tables):
    cut = F.when(F.col("cut"), F.slice("params", 1, 2)).otherwise(F.col("params"))
    lines = log_lines(t).join(combat_events(t).select("line_no", (F.col("spell_id") % 3 == 0).alias("cut")), "line_no")
    d = log.tokenize(lines).filter(F.col("ts").isNotNull()).withColumn("params", cut)
    return log.validate_events(d).select("line_no", "valid", "issue")


@query("w18_advanced_flag", """WITH {EV}, h AS (SELECT line_no, guild_id, ts, CASE WHEN event_type = 'UNIT_DIED' THEN spell_id % 2 END AS f FROM ev)
SELECT line_no, last_value(f IGNORE NULLS) OVER (PARTITION BY guild_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS advanced FROM h""")
def _(t: Tables):
    e = combat_events(t)
    header = F.when(F.col("event_type") == "UNIT_DIED", "COMBAT_LOG_VERSION").otherwise(F.col("event_type"))
    params = F.array(F.lit("21"), F.lit("ADVANCED_LOG_ENABLED"), (F.col("spell_id") % 2).cast("string"))
    d = e.select(F.col("guild_id").cast("string").alias("file_id"), F.floor(F.col("line_no") / 500).alias("block"), "line_no", header.alias("event_type"), params.alias("params"))
    return log.advanced_flag(d).select("line_no", "advanced")


# --- combatant info -------------------------------------------------------------------------------------------

def info_lines(t: Tables):
    """A COMBATANT_INFO line per order: line items as equipment, parts as talents and auras."""
    # only numbers are grouped, their texts are made of them afterwards
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    g = t.lineitem.groupBy("l_orderkey").agg(rows.alias("r"))
    stats = F.concat_ws(",", F.lit("0"), *[F.lit(str(n)) for n in range(1, 22)], (F.col("l_orderkey") % 300).cast("string"))

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in parts])

    def item(x):
        return text("(", x["l_partkey"] + 1, ",", x["l_quantity"].cast("long") + 600, ",(", x["l_partkey"] + 100000, ",50),(", x["l_suppkey"] % 3,
                    "),(", x["l_linenumber"] + 5000, ",", x["l_suppkey"] + 200, "))")

    def talent(x):
        return text("(", x["l_partkey"] + 1, ",", x["l_suppkey"] * 100, ",", x["l_linenumber"], ")")

    def aura(x):
        spell = F.when(x["l_suppkey"] % 10 == 0, 431972).when(x["l_suppkey"] % 10 == 1, 104273).otherwise(x["l_suppkey"])
        return text("Player-", x["l_suppkey"], ",", spell, ",", x["l_linenumber"])

    def arr(f):
        return F.concat(F.lit("["), F.array_join(F.transform("r", f), ","), F.lit("]"))
    line = F.concat(F.lit("1/2/2024 03:04:05.678+1  COMBATANT_INFO,Player-"), F.col("l_orderkey").cast("string"), F.lit(","), stats, F.lit(","), arr(talent),
                    F.lit(",(1,0,22,0),"), arr(item), F.lit(","), arr(aura))
    return g.select(F.col("l_orderkey").alias("line_no"), line.alias("line"))


def info(t: Tables):
    return log.combatant_info(log.tokenize(info_lines(t)))


SLOTS = """sl AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS slot, CAST(l_quantity AS BIGINT) + 600 AS ilvl FROM lineitem)"""
SLOT_NAMES = "['Head','Neck','Shoulder','Shirt','Chest','Waist','Legs','Feet','Wrist','Hands','Finger_1','Finger_2','Trinket_1','Trinket_2','Back','Main_Hand','Off_Hand','Ranged']"


@query("s04_parse_nested", f"""WITH {SLOTS} SELECT l_orderkey AS line_no, count(*) AS items, CAST(sum(l_partkey + 1) AS BIGINT) AS item_sum, CAST(sum(l_partkey + 100050) AS BIGINT) AS gem_sum,
  CAST(sum(5200 + l_linenumber + l_suppkey) AS BIGINT) AS bonus_sum, '1,0,22,0' AS pvp FROM sl GROUP BY 1""", longs=("items",))
def _(t: Tables):
    d = info(t)
    zero = F.lit(0).cast("long")

    def total(f):
        return F.aggregate(F.flatten(F.transform("items", lambda i: i[f])), zero, lambda a, x: a + x)
    return d.select("line_no", F.size("items").alias("items"), F.aggregate("items", zero, lambda a, i: a + i["item_id"]).alias("item_sum"),
                    total("gems").alias("gem_sum"), total("bonus_ids").alias("bonus_sum"), F.array_join(F.transform("pvp_talents", lambda x: x.cast("string")), ",").alias("pvp"))


@query("s08_combatant_info", f"""WITH {SLOTS} SELECT l_orderkey AS line_no, 'Player-' || l_orderkey AS player_guid, 1 AS strength, 21 AS armor, 10.0::DOUBLE AS crit_spell, l_orderkey % 300 AS spec_id,
  string_agg((l_partkey + 1) || ':' || (l_suppkey * 100) || ':' || l_linenumber, ' ' ORDER BY slot) AS talents, string_agg(l_suppkey || 'x' || l_linenumber, ' ' ORDER BY slot) AS auras FROM sl GROUP BY l_orderkey""", longs=("strength", "armor"))
def _(t: Tables):
    d = info(t)
    talents = F.transform("talents", lambda x: F.concat_ws(":", x["id"], x["spell"], x["rank"]))
    auras = F.transform("auras", lambda a: F.concat(F.substring_index(a["source"], "-", -1), F.lit("x"), a["stacks"].cast("string")))
    return d.select("line_no", "player_guid", "strength", "armor", "crit_spell", "spec_id", F.array_join(talents, " ").alias("talents"), F.array_join(auras, " ").alias("auras"))


@query("s09_gear_snapshots", f"""WITH {SLOTS}, w AS (SELECT *, CASE WHEN slot = 4 THEN 0 WHEN slot = 16 THEN 2 ELSE 1 END AS wt FROM sl WHERE slot <= 18),
a AS (SELECT l_orderkey, CASE WHEN sum(wt) > 0 THEN round_even(sum(ilvl * wt) / sum(wt), 2) ELSE 0 END AS average_item_level, count(*) FILTER (wt > 0) AS total_items FROM w GROUP BY 1)
SELECT l_orderkey AS line_no, slot, ({SLOT_NAMES})[slot] AS slot_name, l_partkey + 1 AS item_id, ilvl AS item_level, l_suppkey % 3 AS enchant_id, CASE WHEN l_partkey > 0 THEN (l_partkey + 100000)::VARCHAR ELSE '' END AS gems,
  50 AS upgrade_level, CASE WHEN l_partkey > 0 THEN '' ELSE '100000,' END || (l_linenumber + 5000) || ',' || (l_suppkey + 200) AS bonus, average_item_level, total_items FROM w JOIN a USING (l_orderkey)""", longs=("slot", "upgrade_level", "total_items"))
def _(t: Tables):
    g = log.gear_snapshots(info(t), ["line_no"])

    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return g.select("line_no", "slot", "slot_name", "item_id", "item_level", "enchant_id", text("gem_ids").alias("gems"), "upgrade_level",
                    text("bonus_ids").alias("bonus"), "average_item_level", "total_items")


@query("s10_talent_snapshots", f"""WITH {SLOTS}, c AS (SELECT l_orderkey, count(*) FILTER (l_suppkey > 0) AS total_talents, string_agg((l_suppkey * 100)::VARCHAR, ' ' ORDER BY slot) FILTER (l_suppkey > 0) AS loadout FROM sl GROUP BY 1)
SELECT l_orderkey AS line_no, slot, l_suppkey * 100 AS spell, l_linenumber AS rank, (slot - 1) // 3 + 1 AS tier, (slot - 1) % 3 + 1 AS "column", loadout, total_talents FROM sl JOIN c USING (l_orderkey) WHERE l_suppkey > 0""", longs=("slot", "rank", "column", "total_talents"))
def _(t: Tables):
    return log.talent_snapshots(info(t), ["line_no"])


@query("p22_consumables", f"""WITH {SLOTS} SELECT l_orderkey AS line_no, arg_min(431972, slot) FILTER (l_suppkey % 10 = 0) AS flask, arg_min(104273, slot) FILTER (l_suppkey % 10 = 1) AS food,
  coalesce(string_agg((l_suppkey % 3)::VARCHAR, ',' ORDER BY slot) FILTER (slot <= 2 AND l_suppkey % 3 > 0), '') AS weapon_enchants, count(*) * 2 AS total_gems, round(avg(ilvl), 6) AS average_item_level,
  count(*) FILTER (l_suppkey % 10 < 2) > 0 AS has_consumables, count(*) FILTER (slot <= 8 AND l_suppkey % 3 = 0) = 0 AS fully_enchanted,
  string_agg((l_partkey + 1)::VARCHAR, ',' ORDER BY slot) FILTER (slot <= 10) AS build FROM sl GROUP BY 1""", longs=("flask", "food", "total_gems"))
def _(t: Tables):
    c = log.consumables(info(t), ["line_no"])
    return c.withColumn("weapon_enchants", F.array_join(F.transform("weapon_enchants", lambda x: x.cast("string")), ",")).withColumn(
        "average_item_level", F.round("average_item_level", 6))


@query("p23_gear_advice", f"""WITH {SLOTS}, w AS (SELECT *, CASE WHEN slot = 4 THEN 0 WHEN slot = 16 THEN 2 ELSE 1 END AS wt FROM sl WHERE slot <= 18),
a AS (SELECT l_orderkey, round_even(sum(ilvl * wt) / sum(wt), 2) AS m FROM w GROUP BY 1 HAVING sum(wt) > 0), x AS (SELECT *, ({SLOT_NAMES})[slot] AS slot_name FROM w JOIN a USING (l_orderkey))
SELECT l_orderkey AS line_no, slot_name, ilvl AS item_level, CAST(floor(m) AS BIGINT) AS recommended_ilvl, 'upgrade' AS advice FROM x WHERE ilvl < m - 10
UNION ALL SELECT l_orderkey, slot_name, ilvl, CAST(floor(m) AS BIGINT), 'enchant' FROM x WHERE l_suppkey % 3 = 0 AND slot_name IN ('Main_Hand', 'Off_Hand', 'Chest', 'Legs', 'Feet', 'Hands', 'Wrist', 'Back')""")
def _(t: Tables):
    return log.gear_advice(log.gear_snapshots(info(t), ["line_no"]), ["line_no"])


@query("p23_talent_advice", """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_suppkey > 0) AS n, bool_or(l_suppkey IN (10, 20, 30)) AS d, bool_or(l_suppkey IN (40, 50, 60)) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey AS line_no, 'missing_talents' AS advice FROM g WHERE n < 10 UNION ALL SELECT l_orderkey, 'defensive_talents' FROM g WHERE l_orderkey % 2 = 0 AND NOT d
UNION ALL SELECT l_orderkey, 'aoe_talents' FROM g WHERE l_orderkey % 2 = 1 AND NOT a""")
def _(t: Tables):
    kind = F.when(F.col("line_no") % 2 == 0, "raid").otherwise("mythic_plus")
    return log.talent_advice(info(t), ["line_no"], kind)
