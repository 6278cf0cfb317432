"""Row-level operators: classification, predicates, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.functions import lookups as L
from fraylens.operators import filters
from fraylens.plans.catalog import Tables, query
from fraylens.plans.standins import combat_events, us


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def numbers(values) -> str:
    return ", ".join(str(v) for v in values)


def case_of(expr: str, names: dict, other: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{str(v).replace(chr(39), chr(39) * 2)}'" for k, v in names.items())
    return f"CASE {expr} {whens} ELSE {other} END"


@query("p01_entity_kind", """WITH {EV}
SELECT line_no, dest_guid, CASE WHEN dest_guid LIKE 'Player-%' THEN 'Player' ELSE 'Creature' END AS kind FROM ev""")
def _(t: Tables):
    return combat_events(t).select("line_no", "dest_guid", C.entity_kind(F.col("dest_guid")).alias("kind"))


_NAME = """CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || '-' || c_mktsegment
  WHEN 2 THEN c_name || '-' || c_mktsegment || '-EU' ELSE 'Al-' || c_name || '-' || c_mktsegment || '-US' END"""


def named(t: Tables):
    k = F.col("c_custkey") % 4
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    full = (F.when(k == 0, name).when(k == 1, F.concat_ws("-", name, seg))
            .when(k == 2, F.concat_ws("-", name, seg, F.lit("EU")))
            .otherwise(F.concat_ws("-", F.lit("Al"), name, seg, F.lit("US"))))
    return t.customer.withColumn("full", full)


@query("p02_split_name", f"""
WITH n AS (SELECT c_custkey, {_NAME} AS full_text, c_name, c_mktsegment FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'Al-' || c_name ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS server,
  CASE c_custkey % 4 WHEN 2 THEN 'EU' WHEN 3 THEN 'US' END AS region, full_text FROM n""")
def _(t: Tables):
    d = named(t).withColumn("p", C.name_parts(F.col("full")))
    rebuilt = C.full_name(F.col("p.name"), F.col("p.server"), F.col("p.region"))
    return d.select("c_custkey", "p.name", "p.server", "p.region", rebuilt.alias("full_text"))


@query("p03_normalize_server", """
SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '''S ' ||
  'Customer#' || substr(c_name, 10) AS server,
  CASE c_custkey % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' ELSE 'XX' END AS region,
  c_custkey % 3 <> 2 AS valid FROM customer""")
def _(t: Tables):
    raw = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("'s "), F.upper("c_name"), F.lit(" "))
    region = F.when(F.col("c_custkey") % 3 == 0, "eu").when(F.col("c_custkey") % 3 == 1, "us").otherwise("xx")
    return t.customer.select("c_custkey", C.title_case(raw).alias("server"),
                             F.upper(region).alias("region"), C.is_region(region).alias("valid"))


@query("p04_categorize", """WITH {EV}, both_sides AS (
  SELECT line_no, source_guid AS guid, CASE event_type WHEN 'SPELL_DAMAGE' THEN 'damage_done'
    WHEN 'SPELL_HEAL' THEN 'healing_done' WHEN 'SPELL_CAST_SUCCESS' THEN 'cast_succeeded' END AS category FROM ev
  UNION ALL
  SELECT line_no, dest_guid, CASE event_type WHEN 'SPELL_DAMAGE' THEN 'damage_taken' WHEN 'SPELL_HEAL' THEN 'healing_received'
    WHEN 'UNIT_DIED' THEN 'death' WHEN 'SPELL_RESURRECT' THEN 'resurrected' END FROM ev)
SELECT line_no, guid, category FROM both_sides WHERE category IS NOT NULL AND guid LIKE 'Player-%'""")
def _(t: Tables):
    e = combat_events(t)
    players = e.select(F.explode(F.array("source_guid", "dest_guid")).alias("guid")).filter(
        C.entity_kind(F.col("guid")) == "Player").distinct()
    return C.categorize(e, players).select("line_no", "guid", "category")


@query("p05_effective_healing", """
SELECT l_orderkey, l_linenumber, greatest(0, CAST(l_quantity AS BIGINT) - CAST(round(l_tax * 600) AS BIGINT)) AS effective FROM lineitem""")
def _(t: Tables):
    over = F.round(F.col("l_tax") * 600).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             C.effective_healing(F.col("l_quantity").cast("long"), over).alias("effective"))


@query("p06_is_buff", """WITH {EV}
SELECT line_no, CASE spell_id % 3 WHEN 0 THEN true WHEN 1 THEN false
  ELSE spell_id * 1000 IN (10060, 47000) OR dest_guid LIKE 'Player-%' END AS buff FROM ev""")
def _(t: Tables):
    k = F.col("spell_id")
    aura = F.when(k % 3 == 0, "BUFF").when(k % 3 == 1, "DEBUFF")
    return combat_events(t).select(
        "line_no", C.is_buff(aura, k * 1000, F.col("source_guid"), F.col("dest_guid")).alias("buff"))


_SPELL = "CASE k % 6 WHEN 0 THEN 2825 WHEN 1 THEN 20484 WHEN 2 THEN 431972 WHEN 3 THEN 462854 WHEN 4 THEN 452925 ELSE k END"


@query("p07_spell_sets", f"""
WITH s AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
     z AS (SELECT event_id, {_SPELL} AS id FROM s)
SELECT event_id, id IN ({numbers(L.MAJOR_COOLDOWNS)}) AS major, id IN ({numbers(L.BLOODLUST)}) AS bloodlust,
  id IN ({numbers(L.BATTLE_RES)}) AS battle_res, id IN ({numbers(L.FLASKS)}) AS flask,
  id IN ({numbers(L.FOODS)}) AS food, id IN ({numbers(L.RUNES)}) AS rune FROM z""")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    pick = F.element_at(F.array(*[F.lit(x).cast("long") for x in (2825, 20484, 431972, 462854, 452925)], k),
                        (k % 6 + 1).cast("int"))
    d = t.events.select("event_id", pick.alias("id"))
    sets = {"major": list(L.MAJOR_COOLDOWNS), "bloodlust": L.BLOODLUST, "battle_res": L.BATTLE_RES,
            "flask": L.FLASKS, "food": L.FOODS, "rune": L.RUNES}
    return d.select("event_id", *[F.col("id").isin(v).alias(n) for n, v in sets.items()])


@query("p08_lookup_names", f"""
SELECT p_partkey,
  {case_of('p_size', L.DIFFICULTY_NAMES, "'Unknown (' || p_size || ')'")} AS difficulty,
  {case_of('p_size + 50', {k: v[1] for k, v in L.SPECS.items()}, "'Unknown Spec (' || (p_size + 50) || ')'")} AS spec,
  {case_of('p_size + 50', {k: v[0] for k, v in L.SPECS.items()}, "'Unknown Class (' || (p_size + 50) || ')'")} AS class,
  {case_of('p_size', L.AFFIXES, "'Unknown Affix (' || p_size || ')'")} AS affix FROM part""")
def _(t: Tables):
    n = F.col("p_size")
    return t.part.select("p_partkey", C.difficulty_name(n).alias("difficulty"), C.spec_name(n + 50).alias("spec"),
                         C.class_name(n + 50).alias("class"), C.affix_name(n).alias("affix"))


@query("p09_detect_role", f"""
WITH s AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS damage,
    sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS healing FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 300 IN ({numbers(L.TANK_SPECS)}) THEN 'tank'
  WHEN o_custkey % 300 IN ({numbers(L.HEALER_SPECS)}) THEN 'healer' WHEN healing > 2 * damage THEN 'healer' ELSE 'dps' END AS role FROM s""")
def _(t: Tables):
    def money(status):
        return F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")).otherwise(0.0))
    s = t.orders.groupBy("o_custkey").agg(money("F").alias("damage"), money("O").alias("healing"))
    return s.select("o_custkey", C.detect_role(F.col("o_custkey") % 300, F.col("damage"), F.col("healing")).alias("role"))


@query("p10_fight_type", f"""
SELECT p_partkey, CASE WHEN p_size IN ({numbers(L.RAID_DIFFICULTIES)}) THEN 'raid_boss' ELSE 'dungeon_boss' END AS fight_type,
  CASE WHEN p_size >= 14 THEN 'raid_boss' ELSE 'dungeon_boss' END AS fight_type_by_threshold,
  p_size IN ({numbers(L.RAID_DIFFICULTIES)}) AS is_raid, p_size IN ({numbers(L.DUNGEON_DIFFICULTIES)}) AS is_dungeon FROM part""")
def _(t: Tables):
    n = F.col("p_size")
    return t.part.select("p_partkey", C.fight_type(n).alias("fight_type"),
                         C.fight_type(n, 14).alias("fight_type_by_threshold"),
                         n.isin(L.RAID_DIFFICULTIES).alias("is_raid"), n.isin(L.DUNGEON_DIFFICULTIES).alias("is_dungeon"))


CATEGORY_SQL = """CASE event_type WHEN 'UNIT_DIED' THEN 'death' WHEN 'SPELL_DAMAGE' THEN
   CASE WHEN spell_id % 10 = 0 THEN 'major_cooldown' ELSE 'damage' END WHEN 'SPELL_HEAL' THEN
   CASE WHEN spell_id % 10 = 0 THEN 'major_cooldown' ELSE 'healing' END WHEN 'SPELL_CAST_SUCCESS' THEN
   CASE WHEN spell_id % 10 = 0 THEN 'major_cooldown' ELSE 'cast' END ELSE
   CASE WHEN spell_id % 10 = 0 THEN 'major_cooldown' ELSE 'other' END END"""
IMPORTANCE_SQL = """least(5, CASE event_type WHEN 'UNIT_DIED' THEN 5 WHEN 'SPELL_DAMAGE' THEN 2 WHEN 'SPELL_HEAL' THEN 2 ELSE 1 END
   + CASE WHEN event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') AND amount * 4 > 50000 THEN 2
          WHEN event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') AND amount * 4 > 20000 THEN 1 ELSE 0 END + 1)"""


def timeline_columns(e):
    named_spell = F.when(F.col("spell_id") % 10 == 0, F.lit("Time Warp II")).otherwise(F.col("spell_name"))
    return e.withColumns({
        "category": C.timeline_category(F.col("event_type"), named_spell),
        "importance": C.importance(F.col("event_type"), F.col("amount") * 4, F.col("source_guid"))})


@query("p11_timeline_category", f"""WITH {{EV}} SELECT line_no, {CATEGORY_SQL} AS category FROM ev""")
def _(t: Tables):
    return timeline_columns(combat_events(t)).select("line_no", "category")


@query("p12_importance", f"""WITH {{EV}} SELECT line_no, {IMPORTANCE_SQL} AS importance FROM ev""")
def _(t: Tables):
    return timeline_columns(combat_events(t)).select("line_no", "importance")


DESCRIBE_SQL = """CASE event_type WHEN 'UNIT_DIED' THEN dest_name || ' died'
  WHEN 'SPELL_DAMAGE' THEN source_name || ' dealt ' || format('{:,}', amount * 100) || ' damage to ' || dest_name || ' with ' || spell_name
  WHEN 'SPELL_HEAL' THEN source_name || ' healed ' || dest_name || ' for ' || format('{:,}', amount * 100) || ' with ' || spell_name
  WHEN 'SPELL_CAST_SUCCESS' THEN source_name || ' cast ' || spell_name
  ELSE 'SPELL_RESURRECT: ' || source_name || ' -> ' || dest_name END"""


def description(e):
    return C.describe(*[F.col(c) for c in ("event_type", "source_name", "dest_name", "spell_name")], F.col("amount") * 100)


@query("p13_describe", f"""WITH {{EV}} SELECT line_no, {DESCRIBE_SQL} AS description FROM ev""")
def _(t: Tables):
    e = combat_events(t)
    return e.select("line_no", description(e).alias("description"))


@query("p14_filter_criteria", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O')
  AND o_orderpriority LIKE '%HIGH%' AND o_custkey <> 7 AND o_orderstatus NOT IN ('P') AND o_totalprice < 400000""")
def _(t: Tables):
    return filters.where(t.orders, [
        ("o_totalprice", "ge", 100000), ("o_orderstatus", "in", ["F", "O"]), ("o_orderpriority", "like", "%HIGH%"),
        ("o_custkey", "ne", 7), ("o_orderstatus", "not_in", ["P"]), ("o_totalprice", "lt", 400000),
    ]).select("o_orderkey", "o_totalprice")


def encounters(t: Tables):
    """orders as encounters."""
    return t.orders.select(
        F.col("o_orderkey").alias("encounter_key"), (F.col("o_custkey") % 25).alias("guild_id"),
        F.col("o_custkey").alias("character_id"),
        F.col("o_orderpriority").alias("name"), F.substring("o_orderpriority", 1, 1).alias("difficulty"),
        F.when(F.col("o_orderkey") % 2 == 0, "raid").otherwise("mythic_plus").alias("encounter_type"),
        (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderkey") % 600 + 60).alias("duration"), F.col("o_totalprice").alias("damage"))


ENC = """enc AS (SELECT o_orderkey AS encounter_key, o_custkey % 25 AS guild_id, o_custkey AS character_id,
  o_orderpriority AS name, substr(o_orderpriority, 1, 1) AS difficulty,
  CASE WHEN o_orderkey % 2 = 0 THEN 'raid' ELSE 'mythic_plus' END AS encounter_type, o_orderstatus = 'F' AS success,
  o_orderdate AS start_ts, o_orderkey % 600 + 60 AS duration, o_totalprice AS damage FROM orders)"""


@query("p15_search_encounters", f"""WITH {ENC}
SELECT encounter_key, name, epoch_us(start_ts) AS start_us FROM enc WHERE name LIKE '%URG%' AND encounter_type = 'raid' AND success
  AND start_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30' ORDER BY start_ts DESC, encounter_key DESC LIMIT 100""")
def _(t: Tables):
    found = filters.search_encounters(encounters(t), name="URG", encounter_type="raid", success=True,
                                      start="1996-01-01", end="1998-06-30", limit=100)
    return found.select("encounter_key", "name", us("start_ts").alias("start_us"))


@query("p15_count_encounters", f"""WITH {ENC}
SELECT count(*) AS n FROM enc WHERE difficulty = '2' AND NOT success AND start_ts >= TIMESTAMP '1996-01-01'""")
def _(t: Tables):
    return filters.search_encounters(encounters(t), difficulty="2", success=False, start="1996-01-01").agg(
        F.count("*").alias("n"))


@query("p16_for_guild", f"""WITH {ENC} SELECT 'seven' AS asked, encounter_key, guild_id FROM enc WHERE guild_id = 7
UNION ALL SELECT 'invalid', encounter_key, guild_id FROM enc WHERE guild_id = 1""")
def _(t: Tables):
    e = encounters(t)
    cols = ["encounter_key", "guild_id"]
    return (filters.for_guild(e, 7).select(F.lit("seven").alias("asked"), *cols)
            .unionByName(filters.for_guild(e, -3).select(F.lit("invalid").alias("asked"), *cols)))


@query("p17_time_range", """SELECT o_orderkey FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'""")
def _(t: Tables):
    return filters.time_range(t.orders, "o_orderdate", "1997-01-01", "1997-03-31").select("o_orderkey")


@query("p18_relative_time", """WITH {EV}, s AS (SELECT encounter_key, min(ts) AS start_ts FROM ev GROUP BY 1)
SELECT line_no, (epoch_us(ts) - epoch_us(start_ts)) / 1e6 AS relative_time FROM ev JOIN s USING (encounter_key)
WHERE (epoch_us(ts) - epoch_us(start_ts)) / 1e6 BETWEEN 3600 AND 36000 AND (source_guid = 'Player-3' OR dest_guid = 'Player-3')""")
def _(t: Tables):
    e = combat_events(t)
    starts = e.groupBy("encounter_key").agg(F.min("ts").alias("start_ts"))
    rel = (us("ts") - us("start_ts")) / 1e6
    part = (F.col("source_guid") == "Player-3") | (F.col("dest_guid") == "Player-3")
    return (e.join(starts, "encounter_key").withColumn("relative_time", rel)
            .filter(F.col("relative_time").between(3600, 36000) & part).select("line_no", "relative_time"))


@query("p19_labels", """SELECT o_orderkey, ((o_orderkey % 4000) // 60)::VARCHAR || ':' || lpad(((o_orderkey % 4000) % 60)::VARCHAR, 2, '0') AS duration_str,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' || (o_orderkey % 20 + 2) ELSE substr(o_orderpriority, 3) END AS difficulty_label FROM orders""")
def _(t: Tables):
    k = F.col("o_orderkey")
    level = F.concat(F.lit("+"), (k % 20 + 2).cast("string"))
    return t.orders.select("o_orderkey", C.clock(k % 4000).alias("duration_str"),
                           F.when(k % 2 == 0, level).otherwise(F.expr("substr(o_orderpriority, 3)")).alias("difficulty_label"))


@query("p20_window_key", """SELECT event_id, (epoch_us(ts) // 300000000) * 300000000 AS window_us FROM events""")
def _(t: Tables):
    return t.events.select("event_id", us(F.window("ts", "5 minutes").start).alias("window_us"))


@query("p21_encounter_key", """SELECT o_orderkey, (o_custkey % 25)::VARCHAR || '_' || epoch_ms(o_orderdate)::VARCHAR || '_' ||
  substr(sha256(o_orderpriority), 1, 8) AS encounter_key FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", C.encounter_key(
        F.col("o_custkey") % 25, F.col("o_orderdate"), F.col("o_orderpriority")).alias("encounter_key"))


@query("p24_is_combat_event", """WITH {EV}, x AS (SELECT line_no, CASE spell_id % 7 WHEN 0 THEN 'SPELL_AURA_BROKEN' WHEN 1 THEN 'ZONE_CHANGE'
    WHEN 2 THEN 'SPELL_STOLEN' WHEN 3 THEN 'SPELL_PERIODIC_HEAL' WHEN 4 THEN 'SPELL_CREATE' WHEN 5 THEN 'SPELL_CAST_FAILED' ELSE event_type END AS event_type FROM ev)
SELECT line_no, event_type, event_type IN ('SPELL_STOLEN', 'SPELL_PERIODIC_HEAL', 'SPELL_CREATE', 'SPELL_DAMAGE', 'SPELL_HEAL', 'SPELL_CAST_SUCCESS', 'UNIT_DIED') AS combat,
  event_type LIKE '%HEAL%' AS custom FROM x""")
def _(t: Tables):
    k = F.col("spell_id") % 7
    kinds = ["SPELL_AURA_BROKEN", "ZONE_CHANGE", "SPELL_STOLEN", "SPELL_PERIODIC_HEAL", "SPELL_CREATE", "SPELL_CAST_FAILED"]
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in kinds]), k.cast("int")), F.col("event_type"))
    e = combat_events(t).withColumn("event_type", name)
    return e.select("line_no", "event_type", C.is_combat(F.col("event_type")).alias("combat"),
                    C.is_combat(F.col("event_type"), [], ["HEAL"]).alias("custom"))
