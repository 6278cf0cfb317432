"""Equi-joins of the star schema in the shapes the reports use."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.operators import metrics as M
from fraylens.plans.catalog import Tables, query
from fraylens.plans.standins import combat_events, us


def metric_rows(t: Tables):
    """lineitem joined to its encounter and character (order and customer)."""
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return m.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))


LOC = """loc AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query("j04_metrics_characters_encounters", f"""WITH {LOC}
SELECT l_orderkey, l_linenumber, c_name, c_mktsegment, o_orderpriority, l_extendedprice FROM loc WHERE o_orderstatus = 'F' AND l_quantity > 45""")
def _(t: Tables):
    return metric_rows(t).filter("o_orderstatus = 'F' AND l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "c_name", "c_mktsegment", "o_orderpriority", "l_extendedprice")


def encounters_with_runs(encounters, runs, key: str, least_level: int | None = None, in_time: bool | None = None):
    """Encounters with their run, if any; the level and timing filters apply to the joined rows."""
    out = encounters.join(runs, key, "left")
    if least_level is not None:
        out = out.filter(F.col("keystone_level") >= least_level)
    return out.filter(F.col("in_time") == in_time) if in_time is not None else out


@query("j05_encounters_left_runs", """
SELECT o_orderkey, o_orderpriority, CAST(l_quantity AS BIGINT) % 20 + 2 AS keystone_level, l_returnflag = 'A' AS in_time
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_discount > 0.02) ON l_orderkey = o_orderkey""")
def _(t: Tables):
    runs = t.lineitem.filter("l_linenumber = 1 AND l_discount > 0.02").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity").cast("long") % 20 + 2).alias("keystone_level"),
        (F.col("l_returnflag") == "A").alias("in_time"))
    return encounters_with_runs(t.orders.select("o_orderkey", "o_orderpriority"), runs, "o_orderkey")


@query("j05_runs_in_time", """
SELECT o_orderkey, CAST(l_quantity AS BIGINT) % 20 + 2 AS keystone_level FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_linenumber = 1 AND l_returnflag = 'A' AND CAST(l_quantity AS BIGINT) % 20 + 2 >= 15""")
def _(t: Tables):
    runs = t.lineitem.filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity").cast("long") % 20 + 2).alias("keystone_level"),
        (F.col("l_returnflag") == "A").alias("in_time"))
    return encounters_with_runs(t.orders, runs, "o_orderkey", 15, True).select("o_orderkey", "keystone_level")


def last_seen(characters, performances, key: str):
    """Characters with number of performances and last appearance (null when none)."""
    seen = performances.groupBy(key).agg(F.max("ts").alias("last_seen"), F.count("*").alias("encounter_count"))
    return characters.join(seen, key, "left").withColumn("encounter_count", F.coalesce("encounter_count", F.lit(0)))


@query("j06_characters_last_seen", """SELECT c_custkey, c_name, count(o_orderkey) AS encounter_count, epoch_us(max(o_orderdate)) AS last_us
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1, 2""")
def _(t: Tables):
    perf = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("ts"))
    d = last_seen(t.customer.select("c_custkey", "c_name"), perf, "c_custkey")
    return d.select(
        "c_custkey", "c_name", "encounter_count", us("last_seen").alias("last_us"))


@query("j06_character_by_name", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%CUSTOMER#00000001%'")
def _(t: Tables):
    return t.customer.filter(F.col("c_name").ilike("%CUSTOMER#00000001%")).select("c_custkey", "c_name")


@query("j10_encounter_summary", """WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS damage, count(*) AS events FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority, coalesce(damage, 0) AS damage, coalesce(events, 0) AS events FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def _(t: Tables):
    s = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("damage"), F.count("*").alias("events"))
    d = t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.select("o_orderkey", "o_orderpriority", F.coalesce("damage", F.lit(0.0)).alias("damage"),
                    F.coalesce("events", F.lit(0)).alias("events"))


@query("j13_conditional_left_join", """SELECT c_custkey, count(o_orderkey) AS encounters, count(DISTINCT CAST(o_orderdate AS DATE)) AS days
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' WHERE c_nationkey < 5 GROUP BY 1""")
def _(t: Tables):
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    d = t.customer.filter("c_nationkey < 5").join(t.orders, on, "left")
    return d.groupBy("c_custkey").agg(F.count("o_orderkey").alias("encounters"),
                                      F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("j14_correlated_count", """SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS characters FROM orders""")
def _(t: Tables):
    n = t.lineitem.filter("l_quantity > 25").groupBy("l_orderkey").agg(F.count("*").alias("characters"))
    d = t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.select("o_orderkey", F.coalesce("characters", F.lit(0)).alias("characters"))


def full_players(events, keys):
    """Damage players full-joined with healing players."""
    damage = (events.filter(F.col("event_type").isin(C.DAMAGE_LIKE)).groupBy(*keys, F.col("source_guid").alias("guid"))
              .agg(F.sum("amount").alias("damage")))
    healing = (events.filter(F.col("event_type").isin(C.HEAL_LIKE)).groupBy(*keys, F.col("source_guid").alias("guid"))
               .agg(F.sum(M.effective()).alias("healing")))
    return damage.join(healing, [*keys, "guid"], "full_outer").na.fill(0, ["damage", "healing"])


@query("j15_full_outer_players", """WITH {EV}, d AS (SELECT encounter_key, source_guid AS guid, CAST(sum(amount) AS BIGINT) AS damage FROM ev WHERE event_type = 'SPELL_DAMAGE' GROUP BY 1, 2),
h AS (SELECT encounter_key, source_guid AS guid, CAST(sum(amount - overhealing) AS BIGINT) AS healing FROM ev WHERE event_type = 'SPELL_HEAL' GROUP BY 1, 2)
SELECT encounter_key, guid, coalesce(damage, 0) AS damage, coalesce(healing, 0) AS healing FROM d FULL JOIN h USING (encounter_key, guid)""")
def _(t: Tables):
    return full_players(combat_events(t), ["encounter_key"])


@query("j16_tracked_only", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t: Tables):
    tracked = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return t.events.join(tracked, "user_id", "left_semi").select("event_id", "user_id")
