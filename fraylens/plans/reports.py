"""Exports, details, statistics over tables and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.operators import metrics as M
from fraylens.plans.catalog import Tables, query
from fraylens.plans.joins import LOC, metric_rows
from fraylens.plans.standins import combat_events, us
from fraylens.sources import export


def order_lines(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("encounter_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("spell_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("damage"), F.col("l_quantity").cast("long").alias("hits"))


def order_heads(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("encounter_id"), F.col("o_orderpriority").alias("name"),
                           (F.col("o_orderstatus") == "F").alias("success"), us("o_orderdate").alias("start_us"))


@query("s16_export_encounter", """WITH c AS (SELECT l_orderkey, list(struct_pack(line := l_linenumber, spell_id := l_partkey, damage := CAST(round(l_extendedprice * 100) AS BIGINT), hits := CAST(l_quantity AS BIGINT))
   ORDER BY l_linenumber, l_partkey, round(l_extendedprice * 100), l_quantity) AS metrics FROM lineitem GROUP BY 1)
SELECT o_orderkey AS encounter_id, 0::BIGINT AS part, CASE WHEN metrics IS NULL THEN
  to_json(struct_pack(encounter_id := o_orderkey, name := o_orderpriority, success := o_orderstatus = 'F', start_us := epoch_us(o_orderdate), part := 0))::VARCHAR ELSE
  to_json(struct_pack(encounter_id := o_orderkey, name := o_orderpriority, success := o_orderstatus = 'F', start_us := epoch_us(o_orderdate), part := 0, metrics := metrics))::VARCHAR END AS document
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def _(t: Tables):
    return export.documents(order_heads(t), order_lines(t), "encounter_id", ["line", "spell_id", "damage", "hits"], "metrics")


@query("s16_event_samples", """WITH {EV}, r AS (SELECT encounter_key, source_guid, line_no, row_number() OVER (PARTITION BY encounter_key, guild_id ORDER BY ts, line_no) AS position FROM ev) SELECT * FROM r WHERE position <= 10""")
def _(t: Tables):
    s = export.event_samples(combat_events(t), ["encounter_key", "guild_id"])
    return s.select("encounter_key", "source_guid", "line_no", F.col("position").cast("long").alias("position"))


@query("s17_export_csv", """SELECT c_name AS character_name, c_mktsegment AS class_name, o_orderkey AS encounter_id, o_totalprice AS dps FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t: Tables):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(F.col("c_name").alias("character_name"), F.col("c_mktsegment").alias("class_name"),
                    F.col("o_orderkey").alias("encounter_id"), F.col("o_totalprice").alias("dps"))


@query("s18_export_fights", """WITH f AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus = 'F' AS kill, epoch_ms(o_orderdate) AS start_time, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS players FROM f""")
def _(t: Tables):
    fights = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    d = fights.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    g = d.groupBy("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").agg(F.count_distinct("l_suppkey").alias("players"))
    return g.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").alias("kill"),
                    F.unix_millis("o_orderdate").alias("start_time"), "players")


@query("s18_export_friendlies", """SELECT o_custkey % 25 AS report, c_name AS name, c_mktsegment AS type, count(*) AS fights, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS outcomes
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def _(t: Tables):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = d.groupBy((F.col("o_custkey") % 25).alias("report"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    return g.agg(F.count("*").alias("fights"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("outcomes"))


@query("s19_export_sheet", """SELECT c_name, c_mktsegment, count(*)::VARCHAR AS encounters, round_even(avg(CAST(round(o_totalprice) AS BIGINT)) / 7, 1)::VARCHAR AS avg_dps FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2 ORDER BY avg(CAST(round(o_totalprice) AS BIGINT)) / 7 DESC, c_name LIMIT 100""")
def _(t: Tables):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = d.groupBy("c_name", "c_mktsegment").agg(F.count("*").alias("encounters"), (F.avg(F.round("o_totalprice").cast("long")) / 7).alias("avg_dps"))
    return export.sheet(g.orderBy(F.desc("avg_dps"), "c_name").limit(100), ["c_name", "c_mktsegment", "encounters", "avg_dps"])


@query("s20_export_unified", """WITH c AS (SELECT o_custkey, list(struct_pack(fight_id := o_orderkey, name := o_orderpriority, success := o_orderstatus = 'F') ORDER BY o_orderkey) AS fights FROM orders GROUP BY 1)
SELECT c_custkey, 0::BIGINT AS part, CASE WHEN fights IS NULL THEN to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, part := 0))::VARCHAR
  ELSE to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, part := 0, fights := fights))::VARCHAR END AS document FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def _(t: Tables):
    fights = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("fight_id"), F.col("o_orderpriority").alias("name"),
                             (F.col("o_orderstatus") == "F").alias("success"))
    return export.documents(t.customer.select("c_custkey", "c_name"), fights, "c_custkey", ["fight_id", "name", "success"], "fights")


@query("s20_text_report", """SELECT rpad(o_orderpriority, 16, ' ') || lpad(count(*)::VARCHAR, 8, ' ') || ' pulls ' || lpad((count(*) FILTER (o_orderstatus = 'F'))::VARCHAR, 6, ' ') || ' kills' AS line FROM orders GROUP BY o_orderpriority""")
def _(t: Tables):
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return export.text_report(g, "%-16s%8d pulls %6d kills", ["o_orderpriority", "n", "k"])


STATS_TABLES = ["orders", "lineitem", "customer", "part", "events", "documents"]


@query("a38_table_stats", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows, " + {
        "orders": "count(*) FILTER (o_orderdate >= TIMESTAMP '1999-07-01' - INTERVAL 7 DAY)",
        "events": "count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)"}.get(n, "CAST(NULL AS BIGINT)") + f" AS recent FROM {n}" for n in STATS_TABLES))
def _(t: Tables):
    clocks = {"orders": ("o_orderdate", "1999-07-01"), "events": ("ts", "2024-01-31")}
    out = None
    for name in STATS_TABLES:
        df = getattr(t, name)
        recent = F.lit(None).cast("long")
        if name in clocks:
            ts, now = clocks[name]
            recent = F.count_if(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(7)))
        row = df.agg(F.count("*").alias("rows"), recent.alias("recent")).select(F.lit(name).alias("table_name"), "rows", "recent")
        out = row if out is None else out.unionByName(row)
    return out


@query("a42_character_export", """SELECT c_custkey, c_name, count(o_orderkey) AS encounters, round(coalesce(count(*) FILTER (o_orderstatus = 'F') * 100.0 / nullif(count(o_orderkey), 0), 0), 6)::DOUBLE AS success_rate,
  round(avg(o_totalprice), 4) AS avg_dps, CAST(coalesce(sum(o_orderkey % 3), 0) AS BIGINT) AS deaths FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""", cents=True)
def _(t: Tables):
    from fraylens.functions.classify import ratio
    h = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("encounters"), F.count_if(F.col("o_orderstatus") == "F").alias("kills"), F.avg("o_totalprice").alias("avg_dps"),
        F.sum(F.col("o_orderkey") % 3).alias("deaths"))
    d = t.customer.join(h, F.col("o_custkey") == F.col("c_custkey"), "left").na.fill(0, ["encounters", "kills", "deaths"])
    return d.select("c_custkey", "c_name", "encounters", F.round(ratio(F.col("kills") * 100.0, F.col("encounters")), 6).alias("success_rate"),
                    F.round("avg_dps", 4).alias("avg_dps"), "deaths")


@query("a42_character_performance", f"""WITH {LOC} SELECT c_custkey, count(DISTINCT o_orderkey) AS encounters, round(avg(l_extendedprice), 4) AS avg_damage, round(max(l_extendedprice), 2) AS best_damage FROM loc
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1""", cents=True)
def _(t: Tables):
    d = metric_rows(t).filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return d.groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("encounters"), F.round(F.avg("l_extendedprice"), 4).alias("avg_damage"),
                                      F.round(F.max("l_extendedprice"), 2).alias("best_damage"))


@query("a44_batch_summary", """WITH {EV} SELECT (epoch_us(ts) // 300000000) * 300000000 AS window_us, count(*) AS events, count(DISTINCT encounter_key) AS encounters, count(DISTINCT guild_id) AS guilds FROM ev GROUP BY 1""")
def _(t: Tables):
    e = combat_events(t)
    g = e.groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count("*").alias("events"), F.count_distinct("encounter_key").alias("encounters"), F.count_distinct("guild_id").alias("guilds"))
    return g.select(us("w.start").alias("window_us"), "events", "encounters", "guilds")


@query("a46_encounter_detail", """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS participants, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hits FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT o_orderkey, 0::BIGINT AS part, o_orderpriority, participants, coalesce(hits, 0) AS hits FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def _(t: Tables):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    hits = lines.groupBy("o_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("hits"))
    people = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "s_name").distinct()
    listed = export.parts(people, "o_orderkey", ["s_name"], "items")
    d = t.orders.select("o_orderkey", "o_orderpriority").join(hits, "o_orderkey", "left").join(listed, "o_orderkey", "left")
    d = d.withColumns({"part": F.coalesce("part", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    return d.select("o_orderkey", "part", export.in_head("o_orderpriority"), F.array_join("items.s_name", ",").alias("participants"), export.in_head("hits"))


@query("a47_upload_stats", """SELECT o_orderstatus AS status, count(*) AS logs, CAST(sum(o_orderkey * 10) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS events FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t: Tables):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("logs"), F.sum(F.col("o_orderkey") * 10).alias("bytes"), F.sum("n").alias("events"))


@query("s20_markdown_report", """SELECT '| ' || o_orderpriority || ' | ' || count(*) || ' |' AS line FROM orders GROUP BY o_orderpriority""")
def _(t: Tables):
    return export.markdown_rows(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), ["o_orderpriority", "n"])


@query("s20_html_report", """SELECT '<tr><td>&lt;' || o_orderpriority || '&gt;</td><td>' || count(*) || '</td></tr>' AS line FROM orders GROUP BY o_orderpriority""")
def _(t: Tables):
    g = t.orders.groupBy(F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("name")).agg(F.count("*").alias("n"))
    return export.html_rows(g, ["name", "n"])
