"""Writes, merges, file checks and legacy mappings over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.plans.catalog import Tables, query
from fraylens.plans.standins import combat_events, us
from fraylens.session import work_folder
from fraylens.sources import stores


@query("s11_write_events", """WITH {EV} SELECT CASE WHEN guild_id = 5 THEN 1 ELSE guild_id END AS guild_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS events, CAST(sum(amount) AS BIGINT) AS amount FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    path = work_folder(t.spark, "events")
    e = combat_events(t).withColumn("guild_id", F.when(F.col("guild_id") < 5, F.col("guild_id")).otherwise(-1)).drop("aura_type")
    e = e.withColumn("upload", F.sha2(F.concat_ws("-", F.col("guild_id").cast("string"), (F.col("line_no") % 3).cast("string")), 256))
    # two uploads first, then everything with them, then everything once more
    some = e.where("line_no % 3 = 0 AND guild_id IN (1, 2)")
    for part in (some, e, e):
        stores.ingest_events(part, path)
    d = stores.read_uploads(t.spark, path, "amount long")
    return d.groupBy("guild_id", F.unix_date("event_date").cast("long").alias("day")).agg(
        F.count("*").alias("events"), F.sum("amount").alias("amount"))


@query("s12_upsert_characters", """SELECT o_custkey, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us, count(*) AS encounter_count, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS name FROM orders GROUP BY 1""")
def _(t: Tables):
    def seen(df):
        return df.groupBy("o_custkey", F.pmod("o_orderkey", F.lit(7)).alias("upload")).agg(
            F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.count("*").alias("encounter_count"),
            F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderpriority")).alias("name"))
    o = t.orders
    table = seen(o.filter("o_orderkey % 7 < 4"))
    # the later uploads come twice, the second time with one of the first ones
    for part in (seen(o.filter("o_orderkey % 7 >= 4")), seen(o.filter("o_orderkey % 7 >= 3"))):
        table = stores.upsert_sightings(table, part, "o_custkey")
    return stores.characters_seen(table, "o_custkey").select("o_custkey", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "encounter_count", "name")


@query("s13_upsert_metrics", """SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return stores.upsert_metrics(rows, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_quantity"])


@query("s14_dedupe_files", """SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def _(t: Tables):
    return stores.dedupe_files(t.documents, "text", "doc_id")


@query("s14_new_files_only", """SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE doc_id % 4 > 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY 1""")
def _(t: Tables):
    known = t.documents.filter("doc_id % 4 = 0").select(F.sha2("text", 256).alias("file_hash"))
    return stores.dedupe_files(t.documents.filter("doc_id % 4 > 0"), "text", "doc_id", known)


@query("s15_ingest_status", """WITH {EV} SELECT guild_id, count(*) AS events, count(DISTINCT encounter_key) AS encounters, count(DISTINCT source_guid) AS characters, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM ev GROUP BY 1""")
def _(t: Tables):
    s = stores.ingest_status(combat_events(t), ["guild_id"])
    return s.select("guild_id", "events", "encounters", "characters", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("s21_map_legacy", """SELECT o_orderkey::VARCHAR AS encounter_key, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown') AS name, (o_orderkey % 600000) / 1000 AS duration,
  c_name || '-' || CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS character_guid, 1::BIGINT AS guild_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t: Tables):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    server = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return stores.map_legacy(d, {
        "encounter_key": F.col("o_orderkey").cast("string"),
        "name": F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")), F.lit("Unknown")),
        "duration": (F.col("o_orderkey") % 600000) / 1000, "character_guid": stores.legacy_guid(F.col("c_name"), server),
        "guild_id": F.lit(1).cast("long")})


@query("s22_backfill", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || '-X-US' END AS server, CASE WHEN c_custkey % 2 = 0 THEN 'EU' ELSE '' END AS region, CASE WHEN c_nationkey > 0 THEN c_nationkey ELSE 1 END AS guild_id FROM customer""", longs=("guild_id",))
def _(t: Tables):
    realm = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("-EU"))).otherwise(F.concat("c_mktsegment", F.lit("-X-US")))
    d = t.customer.select("c_custkey", realm.alias("realm"), F.col("c_nationkey").cast("long").alias("guild_id"))
    return stores.backfill_tenant(stores.backfill_server_region(d)).select("c_custkey", "server", "region", "guild_id")


@query("s23_block_stats", """WITH {EV} SELECT encounter_key, guild_id, count(*) AS event_count, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, CAST(sum(length(spell_name)) AS BIGINT) AS raw_bytes FROM ev GROUP BY 1, 2""")
def _(t: Tables):
    path = work_folder(t.spark, "compact")
    stores.compact_events(combat_events(t).drop("aura_type"), path)
    s = stores.block_stats(t.spark.read.parquet(path), ["encounter_key", "guild_id"], F.col("spell_name"))
    return s.select("encounter_key", "guild_id", "event_count", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "raw_bytes")


@query("s24_run_saved_search", """SELECT p_partkey FROM part WHERE p_size > 30 AND p_type = 'SMALL'""")
def _(t: Tables):
    path = work_folder(t.spark, "searches")
    stores.save_search(t.spark, path, "big", {"and": [{"field": "p_size", "operator": "gt", "value": 45}, {"field": "p_type", "value": "SMALL"}]})
    return stores.run_saved(t.spark, path, "big", t.part, {"p_size": 30}).select("p_partkey")


@query("s25_table_round_trip", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def _(t: Tables):
    path = work_folder(t.spark, "table")
    stores.write_table(t.orders, path, "orc")
    return stores.read_table(t.spark, path, "orc").select("o_orderkey", "o_custkey", "o_totalprice")
