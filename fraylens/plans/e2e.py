"""Raw text to metrics: lines of two uploads derived from ``events``, compared with SQL on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens import pipeline
from fraylens.plans.catalog import Tables, query
from fraylens.plans.standins import combat_events
from fraylens.session import work_folder

DAY_US = 86_400_000_000


def upload_lines(t: Tables):
    """Guild 1 logs everything in file a, guild 2 part of it in file b. Melee hits are logged twice, some are a pet's, who is summoned at
    sign-up; one encounter a day from 2:00 to 20:00."""
    e, k, kind = combat_events(t), F.col("spell_id"), F.col("event_type")
    stamp = lambda ts: F.concat(F.date_format(ts, "M/d/yyyy HH:mm:ss.SSS"), F.lit("-4  "))
    text = lambda head, *rest: F.concat_ws(",", F.lit(head), *rest)
    pet = F.concat(F.lit("Pet-"), F.col("user_id").cast("string"))
    units = lambda s, d: F.concat_ws(",", s, F.lit('"A"'), F.lit("0x512,0x0"), d, F.lit('"B"'), F.lit("0xa48,0x0"))
    source = F.when(k % 4 == 1, pet).otherwise(F.col("source_guid"))
    spell = F.concat_ws(",", k.cast("string"), F.lit('"S"'), F.lit("0x1"))
    hit = F.concat_ws(",", "amount", "overkill", F.lit("1,0,0,0,nil,nil,nil"))
    lines = F.array(
        F.when(kind == "SPELL_RESURRECT", F.struct(F.lit(0).alias("i"), text("SPELL_SUMMON", units(F.col("source_guid"), pet), spell).alias("s"))),
        F.when(kind == "SPELL_DAMAGE", F.struct(F.lit(1).alias("i"), text("SWING_DAMAGE", units(source, F.col("dest_guid")), hit).alias("s"))),
        F.when(kind == "SPELL_DAMAGE", F.struct(F.lit(2).alias("i"), text("SWING_DAMAGE_LANDED", units(source, F.col("dest_guid")), hit).alias("s"))),
        F.when(kind == "SPELL_HEAL", F.struct(F.lit(0).alias("i"), text("SPELL_HEAL", units(F.col("source_guid"), F.col("dest_guid")), spell, "amount", "overhealing", F.lit("0,nil")).alias("s"))),
        F.when(kind == "SPELL_CAST_SUCCESS", F.struct(F.lit(0).alias("i"), text("SPELL_CAST_SUCCESS", units(F.col("source_guid"), F.col("dest_guid")), spell).alias("s"))),
        F.when(kind == "UNIT_DIED", F.struct(F.lit(0).alias("i"), F.concat_ws(",", F.lit("UNIT_DIED,nil,nil,0x0,0x0"), "dest_guid", F.lit('"B",0x512,0x0')).alias("s"))))
    said = e.select("spell_id", "ts", (F.col("line_no") * 4).alias("n"), F.explode(F.array_compact(lines)).alias("l")).select(
        "spell_id", (F.col("n") + F.col("l.i")).alias("line_no"), F.concat(stamp("ts"), F.col("l.s")).alias("line"))
    day = e.select(F.date_trunc("day", "ts").alias("d")).distinct()
    number = F.lit(4_000_000_000) + F.floor(F.unix_micros("d") / F.lit(float(DAY_US))) * 2
    frame = lambda h, i, s: day.select(F.lit(1).cast("long").alias("spell_id"), (number + i).alias("line_no"), F.concat(
        stamp(F.col("d") + F.make_dt_interval(hours=F.lit(h))), F.lit(s)).alias("line"))
    said = said.unionByName(frame(2, 0, 'ENCOUNTER_START,7,"Boss",15,20,1')).unionByName(frame(20, 1, 'ENCOUNTER_END,7,"Boss",15,20,1,1'))
    one = lambda g, f, d: d.select(F.lit(g).cast("long").alias("guild_id"), F.lit(f).alias("file_id"), F.lit(0).cast("long").alias("block"), "line_no", "line")
    return one(1, "a", said).unionByName(one(2, "b", said.filter(F.col("spell_id") % 3 != 0)))


E2E = """up AS (SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, 'b')) t(guild_id, file_id)),
b AS (SELECT up.guild_id, file_id, line_no, epoch_us(ts) // 1000 * 1000 AS us, user_id, amount, overkill, overhealing, event_type, dest_guid, source_guid AS owner,
  CASE WHEN event_type = 'SPELL_DAMAGE' AND spell_id % 4 = 1 THEN 'Pet-' || user_id ELSE source_guid END AS src FROM ev, up WHERE up.guild_id = 1 OR spell_id % 3 <> 0),
sw AS (SELECT * FROM b WHERE event_type = 'SPELL_DAMAGE' QUALIFY row_number() OVER (PARTITION BY guild_id, us, src, dest_guid ORDER BY line_no) = 1),
su AS (SELECT guild_id, user_id, min((us, line_no)) AS first FROM b WHERE event_type = 'SPELL_RESURRECT' GROUP BY 1, 2),
hits AS (SELECT sw.*, CASE WHEN src LIKE 'Pet-%' AND first < (us, line_no) THEN owner ELSE src END AS guid FROM sw LEFT JOIN su USING (guild_id, user_id)),
r AS (SELECT guild_id, file_id, us, guid, 'damage_done' AS category, amount, overkill, 0 AS overhealing FROM hits
  UNION ALL SELECT guild_id, file_id, us, dest_guid, 'damage_taken', amount, 0, 0 FROM hits
  UNION ALL SELECT guild_id, file_id, us, owner, 'healing_done', amount, 0, overhealing FROM b WHERE event_type = 'SPELL_HEAL'
  UNION ALL SELECT guild_id, file_id, us, dest_guid, 'healing_received', amount, 0, overhealing FROM b WHERE event_type = 'SPELL_HEAL'
  UNION ALL SELECT guild_id, file_id, us, owner, 'cast', 0, 0, 0 FROM b WHERE event_type = 'SPELL_CAST_SUCCESS'
  UNION ALL SELECT guild_id, file_id, us, dest_guid, 'death', 0, 0, 0 FROM b WHERE event_type = 'UNIT_DIED'),
m AS (SELECT guild_id, file_id, 4000000000 + us // 86400000000 * 2 AS encounter_id, guid,
  CAST(coalesce(sum(amount) FILTER (category = 'damage_done'), 0) AS BIGINT) AS damage_done, CAST(coalesce(sum(overkill) FILTER (category = 'damage_done' AND overkill > 0), 0) AS BIGINT) AS overkill_done,
  CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (category = 'healing_done'), 0) AS BIGINT) AS healing_done,
  CAST(coalesce(sum(amount) FILTER (category = 'damage_taken'), 0) AS BIGINT) AS damage_taken,
  CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (category = 'healing_received'), 0) AS BIGINT) AS healing_received,
  count(*) FILTER (category = 'cast') AS casts, count(*) FILTER (category = 'death') AS deaths, count(*) AS total_events
  FROM r WHERE guid LIKE 'Player-%' AND us % 86400000000 BETWEEN 7200000000 AND 72000000000 GROUP BY 1, 2, 3, 4)"""
TOTALS = ["damage_done", "overkill_done", "healing_done", "damage_taken", "healing_received", "casts", "deaths", "total_events"]


@query("e2e_log_to_metrics", f"""WITH {{EV}}, {E2E}, lines AS (SELECT count(*) + count(*) FILTER (event_type = 'SPELL_DAMAGE') AS n FROM ev),
day AS (SELECT d, dense_rank() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT epoch_us(ts) // 86400000000 AS d FROM ev))
SELECT m.* EXCLUDE (file_id) REPLACE (lines.n + 2 * day.k - 1 AS encounter_id) FROM m, lines, day WHERE guild_id = 1 AND day.d = (m.encounter_id - 4000000000) // 2""")
def _(t: Tables):
    path = work_folder(t.spark, "raw-log")
    # one text file; an encounter's id is the line that it starts in
    lines = upload_lines(t).filter("guild_id = 1")
    lines.repartition("file_id").sortWithinPartitions("file_id", "line_no").select("file_id", "line").write.partitionBy("file_id").text(path)
    return pipeline.character_metrics(t.spark, path, 1).select("guild_id", "encounter_id", "guid", *TOTALS)


@query("e2e_two_guilds_same_log", f"WITH {{EV}}, {E2E} SELECT * FROM m")
def _(t: Tables):
    return pipeline.metrics_of_lines(upload_lines(t)).select("guild_id", "file_id", "encounter_id", "guid", *TOTALS)
