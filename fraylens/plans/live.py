"""Streaming queries run to the end of the given tables and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.operators import segments
from fraylens.operators.ordered import carry, newest, row_number
from fraylens.plans.catalog import Tables, query
from fraylens.plans.logs import log_lines
from fraylens.plans.sequences import GAP, PERIODS
from fraylens.plans.standins import combat_view, us
from fraylens.session import stored, work_folder
from fraylens.sources import log
from fraylens.streaming import live, stateful


def event_stream(t: Tables, path: str | None = None, files: int | None = None):
    schema = t.spark.read.parquet(t.path("events")).schema
    raw = live.stream_table(t.spark, path or t.path("events") + "*", schema, files)
    return combat_view(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def finish(t: Tables, stream, mode: str, name: str, keys=None):
    path = work_folder(t.spark, name)
    live.run_available(stream, mode, live.batch_writer(f"{path}/out"), f"{path}/state")
    return live.stored(t.spark, f"{path}/out", keys)


#: Files that a piece of a table arrives in, i.e. those of one micro-batch.
FILES = 4


def pieces(t: Tables, name: str, conditions: list[str]) -> str:
    """The events table cut into pieces that arrive in the given order, ``FILES`` files each."""
    path = work_folder(t.spark, name)
    e = t.spark.read.parquet(t.path("events"))
    for c in conditions:
        e.filter(c).repartition(FILES).write.mode("append").parquet(path)
    return path


SHUFFLED = ["day(ts) % 3 = 1", "day(ts) % 3 = 0", "day(ts) % 3 = 2"]


@query("r01_stream_log_lines", """WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') THEN amount ELSE 0 END) AS BIGINT) AS amount
FROM (SELECT CASE WHEN event_type = 'SPELL_RESURRECT' THEN 'SPELL_AURA_APPLIED_DOSE' ELSE event_type END AS event_type, amount FROM ev WHERE spell_id <> 7) GROUP BY 1""")
def _(t: Tables):
    path = work_folder(t.spark, "lines")
    log_lines(t).select("line").write.text(path)
    typed = log.project_events(log.tokenize(live.stream_log_files(t.spark, path, 4)))
    d = finish(t, typed.select("event_type", "amount"), "append", "r01")
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("r01_client_messages", """WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type IN ('SPELL_DAMAGE', 'SPELL_HEAL') THEN amount ELSE 0 END) AS BIGINT) AS amount
FROM (SELECT CASE WHEN event_type = 'SPELL_RESURRECT' THEN 'SPELL_AURA_APPLIED_DOSE' ELSE event_type END AS event_type, amount FROM ev WHERE spell_id <> 7 AND line_no % 7 <> 3) GROUP BY 1""")
def _(t: Tables):
    messages = live.dedupe_sequences(live.stream_lines(t.spark, client_messages(t), FILES), delay="40 days")
    typed = log.project_events(log.tokenize(messages.select(F.lit(1).cast("long").alias("guild_id"), F.col("client_id").alias("file_id"), "line")))
    d = finish(t, typed.select("event_type", "amount"), "append", "r01m")
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def client_messages(t: Tables) -> str:
    """JSON messages of clients (one per user, numbered from 1 in event order): 1 in 7 is lost, the others come twice, in four deliveries."""
    numbered = carry(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["event_id"], F.floor(F.col("event_id") / 100_000), seq=row_number())
    lines = log_lines(t).select(F.col("line_no").alias("event_id"), "line")
    sent = numbered.where("event_id % 7 <> 3").join(lines, "event_id").select(
        F.col("user_id").cast("string").alias("client_id"), F.lit("s").alias("session_id"), "seq", (F.unix_micros("ts") / F.lit(1e6)).alias("client_ts"), "line", "event_id")
    sent = stored(sent, "messages")
    path = work_folder(t.spark, "client")
    for part in ("event_id % 3 = 1", "event_id % 2 = 0", "event_id % 3 <> 1", "event_id % 2 = 1"):
        sent.where(part).drop("event_id").repartition(FILES).write.mode("append").json(path)
    return path


def boundaries(stream):
    """Sign-ups start and errors end: runs with every fifth and every fourth spell, encounters of two bosses otherwise."""
    k, kind = F.col("spell_id"), F.col("event_type")
    what = (F.when(kind == "SPELL_RESURRECT", F.when(k % 5 == 0, segments.RUN_START).otherwise(segments.START))
            .when(kind == "UNIT_DIED", F.when(k % 4 == 1, segments.RUN_END).otherwise(segments.END)))
    return stream.select(F.col("user_id").alias("guild_id"), "ts", "line_no", what.alias("event_type"), (F.col("spell_id") % 2).alias("boss_id"),
                         (k % 3 == 0).alias("success")).filter(F.col("event_type").isNotNull())


def live_rows(t: Tables, name: str):
    """Newest encounter rows from a stream whose days arrive out of order; a heartbeat far ahead lets the watermark pass them all."""
    src = pieces(t, f"{name}src", SHUFFLED)
    e = t.spark.read.parquet(t.path("events"))
    known = {"user_id": F.lit(-1), "event_type": F.lit("signup")}
    ahead = e.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    beat = ahead.select(*("ts" if f.name == "ts" else known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema))
    beat.select(*e.columns).coalesce(1).write.mode("append").parquet(src)
    out = finish(t, stateful.live_encounters(boundaries(event_stream(t, src, FILES)), "40 days"), "update", name)
    return newest(out, ["guild_id", "encounter_id"], ["revision"]).where("guild_id >= 0")


LIVE = """b AS (SELECT user_id AS guild_id, ts, line_no, spell_id % 2 AS boss_id, spell_id % 3 = 0 AS success,
  CASE WHEN event_type = 'SPELL_RESURRECT' THEN CASE WHEN spell_id % 5 = 0 THEN 'RS' ELSE 'S' END WHEN spell_id % 4 = 1 THEN 'RE' ELSE 'E' END AS kind
  FROM ev WHERE event_type IN ('SPELL_RESURRECT', 'UNIT_DIED')),
n AS (SELECT *, count(*) FILTER (kind IN ('S', 'RS')) OVER w AS seg, count(*) FILTER (kind = 'RS') OVER w AS run,
  coalesce(last_value(CASE WHEN kind IN ('RS', 'RE') THEN kind END IGNORE NULLS) OVER w, '') AS mode FROM b WINDOW w AS (PARTITION BY guild_id ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING)),
rs AS (SELECT guild_id, run, min((ts, line_no, boss_id)) FILTER (kind = 'RS') AS s, min((ts, line_no, success)) FILTER (kind = 'RE') AS e, max(run) OVER (PARTITION BY guild_id) AS last
  FROM n WHERE run > 0 GROUP BY 1, 2),
runs AS (SELECT guild_id, 'mythic_plus' AS encounter_type, s[2] AS encounter_id, s[3] AS boss_id, 0 AS pull_number, s[1] AS start_ts, e[1] AS end_ts, e[3] AS success,
  CASE WHEN e IS NOT NULL THEN 'closed' WHEN run < last THEN 'replaced' ELSE 'in_progress' END AS status FROM rs),
st AS (SELECT *, max(seg) OVER (PARTITION BY guild_id) AS last FROM n WHERE kind = 'S' AND mode <> 'RS'),
pairs AS (SELECT st.guild_id, st.line_no, min((n.ts, n.line_no, n.success)) AS e FROM st JOIN n ON n.guild_id = st.guild_id AND n.seg = st.seg AND n.kind = 'E' AND n.boss_id = st.boss_id GROUP BY 1, 2),
raids AS (SELECT st.guild_id, 'raid' AS encounter_type, st.line_no AS encounter_id, boss_id, row_number() OVER (PARTITION BY st.guild_id, boss_id ORDER BY ts, st.line_no) AS pull_number,
  ts AS start_ts, e[1] AS end_ts, e[3] AS success, CASE WHEN e IS NOT NULL THEN 'closed' WHEN seg < last THEN 'replaced' ELSE 'in_progress' END AS status
  FROM (SELECT s.*, (SELECT max(seg) FROM n WHERE n.guild_id = s.guild_id) AS last FROM (SELECT * EXCLUDE (last) FROM st) s) st LEFT JOIN pairs USING (guild_id, line_no)),
live AS (SELECT * FROM runs UNION ALL SELECT * FROM raids)"""


@query("r03_live_encounters", f"""WITH {{EV}}, {LIVE} SELECT guild_id, encounter_type, encounter_id, boss_id, pull_number, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, success, status FROM live""",
       longs=("boss_id", "pull_number"))
def _(t: Tables):
    return live_rows(t, "r03").select("guild_id", "encounter_type", "encounter_id", "boss_id", "pull_number", "start_us", "end_us", "success", "status")


@query("r11_active_encounters", f"""WITH {{EV}}, {LIVE} SELECT encounter_type, count(*) FILTER (status = 'in_progress') AS active, count(*) FILTER (status = 'closed') AS finished,
  count(*) FILTER (status = 'replaced') AS abandoned FROM live GROUP BY 1""")
def _(t: Tables):
    return live.active_encounters(live_rows(t, "r11a"))


SPAN_US = 129_600_000_000  # a day and a half, so that encounters last over midnight


@query("r04_live_top_dps", f"""WITH {{EV}}, x AS (SELECT *, epoch_us(ts) // {SPAN_US} AS enc FROM ev), s AS (SELECT enc, source_guid AS guid,
  CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(greatest(0, amount - overhealing)) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS healing FROM x GROUP BY 1, 2),
d AS (SELECT enc, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds, count(DISTINCT source_guid) AS participants FROM x GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY enc ORDER BY damage DESC, guid) AS rank FROM s WHERE damage > 0)
SELECT enc AS encounter_key, rank, guid, damage, healing, round(damage / seconds, 6) AS dps, round(seconds, 6) AS duration_seconds, participants FROM r JOIN d USING (enc) WHERE rank <= 5""")
def _(t: Tables):
    src = pieces(t, "r04src", SHUFFLED)
    events = event_stream(t, src, FILES).withColumn("encounter_key", F.floor(us("ts") / F.lit(float(SPAN_US))))
    top = newest(finish(t, stateful.live_top(events, 5, "40 days", 40 * 86400.0), "update", "r04"), ["encounter_key", "rank"], ["revision"])
    return top.select("encounter_key", "rank", "guid", "damage", "healing", F.round("dps", 6).alias("dps"), F.round("duration_seconds", 6).alias("duration_seconds"), "participants")


@query("r05_live_combat_periods", f"""WITH {{EV}}, {PERIODS} SELECT user_id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, event_count FROM periods
WHERE epoch_us(end_ts) + {int(GAP * 1e6)} <= (SELECT max(epoch_us(ts)) FROM ev WHERE event_type <> 'SPELL_RESURRECT')""")
def _(t: Tables):
    out = finish(t, live.live_combat_periods(event_stream(t), ["user_id"], "6 hours", "0 seconds"), "append", "r05")
    return out.select("user_id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "event_count")


@query("r06_dedupe_sequences", "SELECT user_id::VARCHAR AS client_id, event_id AS seq FROM events")
def _(t: Tables):
    e = event_stream(t)
    twice = e.select(F.col("user_id").cast("string").alias("client_id"), F.explode(F.array("line_no", "line_no")).alias("seq"), "ts")
    return finish(t, live.dedupe_sequences(twice, "ts").select("client_id", "seq"), "append", "r06")


@query("r06_acknowledgements", """WITH k AS (SELECT * FROM (SELECT user_id::VARCHAR AS client_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) WHERE event_id % 7 <> 3),
g AS (SELECT *, lag(seq, 1, 0) OVER (PARTITION BY client_id ORDER BY seq) AS prev FROM k),
a AS (SELECT client_id, max(seq) AS acked, coalesce(min(prev) FILTER (seq > prev + 1), max(seq)) AS contiguous, count(*) AS received,
  coalesce(string_agg((prev + 1) || '-' || (seq - 1), ',' ORDER BY seq) FILTER (seq > prev + 1), '') AS gaps FROM g GROUP BY 1)
SELECT a.*, received AS duplicates, acked - received AS missing, (SELECT count(*) FROM k WHERE k.client_id = a.client_id AND k.seq > a.contiguous) AS pending FROM a""")
def _(t: Tables):
    messages = live.stream_lines(t.spark, client_messages(t), FILES)
    d = newest(finish(t, stateful.live_delivery(messages, first=1), "update", "r06a"), ["client_id"], ["revision"])
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws("-", g["low"].cast("string"), g["high"].cast("string"))), ",")
    return d.select("client_id", "acked", "contiguous", "received", gaps.alias("gaps"), "duplicates", "missing", "pending")


@query("r07_late_rows", """WITH d AS (SELECT event_id, ts, day(ts) BETWEEN 11 AND 20 AS back FROM events), m AS (SELECT max(epoch_us(ts)) AS us FROM d WHERE NOT back)
SELECT event_id, back AND epoch_us(ts) < us - 432000000000 AS late FROM d, m""")
def _(t: Tables):
    src = pieces(t, "r07src", ["day(ts) <= 10", "day(ts) > 20", "day(ts) BETWEEN 11 AND 20"])
    path = work_folder(t.spark, "r07")
    router = live.LateRouter(path, "ts", 5 * 86400.0)
    live.run_available(event_stream(t, src, FILES), "append", router, f"{path}/state")
    return router.rows(t.spark).select(F.col("line_no").alias("event_id"), F.col("late").cast("boolean").alias("late"))


@query("r08_rate_per_client", """SELECT user_id, (epoch_us(ts) // 86400000000) * 86400000000 AS window_us, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2""")
def _(t: Tables):
    out = finish(t, live.rate_per_client(event_stream(t), "user_id", "ts", 3, "1 day"), "update", "r08", ["user_id", "window_start"])
    return out.select("user_id", us("window_start").alias("window_us"), "n", "over_limit")


@query("r09_session_status", """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
SELECT user_id, epoch_us(ts) AS last_us, epoch_us(ts) + 36000000000 AS idle_us FROM g WHERE (nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 36000000000) AND epoch_us(ts) + 36000000000 <= (SELECT max(epoch_us(ts)) FROM events)""")
def _(t: Tables):
    out = finish(t, live.session_status(event_stream(t), "user_id", "ts", "36000 seconds"), "append", "r09")
    return out.select("user_id", us("last_seen").alias("last_us"), us("idle_since").alias("idle_us"))


@query("r10_performance_alerts", """WITH {EV}, s AS (SELECT encounter_key, source_guid AS guid, CAST(coalesce(sum(amount) FILTER (event_type = 'SPELL_DAMAGE'), 0) AS BIGINT) AS damage,
  CAST(coalesce(sum(amount - overhealing) FILTER (event_type = 'SPELL_HEAL'), 0) AS BIGINT) AS healing, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM ev GROUP BY 1, 2)
SELECT encounter_key, guid, damage, healing FROM s WHERE span > 0 AND (damage / span > 0.5 OR healing / span > 0.5)""")
def _(t: Tables):
    alerts = live.performance_alerts(live.live_damage(event_stream(t)), 0.5)
    return finish(t, alerts, "update", "r10", ["window_start", "encounter_key", "guid"]).select("encounter_key", "guid", "damage", "healing")


@query("r11_stream_stats", """WITH {EV}, x AS (SELECT epoch_us(ts) + line_no % 5 * 1000000 AS received, CASE WHEN spell_id <> 7 THEN epoch_us(ts) // 1000 * 1000 END AS said FROM ev)
SELECT (received // 3600000000) * 3600000000 AS window_us, count(*) AS lines, count(*) FILTER (said IS NULL) AS errors, round(count(*) FILTER (said IS NULL) / count(*), 8) AS error_rate,
  max(received - said) AS max_lag_us, round(avg(received - said) / 1e6, 6) AS mean_lag FROM x GROUP BY 1""")
def _(t: Tables):
    path = work_folder(t.spark, "r11src")
    late = F.timestamp_micros(us("ts") + F.col("event_id") % 5 * 1_000_000)
    e = t.events.select(F.col("event_id").alias("line_no"), late.alias("received"))
    log_lines(t).join(e, "line_no").write.parquet(path)
    schema = t.spark.read.parquet(path).schema
    tokens = log.tokenize(live.stream_table(t.spark, path, schema))
    s = finish(t, live.stream_stats(tokens, "1 hour"), "update", "r11", ["window_start"])
    return s.select(us("window_start").alias("window_us"), "lines", "errors", F.round("error_rate", 8).alias("error_rate"),
                    F.round(F.col("max_lag_seconds") * 1e6).cast("long").alias("max_lag_us"), F.round("mean_lag_seconds", 6).alias("mean_lag"))


@query("r12_live_downsample", """WITH {EV}, w AS (SELECT (epoch_us(ts) // 3600000000 - o.o) * 3600000000 AS window_us, amount FROM ev, (SELECT unnest([0, 1, 2]) AS o) o)
SELECT window_us, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM w GROUP BY 1""")
def _(t: Tables):
    out = finish(t, live.live_downsample(event_stream(t), "amount", "3 hours", "1 hour"), "update", "r12", ["window_start"])
    return out.select(us("window_start").alias("window_us"), "total", "n")


@query("r13_store_encounters", f"""WITH {{EV}}, {LIVE} SELECT guild_id, encounter_id, epoch_us(end_ts) AS end_us FROM live WHERE status = 'closed'""")
def _(t: Tables):
    path = work_folder(t.spark, "r13")
    keys = ["guild_id", "encounter_id"]
    stream = stateful.live_encounters(boundaries(event_stream(t)), "0 seconds").filter("status = 'closed'")
    write = live.store_encounters_writer(f"{path}/out", keys)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)
    live.run_available(stream, "update", twice, f"{path}/state")
    return live.stored(t.spark, f"{path}/out", keys).select(*keys, "end_us")


@query("r02_micro_batches", "SELECT 3::BIGINT AS batches, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM events")
def _(t: Tables):
    src = pieces(t, "r02src", SHUFFLED)
    path = work_folder(t.spark, "r02")
    write = live.batch_writer(f"{path}/out", lambda batch, i: batch.select("line_no").withColumn("batch", F.lit(i)))
    live.run_available(event_stream(t, src, FILES), "append", write, f"{path}/state")
    return live.stored(t.spark, f"{path}/out").agg(
        F.count_distinct("batch").alias("batches"), F.count("*").alias("rows"), F.sum("line_no").alias("checksum"))
