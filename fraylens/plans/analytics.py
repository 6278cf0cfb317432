"""Guild and community analytics over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraylens.operators import analytics as A
from fraylens.operators import distribution
from fraylens.plans.catalog import Tables, query
from fraylens.plans.joins import LOC, metric_rows
from fraylens.plans.standins import us


def r(*names, digits=6):
    return {n: F.round(n, digits) for n in names}


@query("a18_class_balance", f"""WITH {LOC},
g AS (SELECT c_mktsegment, avg(l_extendedprice) AS avg_value, count(DISTINCT o_orderkey) AS encounters, count(DISTINCT c_custkey) AS characters, count(*) AS samples FROM loc GROUP BY 1),
s AS (SELECT avg(avg_value) AS m, stddev_samp(avg_value) AS sd, count(*) AS n FROM g)
SELECT c_mktsegment, round(avg_value, 6) AS avg_value, encounters, characters, samples, round(avg_value / m, 6) AS relative_performance,
  round(greatest(0, 1 - sd / m), 6) AS balance_score, avg_value > m + 1.5 * sd AS outlier FROM g, s""", cents=True)
def _(t: Tables):
    b = A.class_balance(metric_rows(t), ["c_mktsegment"], "l_extendedprice", "o_orderkey", "c_custkey")
    return b.withColumns(r("avg_value", "relative_performance", "balance_score"))


@query("a18_class_balance_json", """WITH j AS (SELECT event_type AS class, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS dps, event_id, user_id FROM events),
g AS (SELECT class, avg(dps) AS avg_value, count(DISTINCT user_id) AS characters FROM j GROUP BY 1), s AS (SELECT avg(avg_value) AS m, stddev_samp(avg_value) AS sd FROM g)
SELECT class, round(avg_value, 6) AS avg_value, characters, round(avg_value / m, 6) AS relative_performance, round(greatest(0, 1 - sd / m), 6) AS balance_score FROM g, s""", cents=True)
def _(t: Tables):
    e = t.events.withColumns({"dps": F.get_json_object("props", "$.k").cast("double"), "class": F.col("event_type")})
    b = A.class_balance(e, ["class"], "dps", "event_id", "user_id")
    return b.select("class", "characters", *[F.round(c, 6).alias(c) for c in ("avg_value", "relative_performance", "balance_score")])


@query("a19_daily_trend", """SELECT epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) AS day_us, round(avg(o_totalprice), 4) AS value, count(DISTINCT o_custkey) AS sample_size FROM orders GROUP BY 1""", cents=True)
def _(t: Tables):
    d = A.daily_trend(t.orders, "o_orderdate", "o_totalprice", "o_custkey")
    return d.select(us("day").alias("day_us"), F.round("value", 4).alias("value"), "sample_size")


@query("a19_trend_direction", """WITH d AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS day, avg(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' OR o_orderpriority < '3' THEN o_totalprice ELSE o_totalprice * (1 + o_orderkey % 2) END) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM d WHERE v <> 0),
h AS (SELECT o_orderpriority, any_value(n) AS points, avg(v) FILTER (i <= n // 2) AS a, avg(v) FILTER (i > n // 2) AS b FROM p GROUP BY 1)
SELECT o_orderpriority, points, CASE WHEN b > a * 1.05 THEN 'up' WHEN b < a * 0.95 THEN 'down' ELSE 'stable' END AS direction,
  round(CASE WHEN b > a * 1.05 OR b < a * 0.95 THEN least(abs(b - a) / a, 1) ELSE 0.1 END, 6)::DOUBLE AS strength, CASE WHEN points >= 10 THEN 0.8 ELSE 0.3 END::DOUBLE AS significance FROM h""", cents=True)
def _(t: Tables):
    plain = (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")) | (F.col("o_orderpriority") < "3")
    v = F.when(plain, F.col("o_totalprice")).otherwise(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 2))
    d = A.daily_trend(t.orders.withColumn("v", v), "o_orderdate", "v", "o_custkey", ["o_orderpriority"], "month")
    return A.trend_direction(d, "day", "value", ["o_orderpriority"]).withColumn("strength", F.round("strength", 6))


@query("a19_character_trend", """SELECT o_custkey, epoch_us(date_trunc('week', o_orderdate)::TIMESTAMP) AS day_us, round(avg(o_totalprice), 4) AS value, count(*) AS sample_size FROM orders GROUP BY 1, 2""", cents=True)
def _(t: Tables):
    d = A.daily_trend(t.orders, "o_orderdate", "o_totalprice", "o_orderkey", ["o_custkey"], "week")
    return d.select("o_custkey", us("day").alias("day_us"), F.round("value", 4).alias("value"), "sample_size")


USAGE = """u AS (SELECT l_partkey AS spell_id, CAST(l_quantity AS BIGINT) AS casts, l_extendedprice AS damage, l_discount AS crit_rate, l_orderkey AS encounter FROM lineitem),
g AS (SELECT spell_id, CAST(sum(casts) AS BIGINT) AS total_casts, CAST(sum(damage) AS BIGINT) AS total_damage, round(avg(crit_rate), 6) AS avg_crit_rate, count(DISTINCT encounter) AS encounters FROM u GROUP BY 1)"""


def usage_rows(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("spell_id"), F.col("l_quantity").cast("long").alias("casts"),
        F.col("l_extendedprice").alias("damage"), F.col("l_discount").alias("crit_rate"), F.col("l_orderkey").alias("encounter"))


@query("a20_spell_usage", f"""WITH {USAGE} SELECT *, round(total_casts * 100.0 / (SELECT sum(casts) FROM u), 8) AS usage_percent FROM g ORDER BY total_casts DESC, spell_id LIMIT 50""", cents=True)
def _(t: Tables):
    return A.spell_usage(usage_rows(t)).withColumns({"usage_percent": F.round("usage_percent", 8), "avg_crit_rate": F.round("avg_crit_rate", 6)})


@query("a20_spell_diversity", f"""WITH {USAGE}, x AS (SELECT * FROM g ORDER BY total_casts DESC, spell_id LIMIT 50)
SELECT count(*) AS spells, round(1 - (max(total_casts) - min(total_casts)) / max(total_casts), 8) AS diversity FROM x""", cents=True)
def _(t: Tables):
    return A.usage_diversity(A.spell_usage(usage_rows(t))).withColumn("diversity", F.round("diversity", 8))


@query("a20_highest_damage_spells", f"""WITH {USAGE}, x AS (SELECT * FROM g ORDER BY total_casts DESC, spell_id LIMIT 50) SELECT spell_id, total_damage FROM x ORDER BY total_damage DESC, spell_id LIMIT 5""", cents=True)
def _(t: Tables):
    return A.spell_usage(usage_rows(t)).orderBy(F.desc("total_damage"), "spell_id").limit(5).select("spell_id", "total_damage")


@query("a20_single_spell_users", """SELECT o_custkey, count(*) AS uses, count(DISTINCT o_orderkey) AS encounters FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 77 GROUP BY 1""", cents=True)
def _(t: Tables):
    d = t.lineitem.filter("l_partkey = 77").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy("o_custkey").agg(F.count("*").alias("uses"), F.count_distinct("o_orderkey").alias("encounters"))


@query("a21_damage_breakdown", """WITH g AS (SELECT l_suppkey, CAST(sum(l_extendedprice) AS BIGINT) AS total, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hits FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > 0)
SELECT l_suppkey, total, hits, round(total * 100.0 / sum(total) OVER (), 8) AS percentage, round(total / hits, 6) AS avg_hit FROM g""", cents=True)
def _(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.col("l_extendedprice").alias("v"), F.col("l_quantity").cast("long").alias("h"))
    return A.damage_breakdown(rows, "l_suppkey", "v", "h").withColumns({"percentage": F.round("percentage", 8), "avg_hit": F.round("avg_hit", 6)})


@query("a21_damage_split", """SELECT CASE WHEN l_returnflag = 'A' THEN 'direct' WHEN l_returnflag = 'N' THEN 'periodic' ELSE 'pet' END AS kind,
  round(sum(l_extendedprice) * 100.0 / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS percentage FROM lineitem GROUP BY 1""", cents=True)
def _(t: Tables):
    kind = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "periodic").otherwise("pet")
    d = A.damage_breakdown(t.lineitem.withColumns({"kind": kind, "h": F.lit(1)}), "kind", "l_extendedprice", "h")
    return d.select("kind", F.round("percentage", 6).alias("percentage"))


@query("a22_progression", """SELECT o_custkey % 25 AS guild_id, o_orderpriority, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS kills, epoch_us(min(o_orderdate) FILTER (o_orderstatus = 'F')) AS first_kill_us FROM orders GROUP BY 1, 2""", cents=True)
def _(t: Tables):
    e = t.orders.withColumns({"success": F.col("o_orderstatus") == "F", "ts": F.col("o_orderdate"), "guild_id": F.col("o_custkey") % 25})
    p = A.progression(e, ["guild_id", "o_orderpriority"])
    return p.select("guild_id", "o_orderpriority", "attempts", "kills", us("first_kill").alias("first_kill_us"))


@query("a22_weekly_kills", """SELECT o_orderpriority, epoch_us(date_trunc('week', o_orderdate)::TIMESTAMP) AS week_us, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS kills FROM orders GROUP BY 1, 2""", cents=True)
def _(t: Tables):
    e = t.orders.withColumns({"success": F.col("o_orderstatus") == "F", "ts": F.col("o_orderdate"), "week": F.date_trunc("week", "o_orderdate")})
    return A.progression(e, ["o_orderpriority", "week"]).select("o_orderpriority", us("week").alias("week_us"), "attempts", "kills")


@query("a23_attendance", """WITH e AS (SELECT o_custkey, c_nationkey, o_orderdate, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-06-01'),
p AS (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS raid_days, count(*) AS encounters, count(*) FILTER (o_orderstatus = 'F') AS successes FROM e GROUP BY 1),
g AS (SELECT c_nationkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS guild_days FROM e GROUP BY 1)
SELECT c_custkey, coalesce(raid_days, 0) AS raid_days, coalesce(encounters, 0) AS encounters, coalesce(successes, 0) AS successes, coalesce(guild_days, 0) AS guild_days,
  round(CASE WHEN guild_days > 0 THEN coalesce(raid_days, 0) * 100.0 / guild_days ELSE 0 END, 6)::DOUBLE AS attendance_rate
FROM customer c LEFT JOIN p ON p.o_custkey = c.c_custkey LEFT JOIN g ON g.c_nationkey = c.c_nationkey""", cents=True)
def _(t: Tables):
    members = t.customer.select("c_custkey", "c_nationkey")
    e = t.orders.join(members, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "c_nationkey", F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("success"))
    a = A.attendance(members, e, "c_custkey", "c_nationkey", F.lit("1998-06-01").cast("timestamp"))
    return a.drop("c_nationkey").withColumn("attendance_rate", F.round("attendance_rate", 6))


@query("a24_guild_performance", """SELECT c_nationkey, count(*) AS encounters, count(*) FILTER (o_orderstatus = 'F') AS kills, round(avg(o_totalprice), 4) AS avg_value, max(o_totalprice) AS max_value,
  round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6)::DOUBLE AS success_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 550""", cents=True)
def _(t: Tables):
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("success", F.col("o_orderstatus") == "F")
    return A.guild_performance(e, "c_nationkey", "o_totalprice", 550).withColumns({"avg_value": F.round("avg_value", 4), "success_rate": F.round("success_rate", 6)})


@query("a24_top_guilds", """SELECT c_nationkey, round(avg(o_totalprice), 4) AS avg_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY avg(o_totalprice) DESC LIMIT 5""", cents=True)
def _(t: Tables):
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("success", F.col("o_orderstatus") == "F")
    g = A.guild_performance(e, "c_nationkey", "o_totalprice", 1).orderBy(F.desc("avg_value"), "c_nationkey").limit(5)
    return g.select("c_nationkey", F.round("avg_value", 4).alias("avg_value"))


@query("a25_guild_stats", """SELECT o_custkey % 25 AS guild_id, count(*) AS encounters, count(*) FILTER (o_orderstatus = 'F') AS successes, count(DISTINCT o_orderpriority) AS bosses, count(DISTINCT CAST(o_orderdate AS DATE)) AS raid_days FROM orders GROUP BY 1""", cents=True)
def _(t: Tables):
    from fraylens.plans.rows import encounters
    return A.guild_stats(encounters(t), "guild_id")


@query("a26_roster", """WITH l AS (SELECT c_custkey, c_nationkey, c_mktsegment AS class, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS seen FROM customer)
SELECT c_nationkey, class, count(*) AS members, count(*) FILTER (seen >= TIMESTAMP '1999-03-01' - INTERVAL 30 DAY) AS active FROM l GROUP BY GROUPING SETS ((c_nationkey, class), (c_nationkey))""", cents=True)
def _(t: Tables):
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    m = t.customer.withColumnRenamed("c_mktsegment", "class").join(seen, "c_custkey", "left")
    return A.roster(m, "c_nationkey", "seen", F.lit("1999-03-01").cast("timestamp"))


@query("a27_custom_aggregation", """SELECT l_returnflag, l_linestatus, count(*) AS samples, round(avg(l_extendedprice), 4) AS l_extendedprice_avg, min(l_extendedprice)::DOUBLE AS l_extendedprice_min,
  max(l_extendedprice)::DOUBLE AS l_extendedprice_max, round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice_p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS l_extendedprice_p95,
  round(avg(l_extendedprice / l_quantity), 4) AS hit_avg, round(min(l_extendedprice / l_quantity), 4) AS hit_min, round(max(l_extendedprice / l_quantity), 4) AS hit_max,
  round(quantile_cont(l_extendedprice / l_quantity, 0.5), 4) AS hit_p50, round(quantile_cont(l_extendedprice / l_quantity, 0.95), 4) AS hit_p95 FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 1000""", cents=True)
def _(t: Tables):
    A.register_metric("hit", lambda: F.col("l_extendedprice") / F.col("l_quantity"))
    keys = ["l_returnflag", "l_linestatus"]
    d = A.custom_aggregation(t.lineitem, ["l_extendedprice", "hit"], keys, ["avg", "min", "max"], [0.5, 0.95], 1000)
    return d.select(*keys, "samples", *[F.round(c, 4).alias(c) for c in d.columns if c not in (*keys, "samples")])


@query("a28_percentiles", """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
  round(quantile_cont(o_totalprice, 0.25), 4) AS value_p25, round(quantile_cont(o_totalprice, 0.5), 4) AS value_p50, round(quantile_cont(o_totalprice, 0.75), 4) AS value_p75,
  round(quantile_cont(o_totalprice, 0.9), 4) AS value_p90, round(quantile_cont(o_totalprice, 0.99), 4) AS value_p99 FROM orders GROUP BY 1""", cents=True)
def _(t: Tables):
    d = A.describe(t.orders, ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.75, 0.9, 0.99])
    return d.select("o_orderpriority", "n", "min", "max", *[F.round(c, 4).alias(c) for c in d.columns if c not in ("o_orderpriority", "n", "min", "max")])


@query("a28_percentiles_overall", """SELECT quantile_cont(l_quantity, 0.5) AS l_quantity_p50, quantile_cont(l_quantity, 0.95) AS l_quantity_p95, quantile_cont(l_quantity, 0.999) AS l_quantity_p99_9 FROM lineitem""", cents=True)
def _(t: Tables):
    return distribution.percentiles(t.lineitem, [], "l_quantity", [0.5, 0.95, 0.999])


@query("a29_brackets", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
x AS (SELECT least(CAST(floor((o_totalprice - lo) * 8 / (hi - lo)) AS BIGINT) + 1, 8) AS bracket, o_totalprice FROM orders, b)
SELECT bracket, count(*) AS size, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, round(avg(o_totalprice), 4) AS mean FROM x GROUP BY 1""", cents=True)
def _(t: Tables):
    return A.brackets(t.orders, "o_totalprice", 8).withColumn("mean", F.round("mean", 4))


@query("a30_correlations", """WITH c AS (SELECT 'l_quantity' AS metric, corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount), count(*) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax), count(*) FROM lineitem)
SELECT metric, round(r, 8) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t, abs(r * sqrt((n - 2) / (1 - r * r))) > 1.96 AS significant FROM c""", cents=True)
def _(t: Tables):
    return A.correlations(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumns({"r": F.round("r", 8), "t": F.round("t", 4)})


@query("a31_composite", """WITH m AS (SELECT o_custkey, round(avg(o_totalprice), 1) AS dps, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT min(dps) AS l1, max(dps) AS h1, min(best) AS l2, max(best) AS h2 FROM m),
s AS (SELECT o_custkey, (dps - l1) / (h1 - l1) AS dps_score, (best - l2) / (h2 - l2) AS best_score, least(1, n / 30.0)::DOUBLE AS confidence FROM m, b),
z AS (SELECT *, round(0.0 + dps_score * 0.7 + best_score * 0.3, 9) AS score FROM s)
SELECT o_custkey, round(dps_score, 8) AS dps_score, round(best_score, 8) AS best_score, score, round(confidence, 8) AS confidence, rank() OVER (ORDER BY score DESC) AS rank,
  round(percent_rank() OVER (ORDER BY score) * 100, 8) AS percentile FROM z""", cents=True)
def _(t: Tables):
    m = t.orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 1).alias("dps"), F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    c = A.composite(m, {"dps": 0.7, "best": 0.3}, "n")
    return c.select("o_custkey", "score", "rank", *[F.round(x, 8).alias(x) for x in ("dps_score", "best_score", "confidence", "percentile")])


@query("a32_compare_groups", """WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb,
  var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM orders), x AS (SELECT *, sqrt(va / n_a + vb / n_b) AS se FROM s)
SELECT n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round((ma - mb) * 100 / mb, 6) AS difference_percent, round((ma - mb) / se, 6) AS t,
  round(2 / (1 + exp(1.5976 * abs((ma - mb) / se) + 0.070566 * abs((ma - mb) / se) ** 3)), 6) AS p_value, round(ma - mb - 1.96 * se, 3) AS low, round(ma - mb + 1.96 * se, 3) AS high FROM x""", cents=True)
def _(t: Tables):
    d = A.compare_groups(t.orders, "o_orderstatus", "F", "O", "o_totalprice")
    digits = {"mean_a": 4, "mean_b": 4, "difference_percent": 6, "t": 6, "p_value": 6, "low": 3, "high": 3}
    return d.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("a37_top_average", """SELECT o_custkey, round(avg(o_totalprice), 4) AS avg_value, max(o_totalprice) AS max_value, count(*) AS n FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 0 ORDER BY avg(o_totalprice) DESC, 1 LIMIT 25""", cents=True)
def _(t: Tables):
    return A.top_average(t.orders, "o_custkey", "o_totalprice", 25).withColumn("avg_value", F.round("avg_value", 4))


@query("a43_compare_characters", """WITH g AS (SELECT o_custkey, avg(o_totalprice) AS price, avg(o_orderkey % 97) AS hps FROM orders WHERE o_custkey IN (1, 2, 4, 5) GROUP BY 1),
l AS (SELECT o_custkey, 'price' AS metric, price AS value FROM g UNION ALL SELECT o_custkey, 'hps', hps FROM g)
SELECT l.o_custkey, l.metric, round(l.value, 4) AS value, round(b.value, 4) AS baseline, round(l.value - b.value, 4) AS difference,
  CASE WHEN l.value > b.value THEN 'improved' WHEN l.value < b.value THEN 'regressed' ELSE 'equal' END AS verdict FROM l JOIN l b ON b.metric = l.metric AND b.o_custkey = 1 WHERE l.o_custkey <> 1""", cents=True)
def _(t: Tables):
    rows = t.orders.select("o_custkey", F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).cast("double").alias("hps"))
    return A.compare(rows, "o_custkey", 1, [2, 4, 5], ["price", "hps"]).withColumns(r("value", "baseline", "difference", digits=4))


@query("w11_moving_average", """WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT epoch_us(day) AS day_us, round(avg(value) OVER w, 4) AS moving_avg, round(stddev_samp(value) OVER w, 4) AS volatility FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""", cents=True)
def _(t: Tables):
    d = A.daily_trend(t.orders, "o_orderdate", "o_totalprice", "o_custkey")
    return A.moving_average(d, "value", 7).select(us("day").alias("day_us"), F.round("moving_avg", 4).alias("moving_avg"), F.round("volatility", 4).alias("volatility"))


@query("w12_rankings", """WITH m AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 50) AS BIGINT) AS v FROM customer)
SELECT c_custkey, rank() OVER (ORDER BY v DESC) AS global_rank, rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS server_rank, rank() OVER (PARTITION BY c_mktsegment ORDER BY v DESC) AS class_rank,
  rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY v DESC) AS spec_rank, round(percent_rank() OVER (ORDER BY v) * 100, 6) AS global_percentile,
  round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY v) * 100, 6) AS class_percentile FROM m""", cents=True)
def _(t: Tables):
    c = t.customer.withColumn("v", F.floor(F.col("c_acctbal") / 50))
    scopes = {"global": [], "server": ["c_nationkey"], "class": ["c_mktsegment"], "spec": ["c_nationkey", "c_mktsegment"]}
    out = A.rankings(c, "v", scopes)
    return out.select("c_custkey", *[f"{s}_rank" for s in scopes], F.round("global_percentile", 6).alias("global_percentile"),
                      F.round("class_percentile", 6).alias("class_percentile"))


@query("a43_compare_encounters", """WITH g AS (SELECT l_orderkey, avg(l_extendedprice) AS damage, avg(l_quantity) AS hits FROM lineitem WHERE l_orderkey IN (1, 2, 3) GROUP BY 1),
l AS (SELECT l_orderkey, 'damage' AS metric, damage AS value FROM g UNION ALL SELECT l_orderkey, 'hits', hits FROM g)
SELECT l.l_orderkey, l.metric, round(l.value, 4) AS value, round(b.value, 4) AS baseline, round(l.value - b.value, 4) AS difference,
  CASE WHEN l.value > b.value THEN 'improved' WHEN l.value < b.value THEN 'regressed' ELSE 'equal' END AS verdict FROM l JOIN l b ON b.metric = l.metric AND b.l_orderkey = 1 WHERE l.l_orderkey <> 1""", cents=True)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.col("l_extendedprice").cast("double").alias("damage"), F.col("l_quantity").alias("hits"))
    return A.compare(rows, "l_orderkey", 1, [2, 3], ["damage", "hits"]).withColumns(r("value", "baseline", "difference", digits=4))
