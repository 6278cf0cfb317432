"""Guild and community analytics: balance, trends, usage, progression, percentiles, comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.operators import distribution
from fraylens.operators.ordered import join_keys

# --- registered metrics (extension point of custom aggregations) -----------------------------

METRICS: dict[str, Column | Callable[[], Column]] = {}


def register_metric(name: str, value: Callable[[], Column]) -> None:
    """Make an expression over the metric rows available to ``custom_aggregation``."""
    METRICS[name] = value


def metric(name: str, df: DataFrame) -> Column:
    if name in METRICS:
        return METRICS[name]()
    if name in df.columns:
        return F.col(name)
    raise ValueError(f"unknown metric {name!r}")


FUNCTIONS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "stddev": F.stddev_samp}


def custom_aggregation(
    df: DataFrame, metrics: Sequence[str], group_by: Sequence[str], functions: Sequence[str] = ("avg",),
    percentiles: Sequence[float] = (), least_samples: int = 1,
) -> DataFrame:
    """Columns ``<metric>_<function>`` and ``<metric>_pNN`` per group with enough samples."""
    for f in functions:
        if f not in FUNCTIONS:
            raise ValueError(f"unknown function {f!r}")
    d = df.select(*group_by, *[metric(m, df).cast("double").alias(m) for m in metrics])
    aggs = [FUNCTIONS[f](m).alias(f"{m}_{f}") for m in metrics for f in functions]
    out = d.groupBy(*group_by).agg(F.count("*").alias("samples"), *aggs).filter(F.col("samples") >= least_samples)
    if not percentiles:
        return out
    # all metrics go through one exact percentile pass as (metric, value) rows
    long = d.unpivot(list(group_by), list(metrics), "__m", "__v")
    found = distribution.percentiles(long, [*group_by, "__m"], "__v", percentiles)
    wide = found.groupBy(*group_by).agg(*[
        F.max(F.when(F.col("__m") == m, F.col(f"__v_p{round(p * 100):d}"))).alias(f"{m}_p{round(p * 100):d}")
        for m in metrics for p in percentiles])
    return join_keys(out, wide, list(group_by), "left") if group_by else out.select(
        "*", *[wide.select(c).scalar().alias(c) for c in wide.columns])


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate over the whole frame as a scalar subquery."""
    return df.agg(value.alias("v")).scalar()


# --- balance, trends, usage ---------------------------------------------------------------------

def class_balance(rows: DataFrame, keys: Sequence[str], value: str, encounter: str, character: str) -> DataFrame:
    """Per class: average, distinct encounters and characters, share of the overall mean of averages,
    balance score ``max(0, 1 - sd/mean)`` and outlier flag (> mean + 1.5 sd, more than two classes)."""
    g = rows.groupBy(*keys).agg(
        F.avg(value).alias("avg_value"), F.count_distinct(encounter).alias("encounters"),
        F.count_distinct(character).alias("characters"), F.count("*").alias("samples"))
    every = g.filter(F.col("avg_value") != 0).agg(
        F.struct(F.avg("avg_value").alias("mean"), F.stddev_samp("avg_value").alias("sd"), F.count("*").alias("n")).alias("s")).scalar()
    mean, sd, n = every.getField("mean"), every.getField("sd"), every.getField("n")
    score = F.when(n > 1, F.greatest(F.lit(0.0), 1 - C.ratio(sd, mean))).otherwise(0.5)
    return g.select(
        "*", F.when(mean > 0, F.col("avg_value") / mean).otherwise(1.0).alias("relative_performance"),
        score.alias("balance_score"), F.coalesce((n > 2) & (F.col("avg_value") > mean + 1.5 * sd), F.lit(False)).alias("outlier"))


def daily_trend(rows: DataFrame, ts: str, value: str, character: str, keys: Sequence[str] = (), unit: str = "day") -> DataFrame:
    return rows.groupBy(*keys, F.date_trunc(unit, ts).alias("day")).agg(
        F.avg(value).alias("value"), F.count_distinct(character).alias("sample_size"))


def trend_direction(points: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Compare the mean of the first ``n div 2`` non-zero points with the rest (5% band)."""
    p = points.filter(F.col(value) != 0)
    order_w, all_w = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    p = p.select(*keys, F.col(value).alias("v"), F.row_number().over(order_w).alias("i"), F.count("*").over(all_w).alias("n"))
    early = F.col("i") <= F.floor(F.col("n") / 2)
    h = p.groupBy(*keys).agg(F.max("n").alias("points"), F.avg(F.when(early, F.col("v"))).alias("a"), F.avg(F.when(~early, F.col("v"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    many = F.col("points") >= 2
    direction = F.when(many & (b > a * 1.05), "up").when(many & (b < a * 0.95), "down").otherwise("stable")
    moved = F.when(a > 0, F.least(F.abs(b - a) / a, F.lit(1.0))).otherwise(0.5)
    strength = F.when(~many, 0.0).when(direction != "stable", moved).otherwise(0.1)
    return h.select(*keys, "points", direction.alias("direction"), strength.alias("strength"),
                    F.when(F.col("points") >= 10, 0.8).otherwise(0.3).alias("significance"))


def spell_usage(rows: DataFrame, n: int = 50) -> DataFrame:
    """Input spell_id, casts, damage, crit_rate, encounter. The ``n`` most used spells with their share of all casts."""
    g = rows.groupBy("spell_id").agg(
        F.sum("casts").alias("total_casts"), F.sum("damage").alias("total_damage"), F.avg("crit_rate").alias("avg_crit_rate"),
        F.count_distinct("encounter").alias("encounters"))
    every = scalar(rows, F.sum("casts"))
    return (g.orderBy(F.desc("total_casts"), "spell_id").limit(n)
            .withColumn("usage_percent", C.ratio(F.col("total_casts") * 100.0, every)))


def usage_diversity(usage: DataFrame) -> DataFrame:
    top, low = F.max("total_casts"), F.min("total_casts")
    return usage.agg(F.count("*").alias("spells"), F.when(top > 0, 1.0 - (top - low) / top).otherwise(0.5).alias("diversity"))


def damage_breakdown(rows: DataFrame, key: str, value: str, hits: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.sum(value).alias("total"), F.sum(hits).alias("hits")).filter("total > 0")
    every = scalar(g, F.sum("total"))
    return g.select("*", (F.col("total") * 100.0 / every).alias("percentage"), C.ratio(F.col("total"), F.col("hits")).alias("avg_hit"))


def progression(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempts, kills and first kill; ``success`` and ``ts`` per encounter."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("kills"), F.min(F.when(F.col("success"), F.col("ts"))).alias("first_kill"))


def attendance(members: DataFrame, encounters: DataFrame, member: str, guild: str, since: Column) -> DataFrame:
    """Raid days, encounters and successes per member against the raid days of the guild since a date."""
    recent = encounters.filter(F.col("ts") >= since)
    per = recent.groupBy(member).agg(
        F.count_distinct(F.to_date("ts")).alias("raid_days"), F.count("*").alias("encounters"), F.count_if("success").alias("successes"))
    guild_days = recent.groupBy(guild).agg(F.count_distinct(F.to_date("ts")).alias("guild_days"))
    d = members.join(per, member, "left").join(guild_days, guild, "left").na.fill(0, ["raid_days", "encounters", "successes", "guild_days"])
    return d.withColumn("attendance_rate", C.ratio(F.col("raid_days") * 100.0, F.col("guild_days")))


def guild_performance(rows: DataFrame, guild: str, value: str, least: int) -> DataFrame:
    return rows.groupBy(guild).agg(
        F.count("*").alias("encounters"), F.count_if("success").alias("kills"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"),
        (F.count_if("success") * 100.0 / F.count("*")).alias("success_rate")).filter(F.col("encounters") >= least)


def guild_stats(rows: DataFrame, guild: str) -> DataFrame:
    return rows.groupBy(guild).agg(
        F.count("*").alias("encounters"), F.count_if("success").alias("successes"), F.count_distinct("name").alias("bosses"),
        F.count_distinct(F.to_date("start_ts")).alias("raid_days"))


def roster(members: DataFrame, guild: str, last_seen: str, now: Column, days: int = 30) -> DataFrame:
    """Members, active members and distribution per class as a long table (class null = all)."""
    active = F.count_if(F.col(last_seen) >= now - F.make_dt_interval(days=F.lit(days)))
    return members.groupingSets([[guild, "class"], [guild]], guild, "class").agg(F.count("*").alias("members"), active.alias("active"))


# --- distribution --------------------------------------------------------------------------------

def describe(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return join_keys(base, distribution.percentiles(df, keys, value, points, "value"), list(keys), "left")


def _bounds(df: DataFrame, value: str) -> tuple[Column, Column]:
    s = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    return s.getField("lo"), s.getField("hi")


def brackets(df: DataFrame, value: str, n: int) -> DataFrame:
    """Equal-width brackets 1..n with size and range; the maximum falls in the last one."""
    lo, hi = _bounds(df, value)
    number = F.when(hi > lo, F.least(F.floor((F.col(value) - lo) * n / (hi - lo)) + 1, F.lit(n))).otherwise(1)
    g = df.filter(F.col(value).isNotNull()).groupBy(number.cast("long").alias("bracket")).agg(
        F.count("*").alias("size"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"))
    return g


def correlations(df: DataFrame, primary: str, others: Sequence[str]) -> DataFrame:
    """Pearson r, n and t statistic per pair; significant when \\|t\\| > 1.96."""
    aggs = [F.struct(F.lit(o).alias("metric"), F.corr(primary, o).alias("r"),
                     F.count(F.when(F.col(primary).isNotNull() & F.col(o).isNotNull(), 1)).alias("n")).alias(o) for o in others]
    long = df.agg(*aggs).select(F.explode(F.array(*others)).alias("x")).select("x.*")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return long.withColumn("t", F.when(F.col("n") > 2, t)).withColumn("significant", F.coalesce(F.abs("t") > 1.96, F.lit(False)))


def composite(df: DataFrame, weights: dict[str, float], samples: str) -> DataFrame:
    """Weighted sum of min-max normalised metrics with confidence ``min(1, n/30)`` and exact percentile."""
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    out, score = df, F.lit(0.0)
    for name, weight in weights.items():
        lo, hi = _bounds(df, name)
        part = F.when(hi > lo, (F.col(name) - lo) / (hi - lo)).otherwise(0.0)
        out = out.withColumn(f"{name}_score", part)
        score = score + F.col(f"{name}_score") * weight
    out = out.withColumn("score", F.round(score, 9)).withColumn("confidence", F.least(F.lit(1.0), F.col(samples) / 30.0))
    return distribution.with_rank(out, [], "score", "rank", "percentile")


def compare_groups(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch comparison of two groups: difference, t, two-sided p (normal approximation), 95% interval."""
    def moments(g: str) -> list[Column]:
        v = F.when(F.col(group) == g, F.col(value))
        return [F.count(v), F.avg(v), F.var_samp(v)]
    names = ["n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b"]
    d = df.agg(*[c.alias(n) for c, n in zip([*moments(a), *moments(b)], names, strict=True)])
    diff = F.col("mean_a") - F.col("mean_b")
    se = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    t = diff / se
    return d.select("n_a", "n_b", "mean_a", "mean_b", (diff * 100.0 / F.col("mean_b")).alias("difference_percent"),
                    t.alias("t"), normal_p(t).alias("p_value"), (diff - 1.96 * se).alias("low"), (diff + 1.96 * se).alias("high"))


def normal_p(t: Column) -> Column:
    """Two-sided tail of the standard normal, logistic approximation ``2 / (1 + exp(1.5976 x + 0.070566 x^3))``."""
    x = F.abs(t)
    return 2.0 / (1.0 + F.exp(F.lit(1.5976) * x + F.lit(0.070566) * x * x * x))


def moving_average(daily: DataFrame, value: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and spread over the last ``days`` calendar days of an aggregated daily table."""
    day = F.floor(F.unix_micros("day") / F.lit(86400e6))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1), 0)
    return daily.select("*", F.avg(value).over(w).alias("moving_avg"), F.stddev_samp(value).over(w).alias("volatility"))


def rankings(characters: DataFrame, value: str, scopes: dict[str, Sequence[str]]) -> DataFrame:
    """Rank and percentile of every row in each scope, exact and without a global sort task."""
    return distribution.with_ranks(characters, scopes, value)


def top_average(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    g = rows.groupBy(key).agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.count("*").alias("n"))
    return g.filter("avg_value > 0").orderBy(F.desc("avg_value"), key).limit(n)


def compare(rows: DataFrame, key: str, base: str, others: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Averages of listed keys next to a baseline: difference and verdict per metric."""
    names = [base, *others]
    g = rows.filter(F.col(key).isin(names)).groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics])
    long = g.unpivot([key], list(metrics), "metric", "value")
    ref = long.filter(F.col(key) == base).select("metric", F.col("value").alias("baseline"))
    diff = F.col("value") - F.col("baseline")
    return (long.filter(F.col(key) != base).join(ref, "metric")
            .withColumn("difference", diff)
            .withColumn("verdict", F.when(diff > 0, "improved").when(diff < 0, "regressed").otherwise("equal")))

