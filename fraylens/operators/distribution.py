"""Exact ranks and percentiles without gathering a group in one task.

Equal values are counted first, so a value shared by many rows becomes one row. The
remaining distinct values are laid out in buckets that follow their order (a fixed number
per power of two), counted per bucket, and the bucket totals are accumulated. Position
inside a bucket plus the total below it is the exact position in the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.operators.ordered import join_keys
from fraylens.session import stored

PER_OCTAVE = 1024


def value_bucket(value: Column) -> Column:
    """A bucket number that never decreases with ``value`` and depends on nothing else."""
    size = F.floor(F.log2(F.abs(value) + F.lit(1.0)) * F.lit(PER_OCTAVE))
    return F.when(value < 0, -size - 1).otherwise(size).cast("long")


def _buckets(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per (groups, bucket), rows under it and rows of the group; as small as the value range."""
    order = Window.partitionBy(*groups).orderBy("__vb").rowsBetween(Window.unboundedPreceding, -1)
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*groups, value_bucket(F.col(value).cast("double")).alias("__vb")).agg(F.count(F.lit(1)).alias("__bn")))
    return counts.select(*groups, "__vb", "__bn", F.coalesce(F.sum("__bn").over(order), F.lit(0)).alias("__under"),
                         F.sum("__bn").over(Window.partitionBy(*groups)).alias("total"))


def positions(df: DataFrame, groups: Sequence[str], value: str, wanted: Sequence[Column] = ()) -> DataFrame:
    """One row per (groups, value): ``n`` copies, ``below`` smaller rows, ``total`` rows.

    ``wanted`` holds 0-based positions (expressions over ``total``). Only buckets that contain
    one of them are then looked into, which leaves out nearly all rows before the shuffle.
    """
    # a struct around a group column is never null, so null groups take part in the joins
    df = df.select(F.col(value), *[F.struct(F.col(g).alias("v")).alias(g) for g in groups])
    buckets = _buckets(df, groups, value)
    if wanted:
        inside = [(F.col("__under") <= w) & (w < F.col("__under") + F.col("__bn")) for w in wanted]
        buckets = buckets.filter(reduce(lambda a, b: a | b, inside))
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value))
    rows = rows.withColumn("__vb", value_bucket(F.col(value)))
    keys = [*groups, "__vb"]
    if wanted:
        rows = rows.join(buckets.select(*keys), keys, "left_semi")
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("__in"))
    return (placed.join(buckets, keys)
            .select(*[F.col(g)["v"].alias(g) for g in groups], value, "n", (F.col("__in") + F.col("__under")).alias("below"), "total"))


def label(point: float) -> str:
    """0.5 -> 50, 0.999 -> 99_9."""
    return f"{point * 100:.10g}".replace(".", "_")


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, points: Sequence[float], prefix: str | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column ``<prefix>_pNN`` per point."""
    prefix = prefix or value
    last = F.col("total") - 1
    ranks = [F.lit(float(p)) * last for p in points]
    placed = positions(df, groups, value, [f(r) for r in ranks for f in (F.floor, F.ceil)])
    out = []
    for p in points:
        rank = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        holds_low = (F.col("below") <= low) & (low < F.col("below") + F.col("n"))
        holds_high = (F.col("below") <= high) & (high < F.col("below") + F.col("n"))
        lower = F.max(F.when(holds_low, F.col(value)))
        upper = F.max(F.when(holds_high, F.col(value)))
        share = F.max(rank - low)
        out.append((lower + (upper - lower) * share).alias(f"{prefix}_p{label(p)}"))
    return placed.groupBy(*groups).agg(*out)


def value_at(df: DataFrame, groups: Sequence[str], value: str, index: Column, name: str) -> DataFrame:
    """Value at 0-based ``index`` of the descending order; ``index`` may use ``total``."""
    above = F.col("total") - F.col("below") - F.col("n")
    return (positions(df, groups, value, [F.col("total") - 1 - index])
            .filter((above <= index) & (index < above + F.col("n")))
            .select(*groups, F.col(value).alias(name), F.col("total").alias(f"{name}_of")))


def with_rank(
    df: DataFrame, groups: Sequence[str], value: str, rank: str, percent: str | None = None
) -> DataFrame:
    """Add the rank (1 = greatest, ties share) and optionally the percentile 0..100 of ``value``."""
    above = F.col("total") - F.col("below") - F.col("n")
    cols = [(above + 1).alias(rank)]
    if percent:
        share = F.when(F.col("total") > 1, F.col("below") * 100.0 / (F.col("total") - 1)).otherwise(100.0)
        cols.append(share.alias(percent))
    placed = positions(df, groups, value).select(*groups, F.col(value).alias("__v"), *cols)
    keyed = df.withColumn("__v", F.col(value).cast("double"))
    return join_keys(keyed, placed, [*groups, "__v"], "left").drop("__v")


def ranked_values(df: DataFrame, scopes: dict[str, Sequence[str]], value: str) -> DataFrame:
    """scope, group, value with ``n`` copies, ``below`` smaller rows and ``total`` rows of the group, for all scopes from one reading of ``df``.

    Rows are unpivoted to (scope, group, value) and equal ones counted at once. Counts are sorted by range over all three, so borders come from the data
    and a group of any size lies in as many neighbouring ranges as it needs; sums inside a range and the sums of the ranges before it give positions.
    """
    entries = F.array(*(F.struct(F.lit(name).alias("scope"), group_key(keys).alias("group")) for name, keys in scopes.items()))
    rows = df.where(F.col(value).isNotNull()).select(F.explode(entries).alias("e"), F.col(value).cast("double").alias("value"))
    counts = rows.groupBy("e.scope", "e.group", "value").agg(F.count("*").alias("n"))
    order = ["scope", "group", "value"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranked-values")
    sums = ranged.groupBy("scope", "group", "range").agg(F.sum("n").alias("rows"))
    one = Window.partitionBy("scope", "group")
    earlier = one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("scope", "group", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("under"), F.sum("rows").over(one).alias("total"))
    within = Window.partitionBy("scope", "group", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inside.join(sums, ["scope", "group", "range"]).select(*order, "n", (F.col("under") + F.col("inside")).alias("below"), "total")


def group_key(keys: Sequence[str]) -> Column:
    """One text for a group of any number and types of columns; a null key differs from every other."""
    return F.to_json(F.struct(*(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)))) if keys else F.lit("")


def with_ranks(df: DataFrame, scopes: dict[str, Sequence[str]], value: str) -> DataFrame:
    """Add ``<scope>_rank`` (1 = greatest, ties share) and ``<scope>_percentile`` (0 to 100) for every scope; ``df`` is read twice however many there are."""
    placed = stored(ranked_values(df, scopes, value), "ranks")
    above = F.col("total") - F.col("below") - F.col("n")
    share = F.when(F.col("total") > 1, F.col("below") * 100.0 / (F.col("total") - 1)).otherwise(100.0)
    out = df.withColumn("__v", F.col(value).cast("double"))
    for name, keys in scopes.items():
        own = placed.where(F.col("scope") == name).select(F.col("group").alias("__group"), F.col("value").alias("__value"), (above + 1).alias(f"{name}_rank"),
                                                          share.alias(f"{name}_percentile"))
        out = out.join(own, (group_key(keys) == F.col("__group")) & (F.col("__v") == F.col("__value")), "left").drop("__group", "__value")
    return out.drop("__v")
