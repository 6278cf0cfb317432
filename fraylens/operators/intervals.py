"""Range joins written as equi-joins on time slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.operators.ordered import carry, running_sum, time_bucket, upto

SLICE = "__slice"


def slices(start: str, end: str, seconds: float) -> Column:
    """All slice numbers a closed interval touches."""
    return F.sequence(time_bucket(start, seconds), time_bucket(end, seconds))


def range_join(
    points: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str = "start_ts",
    end: str = "end_ts",
    slice_seconds: float = 3600.0,
    how: str = "inner",
) -> DataFrame:
    """Pair each point with the windows that contain it (closed ends).

    Windows are unfolded to the slices they touch; points keep one row. The join is an
    equality on (keys, slice), so it is hashed and a busy key is spread over its slices.
    ``how`` may be inner, left, left_semi or left_anti. Null window ends never match.
    """
    p = points.withColumn(SLICE, time_bucket(ts, slice_seconds))
    names = {c: f"__w_{c}" for c in windows.columns if c in points.columns}
    w = (windows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
         .withColumn("__w_" + SLICE, F.explode(slices(start, end, slice_seconds))))
    for old, new in names.items():
        w = w.withColumnRenamed(old, new)

    def w_(c: str) -> Column:
        return F.col(names.get(c, c))

    condition = (F.col(SLICE) == F.col("__w_" + SLICE)) & F.col(ts).between(w_(start), w_(end))
    for k in keys:
        condition = condition & (F.col(k) == w_(k))
    return p.join(w, condition, how).drop(SLICE, "__w_" + SLICE, *names.values())


def span_totals(
    points: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    span_seconds: float,
    start: str = "start_ts",
) -> DataFrame:
    """Number of points (``events``) and sum of ``value`` (``total``) in ``[start, start + span]`` per ``by``; windows without a point are left out.

    No point is paired with a window. With slices as long as the span a window is the end of one slice and the beginning of the next, so
    running sums along time, forwards and backwards from the slice borders, give both parts: n log n, however many windows hold a point.
    The parts are added and nothing is subtracted, so values outside a window don't touch its sum.
    """
    span = int(round(span_seconds * 1e6))

    def home(at: Column) -> Column:
        return at - F.pmod(at, F.lit(span))

    def ways(forwards: Column, backwards: Column) -> Column:
        return F.explode(F.array(*[
            F.struct(home(at).alias(SLICE), F.lit(sign).alias("__way"), (at * sign).alias("__at")) for at, sign in ((forwards, 1), (backwards, -1))]))

    at, opens = F.unix_micros(ts), F.unix_micros(start)
    p = points.filter(F.col(ts).isNotNull()).select(F.col(value).alias("__value"), ways(at, at).alias("__p")).select(
        "__p.*", F.lit(0).alias("__rank"), "__value")
    w = windows.filter(F.col(start).isNotNull()).select(*by, ways(opens + span, opens).alias("__p")).select(*by, "__p.*", F.lit(1).alias("__rank"))
    summed = carry(
        w.unionByName(p, allowMissingColumns=True), [SLICE, "__way"], ["__at", "__rank"], F.floor(F.col("__at") / max(span // 16, 1)),
        __events=running_sum((F.col("__rank") == 0).cast("long")), __known=running_sum(F.col("__value").isNotNull().cast("long")),
        __total=running_sum(F.col("__value")))
    totals = summed.filter(F.col("__rank") == 1).groupBy(*by).agg(
        F.sum("__events").alias("events"), F.sum("__known").alias("__known"), F.sum("__total").alias("total"))
    return totals.filter(F.col("events") > 0).select(*by, "events", F.when(F.col("__known") > 0, F.col("total")).alias("total"))


def locate(
    points: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    ts: str,
    payload: Sequence[str],
    start: str = "start_ts",
    end: str = "end_ts",
    bucket_seconds: float = 3600.0,
) -> DataFrame:
    """Attach the payload of the window that contains each point, for disjoint windows.

    Both inputs are stacked and the last opened window is filled forward; the cost does
    not depend on window length. Points outside every window get nulls.
    """
    record = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *payload)
    opened = windows.select(
        *keys, F.col(start).alias("__at"), F.lit(0).alias("__rank"), record.alias("__win"))
    body = F.struct(*points.columns)
    stacked = points.select(
        *keys, F.col(ts).alias("__at"), F.lit(1).alias("__rank"), body.alias("__row")
    ).unionByName(opened, allowMissingColumns=True)
    filled = carry(
        stacked, keys, ["__at", "__rank"], time_bucket("__at", bucket_seconds),
        __open=upto(F.col("__win"))).filter(F.col("__rank") == 1)
    inside = F.col("__at") <= F.col("__open.e")
    return filled.select(
        "__row.*", *[F.when(inside, F.col(f"__open.{c}")).alias(c) for c in payload])


def overlap_seconds(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    slice_seconds: float = 3600.0,
    name: str = "overlap_seconds",
) -> DataFrame:
    """Seconds each left interval (``by``, ``start_ts``, ``end_ts``) shares with right ones.

    Both sides are cut at slice borders first; pieces of the same slice are then compared,
    which counts every shared second once and keeps the join an equality.
    """
    width = int(slice_seconds * 1e6)

    def cut(df: DataFrame, tag: str, extra: Sequence[str]) -> DataFrame:
        s, e = F.unix_micros("start_ts"), F.unix_micros("end_ts")
        exploded = df.filter(F.col("end_ts") > F.col("start_ts")).select(
            *extra, s.alias("__s"), e.alias("__e"),
            F.explode(slices("start_ts", "end_ts", slice_seconds)).alias(SLICE))
        return exploded.select(
            *extra, SLICE, F.greatest("__s", F.col(SLICE) * width).alias(f"{tag}s"),
            F.least("__e", (F.col(SLICE) + 1) * width).alias(f"{tag}e"))

    a = cut(left, "a", list(dict.fromkeys([*keys, *by])))
    b = cut(right, "b", keys)
    shared = F.least("ae", "be") - F.greatest("as", "bs")
    hit = a.join(b, [*keys, SLICE]).filter(shared > 0)
    summed = hit.groupBy(*by).agg((F.sum(shared) / F.lit(1e6)).alias(name))
    return left.join(summed, list(by), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
