"""Order-dependent columns that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a key into one task. Here every key is cut
into buckets that follow its sort order (an hour of events, a block of a log file);
the window runs per (key, bucket), one summary row per (key, bucket) carries the state
across bucket borders, and the summary is joined back on (key, bucket), which is the
partitioning the window already has. The input is read and shuffled once, no group
is larger than one bucket, and the result equals the plain window.

Keys must not be null. ``bucket`` must never decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BUCKET = "__bucket"


def time_bucket(ts: str | Column, seconds: float) -> Column:
    """Number of the ``seconds``-wide slice that holds ``ts``."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column) / F.lit(float(seconds) * 1e6))


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column


def before(value: Column) -> Spec:
    """Last non-null ``value`` strictly before the row."""
    return Spec("before", value)


def upto(value: Column) -> Spec:
    """Last non-null ``value`` at or before the row (forward fill)."""
    return Spec("upto", value)


def after(value: Column) -> Spec:
    """First non-null ``value`` strictly after the row."""
    return Spec("after", value)


def running_sum(value: Column) -> Spec:
    """Sum of ``value`` over the rows up to and including this one."""
    return Spec("sum", value)


def max_before(value: Column) -> Spec:
    """Greatest ``value`` strictly before the row."""
    return Spec("max", value)


def row_number() -> Spec:
    """1-based position of the row within its key."""
    return Spec("sum", F.lit(1).cast("long"))


def _first_or_last(value: Column, order: Column, last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    return pick(value, F.when(value.isNotNull(), order))


def _has_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString()


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | str,
    **specs: Spec,
) -> DataFrame:
    """Add one order-dependent column per keyword argument.

    Rows and summaries share one exchange by (key, bucket), so the input is read, and whatever made it is computed, once.
    """
    # two hashes that are never null: a join on the keys themselves would filter null keys on one side only, and the exchange couldn't be shared
    group = ["__g", "__h"]
    df = df.withColumn(BUCKET, bucket if isinstance(bucket, Column) else F.col(bucket))
    whole = F.struct(*keys, BUCKET)
    columns = [f.name for f in df.schema if not _has_map(f.dataType)]
    df = df.withColumns({"__g": F.xxhash64(whole), "__h": F.xxhash64(F.lit(1), whole)}).repartition(*group)
    along = Window.partitionBy(*group, BUCKET).orderBy(*order)
    against = Window.partitionBy(*group, BUCKET).orderBy(*[F.desc(c) for c in order])
    key_along = Window.partitionBy(*keys).orderBy(BUCKET)
    key_against = Window.partitionBy(*keys).orderBy(F.desc(BUCKET))
    past = (Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, summary, state, merged = [], [], [], {}
    for name, spec in specs.items():
        here, part, prior = f"__l_{name}", f"__s_{name}", f"__c_{name}"
        if spec.kind == "sum":
            local.append(
                F.sum(spec.value).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(here))
            summary.append(F.sum(spec.value).alias(part))
            state.append(F.sum(part).over(key_along.rowsBetween(*past)).alias(prior))
            zero = F.lit(0)
            merged[name] = F.coalesce(F.col(here), zero) + F.coalesce(F.col(prior), zero)
            continue
        if spec.kind == "max":
            local.append(F.max(spec.value).over(along.rowsBetween(*past)).alias(here))
            summary.append(F.max(spec.value).alias(part))
            state.append(F.max(part).over(key_along.rowsBetween(*past)).alias(prior))
            merged[name] = F.greatest(F.col(here), F.col(prior))
            continue
        backwards = spec.kind == "after"
        frame = (against if backwards else along).rowsBetween(
            Window.unboundedPreceding, 0 if spec.kind == "upto" else -1)
        local.append(F.last(spec.value, ignorenulls=True).over(frame).alias(here))
        summary.append(_first_or_last(spec.value, position, last=not backwards).alias(part))
        state.append(
            F.last(part, ignorenulls=True)
            .over((key_against if backwards else key_along).rowsBetween(*past)).alias(prior))
        merged[name] = F.coalesce(F.col(here), F.col(prior))

    # both uses must ask for the same columns, or each gets an exchange of its own: the summaries sum up a hash of all of them, and
    # the new columns depend on a comparison with it that always holds
    digest = F.xxhash64(*columns)
    everything, always = F.bit_xor(digest).alias("__every"), digest >= F.lit(-(1 << 63))
    totals = df.groupBy(*group).agg(*[F.first(c).alias(c) for c in [*keys, BUCKET]], *summary, everything).where(F.col("__every").isNotNull())
    carried = totals.select(*group, *state)
    out = df.select("*", *local).join(carried, group, "left")
    keep = [c for c in df.columns if c != BUCKET]
    return out.select(*keep, *[F.when(always, column).alias(name) for name, column in merged.items()])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap_seconds: float | str,
    bucket_seconds: float,
    totals: dict[str, Column] | None = None,
    index: str = "period_index",
) -> DataFrame:
    """Merge intervals of a key whose distance is at most ``gap_seconds``.

    ``gap_seconds`` is a number or the name of a column that is constant per key.

    A new island starts only when ``start`` lies more than the gap after every earlier
    ``end``. ``totals`` are summed. Islands are first built inside each time slice, where
    they shrink the data to at most one row per gap, and then stitched slice by slice, so
    that a key with any number of islands is spread over tasks at every step.
    """
    totals = totals or {}
    seconds = F.col(gap_seconds) if isinstance(gap_seconds, str) else F.lit(float(gap_seconds))
    gap = F.round(seconds * 1e6).cast("long")
    cols = [F.col(k) for k in keys]
    rows = df.select(
        *cols, F.col(start).alias("__start"), F.col(end).alias("__end"), gap.alias("__gap"),
        *[v.alias(n) for n, v in totals.items()],
        time_bucket(start, bucket_seconds).alias(BUCKET))

    def opens(reach: Column) -> Column:
        return (reach.isNull() | (F.unix_micros("__start") - F.unix_micros(reach) > F.col("__gap"))).cast("long")

    def merge(data: DataFrame, group: list[str], number: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy("__start", "__end")
        reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        numbered = data.withColumn("__open", opens(reach)).withColumn(
            number, F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return total(numbered, [*group, number])

    def total(numbered: DataFrame, group: list[str]) -> DataFrame:
        return numbered.groupBy(*group).agg(
            F.min("__start").alias("__start"), F.max("__end").alias("__end"), F.max("__gap").alias("__gap"),
            *[F.sum(n).alias(n) for n in totals])

    pieces = merge(rows, [*keys, BUCKET], "__piece")
    slice_of, line = time_bucket("__start", bucket_seconds), ["__start", "__end"]
    reached = carry(pieces.drop(BUCKET, "__piece"), keys, line, slice_of, __reach=max_before(F.col("__end")))
    flagged = reached.withColumn("__open", opens(F.col("__reach")))
    merged = total(carry(flagged, keys, line, slice_of, **{index: running_sum(F.col("__open"))}), [*keys, index])
    return merged.select(
        *keys, (F.col(index) - 1).alias(index),
        F.col("__start").alias("start_ts"), F.col("__end").alias("end_ts"), *totals)


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    span_seconds: float,
    bucket_seconds: float,
    **aggregates: Column,
) -> DataFrame:
    """Aggregates over ``[ts, ts + span]`` of the same key for every row.

    Rows of the first ``span`` seconds of a slice are copied to the slice before it, so a
    slice sees everything its own rows need and no frame crosses a task.
    """
    if bucket_seconds < span_seconds:
        raise ValueError("bucket_seconds must be at least span_seconds")
    home = time_bucket(ts, bucket_seconds)
    reached = time_bucket(F.col(ts) - F.make_dt_interval(secs=F.lit(span_seconds)), bucket_seconds)
    spread = df.withColumn("__home", home).withColumn(
        BUCKET, F.explode(F.array_distinct(F.array(reached, F.col("__home")))))
    span = int(round(span_seconds * 1e6))
    frame = (Window.partitionBy(*keys, BUCKET).orderBy(F.unix_micros(ts)).rangeBetween(0, span))
    return (spread.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()])
            .filter(F.col(BUCKET) == F.col("__home")).drop(BUCKET, "__home"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, "__row.*")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right key columns are dropped."""
    if not keys:
        raise ValueError("join_keys needs at least one key")
    for k in keys:
        right = right.withColumnRenamed(k, f"__r_{k}")
    on = [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])
