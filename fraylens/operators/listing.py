"""Pages, top lists, tiers and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def page(
    df: DataFrame, sort: str, allowed: Sequence[str], key: str, descending: bool = True, limit: int = 20, offset: int = 0
) -> DataFrame:
    """One page with totals; an unknown sort column falls back to the first allowed one."""
    column = F.col(sort if sort in allowed else allowed[0])
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(column.desc() if descending else column.asc(), key).offset(offset).limit(limit)
    return rows.select("*", total.alias("total"), F.ceil(total / limit).alias("pages"), (total > offset + limit).alias("has_next"))


PERFORMANCE_METRICS = ("damage_done", "healing_done", "dps", "hps", "combat_dps", "combat_hps", "activity_percentage")


def top_performers(
    rows: DataFrame, metric: str, n: int, *, guild: int | None = None, encounter_type: str | None = None,
    name: str | None = None, since: Column | None = None,
) -> DataFrame:
    if metric not in PERFORMANCE_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    d = rows
    if guild is not None:
        d = d.filter(F.col("guild_id") == guild)
    if encounter_type is not None:
        d = d.filter(F.col("encounter_type") == encounter_type)
    if name is not None:
        d = d.filter(F.col("name").contains(name))
    if since is not None:
        d = d.filter(F.col("start_ts") >= since)
    return d.orderBy(F.desc(metric), "encounter_key", "character_id", "row_id").limit(n)


def replay(events: DataFrame, types: Sequence[str] | None, start: Column, end: Column, limit: int) -> DataFrame:
    """Chronological events of a time range; the limit applies after the sort."""
    d = events.filter(F.col("ts").between(start, end))
    if types:
        d = d.filter(F.col("event_type").isin(list(types)))
    marker = F.when(F.col("event_type") == "UNIT_DIED", "death").when(F.col("event_type").startswith("ENCOUNTER_"), "boundary")
    return d.withColumn("marker", marker).orderBy("ts", "line_no").limit(limit)


# --- storage tiers by age --------------------------------------------------------------------

HOT_DAYS, WARM_DAYS = 7, 30


def tiers(start: datetime, end: datetime, now: datetime) -> list[str]:
    """Which tiers a query range touches."""
    hot, warm = now - timedelta(days=HOT_DAYS), now - timedelta(days=WARM_DAYS)
    out = []
    if end > hot:
        out.append("hot")
    if start < hot and end > warm:
        out.append("warm")
    if start < warm:
        out.append("cold")
    return out or ["hot"]


TIER_ORDER = ("hot", "warm", "cold")


def union_tiers(frames: dict[str, DataFrame], ts: str, start: datetime, end: datetime, key: str) -> DataFrame:
    """Rows of a time range from all tiers, each key once, from the hottest tier that has it.

    A row may be late on its way to the next tier, or be in two tiers for a while, so its age doesn't tell where it is. The time range is
    pushed into every tier's scan; copies meet in an aggregation.
    """
    out = None
    for rank, tier in enumerate(TIER_ORDER):
        if tier not in frames:
            continue
        part = frames[tier].filter(F.col(ts).between(F.lit(start), F.lit(end))).withColumns({"tier": F.lit(tier), "__rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (key, "__rank")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "__rank").alias("__row")).select(key, "__row.*")


def new_files(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


def leaked(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two tenants share (must be empty)."""
    return a.select(key).intersect(b.select(key))
