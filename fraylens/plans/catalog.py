"""Registry of runnable queries over the given tables, each with an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Stand-in event stream as SQL; mirrors ``standins.combat_events``.
EV = r"""
ev0 AS (
  SELECT event_id AS line_no, ts, user_id, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS spell_id,
         event_type AS raw_type, CAST(round(value * 100) AS BIGINT) AS amount
  FROM events),
ev AS (
  SELECT line_no, ts, user_id, user_id % 5 + 1 AS guild_id, spell_id, amount,
         'Spell ' || spell_id AS spell_name,
         CASE raw_type WHEN 'purchase' THEN 'SPELL_DAMAGE' WHEN 'view' THEN 'SPELL_HEAL'
              WHEN 'click' THEN 'SPELL_CAST_SUCCESS' WHEN 'error' THEN 'UNIT_DIED'
              ELSE 'SPELL_RESURRECT' END AS event_type,
         'Player-' || user_id AS source_guid, 'P' || user_id AS source_name,
         CASE WHEN raw_type IN ('error', 'signup') THEN 'Player-' || user_id
              WHEN raw_type = 'purchase' AND spell_id % 2 = 0 THEN 'Creature-' || (spell_id % 7)
              ELSE 'Player-' || ((user_id + spell_id) % 40) END AS dest_guid,
         CASE WHEN raw_type IN ('error', 'signup') THEN 'P' || user_id
              WHEN raw_type = 'purchase' AND spell_id % 2 = 0 THEN 'C' || (spell_id % 7)
              ELSE 'P' || ((user_id + spell_id) % 40) END AS dest_name,
         CASE WHEN raw_type = 'view' AND spell_id % 3 = 0 THEN amount // 5 ELSE 0 END AS overhealing,
         CASE WHEN raw_type = 'purchase' AND spell_id % 5 = 0 THEN amount // 10 ELSE 0 END AS overkill,
         spell_id % 4 = 0 AS critical,
         CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS encounter_key
  FROM ev0)
"""


# Prices as whole cents: sums are exact, so averages do not depend on the order of addition.
CENTS = {"orders": "o_totalprice", "lineitem": "l_extendedprice"}
CENTS_SQL = ", ".join(
    f"{t} AS (SELECT * REPLACE (CAST(round({c} * 100) AS BIGINT) AS {c}) FROM {t})" for t, c in CENTS.items())


class Tables:
    """Reads the given tables; timestamps without zone become UTC timestamps."""

    def __init__(self, spark: SparkSession, folder: str, cents: bool = False):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder, self.cents = spark, folder, cents

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        zoneless = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
        if self.cents and name in CENTS:
            df = df.withColumn(CENTS[name], F.round(F.col(CENTS[name]) * 100).cast("long"))
        return df


def query(name: str, sql: str | None = None, cents: bool = False, longs: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``. ``{EV}`` stands for the stand-in CTEs; with
    ``cents`` both sides read prices as whole cents, and ``longs`` are 64-bit on both sides."""

    def typed(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("long") for c in longs}) if longs else df

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: typed(fn(Tables(spark, folder, cents)))
        if sql is not None:
            text = sql.replace("{EV}", EV.strip())
            if cents:
                text = text.strip()
                rest = ", " + text[5:] if text.upper().startswith("WITH ") else " " + text
                text = "WITH " + CENTS_SQL + rest
            if longs:
                casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs)
                text = f"SELECT * REPLACE ({casts}) FROM ({text})"
            ORACLE[name] = text
        return fn

    return register
