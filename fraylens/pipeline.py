"""Raw log text to character metrics, one upload (guild, file) never mixing with another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.functions import classify
from fraylens.operators import metrics, segments, sequence
from fraylens.session import stored
from fraylens.sources import log

UPLOAD = ["guild_id", "file_id"]


def typed_events(lines: DataFrame) -> DataFrame:
    """Typed events of text lines, melee hits that were logged twice once, pets under their owners in source and dest."""
    # text is parsed once; owners and windows read the typed rows several times
    events = stored(sequence.dedupe_swings(log.project_events(log.tokenize(lines)), UPLOAD), "typed-events")
    summons = events.filter("event_type = 'SPELL_SUMMON'").select(
        *UPLOAD, F.col("dest_guid").alias("guid"), F.col("source_guid").alias("owner_guid"), "ts", "line_no")
    for side in ("source_guid", "dest_guid"):
        owned = sequence.resolve_owner(events.withColumn("guid", F.col(side)), summons, upload=UPLOAD)
        events = stored(owned.withColumn(side, F.col("resolved_guid")).drop("guid", "owner_guid", "resolved_guid"), f"owned-{side}")
    return events


def role_rows(lines: DataFrame) -> DataFrame:
    """(encounter_id, guid, category) rows inside encounters."""
    events = typed_events(lines)
    boundaries = events.filter(F.col("event_type").isin("ENCOUNTER_START", "ENCOUNTER_END"))
    windows, _ = segments.pair_boundaries(boundaries, UPLOAD)
    inside = segments.assign_encounter(events, windows, UPLOAD).filter(F.col("encounter_id").isNotNull())
    return classify.categorize(inside)


def metrics_of_lines(lines: DataFrame) -> DataFrame:
    """Totals and counts per upload, encounter and player."""
    players = role_rows(lines).filter(classify.entity_kind(F.col("guid")) == "Player")
    return metrics.combatant_metrics(players, [*UPLOAD, "encounter_id", "guid"])


def character_metrics(spark: SparkSession, paths: str | Sequence[str], guild_id: int = 1) -> DataFrame:
    """The same, from log files."""
    return metrics_of_lines(log.read_log(spark, paths, guild_id))
