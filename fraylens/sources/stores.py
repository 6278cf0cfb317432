"""Tables as files: event and metric writes, merges, snapshots of files, legacy mappings."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.operators import filters
from fraylens.operators.ordered import newest


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Events partitioned by guild and day; a missing or non-positive guild becomes guild 1.

    The rebalance hint lets Spark split a guild that owns a third of the data over many
    writers and pack small guilds together, by measured partition size.
    """
    guild = F.when(F.col("guild_id") > 0, F.col("guild_id")).otherwise(1)
    d = df.withColumn("guild_id", guild).withColumn("event_date", F.to_date("ts"))
    (d.hint("rebalance", F.col("guild_id"), F.col("event_date"))
     .sortWithinPartitions("guild_id", "event_date", "ts")
     .write.mode(mode).partitionBy("guild_id", "event_date").parquet(path))


def ingest_events(df: DataFrame, path: str, upload: str = "upload") -> None:
    """Writes uploads (``upload``: the digest of a file) so that doing it again, wholly or after a failure, changes nothing.

    An upload's rows lie in folders of their own, which a repeated write replaces; its entry in the commit log follows the rows. Uploads that the log has
    are left out, those that broke off have no entry, are not read, and are written anew. Two writers of the same upload write the same rows.
    """
    spark = df.sparkSession
    known = committed(spark, path)
    if known is not None:
        df = df.join(known.select(F.col("upload").alias(upload)), upload, "left_anti")
    guild = F.when(F.col("guild_id") > 0, F.col("guild_id")).otherwise(1)
    d = df.withColumns({"guild_id": guild, "event_date": F.to_date("ts"), "upload": F.col(upload).cast("string")})
    if upload != "upload":
        d = d.drop(upload)
    parts = ["guild_id", "event_date", "upload"]
    (d.hint("rebalance", *(F.col(c) for c in parts)).sortWithinPartitions(*parts, "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/events"))
    written = spark.read.schema(d.schema).option("basePath", f"{path}/events").parquet(f"{path}/events")
    log = written.join(d.select("upload").distinct(), "upload", "left_semi").groupBy("upload").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """upload, events, last_ts of every finished upload; nothing before the first."""
    context = spark.sparkContext
    log = context._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not log.getFileSystem(context._jsc.hadoopConfiguration()).exists(log):
        return None
    return spark.read.schema("events long, last_ts timestamp, upload string").parquet(f"{path}/commits")


def read_uploads(spark: SparkSession, path: str, schema: str, guild_id: int | None = None) -> DataFrame:
    """Rows of finished uploads. ``schema``: of the events without their folders' columns."""
    d = spark.read.schema(f"{schema}, guild_id long, event_date date, upload string").option("basePath", f"{path}/events").parquet(f"{path}/events")
    done = committed(spark, path)
    d = d.join(done.select("upload"), "upload", "left_semi") if done is not None else d.limit(0)
    return filters.for_guild(d, guild_id) if guild_id is not None else d


def read_events(spark: SparkSession, path: str, guild_id: int | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return filters.for_guild(d, guild_id) if guild_id is not None else d


def write_table(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    """Any Spark sink; ``jdbc`` takes the usual url and driver options."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    writer.save() if fmt == "jdbc" else writer.save(target)


def read_table(
    spark: SparkSession, source: str, fmt: str = "parquet", split: tuple[str, Any, Any, int] | None = None, **options: str
) -> DataFrame:
    """Any Spark source. For ``jdbc``, ``split`` = (column, low, high, parts) reads in parallel."""
    reader = spark.read.format(fmt).options(**options)
    if fmt != "jdbc":
        return reader.load(source)
    if split:
        column, low, high, n = split
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.option("dbtable", source).load()


# --- merges ---------------------------------------------------------------------------------------

def upsert_sightings(old: DataFrame, new: DataFrame, key: str, upload: str = "upload") -> DataFrame:
    """Sightings per character and upload; an upload that comes again replaces its own rows, so counts never add up twice."""
    replaced = new.select(upload).distinct()
    return old.join(replaced, upload, "left_anti").unionByName(new)


def upsert_characters(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge sightings: earliest first_seen, latest last_seen, summed counts, newest name. Each sighting must come once (``upsert_sightings``)."""
    return characters_seen(old.unionByName(new), key)


def characters_seen(sightings: DataFrame, key: str) -> DataFrame:
    """One row per character from its sightings."""
    return sightings.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("encounter_count").alias("encounter_count"), F.max_by("name", F.struct("last_seen", "name")).alias("name"))


def upsert_metrics(rows: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """Insert or replace: the row with the greatest version per key wins."""
    return newest(rows, keys, version)


# --- files -------------------------------------------------------------------------------------------

def dedupe_files(files: DataFrame, content: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """First file per content hash with its number of copies; files already known are left out.

    Copies meet in a map-side combined aggregation keyed by the hash of the whole content.
    """
    first = (files.select(F.sha2(F.col(content), 256).alias("file_hash"), key)
             .groupBy("file_hash").agg(F.min(key).alias(key), F.count("*").alias("copies")))
    return first.join(known.select("file_hash"), "file_hash", "left_anti") if known is not None else first


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Path, size and SHA-256 of whole files."""
    raw = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return raw.select("path", "length", "modificationTime", F.sha2("content", 256).alias("file_hash"))


def ingest_status(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What one ingest job found per file."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_distinct("encounter_key").alias("encounters"),
        F.count_distinct("source_guid").alias("characters"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- legacy schemas --------------------------------------------------------------------------------------

def map_legacy(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Select canonical columns from another dialect by name or expression."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def legacy_guid(name: Column, server: Column) -> Column:
    return F.concat_ws("-", name, F.coalesce(server, F.lit("Unknown")))


def backfill_server_region(df: DataFrame, realm: str = "realm") -> DataFrame:
    """``Server-Region`` splits in two; anything else stays the server with an empty region."""
    parts = F.split(realm, "-")
    two = F.size(parts) == 2
    return df.withColumns({"server": F.when(two, parts[0]).otherwise(F.col(realm)), "region": F.when(two, F.get(parts, F.lit(1))).otherwise("")})


def backfill_tenant(df: DataFrame, default: int = 1) -> DataFrame:
    have = F.col("guild_id") if "guild_id" in df.columns else F.lit(None).cast("long")
    return df.withColumn("guild_id", F.coalesce(F.when(have > 0, have), F.lit(default)).cast("long"))


# --- compaction -----------------------------------------------------------------------------------------------

def compact_events(df: DataFrame, path: str, order: Sequence[str] = ("guild_id", "ts")) -> None:
    """Rewrite events in global order as zstd Parquet; range partitioning follows the data, so a
    busy guild is cut by time instead of landing in one file."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def block_stats(df: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Rows, time span and raw text size per block."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.sum(F.length(payload).cast("long")).alias("raw_bytes"))


def file_sizes(spark: SparkSession, path: str, raw_bytes: int) -> DataFrame:
    """Stored bytes per file of a table and the saving against the raw size."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("stored_bytes")).withColumn(
        "saving", 1 - F.col("stored_bytes") / F.lit(raw_bytes))


# --- saved searches ------------------------------------------------------------------------------------------------

SAVED = "id string, definition string, use_count bigint, version bigint"


def save_search(spark: SparkSession, path: str, ident: str, definition: Mapping[str, Any]) -> None:
    """Append a search definition (a filter tree) as data; the newest version of an id counts."""
    row = spark.createDataFrame([(ident, json.dumps(definition), 0, time.time_ns())], SAVED)
    row.write.mode("append").json(path)


def list_searches(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(SAVED).json(path)
    return d.groupBy("id").agg(
        F.max_by("definition", "version").alias("definition"), F.sum("use_count").alias("use_count"), F.max("version").alias("version"))


def run_saved(spark: SparkSession, path: str, ident: str, target: DataFrame, overrides: Mapping[str, Any] | None = None) -> DataFrame:
    """Apply a stored definition to a table; overrides replace values by field. Counts the use."""
    saved = list_searches(spark, path).filter(F.col("id") == ident).first()
    if saved is None:
        raise KeyError(ident)
    definition = _override(json.loads(saved["definition"]), overrides or {})
    spark.createDataFrame([(ident, saved["definition"], 1, saved["version"])], SAVED).write.mode("append").json(path)
    return target.filter(filters.tree(definition, target.columns))


def _override(node: Any, values: Mapping[str, Any]) -> Any:
    if isinstance(node, list):
        return [_override(n, values) for n in node]
    if isinstance(node, dict):
        if node.get("field") in values:
            return {**node, "value": values[node["field"]]}
        return {k: _override(v, values) if k in ("and", "or", "not") else v for k, v in node.items()}
    return node
