"""Structured Streaming: sources, sinks, rates, periods, de-duplication, late rows, statistics.

All keyed aggregation here is Spark's own (partial aggregation before the shuffle, watermarked state); state machines are in ``stateful``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fraylens import session
from fraylens.functions import classify as C
from fraylens.operators.metrics import effective
from fraylens.operators.ordered import newest

STORE = "spark.sql.streaming.stateStore.providerClass"
MESSAGE = "client_id string, session_id string, seq bigint, client_ts double, line string"


# --- sources ------------------------------------------------------------------------------------

def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Client messages (JSON lines) dropped into a folder; micro-batches by file count."""
    reader = spark.readStream.schema(MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("received", F.timestamp_seconds("client_ts"))


def stream_log_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Growing folder of raw log text, one line per row, ready for ``log.tokenize``.

    A stream has no row numbers; where order matters, send messages with ``seq`` instead.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        F.lit(1).cast("long").alias("guild_id"), F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("line")).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# --- sinks ------------------------------------------------------------------------------------------

def batch_writer(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch function that writes each batch to its own folder; a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch, batch_id) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_available(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str, timeout: int | None = None) -> None:
    """Process everything that is there, however long it takes (``timeout``: seconds, if the caller sets a limit), then stop.

    State lies in RocksDB whatever the session's own store is: state machines need its column families. A query takes over the settings of its session
    when it starts, so the session has its own store again right after.
    """
    conf = stream.sparkSession.conf
    own = conf.get(STORE, None)
    conf.set(STORE, session.DEFAULTS[STORE])
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.unset(STORE) if own is None else conf.set(STORE, own)
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("stream did not finish")


def stored(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """What a ``batch_writer`` stored; with ``keys`` the newest version of each row."""
    d = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    return newest(d, keys, ["batch_id"]).drop("batch_id") if keys else d.drop("batch_id")


# --- live rates --------------------------------------------------------------------------------------------

def live_damage(events: DataFrame, span: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Running damage, healing and time span per encounter and character; state leaves with the window."""
    kind = F.col("event_type")
    damage, heal = kind.isin(C.DAMAGE_LIKE), kind.isin(C.HEAL_LIKE)
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", span).alias("w"), "encounter_key", F.col("source_guid").alias("guid"))
            .agg(F.coalesce(F.sum(F.when(damage, F.col("amount"))), F.lit(0)).alias("damage"),
                 F.coalesce(F.sum(F.when(heal, effective())), F.lit(0)).alias("healing"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
            .select(F.col("w.start").alias("window_start"), "encounter_key", "guid", "damage", "healing", "first_ts", "last_ts", "events"))


def performance_alerts(rates: DataFrame, threshold: float) -> DataFrame:
    """Characters whose damage or healing rate over their active span exceeds the threshold; a filter, on a stream of rates as on a table."""
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    d = rates.withColumns({"dps": C.ratio(F.col("damage"), span), "hps": C.ratio(F.col("healing"), span)})
    return d.filter((F.col("dps") > threshold) | (F.col("hps") > threshold))


def live_combat_periods(events: DataFrame, keys: Sequence[str], gap: str, delay: str = "10 minutes", combat: Column | None = None) -> DataFrame:
    """Combat periods over a stream. The session window only groups: the end is the last event."""
    test = C.is_combat(F.col("event_type")) if combat is None else combat
    return (events.filter(test).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys)
            .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("event_count"))
            .drop("session_window"))


def live_downsample(events: DataFrame, value: str, width: str, slide: str | None = None, delay: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.withWatermark("ts", delay).groupBy(w.alias("w"), *keys)
            .agg(F.sum(value).alias("total"), F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), *keys, "total", "n"))


# --- delivery ------------------------------------------------------------------------------------------------

def dedupe_sequences(lines: DataFrame, ts: str = "received", delay: str = "10 minutes") -> DataFrame:
    """Each (client, sequence) once within the watermark."""
    return lines.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["client_id", "seq"])


class LateRouter:
    """foreachBatch function that sends rows older than ``delay`` behind the newest earlier row to a side table.

    The newest time is one value per batch; it is stored with the batch, so a restarted query continues.
    """

    def __init__(self, path: str, ts: str, delay_seconds: float):
        self.path, self.ts, self.delay = path, ts, delay_seconds

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = self._mark(spark, batch_id)
        late = F.lit(False) if mark is None else F.unix_micros(self.ts) < int(mark - self.delay * 1e6)
        marked = batch.withColumn("late", late)
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/batch_id={batch_id}")
        newest_us = batch.agg(F.max(F.unix_micros(self.ts)).alias("us"))
        newest_us.write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={batch_id}")

    def _mark(self, spark: SparkSession, batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        marks = spark.read.option("basePath", f"{self.path}/marks").parquet(f"{self.path}/marks/batch_id=*")
        return marks.filter(F.col("batch_id") < batch_id).agg(F.max("us")).first()[0]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/batch_id=*").drop("batch_id")


def rate_per_client(lines: DataFrame, client: str, ts: str, limit: int, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width)
    return (lines.withWatermark(ts, delay).groupBy(w.alias("w"), client).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), client, "n", (F.col("n") > limit).alias("over_limit")))


def session_status(lines: DataFrame, client: str, ts: str, idle: str = "300 seconds", delay: str = "0 seconds") -> DataFrame:
    """One row per silence longer than ``idle``: the client, its last row and the moment it turned idle.

    With ``idle='3600 seconds'`` the same rows are the stale sessions.
    """
    return (lines.withWatermark(ts, delay).groupBy(F.session_window(ts, idle).alias("s"), client)
            .agg(F.max(ts).alias("last_seen"), F.count("*").alias("rows"))
            .select(client, "last_seen", F.col("s.end").alias("idle_since"), "rows"))


def stream_stats(tokens: DataFrame, width: str = "1 minute", delay: str = "10 minutes", ts: str = "received") -> DataFrame:
    """Lines, errors, error rate, lines per second and the lag (reception behind the line's own time, of readable lines) per window."""
    bad = F.col("ts").isNull() | F.col("event_type").isNull()
    w = F.window(ts, width)
    lag = F.when(~bad, F.unix_micros(ts) - F.unix_micros(F.col("ts")))
    g = tokens.withWatermark(ts, delay).groupBy(w.alias("w")).agg(
        F.count("*").alias("lines"), F.count_if(bad).alias("errors"), F.max(lag).alias("most"), F.sum(lag).alias("total"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / F.lit(1e6)
    return g.select(F.col("w.start").alias("window_start"), "lines", "errors", (F.col("errors") / F.col("lines")).alias("error_rate"),
                    (F.col("lines") / seconds).alias("lines_per_second"), (F.col("most") / F.lit(1e6)).alias("max_lag_seconds"),
                    (F.col("total") / (F.col("lines") - F.col("errors")) / F.lit(1e6)).alias("mean_lag_seconds"))


def active_encounters(encounters: DataFrame, keys: Sequence[str] = ("encounter_type",)) -> DataFrame:
    """Open, finished and given-up encounters per ``keys`` in the newest rows of ``stateful.live_encounters``."""
    status = F.col("status")
    return encounters.groupBy(*keys).agg(F.count_if(status == "in_progress").alias("active"), F.count_if(status == "closed").alias("finished"),
                                         F.count_if(status.isin("replaced", "idle")).alias("abandoned"))


def progress_row(progress: dict) -> dict:
    """The figures of one ``StreamingQueryProgress`` that a monitor needs."""
    return {"batch_id": progress["batchId"], "input_rows": progress["numInputRows"],
            "rows_per_second": progress.get("processedRowsPerSecond", 0.0), "watermark": progress.get("eventTime", {}).get("watermark")}


def store_encounters_writer(path: str, keys: Sequence[str]):
    """Idempotent store of finished encounters: one folder per batch, read back newest per key."""
    return batch_writer(path, lambda batch, _id: batch.dropDuplicates(list(keys)))

