"""State machines run in a session whose own state store has no column families, and leave that session as it was."""

import pytest
from pyspark.sql import functions as F

from fraylens.operators import segments
from fraylens.operators.ordered import newest
from fraylens.streaming import live, stateful

HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture(params=[None, HDFS])
def plain_store(request, spark):
    """The store of a session that isn't made by ``session.build``: none named, or Spark's default."""
    own = spark.conf.get(live.STORE)
    spark.conf.unset(live.STORE) if request.param is None else spark.conf.set(live.STORE, request.param)
    before = spark.conf.get(live.STORE, None)
    yield
    after = spark.conf.get(live.STORE, None)
    spark.conf.set(live.STORE, own)
    assert after == before


def test_machines_in_any_session(spark, tmp_path, plain_store):
    def run(name, rows, schema, make, keys):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        stream = make(live.stream_table(spark, f"{tmp_path}/{name}", spark.createDataFrame([], schema).schema))
        live.run_available(stream, "update", live.batch_writer(f"{tmp_path}/{name}-out"), f"{tmp_path}/{name}-state")
        return newest(live.stored(spark, f"{tmp_path}/{name}-out"), keys, ["revision"]).collect()

    ts = F.timestamp_micros("us")
    rows = [(1, 1_000_000, 1, segments.START, 5, False), (1, 2_000_000, 2, segments.END, 5, True), (1, 3_000_000, 3, segments.START, 6, False), (2, 900_000_000, 4, segments.START, 5, None)]
    got = run("encounters", rows, "guild_id long, us long, line_no long, event_type string, boss_id long, success boolean",
              lambda s: stateful.live_encounters(s.withColumn("ts", ts).drop("us"), "0 seconds"), ["guild_id", "encounter_id"])
    assert {(r["guild_id"], r["encounter_id"], r["status"]) for r in got if r["guild_id"] == 1} == {(1, 1, "closed"), (1, 3, "in_progress")}

    rows = [(7, "a", 1_000_000, "SPELL_DAMAGE", 10, 0), (7, "b", 2_000_000, "SPELL_DAMAGE", 30, 0), (7, "a", 3_000_000, "SPELL_DAMAGE", 5, 0)]
    got = run("top", rows, "encounter_key long, source_guid string, us long, event_type string, amount long, overhealing long",
              lambda s: stateful.live_top(s.withColumn("ts", ts).drop("us"), 1), ["encounter_key", "rank"])
    assert [(r["guid"], r["damage"], r["participants"]) for r in got] == [("b", 30, 2)]

    got = run("delivery", [("c", 1), ("c", 2), ("c", 2), ("c", 4)], "client_id string, seq long", lambda s: stateful.live_delivery(s, first=1), ["client_id"])
    assert [(r["acked"], r["contiguous"], r["received"], r["duplicates"]) for r in got] == [(4, 2, 3, 1)]
