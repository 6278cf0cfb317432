"""Exports stay whole, writes can be repeated, saved searches run."""

from fraylens.operators.filters import time_range
from fraylens.sources import export, stores

import pytest
from pyspark.sql import functions as F


def test_parts_keep_every_child(spark):
    kids = spark.createDataFrame([(1 if i % 10 else 2, i) for i in range(1000)], "k int, v int")
    p = export.parts(kids, "k", ["v"], "items", rows=50).collect()
    assert sum(len(r["items"]) for r in p) == 1000
    assert len([r for r in p if r.k == 1]) > 10 and max(len(r["items"]) for r in p) < 150
    assert sorted(x.v for r in p for x in r["items"]) == list(range(1000))


def test_events_round_trip_and_tenant(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, "2024-01-01 10:00:00"), (3, 2, "2024-01-02 10:00:00")], "guild_id long, line_no long, t string")
    e = e.selectExpr("guild_id", "line_no", "cast(t as timestamp) ts")
    stores.write_events(e, str(tmp_path / "e"))
    assert stores.read_events(spark, str(tmp_path / "e"), 3).count() == 1
    assert stores.read_events(spark, str(tmp_path / "e"), None).filter("guild_id = 1").count() == 1


def test_saved_search_counts_uses(spark, tmp_path):
    path = str(tmp_path / "s")
    target = spark.createDataFrame([(i,) for i in range(10)], "n int")
    stores.save_search(spark, path, "big", {"field": "n", "operator": "gt", "value": 7})
    assert stores.run_saved(spark, path, "big", target).count() == 2
    assert stores.run_saved(spark, path, "big", target, {"n": 4}).count() == 5
    assert stores.list_searches(spark, path).first().use_count == 2
    with pytest.raises(KeyError):
        stores.run_saved(spark, path, "none", target)


def test_file_hashes(spark, tmp_path):
    for n, text in (("a", "x"), ("b", "x"), ("c", "y")):
        (tmp_path / n).write_text(text)
    h = stores.file_hashes(spark, str(tmp_path))
    assert stores.dedupe_files(h.withColumnRenamed("file_hash", "h0"), "h0", "path").count() == 2


def test_range_must_be_forward(spark):
    with pytest.raises(ValueError):
        time_range(spark.range(1), "id", "2024-02-01", "2024-01-01")


def test_time_range_reads_dates_in_any_writing(spark):
    days = spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-31', interval 1 day)) AS ts")
    assert time_range(days, "ts", "2024-1-9", "2024-01-10").count() == 2
    with pytest.raises(ValueError):
        time_range(days, "ts", "2024-01-09 10:00:00", "2024-01-09T09:00:00")


def test_newest_saved_search_counts(spark, tmp_path):
    path = str(tmp_path / "again")
    stores.save_search(spark, path, "s", {"field": "id", "operator": "lt", "value": 9})
    stores.save_search(spark, path, "s", {"field": "id", "operator": "lt", "value": 2})
    assert stores.run_saved(spark, path, "s", spark.range(20)).count() == 2


def test_ingest_may_be_repeated_and_may_break_off(spark, tmp_path):
    """An upload counts once however often it is written; one that broke off isn't read and is replaced later."""
    path, schema = str(tmp_path / "store"), "line_no long, ts timestamp"
    make = lambda upload, n: spark.createDataFrame([(1 + i % 2, i, "2024-01-01 10:00:00", upload) for i in range(n)], "guild_id long, line_no long, t string, upload string").selectExpr(
        "guild_id", "line_no", "cast(t as timestamp) ts", "upload")
    stores.ingest_events(make("a", 10), path)
    stores.ingest_events(make("a", 10).unionByName(make("b", 6)), path)
    stores.ingest_events(make("b", 6), path)
    assert stores.read_uploads(spark, path, schema).count() == 16 and stores.read_uploads(spark, path, schema, 2).count() == 8
    assert {(r.upload, r.events) for r in stores.committed(spark, path).collect()} == {("a", 10), ("b", 6)}
    # rows without an entry in the log: the job ended between the two
    half = make("c", 4).withColumn("event_date", F.to_date("ts"))
    half.write.mode("append").partitionBy("guild_id", "event_date", "upload").parquet(f"{path}/events")
    assert stores.read_uploads(spark, path, schema).count() == 16
    stores.ingest_events(make("c", 7), path)
    assert stores.read_uploads(spark, path, schema).count() == 23


def test_sightings_replace_their_upload(spark):
    make = lambda rows: spark.createDataFrame(rows, "guid string, upload string, first_seen int, last_seen int, encounter_count long, name string")
    old = make([("p", "u1", 1, 2, 3, "A"), ("q", "u1", 1, 1, 1, "Q"), ("p", "u2", 5, 6, 2, "B")])
    table = stores.upsert_sightings(old, make([("p", "u1", 1, 2, 3, "A"), ("p", "u3", 7, 7, 1, "C")]), "guid")
    got = {r.guid: (r.first_seen, r.last_seen, r.encounter_count, r.name) for r in stores.characters_seen(table, "guid").collect()}
    assert got == {"p": (1, 7, 6, "C")}
