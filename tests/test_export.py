"""Exports of keys with more children than a part holds."""

import json

from pyspark.sql import functions as F

from fraylens.plans import load_all
from fraylens.plans.catalog import QUERIES
from fraylens.sources import export

load_all()


def test_equal_children_spread_over_parts(spark):
    heads = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k long, name string, total long")
    children = spark.range(2500).select(F.lit(1).cast("long").alias("k"), F.lit(5).alias("v")).unionAll(spark.range(1500).select(F.lit(1).cast("long").alias("k"), F.col("id").cast("int").alias("v")))
    rows = [json.loads(r["document"]) for r in export.documents(heads, children, "k", ["v"], "items").collect()]
    mine = [r for r in rows if r["k"] == 1]
    assert len(mine) == 4 and max(len(r["items"]) for r in mine) < 1300
    assert sorted(i["v"] for r in mine for i in r["items"]) == sorted([5] * 2500 + list(range(1500)))
    assert [r["part"] for r in rows if "total" in r] == [0, 0] and sum(r.get("total", 0) for r in rows) == 15


def test_encounter_detail_counts_hits_once(spark, tmp_path):
    spark.range(2).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2500).selectExpr("0L AS l_orderkey", "id AS l_suppkey", "2.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2500).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = QUERIES["a46_encounter_detail"](spark, str(tmp_path)).collect()
    assert sorted((r["o_orderkey"], r["part"]) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert sum(r["hits"] or 0 for r in rows) == 5000
    assert sorted(n for r in rows if r["participants"] for n in r["participants"].split(",")) == sorted(f"s{i}" for i in range(2500))
