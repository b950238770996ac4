"""Lookups with heavy keys give what a plain left join gives, and keep heavy rows where they are."""

import pytest
from pyspark.sql import functions as F

from parlance.llm import skew


@pytest.mark.parametrize("share", [0.0, 0.4, 0.9])
def test_lookup_is_a_left_join(spark, share):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") < share * 1000, F.lit(7)).otherwise(F.col("id") % 90).cast("long").alias("k"), (F.col("id") % 3).alias("j"))
    sizes = rows.groupBy("k", "j").agg(F.count("*").alias("n"))
    table = sizes.where("k % 5 <> 0").select("k", "j", "n", (F.col("k") * 10 + F.col("j")).alias("v"))
    heavy = table.where(F.col("n") > skew.limit(rows, 1000))
    got = {r.row: r.v for r in skew.lookup(rows, table, heavy, ["k", "j"], ["v"], F.xxhash64("row")).collect()}
    want = {r.row: r.k * 10 + r.j if r.k % 5 else None for r in rows.collect()}
    assert got == want
    assert heavy.count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_limits_bound_the_heavy_keys(spark):
    rows = spark.range(10)
    assert skew.limit(rows, 0) == 1 and skew.limit(rows, 10**6) == 10**6 // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
