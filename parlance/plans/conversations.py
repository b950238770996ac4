"""Queries over transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Milliseconds of the synthetic clock per character of a line.
MS_PER_CHAR = 60


def clocked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every conversation with integer start and end times."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("text").cast("long") * MS_PER_CHAR
    start = F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))
    return lines.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + length)


def talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time, merged turns and share of each speaker in each conversation."""
    from parlance.operators.intervals import merge_turns

    merged = merge_turns(
        clocked_lines(spark, sf_dir).select(
            "conv_id",
            F.col("role").alias("speaker"),
            F.col("start_ms").alias("start"),
            F.col("end_ms").alias("end"),
            F.col("turn").alias("seq"),
        ),
        keys=["conv_id"],
        gap=0,
        order="seq",
    )
    per = merged.groupBy("conv_id", "speaker").agg(F.count("*").alias("turns"), F.sum(F.col("end") - F.col("start")).alias("talk_ms"))
    total = F.sum("talk_ms").over(W.partitionBy("conv_id"))
    return per.select(
        "conv_id",
        "speaker",
        "turns",
        "talk_ms",
        F.floor(F.col("talk_ms") * 1000000 / F.when(total > 0, total).otherwise(1)).alias("share_ppm"),
    )


_CLOCK = """
WITH clock AS (
  SELECT conv_id, turn, role, text, length(text) AS chars,
         coalesce(sum(length(text)*60) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM conversations),
lines AS (SELECT *, (start_ms + chars*60)::BIGINT AS end_ms FROM clock)
"""

QUERIES = {"talk_time": talk_time}
ORACLES = {
    "talk_time": _CLOCK
    + """, flagged AS (
  SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY conv_id, role ORDER BY start_ms, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM lines),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, role ORDER BY start_ms, turn) AS island FROM flagged),
merged AS (SELECT conv_id, role AS speaker, island, min(start_ms) AS s, max(end_ms) AS e FROM islands GROUP BY ALL),
per AS (SELECT conv_id, speaker, count(*) AS turns, sum(e - s)::BIGINT AS talk_ms FROM merged GROUP BY ALL)
SELECT conv_id, speaker, turns, talk_ms,
       floor(talk_ms * 1000000 / greatest(1, sum(talk_ms) OVER (PARTITION BY conv_id)))::BIGINT AS share_ppm
FROM per"""
}
