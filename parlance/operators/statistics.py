"""Pooled, paired and resampled statistics over result rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ranking import global_row_number


def pooled_rate(errors: str, words: str) -> Column:
    """Sum of errors over sum of words (at least 1)."""
    return F.sum(errors) / F.greatest(F.sum(words), F.lit(1))


#: A prime below 2^31; fifth powers are a permutation of its remainders.
PRIME = 2147483647
#: Fixed offsets of the draws: resample and stream of the first key, of the second, and place.
OFFSETS = (12345, 1013904223, 747796405, 1103515245, 362436069)
#: Items of a block, at least; there are at most ``MOST_BLOCKS``.
BLOCK, MOST_BLOCKS = 1 << 14, 1 << 12
#: Resamples of one row of work, and draws of one stream when blocks are drawn.
_CHUNK, _STREAM = 512, 1 << 20


def _reduced(x: np.ndarray) -> np.ndarray:
    """Remainders of products of remainders."""
    x = (x & PRIME) + (x >> 31)
    x -= PRIME * (x >= PRIME)
    return x


def _fifth(x: np.ndarray) -> np.ndarray:
    square = _reduced(x * x)
    return _reduced(_reduced(square * square) * x)


def places(count: int) -> np.ndarray:
    """What the draws 0 to ``count`` - 1 of any stream start from."""
    return _fifth((np.arange(count, dtype=np.int64) + OFFSETS[4]) % PRIME)


def uniforms(resample: int, stream: int, start: np.ndarray) -> np.ndarray:
    """Numbers below ``PRIME`` for the draws that begin with ``start``, from two keys of resample and stream.

    Resample, stream and place are each raised to the fifth power before they
    meet, and twice after: no stream is another one shifted.
    """
    first, second = (
        _fifth((_fifth(np.array([(resample + OFFSETS[k]) % PRIME])) + _fifth(np.array([(stream + OFFSETS[k + 1]) % PRIME]))) % PRIME) for k in (0, 2)
    )
    return _fifth((_fifth((start + first) % PRIME) + second) % PRIME)


def block_size(n: int, least: int = BLOCK) -> int:
    return max(least, -(-n // MOST_BLOCKS))


def _block_counts(spark: SparkSession, n: int, size: int, resamples: int) -> DataFrame:
    """(blk, chunk, drawn): how many of each resample's n draws fall in a block, as structs (b, k).

    Counts alone are shuffled: of every group of draws one row per block and resample.
    """
    chunks, parts = -(-resamples // _CHUNK), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    streams = -(-n // _STREAM)
    groups = min(streams, -(-parts // chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = places(min(n, _STREAM))
        for work in (int(i) for batch in batches for i in batch.column("id").to_pylist()):
            chunk, group = work % chunks, work // chunks
            for b in range(chunk * _CHUNK, min(resamples, (chunk + 1) * _CHUNK)):
                counts = np.zeros(-(-n // size), np.int64)
                for stream in range(group, streams, groups):
                    u = uniforms(b, 2 * stream + 1, start[: n - stream * _STREAM])
                    counts += np.bincount(u * n // PRIME // size, minlength=len(counts))
                blk = np.flatnonzero(counts)
                one = [blk, np.full(len(blk), chunk), np.full(len(blk), b), counts[blk]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one], ["blk", "chunk", "b", "k"])

    rows = spark.range(0, chunks * groups, 1, min(parts, chunks * groups)).mapInArrow(run, "blk long, chunk long, b long, k long")
    whole = rows.groupBy("blk", "chunk", "b").agg(F.sum("k").alias("k"))
    return whole.groupBy("blk", "chunk").agg(F.collect_list(F.struct("b", "k")).alias("drawn"))


def resampled(items: DataFrame, key: str, numerator: str, denominator: str, resamples: int, *, block: int = BLOCK) -> DataFrame:
    """(b, rate): the ratio of sums in each resample of the n items with replacement, n draws each.

    No draw is a row. Items stand in blocks by the order of ``key``. If there are
    several, each resample's draws first choose blocks, which gives a count per
    block and resample; inside a block, that many draws choose items. Either
    step's draws are even and independent, so together they are draws from all
    items. A task sums the items that its draws choose, and only a pair of sums
    per resample and task is shuffled.

    Work grows with n times ``resamples`` in numpy, memory with a block and
    ``resamples``. Null numbers count as 0; without items there are no rates.
    """
    spark = items.sparkSession
    number = lambda c, name: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(name)
    numbered = global_row_number(items.select(F.col(key).alias("key"), number(numerator, "num"), number(denominator, "den")), ["key"], "i")
    n = numbered.count()
    size = block_size(n, block)
    blocks = numbered.groupBy(F.expr(f"(i - 1) div {size}").alias("blk")).agg(F.array_sort(F.collect_list(F.struct("i", "num", "den"))).alias("rows"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-resamples // _CHUNK) - 1).cast("long")))
    work = blocks.select("blk", F.col("rows.num").alias("num"), F.col("rows.den").alias("den"), chunks.alias("chunk"))
    if n > size:
        work = work.join(_block_counts(spark, n, size, resamples), ["blk", "chunk"])
    else:
        work = work.withColumn("drawn", F.lit(None).cast("array<struct<b:bigint,k:bigint>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, resamples))
        for row in (r for batch in batches for r in batch.to_pylist()):
            num, den = np.array(row["num"]), np.array(row["den"])
            own = range(row["chunk"] * _CHUNK, min(resamples, (row["chunk"] + 1) * _CHUNK))
            drawn = [(b, n) for b in own] if row["drawn"] is None else [(d["b"], d["k"]) for d in row["drawn"]]
            start = places(max(k for _, k in drawn))
            for b, k in drawn:
                at = uniforms(b, 2 * row["blk"], start[:k]) % len(num)
                sums[:, b] += num[at].sum(), den[at].sum()
        met = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[0, met]), pa.array(sums[1, met])], ["b", "num", "den"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = work.repartition(parts, "blk", "chunk").mapInArrow(run, "b long, num double, den double")
    every = spark.range(resamples if n else 0).select(F.col("id").alias("b"), F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return sums.unionByName(every).groupBy("b").agg((F.sum("num") / F.greatest(F.sum("den"), F.lit(1.0))).alias("rate"))


def interval(rates: DataFrame) -> DataFrame:
    """The 2.5 and 97.5 percentiles of resampled rates."""
    return rates.agg(
        F.round(F.percentile("rate", F.lit(0.025)), 6).alias("lo"),
        F.round(F.percentile("rate", F.lit(0.975)), 6).alias("hi"),
        F.count("*").alias("resamples"),
    )


def upper_median_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The row at index n // 2 of each group, by global numbers: no group is one task's work."""
    ranked = global_row_number(df, [F.col(group), *(F.col(c) for c in order)], "_r")
    places = ranked.groupBy(group).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    wanted = places.select((F.col("_first") + F.floor(F.col("_n") / 2)).alias("_r"))
    return ranked.join(wanted, "_r", "left_semi").drop("_r")
