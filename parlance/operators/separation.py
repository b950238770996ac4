"""Scores of separated signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import clustering as cl


def si_sdr(est: Column, ref: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB of two double arrays, from sums of products alone."""
    n = F.size(ref)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    centred = lambda x, y: cl.dot(x, y) - total(x) * total(y) / n
    ee, rr, er = centred(est, est), centred(ref, ref), centred(est, ref)
    alpha = er / (rr + 1e-8)
    return 10 * F.log10((alpha * alpha * rr + 1e-8) / (ee - 2 * alpha * er + alpha * alpha * rr + 1e-8))


def output_table(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, first_db, second_db, swapped) of outputs (keys, name, out0, out1, ref0, ref1, fixed).

    Outputs whose order means nothing (``fixed`` false) are matched with the
    sources in the better of both ways.
    """
    score = lambda e, r: si_sdr(F.col(e), F.col(r))
    scored = outputs.select(*keys, "name", "fixed", *(score(f"out{i}", f"ref{j}").alias(f"s{i}{j}") for i in (0, 1) for j in (0, 1)))
    crossed = scored.withColumn("swapped", ~F.col("fixed") & (F.col("s10") + F.col("s01") > F.col("s00") + F.col("s11")))
    pick = lambda straight, other: F.round(F.when(F.col("swapped"), F.col(other)).otherwise(F.col(straight)), 1)
    return crossed.select(*keys, "name", pick("s00", "s10").alias("first_db"), pick("s11", "s01").alias("second_db"), "swapped")
