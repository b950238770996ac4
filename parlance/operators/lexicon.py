"""Mining of a loanword lexicon from tagged words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mine(
    tagged: DataFrame,
    words: DataFrame,
    manual: list[str],
    *,
    blocked: int = 2500,
    least: int = 2,
    agreement: float = 0.7,
    share: float = 0.5,
) -> DataFrame:
    """(dev, eng, total, n): the spelling that tags give a word most often (of equals the one seen first).

    ``tagged`` has (dev, eng, at; at in any type with an order), ``words`` has (word) of every occurrence. A
    word needs ``least`` tags, of which ``agreement`` give that spelling, and
    ``share`` of its occurrences tagged. The ``blocked`` most frequent words
    (ties by word) without the ``manual`` ones, and the manual ones themselves,
    are left out.
    """
    known = F.array(*(F.lit(w) for w in manual)) if manual else F.array().cast("array<string>")
    counts = words.groupBy("word").agg(F.count("*").alias("seen"))
    # A set of ``blocked`` words at most, so it is fit to broadcast.
    frequent = counts.orderBy(F.desc("seen"), "word").limit(blocked).where(~F.array_contains(known, F.col("word"))).select(F.col("word").alias("dev"))
    pairs = tagged.groupBy("dev", "eng").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = pairs.groupBy("dev").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "first", "eng", "n")).alias("b"))
    kept = best.where((F.col("total") >= least) & (F.col("b.n") >= agreement * F.col("total")) & ~F.array_contains(known, F.col("dev")))
    kept = kept.join(F.broadcast(frequent), "dev", "left_anti").join(counts.withColumnRenamed("word", "dev"), "dev", "left")
    enough = F.col("total") >= share * F.greatest(F.coalesce("seen", F.lit(0)), F.col("total"))
    return kept.where(enough).select("dev", F.col("b.eng").alias("eng"), "total", F.col("b.n").alias("n"))
