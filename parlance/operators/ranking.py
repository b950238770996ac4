"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.runtime import written


#: Bits of a row's place in its partition, as ``monotonically_increasing_id`` packs it.
_PLACE = 33


def global_row_number(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """``df`` with 1-based numbers by a total ``order`` (columns or column names).

    Rows are range-partitioned, sorted and written once with their place in
    their partition, as a second evaluation would sample the ranges anew. The
    counts of the partitions, one row each, are summed up in one place.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(placed, "ranges")
    part, place = F.shiftright("_id", _PLACE), F.col("_id").bitwiseAND((1 << _PLACE) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", offset.alias("_offset")))  # a row per partition
    numbered = ranged.withColumn("_part", part).join(offsets, "_part")
    return numbered.withColumn(name, place + F.col("_offset") + 1).drop("_part", "_offset", "_id")
