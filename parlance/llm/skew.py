"""Joins that stay spread where a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit(rows: DataFrame, count: int) -> int:
    """How many of ``count`` rows a key may hold before it is heavy: half a shuffle partition's share.

    So there are at most twice as many heavy keys as shuffle partitions.
    """
    return max(1, count // (2 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def lookup(rows: DataFrame, table: DataFrame, heavy: DataFrame, keys: list[str], values: list[str], spread: Column) -> DataFrame:
    """``rows`` without ``keys`` but with ``values`` of ``table``, which holds each key at most once; null where it has none.

    ``heavy`` (keys and values) are the rows of ``table`` for keys with more than
    ``limit`` rows; their number is bounded, so they are broadcast. A row that
    they answer needs no partner any more: ``spread``, of the first key's type,
    replaces that key and scatters such rows over all partitions.
    """
    few = heavy.select(*keys, F.struct(*values).alias("__few"))
    marked = rows.join(F.broadcast(few), keys, "left")
    key = [F.when(F.col("__few").isNull(), F.col(keys[0])).otherwise(spread), *(F.col(k) for k in keys[1:])]
    rest = [c for c in rows.columns if c not in keys]
    marked = marked.select(*rest, "__few", *(k.alias(f"__key{i}") for i, k in enumerate(key)))
    many = table.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.struct(*values).alias("__many"))
    joined = marked.join(many, [f"__key{i}" for i in range(len(keys))], "left")
    found = F.coalesce("__few", "__many")
    return joined.select(*rest, *(found[v].alias(v) for v in values))
