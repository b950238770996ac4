"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of fixed byte length. Equal blocks get one
integer name, different blocks different ones: occurrences are numbered, and a
block is named by its least occurrence. Adjacent names are then named in pairs,
level by level, until one name is left for each document. Two documents have the
same last name (and block count) exactly when their texts are equal: no hashes
decide, so nothing collides.

Hot blocks and groups are safe: naming is a grouped minimum, combined before the
shuffle, and on the way back names of heavy keys are broadcast, so that their
rows go nowhere (``skew.lookup``).

Edge cases: a null text counts as empty, and all empty texts are equal; a very
long text only has more blocks; rows with the same doc_id and equal texts are
copies of each other, of which the first in the table stays; a null doc_id takes
part and stays only where no other row of its group is as long; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import skew
from parlance.llm.scratch import Scratch

#: Characters that normalisation deletes.
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_spaces(text: Column) -> Column:
    """``text`` without ASCII white space; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for space in _SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _named(parts: DataFrame, key: list[str], count: int, spread: Column) -> DataFrame:
    """``parts`` with, for their key, ``name``: the least occurrence ``at`` among the rows with an equal key.

    ``count`` is the number of parts, or somewhat more.
    """
    names = parts.groupBy(*key).agg(F.min("at").alias("name"), F.count("*").alias("n"))
    heavy = names.where(F.col("n") > skew.limit(parts, count))
    # Always true; but both uses of the names now need the same columns, so the parts are shuffled for them once.
    return skew.lookup(parts, names.where("n > 0"), heavy, key, ["name"], spread)


def identities(texts: DataFrame, scratch: Scratch, *, block_bytes: int = 2048, wide: bool = False) -> DataFrame:
    """(row, blocks, name) for rows (row long, body binary): equal (blocks, name) means equal bodies.

    ``row`` must be unique, as ``monotonically_increasing_id`` gives it: a
    partition number above 33 bits of place. Occurrences pack partition, place
    and block into one number, with as many bits for each as the table needs;
    where 63 bits do not suffice, numbers are decimals of 38 digits.
    """
    count = F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes).cast("int"))
    sizes = texts.select("row", count.alias("blocks"))
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    parts, places, longest, total = (int(x or 1) for x in sizes.agg(F.max(part), F.max(place), F.max("blocks"), F.sum("blocks")).first())
    for_place, for_block = places.bit_length(), longest.bit_length()
    if parts.bit_length() + for_place + for_block <= 63 and not wide:
        at, none = F.shiftleft(F.shiftleft(part, for_place) + place, for_block) + F.col("i"), F.lit(-1).cast("long")
        spread = F.xxhash64("at")
    else:
        number, none = F.col("row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)"), F.lit(-1).cast("decimal(38,0)")
        at = (number + F.col("i").cast("decimal(10,0)")).cast("decimal(38,0)")
        spread = F.xxhash64("at").cast("decimal(38,0)")
    cut = texts.select("row", "body", count.alias("blocks")).select(
        "row",
        "blocks",
        "body",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
    )
    first = cut.select(
        "row",
        "blocks",
        "i",
        F.substring(F.col("body"), F.col("i") * block_bytes + 1, F.lit(block_bytes)).alias("block"),
        at.alias("at"),
    )
    level = scratch.save(
        _named(first, ["block"], total, F.xxhash64("at").cast("string").cast("binary")).select("row", "blocks", "i", "name"),
        "names-0",
    )
    done, k = level.where("blocks = 1").select("row", "blocks", "name"), 0
    width = F.col("blocks")
    while longest > 2**k:
        k += 1
        # Pairs of neighbours; the last of an odd number stays alone and is named as such.
        pairs = level.where(width > 2 ** (k - 1)).groupBy("row", "blocks", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), none).alias("right"),
        )
        level = scratch.save(_named(pairs.withColumn("at", at), ["left", "right"], total, spread).select("row", "blocks", "i", "name"), f"names-{k}")
        done = done.unionByName(level.where((width > 2 ** (k - 1)) & (width <= 2**k)).select("row", "blocks", "name"))
    return done


def exact_duplicates(documents: DataFrame, *, block_bytes: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row.

    Of equal texts the row with the most code points in the original stays, then
    the one with the least doc_id, then the first in the table.
    """
    scratch = Scratch(documents.sparkSession, "exact")
    body = without_spaces(F.col(text)).cast("binary")
    # The row number is fixed by writing it: a retried task reads it back instead of numbering anew.
    rows = scratch.save(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.length(text), F.lit(0)).alias("points"),
            body.alias("body"),
        ),
        "rows",
    )
    packed = rows.select("row", "body")
    named = identities(packed, scratch, block_bytes=block_bytes)
    held = scratch.save(rows.select("row", "doc_id", "points", F.sha2("body", 256).alias("text_sha256")).join(named, "row"), "held")
    scratch.drop("rows", *(f"names-{k}" for k in range(64)))
    best = F.struct(
        (-F.col("points")).alias("shorter"),
        F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("doc_id"),
        F.col("row").alias("row"),
    )
    keep = held.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("first"))
    keep = scratch.save(
        keep.select("blocks", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")),
        "groups",
    )
    # The row count of a written table is in its footers.
    heavy = keep.where(F.col("group_size") > skew.limit(held, held.count()))
    spread = F.xxhash64("row").cast(held.schema["name"].dataType)
    out = skew.lookup(held, keep, heavy, ["name", "blocks"], ["group_size", "keep_id", "keep_row"], spread)
    kept = F.col("row") == F.col("keep_row")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
