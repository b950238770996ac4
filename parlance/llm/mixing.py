"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, document after document, are cut into blocks of fixed
length. Output shards draw how many slots each source fills: the whole part of
its expected count, and the rest by multinomial draws. The k-th slot of a source
maps through a pseudorandom permutation of the source's block numbers, round
after round, and blocks are joined by number.

Targets are water-filled: shares by weight, no source above ``limit`` times its
size, the excess reshared by weight. No block is used more than ``limit`` times.
A source at that limit is not drawn: its slots are dealt to the shards evenly,
so that it gets all that it can give. Blocks have ``block_words`` words, or a
64th of a small source, so that its target is met to about that share, too.

All random numbers are hashes of positions and the seed, so reruns agree as long
as ids and texts do. Positions inside a source come from two levels of running
sums over hashed buckets, so that a source with a third of all rows is not one
task's work.

Edge cases: a null or empty text has no words and is never taken; a null source
is a source of its own, ordered last; a null doc_id is an id like any other;
rows that share a doc_id and a size lie side by side and are drawn separately; a
very long text lies in as many blocks as it needs and is split once; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.scratch import Scratch

#: Runs of characters beyond ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 24
_CELLS = 4096
_UNIT = 1 << 52
#: Blocks that a source has at least, where it has as many words.
_LEAST_BLOCKS = 64
#: Numbers that one row of a counted range makes.
_STRIDE = 1 << 16
_BUCKET_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_UNIT)) / F.lit(float(_UNIT))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. Sources
    are capped in order of cap by weight: once the common level per weight stays
    below a source's cap by weight, all later ones get that level.
    """
    everything = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.select("source", "source_size", (F.row_number().over(everything) - 1).alias("place")).withColumn("w", w)
    ordered = W.orderBy(F.col("source_size") / F.col("w"), "place")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * share
    level = (total - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    open_ = F.col("level") * F.col("w") <= limit * F.col("source_size")
    ranked = placed.withColumn("level", level).withColumn("rank", F.row_number().over(ordered))
    first = F.min(F.when(open_, F.struct("rank", "level"))).over(W.partitionBy())
    ranked = ranked.withColumn("first", first)
    target = F.when(
        F.col("first").isNull() | (F.col("rank") < F.col("first.rank")),
        limit * F.col("source_size").cast("double"),
    ).otherwise(F.col("first.level") * F.col("w"))
    return ranked.select("source", "place", "source_size", target.cast("double").alias("target"))


def permute(x: Column, n: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds, keyed by ``keys``."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *keys), n) - at, n)
        coin = F.xxhash64(F.lit("b"), r, F.greatest(at, partner), *keys).bitwiseAND(1)
        return F.when(coin == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x.cast("long"), swap)


def block_length(source_size: Column, block_words: int) -> Column:
    return F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(source_size / _LEAST_BLOCKS))).cast("long")


def place_documents(sized: DataFrame, *, buckets: int = 512) -> DataFrame:
    """``sized`` (row, doc_id, source, size) with ``lo``: the words of its source that come before it.

    A bucket is a hash of id and size, so every source spreads over ``buckets`` tasks.
    """
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1))
    local = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = local.join(offsets, local["source"].eqNullSafe(offsets["s"]) & (local["bucket"] == offsets["b"]))
    return joined.select("row", "doc_id", "source", "size", (F.col("inside") + F.col("offset")).alias("lo"))


def _counted(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """``rows`` with every number from 0 to ``count`` - 1, made stride by stride over all partitions."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A few bytes here become very many rows: a set number of partitions keeps them from being merged.
    strides = rows.withColumn("__count", count).where("__count > 0").withColumn(
        "__stride",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / _STRIDE))),
    ).repartition(parts)
    first = F.col("__stride") * _STRIDE
    return strides.withColumn(name, F.explode(F.sequence(first, F.least(F.col("__count"), first + _STRIDE) - 1))).drop("__count", "__stride")


def draw_slots(goals: DataFrame, *, block_words: int, shard_slots: int = 4096, limit: int = 2, seed: int = 0) -> DataFrame:
    """(place, shard, turn, block): the block in each slot of each source.

    ``goals``: place, source_size, target. Every shard gives each source the
    whole part of its expected slots; its remaining slots are multinomial draws
    by inverse distribution function over the fractions, an equi-join on cells
    of the unit interval. The k-th slot of a source takes its k-th permuted block.
    """
    all_ = W.partitionBy()
    size, length = F.col("source_size"), block_length(F.col("source_size"), block_words)
    base = goals.where("source_size > 0 and target > 0").select(
        "place",
        F.ceil(size / length).cast("long").alias("blocks"),
        (F.col("target") >= limit * size).alias("full"),
        "target",
        "source_size",
    )
    # A slot holds the words of a mean block, as the last one of a source may be short.
    base = base.withColumn(
        "slots",
        F.when(F.col("full"), F.lit(float(limit)) * F.col("blocks")).otherwise(F.col("target") * F.col("blocks") / size),
    ).drop("target", "source_size")
    shards = F.greatest(F.lit(1), F.round(F.sum("slots").over(all_) / shard_slots)).cast("long")
    base = base.withColumn("shards", shards).withColumn("each", F.col("slots") / F.col("shards"))
    base = base.withColumn("whole", F.floor("each").cast("long")).withColumn(
        "part",
        F.when(F.col("full"), 0.0).otherwise(F.col("each") - F.floor("each")),
    )
    upto = F.sum("part").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    parts = F.sum("part").over(all_)
    # The last source with a part ends the interval, whatever the sums round to.
    last = F.max(F.when(F.col("part") > 0, F.col("place"))).over(all_)
    base = base.withColumn("parts", parts).withColumn(
        "hi",
        F.when(F.col("place") >= last, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(upto, F.col("parts")))),
    )
    base = base.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("place")), F.lit(0.0)))

    # Slots without a draw; a full source gets all its slots, spread over the shards.
    sure = _counted(base, F.when(F.col("full"), F.floor(F.col("slots") + 0.5)).otherwise(F.col("whole") * F.col("shards")).cast("long"), "k")
    sure = sure.select(
        "place",
        "blocks",
        F.least(
            F.col("shards") - 1,
            F.floor(F.when(F.col("full"), F.col("k") / F.col("each")).otherwise(F.col("k") / F.col("whole"))),
        ).cast("long").alias("shard"),
        "k",
    )

    cell = lambda u: F.floor(u * _CELLS).cast("int")
    grid = base.where("hi > lo").select(
        "place",
        "blocks",
        (F.col("whole") * F.col("shards")).alias("first"),
        "lo",
        "hi",
        F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(_CELLS - 1)))).alias("cell"),
    )
    tries = _counted(base.limit(1).select("parts", "shards"), F.when(F.col("parts") > 0, F.col("shards")).otherwise(0), "shard")
    # The draws of all shards up to any one are the sum of their parts, rounded from a random start.
    upto = lambda s: F.floor(s * F.col("parts") + _uniform(seed, F.lit("n")))
    tries = tries.withColumn("left", upto(F.col("shard") + 1) - upto(F.col("shard"))).where("left > 0")
    tries = tries.select("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("r")).withColumn(
        "u",
        _uniform(seed, F.col("shard"), F.col("r")),
    )
    drawn = tries.withColumn("cell", cell(F.col("u"))).join(grid, "cell").where("u >= lo and u < hi").groupBy(
        "place",
        "blocks",
        "first",
        "shard",
    ).agg(F.count("*").alias("n"))
    # Drawn slots of a source are numbered behind its sure ones: sums of ranges of shards, then inside each range.
    drawn = drawn.withColumn("range", F.floor(F.col("shard") / _CELLS))
    sums = drawn.groupBy("place", "range").agg(F.sum("n").alias("in_range"))
    sums = sums.select(
        "place",
        "range",
        F.coalesce(F.sum("in_range").over(W.partitionBy("place").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = F.coalesce(F.sum("n").over(W.partitionBy("place", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("inside", inside).join(sums, ["place", "range"])
    start = F.col("first") + F.col("before") + F.col("inside")
    drawn = drawn.select("place", "blocks", "shard", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("k"))

    slots = sure.unionByName(drawn).where(F.col("k") < limit * F.col("blocks"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    return slots.select(
        "place",
        "shard",
        turn.alias("turn"),
        permute(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.col("place"), turn).alias("block"),
    )


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """Each document's part of each block it lies in: row, place, block, first word and number of words."""
    lo, hi, length = F.col("lo"), F.col("lo") + F.col("size"), F.col("length")
    cut = placed.where("size > 0").withColumn("length", block_length(F.col("source_size"), block_words))
    spread = cut.withColumn("block", F.explode(F.sequence(F.floor(lo / length), F.floor((hi - 1) / length))))
    begin = F.greatest(lo, F.col("block") * length)
    return spread.withColumn("first", begin - lo).withColumn("words", F.least(hi, (F.col("block") + 1) * length) - begin)


def mix_sources(
    documents: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    block_words: int = 32,
    seed: int = 0,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    row: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, draws): sized rows with their targets, their pieces per block, and the drawn slots.

    ``row`` names a column of unique numbers; without it rows are numbered, and
    the numbers are written once so that retried tasks read the same ones.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    sized = scratch.save(
        documents.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
        ),
        "sized",
    )
    goals = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, limit=limit), "goals")
    draws = scratch.save(draw_slots(goals, block_words=block_words, limit=limit, seed=seed), "draws")
    by_source = goals.withColumnRenamed("source", "s")
    # The row count of a written table is in its footers.
    placed = place_documents(sized, buckets=max(512, sized.count() // _BUCKET_ROWS))
    placed = scratch.save(placed.join(by_source, placed["source"].eqNullSafe(by_source["s"])).drop("s"), "placed")
    scratch.drop("sized", "goals")
    return placed, pieces(placed, block_words), draws


def taken_words(placed: DataFrame, parts: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row.

    The joins are by sort and merge: draws compress so well as files that their
    size would pass for that of a table fit to broadcast.
    """
    uses = draws.groupBy("place", "block").agg(F.count("*").alias("uses"))
    taken = parts.select("row", "place", "block", "words").join(uses.hint("merge"), ["place", "block"]).groupBy("row").agg(
        F.sum(F.col("words") * F.col("uses")).alias("taken")
    )
    return placed.join(taken.hint("merge"), "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
    )


def mixed_texts(
    documents: DataFrame,
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    block_words: int = 512,
    seed: int = 0,
) -> DataFrame:
    """The mix itself with the columns of ``documents``: adjoining pieces of a document drawn in one turn are one row.

    A piece holds its words with the white space after each (the first piece of
    a document also the white space before), so pieces join to the whole text.
    """
    columns = documents.columns
    scratch = Scratch(documents.sparkSession, "mixed")
    numbered = scratch.save(documents.withColumn("__mixing_row", F.monotonically_increasing_id()), "numbered")
    _, parts, draws = mix_sources(
        numbered.select("doc_id", "source", "text", "__mixing_row"),
        weights=weights,
        share=share,
        limit=limit,
        block_words=block_words,
        seed=seed,
        row="__mixing_row",
    )
    hit = parts.select("row", "place", "block", "first", "words").join(draws.select("place", "block", "turn").hint("merge"), ["place", "block"])
    by = W.partitionBy("row", "turn").orderBy("first")
    apart = F.when(F.lag(F.col("first") + F.col("words")).over(by) == F.col("first"), 0).otherwise(1)
    runs = hit.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by)).groupBy("row", "turn", "run").agg(
        F.min("first").alias("first"),
        F.sum("words").alias("words"),
    )
    # All runs of a document meet its text once, which is split once.
    runs = runs.groupBy(F.col("row").alias("__mixing_row")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "first", "words"))).alias("__mixing_runs")
    )
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    both = F.array(F.struct(words.alias("words"), F.col("__mixing_runs").alias("runs")))
    cut = lambda p: F.transform(p["runs"], lambda r: F.array_join(F.slice(p["words"], (r["first"] + 1).cast("int"), r["words"].cast("int")), ""))
    joined = numbered.join(runs.hint("merge"), "__mixing_row")
    piece = joined.select(*(c for c in columns if c != "text"), F.explode(F.get(F.transform(both, cut), F.lit(0))).alias("text"))
    if "n_chars" in columns:
        piece = piece.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return piece.select(*columns)
