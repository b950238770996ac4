"""Interval algebra over rows with a start and an end, per key.

Every operator is declarative: windows and joins on the keys, so that all steps
share one partitioning by key. Ties are broken by the ``order`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], gap: float = 0, order: str | None = None, inclusive: bool = True) -> DataFrame:
    """``df`` with an ``island`` number: rows whose start is within ``gap`` of what came before share one."""
    by = W.partitionBy(*keys).orderBy("start", "end", *([order] if order else []))
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)) + F.lit(gap)
    joins = F.col("start") <= reach if inclusive else F.col("start") < reach
    return df.withColumn("_fresh", F.when(joins, 0).otherwise(1)).withColumn(
        "island",
        F.sum("_fresh").over(by.rowsBetween(W.unboundedPreceding, 0)),
    ).drop("_fresh")


def merge_turns(turns: DataFrame, keys: list[str], gap: float = 0, order: str | None = None) -> DataFrame:
    """Turns of one speaker that touch or lie within ``gap`` become one; the first stream is kept."""
    own = [*keys, "speaker"]
    extra = [F.min_by("stream", F.struct("start", "end", *([order] if order else []))).alias("stream")] if "stream" in turns.columns else []
    return islands(turns, own, gap, order).groupBy(*own, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("n"),
        *extra,
    ).drop("island")


def regions_of(df: DataFrame, keys: list[str], gap: float = 0, order: str | None = None) -> DataFrame:
    """The union of intervals per key: maximal covered stretches, bridging gaps up to ``gap``."""
    return islands(df, keys, gap, order).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def concurrency(df: DataFrame, keys: list[str], order: str, least: int = 2) -> DataFrame:
    """Maximal spans of positive length with at least ``least`` intervals active; an end at t precedes a start at t."""
    starts = df.select(*keys, F.col("start").alias("t"), F.lit(1).alias("delta"), order)
    ends = df.select(*keys, F.col("end").alias("t"), F.lit(-1).alias("delta"), order)
    by = W.partitionBy(*keys).orderBy("t", "delta", order)
    active = starts.unionByName(ends).withColumn("active", F.sum("delta").over(by.rowsBetween(W.unboundedPreceding, 0)))
    crossing = active.where((F.col("active") >= least) != (F.col("active") - F.col("delta") >= least))
    paired = crossing.withColumn("end", F.lead("t").over(by))
    return paired.where((F.col("active") >= least) & (F.col("end") > F.col("t"))).select(*keys, F.col("t").alias("start"), "end")


def slices(df: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Elementary slices (keys, start, end, and how many intervals of each kind are active).

    ``df`` has one 0/1 column per name in ``counts`` saying of which kinds an interval is.
    """
    marks = df.select(*keys, F.col("start").alias("t"), *(F.col(c) for c in counts)).unionByName(
        df.select(*keys, F.col("end").alias("t"), *((-F.col(c)).alias(c) for c in counts))
    )
    net = marks.groupBy(*keys, "t").agg(*(F.sum(c).alias(c) for c in counts))
    by = W.partitionBy(*keys).orderBy("t")
    run = by.rowsBetween(W.unboundedPreceding, 0)
    out = net.select(*keys, F.col("t").alias("start"), F.lead("t").over(by).alias("end"), *(F.sum(c).over(run).alias(c) for c in counts))
    return out.where("end is not null")


def complement(df: DataFrame, keys: list[str], duration: float, pad: float = 0) -> DataFrame:
    """Gaps between padded intervals inside [0, duration]; keys without intervals do not appear."""
    padded = df.select(
        *keys,
        F.greatest(F.lit(0), F.col("start") - pad).cast("long").alias("start"),
        F.least(F.lit(duration), F.col("end") + pad).cast("long").alias("end"),
    )
    whole = padded.select(*keys).distinct().withColumn("start", F.lit(duration).cast("long")).withColumn("end", F.lit(duration).cast("long"))
    by = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    return padded.unionByName(whole).withColumn("reach", F.coalesce(F.max("end").over(by), F.lit(0).cast("long"))).where("start > reach").select(
        *keys,
        F.col("reach").alias("start"),
        F.col("start").alias("end"),
    )


def intersecting(a: DataFrame, b: DataFrame, keys: list[str], cell: int, parts: int = 0) -> DataFrame:
    """Pairs (columns of ``a`` and of ``b`` with suffixes _a and _b) that share time, strictly on both sides.

    Both sides are spread over time cells of length ``cell``, so the join is an
    equi-join on keys and cell even for very long recordings; each pair is kept
    once, in the cell where the later of its two starts lies. With ``parts`` the
    cells are dealt over so many partitions, not over as few as their bytes fill.
    """

    def spread(df: DataFrame, tag: str) -> DataFrame:
        renamed = df.select(*keys, *(F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in keys)).where(f"end_{tag} > start_{tag}")
        cells = renamed.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"start_{tag}") / cell), F.floor((F.col(f"end_{tag}") - 1) / cell))))
        return cells.repartition(parts, *keys, "cell") if parts else cells

    joined = spread(a, "a").join(spread(b, "b"), [*keys, "cell"])
    own = F.floor(F.greatest("start_a", "start_b") / cell) == F.col("cell")
    return joined.where((F.col("start_a") < F.col("end_b")) & (F.col("end_a") > F.col("start_b")) & own).drop("cell")


def sharing(a: DataFrame, b: DataFrame, keys: list[str], cell: int, least: int, parts: int = 0) -> DataFrame:
    """Pairs as ``intersecting`` gives them, of intervals in whole units that have at least ``least`` in common, and that as ``shared``.

    They are those that still intersect when all ends come ``least - 1`` sooner,
    so what is too short for any pair is not spread. The pairs have these ends.
    """
    early = lambda df: df.withColumn("end", F.col("end") - (least - 1))
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b") + (least - 1)
    return intersecting(early(a), early(b), keys, cell, parts).withColumn("shared", shared)


def filled(df: DataFrame, keys: list[str], order: str, column: str) -> Column:
    """The next known value of ``column`` from a row on, at the end the last one before.

    Both ways are running windows: one that grows towards the start of a
    descending order is linear, one that shrinks towards the end would be
    computed anew for every row.
    """
    later = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(column, ignorenulls=True).over(later), F.last(column, ignorenulls=True).over(earlier))


def nearest_inactive(regions: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, busy, speaker, double_distance): the speaker who is not active in a region and whose turn is nearest to its middle.

    ``turns`` (keys, speaker, start, end) are disjoint for each speaker, so the
    last turn that starts before a region ends says whether the speaker is
    active, and else is the nearest before; the next turn is the nearest after.
    That is one window per speaker over turns and regions. Distances are doubled
    to stay whole; ties go to the earlier turn, then to the lesser name.
    ``busy`` says whether anybody is active; regions without an inactive speaker
    do not appear.
    """
    who = turns.select(*keys, "speaker").distinct()
    probes = regions.select(*keys, "start", "end").join(who, keys).select(
        *keys,
        "speaker",
        F.col("end").alias("at"),
        F.lit(0).alias("kind"),
        F.col("start").alias("r0"),
        F.col("end").alias("r1"),
        F.lit(None).cast(turns.select(F.struct("start", "end")).schema[0].dataType).alias("turn"),
    )
    said = turns.select(
        *keys,
        "speaker",
        F.col("start").alias("at"),
        F.lit(1).alias("kind"),
        *(F.lit(None).cast(regions.schema[c].dataType).alias(r) for c, r in (("start", "r0"), ("end", "r1"))),
        F.struct("start", "end").alias("turn"),
    )
    own = W.partitionBy(*keys, "speaker")
    running = W.unboundedPreceding, -1
    before = F.last("turn", ignorenulls=True).over(own.orderBy("at", "kind").rowsBetween(*running))
    after = F.last("turn", ignorenulls=True).over(own.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(*running))
    met = probes.unionByName(said).withColumn("before", before).withColumn("after", after).where("kind = 0")
    idle = F.col("before").isNull() | (F.col("before.end") <= F.col("r0"))
    middle = F.col("r0") + F.col("r1")
    reach = lambda t: F.when(
        t.isNotNull(),
        F.struct(
            F.least(F.abs(2 * t["start"] - middle), F.abs(2 * t["end"] - middle)).alias("distance"),
            t["start"].alias("start"),
            F.col("speaker").alias("speaker"),
        ),
    )
    best = F.min(F.when(idle, F.least(reach(F.col("before")), reach(F.col("after")))))
    return met.groupBy(*keys, "r0", "r1").agg(best.alias("b"), F.max(~idle).alias("busy")).where("b is not null").select(
        *keys,
        F.col("r0").alias("start"),
        F.col("r1").alias("end"),
        "busy",
        F.col("b.speaker").alias("speaker"),
        F.col("b.distance").alias("double_distance"),
    )


def add_overlap_speakers(turns: DataFrame, overlaps: DataFrame, keys: list[str]) -> DataFrame:
    """Turns with, in every overlap in which somebody is active, the nearest other speaker as a second one; touching turns are merged."""
    merged = merge_turns(turns.select(*keys, "speaker", "start", "end"), keys).select(*keys, "speaker", "start", "end")
    extra = nearest_inactive(overlaps.where(F.col("end") > F.col("start")), merged, keys).where("busy").select(*keys, "speaker", "start", "end")
    return merge_turns(merged.unionByName(extra), keys).select(*keys, "speaker", "start", "end")


def max_overlap_partner(turns: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """(keys, speaker, start, other): for each turn the other speaker whose turn shares most time with it, where any does."""
    pairs = intersecting(
        turns.select(*keys, "speaker", "start", "end"),
        turns.select(*keys, "speaker", "start", "end"),
        keys,
        cell,
    ).where("speaker_a <> speaker_b")
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    best = F.min(F.struct((-shared).alias("less"), F.col("start_b").alias("start"), F.col("speaker_b").alias("speaker")))
    return pairs.groupBy(*keys, F.col("speaker_a").alias("speaker"), F.col("start_a").alias("start")).agg(best.alias("b")).select(
        *keys,
        "speaker",
        "start",
        F.col("b.speaker").alias("other"),
        (-F.col("b.less")).alias("shared"),
    )


def sliding_windows(regions: DataFrame, keys: list[str], win: int, hop: int, least: int) -> DataFrame:
    """Windows over regions: regions below ``least`` give none, short ones one, long ones a train and a right-aligned last."""
    length = F.col("end") - F.col("start")
    regions = regions.where(length >= least)
    train = F.greatest(F.lit(0), F.ceil((length - win) / hop)).cast("int")
    heads = F.transform(
        F.sequence(F.lit(0), train),
        lambda i: F.when(i < train, F.struct((F.col("start") + i * hop).alias("start"), (F.col("start") + i * hop + win).alias("end"))).otherwise(
            F.struct(F.greatest(F.col("start"), F.col("end") - win).alias("start"), F.col("end").alias("end"))
        ),
    )
    return regions.select(*keys, F.explode(heads).alias("w")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Pieces of the intervals of ``a`` (unique per keys, speaker, start) outside all intervals of ``b`` (disjoint per key)."""
    own = [*keys, "speaker"]
    cut = intersecting(a.select(*own, "start", "end"), b, keys, cell).select(
        *keys,
        F.col("speaker_a").alias("speaker"),
        F.col("start_a").alias("start"),
        F.col("end_a").alias("end"),
        F.col("start_b").alias("lo"),
        F.col("end_b").alias("hi"),
    )
    tails = a.select(*own, "start", "end", F.col("end").alias("lo"), F.col("end").alias("hi"))
    by = W.partitionBy(*own, "start", "end").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    pieces = cut.unionByName(tails).withColumn("from", F.coalesce(F.max("hi").over(by), F.col("start")))
    return pieces.where("lo > from").select(*own, F.col("from").alias("start"), F.col("lo").alias("end"))


def run_lengths(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of equal labels over consecutive frames: (keys, first, last, label)."""
    by = W.partitionBy(*keys).orderBy("frame")
    fresh = F.when((F.lag("label").over(by) == F.col("label")) & (F.lag("frame").over(by) == F.col("frame") - 1), 0).otherwise(1)
    numbered = frames.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", "label").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("_run")


def smooth_runs(runs: DataFrame, keys: list[str], least: int, passes: int = 3) -> DataFrame:
    """Absorb runs shorter than ``least`` frames into the longer adjoining run (ties: the left one), up to ``passes`` times."""
    for _ in range(passes):
        by = W.partitionBy(*keys).orderBy("first")
        size = F.col("last") - F.col("first") + 1
        side = lambda f, near: F.when(near, f(F.struct(size.alias("size"), F.col("label").alias("label"))).over(by))
        left = side(F.lag, F.lag("last").over(by) == F.col("first") - 1)
        right = side(F.lead, F.lead("first").over(by) == F.col("last") + 1)
        taken = F.when(size >= least, F.col("label")).when(left.isNull() & right.isNull(), F.col("label")).when(
            right.isNull() | (left["size"] >= right["size"]),
            left["label"],
        ).otherwise(right["label"])
        runs = runs.withColumn("to", taken).drop("label").withColumnRenamed("to", "label")
        fresh = F.when((F.lag("label").over(by) == F.col("label")) & (F.lag("last").over(by) == F.col("first") - 1), 0).otherwise(1)
        runs = runs.withColumn("_fresh", fresh).withColumn(
            "_run",
            F.sum("_fresh").over(by.rowsBetween(W.unboundedPreceding, 0)),
        ).groupBy(*keys, "_run", "label").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return runs


def hysteresis(
    frames: DataFrame,
    keys: list[str],
    *,
    on: float,
    off: float,
    least_on: int = 1,
    least_off: int = 1,
    frame: str = "frame",
    score: str = "score",
) -> DataFrame:
    """(keys, start, end) of active stretches of frames (end exclusive), from scores with two thresholds.

    A stretch begins with a score of at least ``on`` and lasts until one below
    ``off``; in between, what was goes on. Pauses shorter than ``least_off`` frames
    are filled, then stretches shorter than ``least_on`` dropped. A missing frame
    ends a stretch, a null score changes nothing.
    """
    along = W.partitionBy(*keys).orderBy(frame)
    fresh = F.coalesce((F.col(frame) - F.lag(frame).over(along) > 1).cast("long"), F.lit(1))
    told = frames.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(along.rowsBetween(W.unboundedPreceding, 0)))
    here = W.partitionBy(*keys, "_part").orderBy(frame)
    decided = F.when(F.col(score) >= on, True).when(F.col(score) < off, False)
    active = told.withColumn("_on", F.coalesce(F.last(decided, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
    kept = active.where("_on").select(*keys, F.col(frame).alias("start"), (F.col(frame) + 1).alias("end"))
    return regions_of(kept, keys, least_off - 1).where(F.col("end") - F.col("start") >= least_on).select(*keys, "start", "end")
