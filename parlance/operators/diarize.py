"""From labelled windows to a timeline of speakers, per key and without a loop over frames.

Times are whole milliseconds; labels are small integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators import clustering as cl, intervals as iv


def frame_votes(windows: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """(keys, frame, label, w): triangular votes of windows (keys, label, start, end), strongest in a window's middle."""
    a = F.expr(f"start div {frame}")
    b = F.greatest(a + 1, F.expr(f"end div {frame}"))
    span = windows.select(*keys, "label", a.alias("a"), b.alias("b")).withColumn("frame", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    n = F.col("b") - F.col("a")
    slope = F.floor(1_000_000 * (1 - 0.9 * F.abs(2.0 * (F.col("frame") - F.col("a")) / F.greatest(F.lit(1), n - 1) - 1)))
    weight = F.when(n == 1, F.lit(100_000)).otherwise(slope).cast("long")
    return span.select(*keys, "frame", "label", weight.alias("w")).groupBy(*keys, "frame", "label").agg(F.sum("w").alias("w"))


def labelled_frames(windows: DataFrame, speech: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """(keys, frame, label): the label with most votes on each frame of ``speech``; frames without votes take the next label."""
    strongest = F.min(F.struct((-F.col("w")).alias("w"), F.col("label").alias("label")))
    winner = frame_votes(windows, keys, frame).groupBy(*keys, "frame").agg(strongest.alias("b")).select(
        *keys,
        "frame",
        F.col("b.label").alias("label"),
    )
    first, last = F.expr(f"start div {frame}"), F.expr(f"(end + {frame - 1}) div {frame} - 1")
    spoken = speech.select(*keys, F.explode(F.sequence(first, F.greatest(first, last))).alias("frame")).distinct()
    joined = spoken.join(winner, [*keys, "frame"], "left")
    return joined.select(*keys, "frame", iv.filled(joined, keys, "frame", "label").alias("label"))


def speaker_name(label: Column) -> Column:
    """Speaker_A to Speaker_Z, then by number."""
    return F.concat(F.lit("Speaker_"), F.when(label < 26, F.char(65 + label)).otherwise(label.cast("string")))


def turns_of_runs(runs: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """(keys, speaker, start, end) of runs of frames."""
    return runs.select(
        *keys,
        speaker_name(F.col("label")).alias("speaker"),
        (F.col("first") * frame).alias("start"),
        ((F.col("last") + 1) * frame).alias("end"),
    )


def assign(windows: DataFrame, speech: DataFrame, overlaps: DataFrame | None, keys: list[str], *, frame: int, least: int) -> DataFrame:
    """The timeline (keys, speaker, start, end) of clustered windows (keys, label, start, end).

    Frames of ``speech`` take the label with most votes, runs shorter than
    ``least`` frames go to their longer neighbour, and in every one of
    ``overlaps`` the nearest other speaker speaks, too.
    """
    frames = labelled_frames(windows, speech, keys, frame)
    turns = turns_of_runs(iv.smooth_runs(iv.run_lengths(frames, keys), keys, least), keys, frame)
    return turns if overlaps is None else iv.add_overlap_speakers(turns, overlaps, keys)


def main_speakers(turns: DataFrame, keys: list[str], count: int = 2) -> DataFrame:
    """(keys, rank, speaker, talk): the speakers with most time, of equals the one who spoke first."""
    per = turns.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk"), F.min("start").alias("since"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("talk"), "since", "speaker"))
    return per.withColumn("rank", rank.cast("long")).where(F.col("rank") <= count).select(*keys, "rank", "speaker", "talk")


def match_tracks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track, rank) of two separated tracks and two speakers from likeness rows (keys, track 0/1, rank 1/2, score).

    The better of both ways to name them; a tie keeps their order.
    """
    at = lambda t, r: F.sum(F.when((F.col("track") == t) & (F.col("rank") == r), F.col("score")))
    both = scores.groupBy(*keys).agg((at(0, 1) + at(1, 2)).alias("straight"), (at(0, 2) + at(1, 1)).alias("crossed"))
    second = F.when(F.col("crossed") > F.col("straight"), 1).otherwise(0)
    named = F.array(
        F.struct(F.lit(0).alias("track"), (1 + second).cast("long").alias("rank")),
        F.struct(F.lit(1).alias("track"), (2 - second).cast("long").alias("rank")),
    )
    return both.where("straight is not null and crossed is not null").select(*keys, F.inline(named))


def pick_voice(tracks: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, track): of both separated tracks the one most like the unit's speaker and least like the other.

    ``tracks`` has (keys, unit, track, emb, speaker, other) with unit vectors,
    ``centroids`` (keys, speaker, centroid). Without another speaker, or without
    a centroid of theirs, only the likeness to the speaker counts.
    """
    like = lambda who, name: centroids.select(*keys, F.col("speaker").alias(who), F.col("centroid").alias(name))
    joined = tracks.join(like("speaker", "own"), [*keys, "speaker"]).join(like("other", "theirs"), [*keys, "other"], "left")
    score = cl.dot(F.col("emb"), F.col("own")) - F.coalesce(cl.dot(F.col("emb"), F.col("theirs")), F.lit(0.0))
    best = F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("track")).alias("t")))
    return joined.groupBy(*keys, "unit").agg(best.alias("b")).select(*keys, "unit", (-F.col("b.t")).alias("track"), F.col("b.score").alias("score"))


def prune_leakage(frames: DataFrame, keys: list[str], ratio: int = 4) -> DataFrame:
    """Frames (keys, frame, stream, speaker, power) without leaks from one track into another.

    Of a speaker's simultaneous copies the loudest stays, then tracks quieter
    than another one by ``ratio`` in power (4: about 6 dB) go.
    """
    copies = W.partitionBy(*keys, "frame", "speaker").orderBy(F.desc("power"), "stream")
    own = frames.withColumn("r", F.row_number().over(copies)).where("r = 1").drop("r")
    together = W.partitionBy(*keys, "frame")
    ranked = own.withColumn("top", F.max(F.struct("power", "stream")).over(together))
    runner_up = F.max(F.when(F.col("stream") != F.col("top.stream"), F.col("power"))).over(together)
    rest = F.when(F.col("stream") == F.col("top.stream"), runner_up).otherwise(F.col("top.power"))
    return ranked.withColumn("rest", rest).where(F.col("rest").isNull() | (F.col("power") * ratio >= F.col("rest"))).select(
        *keys,
        "frame",
        "stream",
        "speaker",
        "power",
    )
