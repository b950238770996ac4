"""Seeded plans of test conversations."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import signals
from parlance.operators.ranking import global_row_number

# Overlap probability by level, and the soundscapes.
LEVELS = {"ovl-none": 0.0, "ovl-low": 0.3, "ovl-high": 0.7}
NOISES = ("clean", "village10", "market5")


def paired_design(spark: SparkSession, groups: int, split: str = "test") -> DataFrame:
    """Every group in every overlap level and soundscape, so that conditions are paired by group."""
    speakers = F.when(F.col("grp") % 2 == 0, 2).otherwise(3)
    base = spark.range(groups).select(F.col("id").alias("grp")).withColumn("n_speakers", speakers)
    crossed = base.withColumn("overlap_level", F.explode(F.array(*(F.lit(x) for x in LEVELS)))).withColumn(
        "noise",
        F.explode(F.array(*(F.lit(x) for x in NOISES))),
    )
    return crossed.withColumn("id", F.format_string("%s_g%02d_%dspk_%s_%s", F.lit(split), "grp", "n_speakers", "overlap_level", "noise"))


def tuning_settings(spark: SparkSession, choices: dict[str, list]) -> DataFrame:
    """Every combination of settings but those that cannot matter: order A without overlap awareness."""
    out = spark.range(1).select(*(F.explode(F.array(*(F.lit(v) for v in values))).alias(name) for name, values in list(choices.items())[:1]))
    for name, values in list(choices.items())[1:]:
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out.where(~((F.col("order") == "A") & ~F.col("overlap_aware")))


def without_tuning(df: DataFrame, group: str, wanted: list[int] | None = None, tuning: int = 7) -> DataFrame:
    """Rows of the wanted groups, or of all but the tuning one, which nobody may ask for."""
    if wanted is not None and tuning in wanted:
        raise ValueError(f"group {tuning} was tuned on and cannot be evaluated")
    return df.where((F.col(group) != tuning) if wanted is None else F.col(group).isin(wanted))


def refreshed_references(tracks: DataFrame, top_db: float = 40.0) -> DataFrame:
    """(rec_id, speaker, start, end): what each stored track (rec_id, speaker, samples) says, found anew by its energy."""

    def run(frames):
        for frame in frames:
            rows = [(r.rec_id, r.speaker, a, b) for r in frame.itertuples() for a, b in signals.energy_regions(np.asarray(r.samples, float), top_db)]
            yield pd.DataFrame(rows, columns=["rec_id", "speaker", "start", "end"])

    return tracks.select("rec_id", "speaker", "samples").mapInPandas(run, "rec_id string, speaker string, start double, end double")


def music_design(recordings: DataFrame, per_raga: int = 2) -> DataFrame:
    """(raga, place, singer, recording, amount): for each raga pieces by different singers, each in three amounts of accompaniment."""
    first = recordings.groupBy("raga", "singer").agg(F.min("recording").alias("recording"))
    place = F.row_number().over(W.partitionBy("raga").orderBy(F.md5(F.concat_ws("/", "raga", "singer").cast("binary")), "singer"))
    chosen = first.withColumn("place", place.cast("long")).where(F.col("place") <= per_raga)
    return chosen.select("raga", "place", "singer", "recording", F.explode(F.array(*(F.lit(x) for x in ("solo", "some", "full")))).alias("amount"))


def plan_turns(n_speakers: int, overlap: float, target: float, seed: int) -> pd.DataFrame:
    """Turns of one conversation: overlaps of at most half of either turn, and never three speakers at once."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, float, float]] = []
    ends, last = [0.0, 0.0], None
    while ends[-1] < target:
        speaker = f"S{rng.choice([k for k in range(n_speakers) if k != last])}"
        last = int(speaker[1:])
        length = float(rng.uniform(1.0, 6.0))
        start = ends[-1] + float(rng.uniform(0.15, 0.8))
        if rows and rng.random() < overlap:
            shared = min(float(rng.uniform(0.5, 2.0)), (rows[-1][2] - rows[-1][1]) / 2, length / 2)
            start = max(ends[-1] - shared, ends[-2] + 0.05)
        rows.append((speaker, round(start, 3), round(start + length, 3)))
        ends = sorted([ends[-1], start + length])
    return pd.DataFrame(rows, columns=["speaker", "start", "end"])


def simulate(design: DataFrame, target: float = 60.0) -> DataFrame:
    """(id, speaker, start, end) of every conversation of a design."""
    levels = dict(LEVELS)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        seed = int.from_bytes(hashlib.blake2b(str(r["id"]).encode(), digest_size=8).digest(), "little")
        return plan_turns(int(r["n_speakers"]), levels[r["overlap_level"]], target, seed).assign(id=r["id"])[["id", "speaker", "start", "end"]]

    return design.groupBy("id").applyInPandas(one, "id string, speaker string, start double, end double")


def render(
    plan: pd.DataFrame,
    clips: dict[str, np.ndarray],
    *,
    noise: np.ndarray | None = None,
    snr_db: float = 10.0,
    peak: float = 0.9,
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(mixture, sources) of planned turns (speaker, start, end), whose speech is taken from each speaker's clip in order.

    Every turn has the same active level and short fades; noise lies ``snr_db``
    below the speech, and one gain brings the mixture to its peak, so that the
    sources still add up to it.
    """
    size = int(round(plan["end"].max() * signals.RATE)) if len(plan) else 0
    sources = {s: np.zeros(size) for s in sorted(plan["speaker"].unique())}
    used = dict.fromkeys(sources, 0)
    for turn in plan.sort_values("start").itertuples():
        lo, hi = (int(round(t * signals.RATE)) for t in (turn.start, turn.end))
        clip = np.take(clips[turn.speaker], np.arange(used[turn.speaker], used[turn.speaker] + hi - lo), mode="wrap")
        used[turn.speaker] += hi - lo
        fade = np.minimum(1, np.minimum(np.arange(hi - lo), np.arange(hi - lo)[::-1]) / (0.01 * signals.RATE))
        sources[turn.speaker][lo:hi] += 0.05 * clip / max(signals.active_rms(clip), 1e-9) * fade
    mix = sum(sources.values(), np.zeros(size))
    if noise is not None and size:
        mix = mix + signals.scale_to_snr(mix, np.take(noise, np.arange(size), mode="wrap"), snr_db)
    mix, gain = signals.peak_normalised(mix, peak)
    return mix, {s: x * gain for s, x in sources.items()}


def pick_groups(sides: DataFrame, key: str, person: str, size: int = 2) -> DataFrame:
    """Groups of alternately ``size`` and ``size + 1`` different persons of each key, in order, none used twice.

    Places come from global numbers, so a key with very many persons is not one
    task's work; the last group of a key stays out unless it is full.
    """
    people = global_row_number(sides.select(key, person).distinct(), [F.col(key), F.col(person)], "_r")
    per = people.groupBy(key).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    placed = people.join(per, key).withColumn("_p", F.col("_r") - F.col("_first"))
    pair = 2 * size + 1
    late = (F.col("_p") % pair >= size).cast("int")
    grouped = placed.withColumn("grp", (2 * F.floor(F.col("_p") / pair) + late).cast("int"))
    end = F.floor(F.col("grp") / 2) * pair + F.when(F.col("grp") % 2 == 0, size).otherwise(pair)
    return grouped.where(end <= F.col("_n")).select(key, "grp", person)


def plan_duo(
    cycles: list[list[float]],
    target: float,
    seed: int,
    *,
    accompanied: float = 0.3,
    partial: float = 0.5,
    interlude: float = 0.8,
) -> pd.DataFrame:
    """(part, start, end, source_start) of a piece for voice and drum.

    ``cycles`` holds nine beat times each: eight beats and the next cycle's
    first. The voice sings one or two cycles at a time; the drum accompanies
    some phrases, wholly or in their last beats, and fills pauses alone.
    """
    rng, rows = np.random.default_rng(seed), []
    at, now = int(rng.integers(max(1, len(cycles) - 12))), float(rng.uniform(0.3, 0.8))
    while now < target and at < len(cycles):
        phrase = cycles[at : at + int(rng.integers(1, 3))]
        at += len(phrase) + int(rng.integers(0, 3))
        first, last = phrase[0][0], phrase[-1][-1]
        shift = now - first
        rows.append(("voice", now, last + shift, first))
        beats = [b + shift for c in phrase for b in c[:8]] + [last + shift]
        if rng.random() < accompanied:
            own = beats[-int(rng.integers(3, 6)) :] if rng.random() < partial else beats
            rows.append(("drum", own[0], own[-1], None))
        now = last + shift
        if rng.random() < interlude and now < target:
            beat = (last - first) / (8 * len(phrase))
            end = now + 0.05 + beat * int(rng.integers(2, 5))
            rows.append(("drum", now + 0.05, end, None))
            now = end
        now += float(rng.uniform(0.2, 0.8))
    return pd.DataFrame(rows, columns=["part", "start", "end", "source_start"]).sort_values("start", ignore_index=True)
