"""Who said what and when: from recordings to speakers, lines and reports, with models as exchangeable parts.

Order B finds the speakers first and separates only what overlaps; order A
separates whole recordings and finds the speakers over both tracks. A recording
is one row (its samples) and one task's work where models look at it; all steps
between are DataFrame operators over windows, frames, turns and lines.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import signals
from parlance.operators import clustering as cl, diarize as dz, intervals as iv, reports
from parlance.sources import models

KEY = ["rec_id"]
FRAME = 50  # milliseconds of a frame of the timeline
Save = Callable[[DataFrame, str], DataFrame]


def analyse(
    recordings: DataFrame,
    embed: models.Embedder,
    detect: models.Detector,
    *,
    window: int = 1500,
    hop: int = 750,
    least: int = 400,
) -> tuple[DataFrame, DataFrame]:
    """(speech, windows): regions (rec_id, stream, start, end) and windows (.., win_idx, emb) of recordings (rec_id, stream, samples)."""

    def regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (r.rec_id, r.stream, round(1000 * a), round(1000 * b)) for r in frame.itertuples() for a, b in detect(np.asarray(r.samples, float))
            ]
            yield pd.DataFrame(rows, columns=["rec_id", "stream", "start", "end"])

    speech = recordings.mapInPandas(regions, "rec_id string, stream int, start long, end long")
    spans = iv.sliding_windows(speech, ["rec_id", "stream"], window, hop, least).groupBy("rec_id", "stream").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )

    def fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = lambda ms: int(ms * signals.RATE / 1000)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                samples = np.asarray(r.samples, float)
                emb = np.nan_to_num(embed([samples[at(s["start"]) : at(s["end"])] for s in r.spans]))
                rows += [(r.rec_id, r.stream, s["start"], s["end"], e.astype(float).tolist()) for s, e in zip(r.spans, emb, strict=True)]
            yield pd.DataFrame(rows, columns=["rec_id", "stream", "start", "end", "emb"])

    windows = recordings.join(spans, ["rec_id", "stream"]).mapInPandas(
        fingerprints,
        "rec_id string, stream int, start long, end long, emb array<double>",
    )
    # Windows of all tracks are numbered together: speakers are clustered over the whole recording.
    return speech, windows.withColumn("win_idx", F.col("start") * 2 + F.col("stream"))


def frame_power(tracks: DataFrame) -> DataFrame:
    """(rec_id, stream, frame, power): the mean power of every frame of a track."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FRAME * signals.RATE // 1000
        for frame in frames:
            parts = [(r, np.asarray(r.samples, float)) for r in frame.itertuples()]
            power = [(r, (x[: len(x) // size * size].reshape(-1, size) ** 2).mean(1)) for r, x in parts]
            yield pd.concat(
                [pd.DataFrame({"rec_id": r.rec_id, "stream": r.stream, "frame": np.arange(len(p)), "power": p}) for r, p in power] or [
                    pd.DataFrame(columns=["rec_id", "stream", "frame", "power"])
                ]
            )

    return tracks.mapInPandas(run, "rec_id string, stream int, frame long, power double")


def separated(recordings: DataFrame, separator: models.Separator) -> DataFrame:
    """(rec_id, stream, samples): both tracks of every recording."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (
                    r.rec_id,
                    k,
                    track.astype(np.float32).tolist(),
                ) for r in frame.itertuples() for k, track in enumerate(separator(np.asarray(r.samples, float)))
            ]
            yield pd.DataFrame(rows, columns=["rec_id", "stream", "samples"])

    return recordings.mapInPandas(run, "rec_id string, stream int, samples array<float>")


def spoken(turns: DataFrame, tracks: DataFrame, make: Callable[[], models.Recogniser]) -> DataFrame:
    """(rec_id, line_id, speaker, start, end, text) of turns (rec_id, stream, speaker, start, end): lines are numbered by start, times are seconds."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "speaker")))
    units = turns.groupBy("rec_id", "stream").agg(ordered.alias("turns")).join(tracks, ["rec_id", "stream"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        at = lambda ms: int(ms * signals.RATE / 1000)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                samples = np.asarray(r.samples, np.float32)
                texts = models.transcribe([samples[at(t["start"]) : at(t["end"])] for t in r.turns], model)
                rows += [(r.rec_id, t["speaker"], t["start"] / 1000, t["end"] / 1000, text) for t, text in zip(r.turns, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["rec_id", "speaker", "start", "end", "text"])

    said = units.mapInPandas(run, "rec_id string, speaker string, start double, end double, text string")
    per = said.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "text"))).alias("lines"))
    return per.select("rec_id", F.posexplode("lines").alias("pos", "l")).select(
        "rec_id",
        (F.col("pos") + 1).cast("long").alias("line_id"),
        "l.speaker",
        "l.start",
        "l.end",
        "l.text",
    )


@dataclass
class Result:
    """The tables of a run, written once each, and the seconds that each stage took."""

    speech: DataFrame
    windows: DataFrame
    timeline: DataFrame
    lines: DataFrame
    reports: DataFrame | None
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class Pipeline:
    """The parts of a run; every one can be exchanged, a stand-in included."""

    save: Save
    recogniser: Callable[[], models.Recogniser] = models.DurationRecogniser
    embed: models.Embedder = models.timbre_embedder
    detect: models.Detector = signals.energy_regions
    separator: models.Separator | None = None
    chat: Callable[[], models.Chat] | None = None
    order: str = "B"
    method: str = "spectral"
    language: str = "hi"
    least: int = 6  # frames that a turn must last

    @classmethod
    def of(cls, save: Save, *, activity: str = "energy", fingerprint: str = "timbre", separator: str | None = None, **parts) -> Pipeline:
        """A pipeline from the names of registered parts."""
        return cls(
            save,
            detect=models.registered(models.DETECTORS, activity),
            embed=models.registered(models.EMBEDDERS, fingerprint),
            separator=models.separator(separator),
            **parts,
        )

    def __post_init__(self) -> None:
        if self.order not in ("A", "B"):
            raise ValueError("the order is A or B")
        if self.order == "A" and self.separator is None:
            raise ValueError("order A needs a separator")

    def run(self, recordings: DataFrame, n_speakers: int | None = None, timeline: DataFrame | None = None) -> Result:
        """From recordings (rec_id, samples), or from a given timeline, to lines and reports."""
        seconds: dict[str, float] = {}

        def stage(name: str, make: Callable[[], DataFrame], table: str) -> DataFrame:
            began = time.monotonic()
            out = self.save(make(), table)
            seconds[name] = round(seconds.get(name, 0.0) + time.monotonic() - began, 3)
            return out

        if self.order == "A":
            tracks = stage("separation", lambda: separated(recordings, self.separator), "tracks")
        else:
            tracks = recordings.select("rec_id", F.lit(0).alias("stream"), "samples")
        speech, windows = analyse(tracks, self.embed, self.detect)
        speech, windows = stage("diarization", lambda: speech, "speech"), stage("diarization", lambda: windows, "windows")
        if timeline is None:
            timeline = self._timeline(speech, windows, tracks, n_speakers)
        timeline = stage("diarization", lambda: timeline, "timeline")
        lines = stage("asr", lambda: spoken(timeline, tracks, self.recogniser), "lines")
        made = None
        if self.chat:
            made = stage("llm", lambda: reports.build_reports(lines, self.chat, self.save, key="rec_id", language=self.language), "reports")
        return Result(speech, windows, timeline, lines, made, seconds)

    def _timeline(self, speech: DataFrame, windows: DataFrame, tracks: DataFrame, n_speakers: int | None) -> DataFrame:
        clusters = cl.cluster_windows(windows, KEY, method=self.method, n_speakers=n_speakers)
        own = ["rec_id", "stream"]
        labelled = windows.join(clusters, [*KEY, "win_idx"]).select(*own, F.col("cluster").alias("label"), "start", "end")
        frames = dz.labelled_frames(labelled, speech, own, FRAME)
        if self.order == "A":  # what leaks from one track into the other is not said there
            powered = frames.join(frame_power(tracks), [*own, "frame"]).withColumnRenamed("label", "speaker")
            frames = dz.prune_leakage(powered, KEY).withColumnRenamed("speaker", "label")
        runs = iv.smooth_runs(iv.run_lengths(frames, own), own, self.least)
        return dz.turns_of_runs(runs, own, FRAME).select("rec_id", "stream", "speaker", "start", "end")
