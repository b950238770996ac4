"""The whole way from samples to lines, with stand-ins for the models."""

import numpy as np
import pytest

from parlance.functions import signals
from parlance.operators import diarize as dz, pipeline
from parlance.runtime import ship_package
from parlance.sources import models

RATE = signals.RATE


def voice(hz, seconds, seed=0):
    """A buzz with harmonics, which sounds like one speaker at each pitch."""
    t = np.arange(int(seconds * RATE)) / RATE
    buzz = sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, 8))
    return buzz + 0.05 * np.random.default_rng(seed).normal(size=len(t))


@pytest.fixture(scope="module")
def recordings(spark):
    low, high, rest = voice(110, 4), voice(700, 4), np.zeros(RATE)
    rows = [("ab", np.concatenate([low, rest, high, rest, low]).tolist()), ("b", np.concatenate([high, rest]).tolist())]
    ship_package(spark)
    return spark.createDataFrame(rows, "rec_id string, samples array<float>")


@pytest.fixture
def save(spark, tmp_path):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}")

    return write


def test_speakers_then_lines(recordings, save):
    result = pipeline.Pipeline(save, method="gmm").run(recordings, n_speakers=2)
    turns = sorted((r.start, r.end, r.speaker) for r in result.timeline.where("rec_id = 'ab'").collect())
    assert [s for *_, s in turns] == ["Speaker_A", "Speaker_B", "Speaker_A"]
    assert all(
        abs(a - b) <= 150 for (s, e, _), want in zip(
            turns,
            [(0, 4000), (5000, 9000), (10_000, 14_000)],
            strict=True,
        ) for a, b in zip((s, e), want, strict=True)
    )
    lines = result.lines.where("rec_id = 'ab'").orderBy("line_id").collect()
    assert [r.line_id for r in lines] == [1, 2, 3] and all(3.8 <= float(r.text) <= 4.2 for r in lines)
    assert set(result.seconds) == {"diarization", "asr"} and result.reports is None


def test_given_timeline_and_reports(spark, recordings, save):
    given = spark.createDataFrame(
        [("ab", 0, "S1", 0, 4000), ("ab", 0, "S2", 5000, 9000)],
        "rec_id string, stream int, speaker string, start long, end long",
    )
    result = pipeline.Pipeline(save, chat=lambda: models.ScriptedChat(["no JSON"])).run(recordings, timeline=given)
    assert [(r.speaker, r.text) for r in result.lines.orderBy("line_id").collect()] == [("S1", "4.00"), ("S2", "4.00")]
    report = result.reports.collect()
    assert len(report) == 1 and report[0].diagnostics.synthesis_failed and len(report[0].dialogue) == 2


def test_separation_first(recordings, save):
    both = lambda x: np.stack([x, 0.1 * x])
    result = pipeline.Pipeline(save, order="A", separator=both, method="gmm").run(recordings, n_speakers=2)
    assert {r.stream for r in result.timeline.collect()} == {0} and result.seconds["separation"] > 0
    with pytest.raises(ValueError, match="needs a separator"):
        pipeline.Pipeline(save, order="A")
    with pytest.raises(ValueError, match="A or B"):
        pipeline.Pipeline(save, order="C")


def test_separators_by_name():
    t = np.arange(2 * RATE) / RATE
    tone, clicks = np.sin(2 * np.pi * 440 * t), np.zeros(2 * RATE)
    clicks[::4000] = 3.0
    harmonic, percussive = models.separator("hpss")(tone + clicks)
    assert len(harmonic) == len(t) and np.corrcoef(harmonic, tone)[0, 1] > 0.95 and np.corrcoef(percussive, clicks)[0, 1] > 0.6
    assert models.separator(None) is None
    with pytest.raises(ValueError, match="unknown part x"):
        models.separator("x")


def test_tracks_are_named_by_likeness(spark):
    rows = [
        ("x", 0, 1, 0.2),
        ("x", 0, 2, 0.9),
        ("x", 1, 1, 0.8),
        ("x", 1, 2, 0.3),
        ("tie", 0, 1, 0.5),
        ("tie", 0, 2, 0.5),
        ("tie", 1, 1, 0.5),
        ("tie", 1, 2, 0.5),
        ("one", 0, 1, 0.5),
    ]
    got = dz.match_tracks(spark.createDataFrame(rows, "rec_id string, track int, rank long, score double"), ["rec_id"]).collect()
    assert sorted((r.rec_id, r.track, r["rank"]) for r in got) == [("tie", 0, 1), ("tie", 1, 2), ("x", 0, 2), ("x", 1, 1)]


def test_turns_from_outside_are_named_and_merged(spark):
    rows = [("r", "z", 0, 10), ("r", "a", 5, 20), ("r", "z", 10, 30), ("r", "a", 40, 50)]
    got = models.outside_turns(spark.createDataFrame(rows, "rec_id string, label string, start long, end long"), ["rec_id"]).collect()
    assert sorted((r.speaker, r.start, r.end) for r in got) == [("Speaker_A", 0, 30), ("Speaker_B", 5, 20), ("Speaker_B", 40, 50)]
