"""Recordings read by ranges, and takes as keyed state."""

import datetime as dt
import io
import wave

import numpy as np
import pytest

from parlance.functions import signals
from parlance.runtime import ship_package
from parlance.sources import writers
from parlance.streaming import source, takes


def wav(samples, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((samples * 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


class Watched:
    """A store whose files tell which ranges are read."""

    def __init__(self, store, ranges):
        self.store, self.ranges = store, ranges

    def __getattr__(self, name):
        return getattr(self.store, name)

    def open_input_file(self, path):
        file, ranges = self.store.open_input_file(path), self.ranges

        class File:
            def read_at(self, count, at):
                ranges.append((at, count))
                return file.read_at(count, at)

            def __enter__(self):
                return self

            def __exit__(self, *args):
                file.close()

        return File()


@pytest.mark.parametrize("rate,channels", [(16_000, 1), (8000, 2), (24_000, 1)])
def test_a_read_touches_its_range_only(tmp_path, monkeypatch, rate, channels):
    sound = 0.5 * np.sin(np.arange(10 * rate) * 700 / rate)
    (tmp_path / "a.wav").write_bytes(wav(sound, rate, channels))
    ranges, real = [], source.located
    monkeypatch.setattr(source, "located", lambda path: (Watched(real(path)[0], ranges), real(path)[1]))
    reader = source.RecordingReader({"path": str(tmp_path), "seconds": "1", "chunks_per_task": "2"})
    end = reader.latestOffset()
    assert end == {str(tmp_path / "a.wav"): 10} and sum(n for _, n in ranges) < 200  # headers alone
    parts = reader.partitions({str(tmp_path / "a.wav"): 3}, end)
    assert [(p.lo, p.hi) for p in parts] == [(3, 5), (5, 7), (7, 9), (9, 10)]
    ranges.clear()
    got = list(reader.read(parts[1]))
    frame, margin = 2 * channels, 0.05 * rate
    assert all(44 + frame * (5 * rate - margin) <= at and at + n <= 44 + frame * (7 * rate + margin) for at, n in ranges)
    whole = signals.decode_wav(wav(sound, rate, channels))
    assert [(k, len(x)) for _, k, _, x in got] == [(5, 16_000), (6, 16_000)]
    assert np.allclose(np.concatenate([x for *_, x in got]), whole[5 * 16_000 : 7 * 16_000], atol=2e-3)


def test_a_recording_that_grows(tmp_path):
    whole = wav(np.zeros(40_000), 16_000)
    reader = source.RecordingReader({"path": str(tmp_path / "r.wav"), "seconds": "1"})
    assert reader.latestOffset() == {}
    for size, chunks in ((20, None), (44 + 2 * 15_000, 0), (44 + 2 * 33_000, 2), (len(whole), 3)):
        (tmp_path / "r.wav").write_bytes(whole[:size])
        assert reader.latestOffset() == ({} if chunks is None else {str(tmp_path / "r.wav"): chunks})


def test_several_recordings_at_once(spark, tmp_path):
    ship_package(spark)
    sounds = {f"r{k}.wav": np.random.default_rng(k).uniform(-0.5, 0.5, 16_000 * (k + 1) + 500) for k in range(3)}
    for name, x in sounds.items():
        (tmp_path / name).write_bytes(writers.wav_bytes(x))
    source.register(spark)
    stream = spark.readStream.format("recording").option("path", str(tmp_path)).option("seconds", "1").option("chunks_per_task", "1").load()
    query = stream.writeStream.format("memory").queryName("several").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("several").orderBy("recording", "chunk").collect()
    for name, x in sounds.items():
        own = [r for r in rows if r.recording.endswith(name)]
        assert [r.chunk for r in own] == list(range(len(x) // 16_000 + 1))
        assert np.allclose(np.concatenate([r.samples for r in own]), x, atol=1e-3)


def test_passes_of_a_take():
    """First pass from three seconds of talk on, then each 1.5; stale takes give nothing; a limit ends a take."""
    held, shown = takes.advance(None, [(1, 0, 2000), (1, 900, 900)])
    assert shown == [] and held.talk == 2900
    held, shown = takes.advance(held, [(1, 1000, 200)])
    assert shown == [(1, 1, 3, 3100, False)]
    held, shown = takes.advance(held, [(1, 2000, 1000)])
    assert shown == []
    held, shown = takes.advance(held, [(1, 3000, 600), (0, 3100, 9000)])
    assert shown == [(1, 2, 5, 4700, False)]
    held, shown = takes.advance(held, [(2, 4000, 5000), (1, 4100, 9000)])
    assert shown == [(2, 1, 1, 5000, False)] and held.take == 2
    held, shown = takes.advance(held, [(1, 5000, 9000)])
    assert shown == [] and held.take == 2
    held, shown = takes.advance(held, [(2, 5000, 100), (2, 99_000, 100)], most=60_000)
    assert shown == [(2, 2, 2, 5100, True)] and held.ended
    assert takes.advance(held, [(2, 5200, 9000)], most=60_000)[1] == []


def test_takes_in_a_stream(spark, tmp_path):
    """A restarted query goes on; a silence ends a take with a final pass, and then no state is left of it."""
    from pyspark.sql import functions as F

    ship_package(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    takes.use_state_store(spark)
    schema = "device string, take long, at timestamp, talk_ms long"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [("a", 1, at(0), 4000), ("b", 7, at(1), 1000)],
        [("a", 1, at(4), 2000), ("b", 7, at(5), 2500), ("a", 0, at(5), 9000)],
        [("c", 1, at(60), 100)],  # the clock goes on: a and b are over
        [("d", 1, at(200), 100)],
    ]
    out, progress = [], []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 second")
        query = takes.take_results(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True)
        query = query.foreachBatch(lambda df, _: out.extend((k, *r) for r in df.collect())).start()  # noqa: B023
        query.awaitTermination(120)
        progress.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert (0, "a", 1, 1, 1, 4000, False) in out
    assert (1, "a", 1, 2, 2, 6000, False) in out and (1, "b", 7, 1, 2, 3500, False) in out
    assert {r[1:] for r in out if r[-1]} >= {("a", 1, 3, 2, 6000, True), ("b", 7, 2, 2, 3500, True), ("c", 1, 1, 1, 100, True)}
    assert not any(r[2] == 0 for r in out) and sum(r[-1] for r in out) == 3
    assert progress[-1] < max(progress[:2])  # only what is on
