"""Recordings as a live source: their samples arrive in chunks, as from microphones.

The driver lists the files and reads their headers; samples are read by tasks,
each the byte range of its own chunks and no more, so several recordings, and
parts of a long one, are read side by side.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from parlance.functions import signals


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(quote(path, safe="/:@")) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Head:
    """What a PCM file's header says; ``frames`` are those that are there, ``ended`` whether more may come."""

    rate: int
    channels: int
    width: int
    at: int
    frames: int
    ended: bool

    @property
    def frame(self) -> int:
        return self.channels * self.width


def head_of(source, size: int) -> Head | None:
    """The header of an open file, by the marks of its parts alone; None while it is not yet whole."""
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", source.read_at(8, at))
        if name == b"fmt ":
            if at + 24 > size:
                return None
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", source.read_at(16, at + 8))
            form = rate, channels, bits // 8
        elif name == b"data" and form:
            there = size - at - 8
            return Head(*form, at + 8, min(there, length) // (form[1] * form[2]), there >= length)
        at += 8 + length + length % 2
    return None


@dataclass
class Chunks(InputPartition):
    """Chunks ``lo`` to ``hi`` - 1 of one recording."""

    path: str
    head: Head
    lo: int
    hi: int


class RecordingReader(DataSourceStreamReader):
    """Chunks of ``seconds`` of the PCM file, or of all ``.wav`` files of the folder, at ``path``.

    An offset is the next chunk of each recording. A chunk counts once it is
    whole, the last one once the file is as long as its header says.
    ``chunks_per_task`` bounds what a task reads.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.seconds = options["path"], float(options.get("seconds", "1.5"))
        self.per_task = int(options.get("chunks_per_task", "64"))

    def _heads(self) -> Iterator[tuple[str, Head]]:
        store, root = located(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if "*" not in root else []
        for file in sorted((f for f in found if f.is_file and (f is info or f.path.endswith(".wav"))), key=lambda f: f.path):
            with store.open_input_file(file.path) as source:
                if head := head_of(source, file.size):
                    yield file.path, head

    def _size(self, head: Head) -> int:
        return max(1, round(self.seconds * head.rate))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        whole = lambda head: head.frames // self._size(head)
        return {path: -(-head.frames // self._size(head)) if head.ended else whole(head) for path, head in self._heads()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        heads = dict(self._heads())
        return [
            Chunks(path, heads[path], lo, min(to, lo + self.per_task))
            for path, to in sorted(end.items())
            for lo in range(start.get(path, 0), to, self.per_task)
        ]

    def read(self, partition: Chunks) -> Iterator[tuple]:
        head, size = partition.head, self._size(partition.head)
        g = math.gcd(head.rate, signals.RATE)
        up, down = signals.RATE // g, head.rate // g
        # What the filter of another rate reaches beyond a chunk, in whole steps of both rates.
        pad = 0 if up == down else down * math.ceil(10 * max(up, down) / up / down)
        store, _ = located(self.path)
        with store.open_input_file(partition.path) as source:
            for k in range(partition.lo, partition.hi):
                first, last = k * size, min(head.frames, (k + 1) * size)
                lo, hi = max(0, (first - pad) // down * down), min(head.frames, last + pad)
                raw = source.read_at((hi - lo) * head.frame, head.at + lo * head.frame)
                x = signals.resample(signals.pcm(raw, head.width, head.channels), head.rate, signals.RATE)
                skip = round(first * up / down) - lo * up // down
                part = x[skip : skip + round(last * up / down) - round(first * up / down)]
                yield partition.path, k, k * self.seconds, np.asarray(part, float).tolist()


class RecordingSource(DataSource):
    """``spark.readStream.format("recording").option("path", ...)``: recording, chunk, at (seconds) and samples."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "recording string, chunk long, at double, samples array<float>"

    def streamReader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)
