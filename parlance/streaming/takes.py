"""Live sessions as keyed state: one take per device, with passes, a limit, and state that goes when the take ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds: talk before the first pass, new talk before each further one, longest take, silence that ends one.
FIRST, REFRESH, MOST, IDLE = 3_000, 1_500, 600_000, 10_000

_STATE = "take bigint, begun bigint, last bigint, version int, turns bigint, talk bigint, shown bigint, ended boolean"
_OUT = "device string, take bigint, version int, turns bigint, talk_ms bigint, final boolean"


@dataclass
class Take:
    """What is kept of a device's current take."""

    take: int
    begun: int
    last: int
    version: int = 0
    turns: int = 0
    talk: int = 0
    shown: int = 0
    ended: bool = False

    def result(self, final: bool) -> tuple:
        self.version += 1
        self.shown = self.talk
        return self.take, self.version, self.turns, self.talk, final


def advance(held: Take | None, rows: list[tuple[int, int, int]], *, first: int = FIRST, refresh: int = REFRESH, most: int = MOST) -> tuple[Take | None, list[tuple]]:
    """The state after ``rows`` (take, time, talk in milliseconds) of a device, and the results to show.

    Rows of an older take are stale and give nothing; a newer take replaces the
    one that is held. Of the passes that a batch makes due, the last one alone
    is shown, as it replaces the others. A take that has lasted ``most`` ends with
    a final pass, and what still comes for it is dropped.
    """
    shown: list[tuple] = []
    due = False
    for take, at, talk in sorted(rows):
        if held is None or take > held.take:
            held, due = Take(take, at, at), False
        if take < held.take or held.ended:
            continue
        if at - held.begun > most:
            held.ended, due = True, False
            shown.append(held.result(True))
            continue
        held.turns, held.talk, held.last = held.turns + 1, held.talk + talk, max(held.last, at)
        due = held.talk >= first and held.talk - held.shown >= refresh
    if due:
        shown.append(held.result(False))
    return held, shown


class TakeProcessor(StatefulProcessor):
    """One value of state per device, and a timer that ends its take after a silence."""

    def __init__(self, first: int, refresh: int, most: int, idle: int) -> None:
        self.limits, self.idle = {"first": first, "refresh": refresh, "most": most}, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("take", _STATE)

    def _rows(self, key: tuple, shown: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in shown], columns=["device", "take", "version", "turns", "talk_ms", "final"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        kept = self.state.get()
        come = [(int(t), int(at.value // 1_000_000), int(ms)) for frame in rows for t, at, ms in zip(frame["take"], frame["at"], frame["talk_ms"], strict=True)]
        held, shown = advance(Take(*kept) if kept else None, come, **self.limits)
        if held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(held.last + self.idle)
            self.state.update(astuple(held))
        yield self._rows(key, shown)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        kept = self.state.get()
        held = Take(*kept) if kept else None
        self.state.clear()
        yield self._rows(key, [held.result(True)] if held and not held.ended else [])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def take_results(turns: DataFrame, *, first: int = FIRST, refresh: int = REFRESH, most: int = MOST, idle: int = IDLE) -> DataFrame:
    """(device, take, version, turns, talk_ms, final) of a stream (device, take, at, talk_ms) with a watermark on ``at``.

    Every row replaces those of lower version of its take. State is one row per
    device with a take that is on; it goes with the final pass, and a query that
    is started again with its checkpoint goes on with versions and sums.
    """
    grouped = turns.select("device", "take", "at", "talk_ms").groupBy("device")
    return grouped.transformWithStateInPandas(TakeProcessor(first, refresh, most, idle), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
