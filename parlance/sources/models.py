"""The boundary to models: each is an object made once per partition, with deterministic stand-ins for tests.

Neural separation, voice, recognition and language models are not part of this
repository; anything with the same methods can take their place.
"""

from __future__ import annotations

import http.client
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import signals
from parlance.operators import diarize as dz, intervals as iv


class Recogniser(Protocol):
    def transcribe(self, batch: list[np.ndarray]) -> list[str]: ...


class Chat(Protocol):
    def complete(self, system: str, user: str, max_tokens: int, schema: dict | None = None) -> str: ...


#: Speech regions (start, end in seconds) of a recording: a trained detector of voice, or ``signals.energy_regions``.
Detector = Callable[[np.ndarray], list[tuple[float, float]]]
#: Fingerprints, one row per clip.
Embedder = Callable[[list[np.ndarray]], np.ndarray]
#: Two sources of a mixture.
Separator = Callable[[np.ndarray], np.ndarray]


def timbre_embedder(clips: list[np.ndarray]) -> np.ndarray:
    """The colour of each clip, in place of a trained voice model."""
    return np.stack([signals.timbre(x) for x in clips])


def outside_turns(found: DataFrame, keys: list[str]) -> DataFrame:
    """Turns of a diarizer from outside (keys, label, start, end): its labels are named by first appearance, its turns merged."""
    first = F.min("start").over(W.partitionBy(*keys, "label"))
    dense = F.dense_rank().over(W.partitionBy(*keys).orderBy("first", "label")) - 1
    named = found.withColumn("first", first).withColumn("dense", dense)
    return iv.merge_turns(
        named.select(*keys, dz.speaker_name(F.col("dense")).alias("speaker"), "start", "end"),
        keys,
    ).select(*keys, "speaker", "start", "end")


#: Separators by name; neural ones register themselves.
SEPARATORS: dict[str, Separator] = {"hpss": signals.hpss}
#: What counts as activity, and what a voice is told by: the switches between speech and music.
DETECTORS: dict[str, Detector] = {"energy": signals.energy_regions}
EMBEDDERS: dict[str, Embedder] = {"timbre": timbre_embedder}


def registered(kind: dict, name: str):
    """The part of a name."""
    if name not in kind:
        raise ValueError(f"unknown part {name}; known are {', '.join(sorted(kind))}")
    return kind[name]


def separator(name: str | None) -> Separator | None:
    """The separator of a name; none for none."""
    return None if name is None else registered(SEPARATORS, name)


class ModelError(RuntimeError):
    """A reply that cannot be used; the caller degrades."""


class ConnectionFailed(ModelError):
    """The server cannot be reached; the caller stops."""


class Refused(ModelError):
    """The server answered with an error status."""

    def __init__(self, detail: str, status: int | None = None) -> None:
        super().__init__(detail)
        self.status = status


class TooLong(Refused):
    """The prompt does not fit the model's context, or takes too long; smaller parts may do."""


@dataclass
class DurationRecogniser:
    """Stand-in: says how long a clip is."""

    def transcribe(self, batch: list[np.ndarray]) -> list[str]:
        return [f"{len(x) / signals.RATE:.2f}" for x in batch]


def transcribe(clips: list[np.ndarray], model: Recogniser, *, most: float = 30.0, least: float = 0.1, batch: int = 4) -> list[str]:
    """Texts of clips in order: too short ones are empty, long ones are cut, pieces go longest first in batches."""
    clips = [signals.clip(np.array(list(c)) if getattr(c, "dtype", None) == object else c) for c in clips]
    pieces = [
        (k, n, p) for k, clip in enumerate(clips) if len(clip) >= least * signals.RATE for n, p in enumerate(signals.split_at_quiet(clip, most))
    ]
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i][2]))
    said: dict[tuple[int, int], str] = {}
    for lo in range(0, len(order), batch):
        part = order[lo : lo + batch]
        for i, text in zip(part, model.transcribe([pieces[i][2] for i in part]), strict=True):
            said[pieces[i][:2]] = " ".join(text.split())
    return [" ".join(filter(None, (said[key] for key in sorted(said) if key[0] == k))) for k in range(len(clips))]


def recognised(units: DataFrame, make: Callable[[], Recogniser], samples: str = "samples", out: str = "text") -> DataFrame:
    """``units`` with the recognised text of a sample column; the model is made once per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.drop(columns=samples).assign(**{out: transcribe(list(frame[samples]), model)})

    kept = units.drop(out)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != samples)
    return kept.mapInPandas(run, f"{schema}, `{out}` string")


def ctc_text(ids: list[int], blank: int, vocabulary: list[str]) -> str:
    """Greedy decoding: repeats fall together, blanks go."""
    kept = [i for k, i in enumerate(ids) if i != blank and (k == 0 or i != ids[k - 1])]
    return " ".join("".join(vocabulary[i] for i in kept).replace("▁", " ").split())


def transducer_ids(frames: list, state, join: Callable, advance: Callable, blank: int, most: int = 10) -> list[int]:
    """Greedy decoding of a transducer: on each frame the best symbols until a blank, at most ``most`` of them.

    ``join(frame, state)`` scores the symbols, ``advance(state, symbol)`` is the
    state after one.
    """
    out: list[int] = []
    for frame in frames:
        for _ in range(most):
            symbol = int(np.argmax(join(frame, state)))
            if symbol == blank:
                break
            out.append(symbol)
            state = advance(state, symbol)
    return out


@dataclass
class ScriptedChat:
    """Stand-in: gives prepared replies in order, the last again and again."""

    replies: list
    calls: int = 0
    asked: list = field(default_factory=list)

    def complete(self, system: str, user: str, max_tokens: int, schema: dict | None = None) -> str:
        reply = self.replies[min(self.calls, len(self.replies) - 1)]
        self.calls += 1
        self.asked.append(user)
        if isinstance(reply, Exception):
            raise reply
        return reply if isinstance(reply, str) else json.dumps(reply, ensure_ascii=False)


@dataclass
class Usage:
    """What a client has used: calls, seconds, and tokens where the server counts them."""

    calls: int = 0
    seconds: float = 0.0
    prompt_tokens: int = 0
    completion_tokens: int = 0

    def add(self, seconds: float, counted: dict | None) -> None:
        self.calls += 1
        self.seconds = round(self.seconds + seconds, 3)
        for name in ("prompt_tokens", "completion_tokens"):
            setattr(self, name, getattr(self, name) + ((counted or {}).get(name) or 0))


# Words of a refusal that tell what the server minds.
_FORM = re.compile(r"response_format|schema|grammar", re.IGNORECASE)
_LENGTH = re.compile(r"context|too long|maximum.{0,20}tokens|n_ctx", re.IGNORECASE)

#: What a call comes to, the first that fits: a status range, or a kind of failure, words of the answer, and what follows.
#: ``plain`` is the same call without a schema, ``split`` may fit in smaller parts, ``stop`` is for the caller.
OUTCOMES: tuple[tuple[str, re.Pattern | None, str], ...] = (
    ("ok", None, "read"),
    ("status 503", None, "wait"),
    ("status", _LENGTH, "split"),
    ("status 400", _FORM, "plain"),
    ("status 422", _FORM, "plain"),
    ("status 500", _FORM, "plain"),
    ("status", None, "refuse"),
    ("late", None, "split"),
    ("lost", None, "stop"),
)
#: Errors that end a call, by what follows.
ENDS = {"split": TooLong, "plain": Refused, "refuse": Refused, "wait": ConnectionFailed, "stop": ConnectionFailed}


@dataclass(frozen=True)
class Seen:
    """One exchange: ``ok`` with a body, ``status N`` with one, ``late`` or ``lost``."""

    kind: str
    body: str = ""

    def follows(self) -> str:
        return next(then for kind, words, then in OUTCOMES if f"{self.kind} ".startswith(f"{kind} ") and (words is None or words.search(self.body)))

    def error(self) -> ModelError:
        told, status = f"{self.kind}: {self.body[:1000]}", self.kind.removeprefix("status ")
        kind = ENDS[self.follows()]
        return kind(told, int(status)) if issubclass(kind, Refused) and status.isdigit() else kind(told)


@dataclass
class HttpChat:
    """Client of a chat-completions server.

    Every exchange is classified by ``OUTCOMES``. Waits double and end with the
    ``tries``; a schema that was refused by name is left out for good once the
    same call without it has been answered.
    """

    url: str
    model: str
    timeout: float = 900
    use_schema: bool = True
    tries: int = 6
    pause: Callable[[float], None] = time.sleep
    usage: Usage = field(default_factory=Usage)

    def exchange(self, path: str, body: dict | None, timeout: float) -> Seen:
        data = None if body is None else json.dumps(body).encode()
        call = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(call, timeout=timeout) as reply:
                return Seen("ok", reply.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as error:
            return Seen(f"status {error.code}", error.read().decode("utf-8", "replace"))
        except (OSError, http.client.HTTPException) as error:
            late = isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError)
            return Seen("late" if late else "lost", str(error))

    def ping(self, wait: float = 120, every: float = 5) -> None:
        """Return once the server answers at all; one that is still loading gets ``wait`` seconds."""
        waits = [every] * max(1, int(wait / every))
        while (seen := self.exchange("/models", None, 10)).follows() == "wait" and waits:
            self.pause(waits.pop())
        if seen.follows() == "wait" or not seen.kind.startswith(("ok", "status")):
            raise ConnectionFailed(f"{seen.kind}: {seen.body[:1000]}")

    def complete(self, system: str, user: str, max_tokens: int, schema: dict | None = None) -> str:
        said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "temperature": 0, "seed": 0, "max_tokens": max_tokens, "messages": said}
        form = {"response_format": {"type": "json_object", "schema": schema}} if schema and self.use_schema else {}
        waits, dropped, began = [2.0**k for k in range(self.tries)], False, time.monotonic()
        while (then := (seen := self.exchange("/chat/completions", body | form, self.timeout)).follows()) != "read":
            if then == "wait" and waits:
                self.pause(waits.pop(0))
            elif then == "plain" and form:
                form, dropped, waits, began = {}, True, [2.0**k for k in range(self.tries)], time.monotonic()
            else:
                raise seen.error()
        text = self.content(seen.body, time.monotonic() - began)
        self.use_schema &= not dropped
        return text

    def content(self, body: str, seconds: float) -> str:
        """The text of a reply, whose use is counted; one that is cut off is none."""
        try:
            reply = json.loads(body)
        except ValueError as error:
            raise ModelError("a reply that is no JSON") from error
        try:
            first, used = reply["choices"][0], reply.get("usage")
            text, cut = first["message"]["content"], first.get("finish_reason") == "length"
        except (AttributeError, KeyError, IndexError, TypeError) as error:
            raise ModelError("a reply of unknown form") from error
        self.usage.add(seconds, used)
        if cut or not isinstance(text, str):
            raise ModelError("reply cut off at the token limit")
        return text.strip()


def json_object(text: str) -> dict:
    """The JSON object of a reply, inside code fences or stray words."""
    body = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", text.strip())
    m = re.search(r"(?s)\{.*\}", body)
    try:
        value = json.loads(m[0]) if m else None
    except json.JSONDecodeError as error:
        raise ModelError("not valid JSON") from error
    if not isinstance(value, dict):
        raise ModelError("no JSON object")
    return value


def ask_in_halves(lines: list[dict], ask: Callable[[list[dict]], dict]) -> list[tuple[list[dict], dict | None]]:
    """(lines, reply) pairs: a chunk without a usable reply is halved; a single line without one stands alone."""
    try:
        return [(lines, ask(lines))]
    except ConnectionFailed:
        raise
    except ModelError:
        if len(lines) == 1:
            return [(lines, None)]
        half = len(lines) // 2
        return ask_in_halves(lines[:half], ask) + ask_in_halves(lines[half:], ask)


def embedded(windows: DataFrame, embed: Callable[[list[np.ndarray]], np.ndarray], samples: str = "samples") -> DataFrame:
    """``windows`` with a fingerprint per window; values that are no numbers become 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns=samples).assign(emb=list(np.nan_to_num(embed(list(frame[samples])))))

    schema = ", ".join(f"`{c}` {t}" for c, t in windows.dtypes if c != samples)
    return windows.mapInPandas(run, f"{schema}, emb array<float>")


def first_that_works(*translators: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
    """A translator that asks one after the other; what none can do stays empty."""

    def translate(texts: list[str]) -> list[str]:
        for ask in translators:
            try:
                return ask(texts)
            except ModelError:
                continue
        return [""] * len(texts)

    return translate


def translated(lines: DataFrame, translate, keys: list[str], out: str = "english") -> DataFrame:
    """``lines`` with translations by a column function, each distinct (language, text) translated once."""
    once = lines.select(*keys).distinct().withColumn(out, translate(*(F.col(k) for k in keys)))
    return lines.drop(out).join(once, keys)
