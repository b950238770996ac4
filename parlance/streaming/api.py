"""What a page reads of a live session, as JSON over HTTP: its state, the newest result, and a few actions."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.streaming import live


@dataclass
class Session:
    """A live session: the take that is on, the folder of its versioned result, and what the page may change."""

    spark: SparkSession
    path: str
    envelope: Callable[[], DataFrame] | None = None
    take: int = 1
    options: dict = field(default_factory=lambda: {"language": "hi", "people": None})
    recording: bool = False
    lock: threading.Lock = field(default_factory=threading.Lock)

    def version(self) -> int | None:
        """The newest version that was written; none before the first."""
        try:
            return self.spark.read.parquet(self.path).agg(F.max("version")).first()[0]
        except Exception as error:  # there is no table yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def state(self, take: int, offset: int) -> dict:
        """The state, with the envelope from ``offset`` on; a page of another take gets all of it."""
        offset = offset if take == self.take else 0
        bins = live.envelope_since(self.envelope(), offset).collect() if self.envelope else []
        return {
            "take": self.take,
            "recording": self.recording,
            **self.options,
            "result_version": self.version(),
            "env_from": bins[0]["bin"] if bins else 0,
            "env": [b["peak"] for b in bins],
        }

    def result(self) -> list[dict]:
        """The rows of the newest version: one small result, as the page shows it."""
        return [] if self.version() is None else [json.loads(x) for x in live.latest(self.spark, self.path).toJSON().collect()]

    def act(self, action: str, body: dict) -> bool:
        """Start, stop or reset a take, or set options; false for an action that is unknown."""
        with self.lock:
            if action == "start":
                self.take, self.recording = self.take + 1, True
            elif action == "stop":
                self.recording = False
            elif action == "reset":
                self.take, self.recording = self.take + 1, False
            elif action == "options":
                self.options |= {k: v for k, v in body.items() if k in self.options}
            else:
                return False
        return True


def server(session: Session, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine only; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path == "/api/state":
                    return self.say(200, session.state(int(asked.get("take", 0)), int(asked.get("env_from", 0))))
                if url.path == "/api/result":
                    return self.say(200, session.result())
            except ValueError as error:
                return self.say(400, {"error": str(error)})
            return self.say(404, {"error": "not found"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self.say(400, {"error": "no JSON"})
            known = self.path.startswith("/api/") and session.act(self.path.removeprefix("/api/"), body if isinstance(body, dict) else {})
            return self.say(200 if known else 404, {"take": session.take} if known else {"error": "not found"})

        def say(self, status: int, content: object) -> None:
            data = json.dumps(content, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
