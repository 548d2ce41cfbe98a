"""Command line, TCP front and client of a log folder.

    python -m logweave.cli --root FOLDER put TOPIC TEXT
    python -m logweave.cli --root FOLDER get TOPIC
    python -m logweave.cli --root FOLDER serve --port 9091
    python -m logweave.cli connect --port 9091

The server speaks frames: a little-endian 32-bit length, then a line of text.
Without --root, the folder and more come from the environment.
"""

from __future__ import annotations

import argparse
import json
import socket
import socketserver
import sys
import threading
from collections.abc import Iterable, Iterator

from .engine import LogEngine
from .model import MAX_FRAME_BYTES, LogError, UnknownCommand, UnknownTopic

VERBS = ("REGISTER", "PUT", "GET", "STATE", "METRICS")


class Commands:
    """Lines in, response lines out."""

    def __init__(self, engine: LogEngine):
        self.engine, self.lock = engine, threading.Lock()

    def handle(self, line: str) -> str:
        verb, _, rest = line.rstrip().partition(" ")
        topic, given, payload = rest.partition(" ")
        with self.lock:
            try:
                return self._run(verb, topic, payload if given else None)
            except LogError as e:
                return f"ERR {e}"

    def _run(self, verb: str, topic: str, payload: str | None) -> str:
        if verb not in VERBS:
            raise UnknownCommand("unknown command")
        if verb == "METRICS":
            unread = {r.topic: r.unread for r in self.engine.unread().collect()}
            return "OK " + json.dumps({"topics": len(unread), "unread": unread}, sort_keys=True)
        if not topic:
            return f"ERR {verb} requires a topic"
        if verb == "REGISTER":
            self.engine.register(topic)
            return "OK"
        if topic not in self.engine.topics():
            return "ERR unknown topic"
        if verb == "PUT":
            if payload is None:
                return "ERR PUT requires a payload"
            self.engine.append(topic, payload.encode())
            return "OK"
        if verb == "GET":
            found = self.engine.read_next(topic)
            return "EMPTY" if found is None else "OK " + found.decode("utf-8", "replace")
        return "OK " + self.engine.state(topic)


def _frame(line: str) -> bytes:
    body = line.encode()
    return len(body).to_bytes(4, "little") + body


def serve(commands: Commands, port: int, host: str = "127.0.0.1") -> socketserver.ThreadingTCPServer:
    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            while len(head := self.rfile.read(4)) == 4:
                n = int.from_bytes(head, "little")
                if not 0 < n <= MAX_FRAME_BYTES:
                    answer = "ERR invalid frame length"
                else:
                    answer = commands.handle(self.rfile.read(n).decode("utf-8", "replace"))
                self.wfile.write(_frame(answer))

    class Server(socketserver.ThreadingTCPServer):
        daemon_threads, block_on_close, allow_reuse_address = True, False, True

    return Server((host, port), Handler)


class Client:
    """Speaks to a server; a refused command raises LogError."""

    def __init__(self, port: int, host: str = "127.0.0.1", timeout: float | None = None):
        self._socket = socket.create_connection((host, port), timeout)
        self._file = self._socket.makefile("rb")

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._file.close()
        self._socket.close()

    def ask(self, line: str) -> str:
        """The response line to one line."""
        self._socket.sendall(_frame(line))
        head = self._file.read(4)
        if len(head) < 4:
            raise LogError("connection closed")
        return self._file.read(int.from_bytes(head, "little")).decode()

    def _done(self, line: str) -> str | None:
        answer = self.ask(line)
        if answer.startswith("ERR "):
            message = answer[4:]
            raise (UnknownTopic if message == "unknown topic" else UnknownCommand if message == "unknown command" else LogError)(message)
        return None if answer == "EMPTY" else answer[3:]

    def register(self, topic: str) -> None:
        self._done(f"REGISTER {topic}")

    def put(self, topic: str, payload: str) -> None:
        self._done(f"PUT {topic} {payload}")

    def get(self, topic: str) -> str | None:
        return self._done(f"GET {topic}")

    def state(self, topic: str) -> dict:
        return json.loads(self._done(f"STATE {topic}") or "{}")

    def metrics(self) -> dict:
        return json.loads(self._done("METRICS") or "{}")


def converse(client: Client, lines: Iterable[str]) -> Iterator[str]:
    """Responses to typed lines, verbs in any case, until `quit` or `exit`."""
    for line in lines:
        verb, gap, rest = line.strip().partition(" ")
        if verb.lower() in ("quit", "exit"):
            return
        if verb:
            yield client.ask(verb.upper() + gap + rest)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logweave")
    parser.add_argument("--root")
    parser.add_argument("--namespace")
    parser.add_argument("command", choices=["register", "put", "get", "state", "metrics", "serve", "connect"])
    parser.add_argument("topic", nargs="?", default="")
    parser.add_argument("payload", nargs="*")
    parser.add_argument("--port", type=int, default=9091)
    parser.add_argument("--host", default="127.0.0.1")
    a = parser.parse_args(args)
    if a.command == "connect":
        with Client(a.port, a.host) as client:
            for answer in converse(client, sys.stdin):
                print(answer)
        return 0
    from pyspark.sql import SparkSession

    options = {k: v for k, v in (("root", a.root), ("namespace", a.namespace)) if v}
    commands = Commands(LogEngine.from_environment(SparkSession.builder.getOrCreate(), **options))
    if a.command == "serve":
        with serve(commands, a.port, a.host) as server:
            server.serve_forever()
        return 0
    if a.command == "put" and a.topic:
        commands.engine.register(a.topic)
    answer = commands.handle(" ".join([a.command.upper(), a.topic, *a.payload]))
    print(answer)
    return int(answer.startswith("ERR"))


if __name__ == "__main__":
    raise SystemExit(main())
