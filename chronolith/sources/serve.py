"""Queries over HTTP and TCP, answered with JSON."""

from __future__ import annotations

import socketserver
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from chronolith.engine import Engine


def http(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """POST with the query as body, or GET with ``?query=``. Runs in threads of its own until ``shutdown``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            self.answer(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode())

        def do_GET(self) -> None:
            self.answer(parse_qs(urlparse(self.path).query).get("query", [""])[0])

        def answer(self, query: str) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            for part in engine.json_parts(query):
                self.wfile.write(part.encode())

        def log_message(self, *_) -> None:
            pass

    return started(ThreadingHTTPServer((host, port), Handler))


def tcp(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> socketserver.ThreadingTCPServer:
    """A query a line, an answer a line. An empty line ends the connection."""

    class Handler(socketserver.StreamRequestHandler):
        def queries(self) -> Iterator[str]:
            for line in self.rfile:
                if not line.strip():
                    return
                yield line.decode().strip()

        def handle(self) -> None:
            for q in self.queries():
                for part in engine.json_parts(q):
                    self.wfile.write(part.encode())
                self.wfile.write(b"\n")

    return started(socketserver.ThreadingTCPServer((host, port), Handler))


def started(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
