"""The session's routes over HTTP, on this machine only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from ..schema import EMBEDDING
from .session import BadRequest, VectorSession

PAGE = b"<!doctype html><title>vecspark</title><h1>vecspark</h1><p>POST a query to /api/search.</p>"


def handler(session: VectorSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | bytes) -> None:
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html" if isinstance(body, bytes) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, act) -> None:
            try:
                self._send(200, act())
            except Exception as e:  # every failure is an answer; its status says which
                self._send(getattr(e, "status", 500), {"error": str(e)})

        def do_GET(self) -> None:
            url = urlparse(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            routes = {"/": lambda: PAGE, "/health": session.health, "/api/stats": session.stats, "/api/load": lambda: session.load(query.get("path", ""))}
            self._answer(routes[url.path]) if url.path in routes else self._send(404, {"error": "no such route"})

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def act():
                body = json.loads(raw or b"{}")
                if self.path == "/api/upload":
                    rows = [(i, str(r["id"]), [float(x) for x in r["vector"]]) for i, r in enumerate(body.get("embeddings", []))]
                    if not rows:
                        raise BadRequest("no vectors")
                    return session.upload(session.spark.createDataFrame(rows, EMBEDDING))
                if self.path == "/api/search":
                    return session.search(body["query"], int(body.get("k", 10)))
                if self.path == "/api/index/build":
                    return session.build_index(int(body.get("shards", 0)) or None, int(body.get("m", 16)), int(body.get("ef_construction", 200)))
                return session.index_search(body["query"], int(body.get("k", 10)), int(body.get("ef", 50)))

            if self.path in ("/api/upload", "/api/search", "/api/index/build", "/api/index/search"):
                self._answer(act)
            else:
                self._send(404, {"error": "no such route"})

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(session: VectorSession, port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(session))
