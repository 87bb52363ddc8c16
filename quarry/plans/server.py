"""HTTP over lexical search and answers: GET /health, POST /search, POST /answer."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quarry.operators.answers import Generator, extractive_generator
from quarry.plans import index as plans


# What clients read in replies.
HEALTH = {"status": "ok", "service": "rag-api"}
BLANK_QUERY = "Query cannot be empty."
BAD_K = "Parameter 'k' must be a positive integer."


class Service:
    """Requests to status and body; the session and the open snapshot live as long as it does."""

    def __init__(self, spark, index_dir: str, make: Generator | None = None):
        self.spark, self.index_dir, self.make = spark, index_dir, make or extractive_generator()

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        if (method, path) == ("GET", "/health"):
            return 200, dict(HEALTH)
        if method != "POST" or path not in ("/search", "/answer"):
            return 404, {"detail": "Not Found"}
        query, k = (body or {}).get("query"), (body or {}).get("k", 5)
        if not isinstance(query, str) or not isinstance(k, int):
            return 422, {"detail": "query must be a string and k an integer"}
        if not query.strip():
            return 400, {"detail": BLANK_QUERY}
        if k <= 0:
            return 400, {"detail": BAD_K}
        try:
            plans.load(self.spark, self.index_dir)
        except FileNotFoundError as e:
            return 503, {"detail": str(e)}
        try:
            if path == "/search":
                return 200, {"query": query, "k": k, "results": plans.search(self.spark, query, k, self.index_dir)}
            found = plans.answer(self.spark, query, self.make, k, self.index_dir)
            return 200, {"query": query, "k": k, "answer": found["answer"], "sources": found["sources"]}
        except Exception as e:  # reported to the client
            return 500, {"detail": str(e)}


def server(spark, index_dir: str, host: str = "127.0.0.1", port: int = 8000, make: Generator | None = None) -> ThreadingHTTPServer:
    """A server bound to host and port (0: any free one), not yet serving."""
    service = Service(spark, index_dir, make)

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size)) if size else {}
                status, out = service.handle(method, self.path, body if isinstance(body, dict) else {})
            except ValueError:
                status, out = 422, {"detail": "malformed JSON"}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark, index_dir: str, host: str = "127.0.0.1", port: int = 8000, make: Generator | None = None) -> None:
    server(spark, index_dir, host, port, make).serve_forever()
