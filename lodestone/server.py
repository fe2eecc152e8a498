"""A session over HTTP: POST /query {"sql", "params"}, POST /insert/{collection}; GET /collections /views /schema /dump /cache.

Statements run one after another. An error in a statement comes back as `error`, with status 200. Rows are sent as they
come, a partition at a time, so a large result doesn't gather on the driver.
"""

from __future__ import annotations

import datetime
import json
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestone.session import Session


def plain(x: object) -> object:
    return x.isoformat() if isinstance(x, datetime.date) else str(x)


def answer(session: Session, method: str, path: str, body: str) -> Iterator[str]:
    """The JSON of an answer, in pieces. An error after the first row ends the answer with `error` beside the rows sent."""
    close = ""
    try:
        if method == "POST" and path == "/query":
            said = json.loads(body)
            result = session.execute(said["sql"], said.get("params") or ())
            if result.df is None:
                yield json.dumps({"rows_affected": result.rows_affected, "last_insert_id": result.last_insert_id})
                return
            rows = result.df.toLocalIterator()
            first = next(rows, None)  # errors show before anything is sent
            yield '{"docs": ['
            close = "]"
            if first is not None:
                yield json.dumps(first.asDict(True), default=plain)
                for r in rows:
                    yield "," + json.dumps(r.asDict(True), default=plain)
            yield "]}"
        elif method == "POST" and path.startswith("/insert/"):
            result = session.insert_json(path.removeprefix("/insert/"), body)
            yield json.dumps({"rows_affected": result.rows_affected, "last_insert_id": result.last_insert_id})
        elif method == "GET" and path in ("/collections", "/views", "/cache"):
            yield json.dumps({"/collections": session.collections, "/views": session.views, "/cache": session.cache_stats}[path]())
        elif method == "GET" and path == "/schema":
            yield json.dumps({c: session.schema(c) for c in session.collections()})
        elif method == "GET" and path == "/dump":
            yield '"'
            close = '"'
            for k, line in enumerate(session.dump()):
                yield json.dumps(("\n" if k else "") + line)[1:-1]
            yield '"'
        else:
            yield json.dumps({"error": f"no {method} {path}"})
    except Exception as error:  # noqa: BLE001
        said = str(error).splitlines()[0]
        yield {"": json.dumps({"error": said}), "]": f'], "error": {json.dumps(said)}}}', '"': json.dumps(f"\n-- error: {said}")[1:]}[close]


def serve(session: Session, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    one = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            with one:
                for piece in answer(session, self.command, self.path, body):
                    self.wfile.write(piece.encode())

        do_GET = do_POST = reply

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
