"""The engine over HTTP, with the standard library's server: /health, /query, /upload, /create_index."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import batched
from typing import BinaryIO
from urllib.parse import parse_qs, urlparse

from basalt.plans.engine import Engine
from basalt.sources import files

#: Bytes of a body that are held at once, and of a form's field other than the file.
PIECE, MOST_FIELD = 1 << 16, 1 << 16


class Body:
    """A request's body, read line by line and never beyond its length. A line longer than `PIECE` comes in several."""

    def __init__(self, source: BinaryIO, length: int):
        self.source, self.left = source, length

    def line(self) -> bytes:
        line = self.source.readline(min(PIECE, self.left)) if self.left else b""
        self.left -= len(line)
        return line

    def pieces(self) -> Iterator[bytes]:
        while self.left:
            piece = self.source.read(min(PIECE, self.left))
            if not piece:
                return
            self.left -= len(piece)
            yield piece

    def rest(self) -> bytes:
        return b"".join(self.pieces())


def form_parts(body: Body, boundary: bytes) -> Iterator[tuple[str, str | None, Iterator[bytes]]]:
    """(name, file name, pieces) of the parts of a multipart form, one after another; a part's pieces are read before the next part."""
    mark = b"--" + boundary
    line = body.line()
    while line and not line.startswith(mark):
        line = body.line()
    while line and not line.startswith(mark + b"--"):
        head = b""
        while (line := body.line()).strip():
            head += line
        text = head.decode("utf-8", "replace")
        name, file_name = (re.search(rf'[;\s]{key}="([^"]*)"', text) for key in ("name", "filename"))
        ended = [b""]

        def pieces(ended: list[bytes] = ended) -> Iterator[bytes]:
            held, start = b"", True  # the line end before a boundary is not part of the content
            while line := body.line():
                if start and line.startswith(mark):
                    ended[0] = line
                    return
                start = line.endswith(b"\n")
                end = 2 if line.endswith(b"\r\n") else 1 if start else 0
                yield held + line[: len(line) - end]
                held = line[len(line) - end :]

        content = pieces()
        yield name[1] if name else "", file_name[1] if file_name else None, content
        for _ in content:
            pass
        line = ended[0]


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, body: dict, status: int = 200) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def stream(self, pieces: Iterator[str]) -> None:
            """A body of unknown length, which ends with the connection (HTTP/1.0)."""
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            for some in batched(pieces, 1000):
                self.wfile.write("".join(some).encode())

        def do_GET(self) -> None:
            found = urlparse(self.path).path == "/health"
            self.reply({"status": "ok", "message": "running"} if found else {"error": "not found"}, 200 if found else 404)

        def do_POST(self) -> None:
            url = urlparse(self.path)
            body = Body(self.rfile, int(self.headers.get("Content-Length") or 0))
            try:
                if url.path == "/query":
                    self.stream(engine.answer_pieces(json.loads(body.rest())["query"]))
                elif url.path == "/create_index":
                    given = json.loads(body.rest())
                    self.reply(engine.answer(f"CREATE INDEX {given['index_type']} ON {given['table_name']} ({given['column']})"))
                elif url.path == "/upload":
                    self.upload(body, parse_qs(url.query).get("table_name", ["uploaded_table"])[0])
                else:
                    self.reply({"error": "not found"}, 404)
            except ConnectionError:
                pass  # the caller has gone
            except Exception as problem:
                self.reply({"ok": False, "error": str(problem).split("\n")[0], "detail": str(problem)}, 500)

        def upload(self, body: Body, table: str) -> None:
            """A form with a part `file` and perhaps one `table_name`, or a body that is the file itself. The file goes to the tables'
            own file system piece by piece, where executors can read it; its name never becomes a path."""
            path, file_name = f"{engine.store.root}/_uploads/{uuid.uuid4().hex}.csv", None
            form = re.match(r'multipart/form-data;.*boundary="?([^";]+)"?', self.headers.get("Content-Type") or "")
            try:
                if form:
                    for name, given, pieces in form_parts(body, form[1].encode()):
                        if name == "file":
                            file_name = given
                            files.write_stream(engine.spark, path, pieces)
                        elif name == "table_name":
                            table = b"".join(pieces)[:MOST_FIELD].decode()
                else:
                    files.write_stream(engine.spark, path, body.pieces())
                if engine.store.has(table):
                    self.reply({"ok": False, "error": f"table exists: {table}"}, 400)
                    return
                self.reply(engine.upload(path, table, file_name=file_name))
            finally:
                files.remove(engine.spark, path)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; call `serve_forever`."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(engine))
