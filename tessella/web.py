"""A small JSON service over the stores, from the standard library: what a page for people would ask for."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from math import isfinite
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prompts
from .operators import reports, retrieve
from .sources import store

#: Rows of one answer of the service at most; more are asked for page by page.
MOST_ROWS = 1000


class Refused(Exception):
    """An answer of the service that is an error: its status and message."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def json_safe(value):
    """Values that JSON can carry: numbers that are none or infinite become null, at any depth."""
    if isinstance(value, float):
        return value if isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


class Service:
    """Tables behind the service: questions, profiles, records, usage and chunks.

    ``answer`` and ``ingest`` make something for one id (question or file) and return a row as a dict; they are called by POST.
    """

    def __init__(self, questions: DataFrame, profiles: DataFrame, records: Callable[[], DataFrame], usage: DataFrame, chunks: DataFrame, templates: str | None = None, answer=None, ingest=None):
        self.questions, self.profiles, self.records, self.usage, self.chunks = questions, profiles, records, usage, chunks
        self.folder, self.makers = templates, {"answer": answer, "ingest": ingest}
        self.templates = prompts.read_templates(templates) if templates else {}

    @staticmethod
    def rows(table: DataFrame) -> list[dict]:
        return [json_safe(r.asDict(recursive=True)) for r in table.limit(MOST_ROWS).collect()]

    def get(self, path: str, asked: dict[str, str]):
        if path == "/api/questions":
            return self.rows(reports.question_list(self.questions, self.profiles, self.records(), asked.get("type"), asked.get("status"), asked.get("q", "")).orderBy("question_id"))
        if path == "/api/cost":
            return self.rows(reports.usage_summary(self.usage))
        if path == "/api/vector/stats":
            return self.rows(reports.store_stats(self.chunks).orderBy("scope", F.desc("n"), "name"))
        if path == "/api/vector/chunks":
            page = store.browse(self.chunks.drop("vector"), asked.get("file"), _whole(asked, "limit", 20), _whole(asked, "offset", 0))
            return {"total": self.chunks.count(), "rows": self.rows(page)}
        if path == "/api/vector/search":
            words = [w for w in asked.get("q", "").split() if w]
            if not words:
                raise Refused(400, "nothing to search for")
            found = self.chunks.drop("vector").withColumn("met", retrieve.overlap(F.array(*map(F.lit, words)), F.array("chunk_text"))).where("met > 0")
            return self.rows(found.orderBy(F.desc("met"), "chunk_id").limit(max(1, min(20, _whole(asked, "k", 3)))))
        if path.startswith("/api/record/"):
            found = self.rows(self.records().where(F.col("question_id") == path.removeprefix("/api/record/")))
            if not found:
                raise Refused(404, "no record")
            return found[0]
        raise Refused(404, "no such path")

    def post(self, path: str, asked: dict[str, str]):
        if path == "/api/prompts/reload":
            self.templates = prompts.read_templates(self.folder) if self.folder else {}
            return {"templates": len(self.templates)}
        verb, _, key = path.removeprefix("/api/").partition("/")
        maker = self.makers.get(verb)
        if maker is None or not key:
            raise Refused(404, "no such path")
        if verb == "answer":
            if self.questions.where(F.col("question_id") == key).isEmpty():
                raise Refused(404, "no such question")
            held = self.records().where(F.col("question_id") == key)
            if asked.get("force") != "1" and not held.isEmpty():
                return self.rows(held)[0]
        return json_safe(maker(key))


def _whole(asked: dict[str, str], name: str, default: int) -> int:
    try:
        return int(asked.get(name, default))
    except ValueError:
        raise Refused(400, f"{name} is no number") from None


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, verb):
            at = urlparse(self.path)
            try:
                status, body = 200, verb(at.path, {k: v[-1] for k, v in parse_qs(at.query).items()})
            except Refused as e:
                status, body = e.status, {"error": str(e)}
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802  the server's name for it
            self._reply(service.get)

        def do_POST(self):  # noqa: N802
            self._reply(service.post)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
