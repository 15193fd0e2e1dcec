"""The JSON interface as one function from request to answer, and a small HTTP server around it."""

from __future__ import annotations

import hmac
import json
import logging
import re
import time
from datetime import date, datetime
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, Row

from lakeleaf.operators.context import Request
from lakeleaf.operators.search import Options, Result
from lakeleaf.plans.store import Conflict, NotFound, Store, SyncInProgress
from lakeleaf.plans.sync import sync_source
from lakeleaf.sources import web

log = logging.getLogger(__name__)
#: Settings of sources that may stand beside config_json in a request.
TEXT_SETTINGS = (
    "branch path cache include exclude url_prefix identity_file password passphrase known_hosts base_url page_id space_key token username api_token max_pages max_depth bearer_token cookie headers_json"
).split()
FLAG_SETTINGS = ("include_children", "strict_host_key", "is_spa")
SOURCE_FIELDS = ("kind", "name", "dsn", "product_hint", "module_hint", "sync_schedule")


def plain(value: Any) -> Any:
    """Rows, frames and times as JSON values."""
    if isinstance(value, DataFrame):
        return [plain(r) for r in value.collect()]
    if isinstance(value, Row):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.strftime("%Y-%m-%d %H:%M:%S") if isinstance(value, (datetime, date)) else value


def search_answer(result: Result) -> dict[str, Any]:
    hits = [] if result.hits is None else plain(result.hits.orderBy("place"))
    return {"query": result.query, "searches_used": result.searches_used, "attempts": result.attempts, "hits": hits}


def merged_config(existing: str, settings: dict[str, Any], clear: bool) -> str:
    """config_json with the settings that a request gives: blank texts delete theirs if ``clear``, flags are always set."""
    try:
        value = json.loads(existing or "{}")
    except ValueError:
        value = {}
    for key in TEXT_SETTINGS:
        if key in settings:
            text = str(settings[key] if settings[key] is not None else "").strip()
            if text:
                value[key] = text
            elif clear:
                value.pop(key, None)
    value.update({key: bool(settings[key]) for key in FLAG_SETTINGS if settings.get(key) is not None})
    return json.dumps(value, sort_keys=True)


def whole(query: dict[str, str], key: str, fallback: int, zero: bool = False) -> int:
    raw = query.get(key, "").strip()
    if not raw:
        return fallback
    if not raw.isdigit():
        raise ValueError(f"invalid {'non-negative' if zero else 'positive'} integer {raw!r}")
    return int(raw) if zero else int(raw) or fallback


class Api:
    def __init__(self, store: Store, auth: dict[str, str] | None = None, transport: web.Transport = web.http_get):
        self.store, self.auth, self.transport = store, auth or {"mode": "none"}, transport
        s, i = store, r"([^/]+)"
        self.routes = [
            ("GET", "/api/health", lambda q, b: {"status": "ok"}),
            ("GET", "/api/status", lambda q, b: s.status()),
            ("POST", "/api/search", self.search),
            ("POST", "/api/context", self.context),
            ("GET", "/api/sources", lambda q, b: {"sources": plain(s.sources())}),
            ("POST", "/api/sources", self.create_source),
            ("PUT", f"/api/sources/{i}", self.update_source),
            ("DELETE", f"/api/sources/{i}", lambda q, b, x: s.delete_source(x) or {"deleted": x}),
            ("POST", f"/api/sources/{i}/sync", self.sync),
            ("GET", f"/api/sources/{i}/jobs", lambda q, b, x: {"jobs": plain(s.jobs(x, whole(q, "limit", 20)))}),
            ("DELETE", f"/api/sources/{i}/jobs/{i}", lambda q, b, x, y: s.delete_job(x, y) or {"deleted": y}),
            ("GET", f"/api/sources/{i}/artifacts", lambda q, b, x: plain(s.artifacts(x, whole(q, "limit", 50), whole(q, "offset", 0, True), (q.get("after_title", ""), q["after_id"]) if q.get("after_id") else None))),
            ("GET", f"/api/documents/{i}/profile", lambda q, b, x: plain(s.profile(x))),
            ("PUT", f"/api/documents/{i}/profile", lambda q, b, x: plain(s.put_profile(x, str(b.get("desc") or ""), b.get("retrieval_profile_json")))),
            ("GET", "/api/nodes", lambda q, b: {"nodes": plain(s.search_nodes(q.get("q", q.get("query", "")), whole(q, "limit", 20)))}),
            ("GET", f"/api/nodes/{i}", lambda q, b, x: plain(s.node(x))),
            ("GET", f"/api/nodes/{i}/related", lambda q, b, x: {"related": plain(s.related(x, q.get("direction", ""), q.get("kind", ""), whole(q, "limit", 50)))}),
            ("POST", "/api/impact", self.impact),
            ("POST", "/api/feedback", lambda q, b: plain(s.add_feedback(b))),
            ("GET", "/api/feedback", lambda q, b: {"events": plain(s.feedback(q.get("target_kind", ""), q.get("target_id", ""), q.get("feedback_kind", ""), whole(q, "limit", 20)))}),
            ("DELETE", f"/api/feedback/{i}", lambda q, b, x: s.delete_feedback(x) or {"deleted": x}),
        ]

    def search(self, q: dict, b: dict) -> dict:
        if not str(b.get("query") or "").strip():
            raise ValueError("query is required")
        return search_answer(self.store.search(Options.preset(b["query"], int(b.get("limit") or 0))))

    def context(self, q: dict, b: dict) -> dict:
        return plain(self.store.context(Request(str(b.get("task") or ""), str(b.get("query") or ""), int(b.get("max_sections") or 0), int(b.get("max_chars") or 0))))

    def impact(self, q: dict, b: dict) -> dict:
        node = str(b.get("id") or b.get("node_id") or "").strip()
        if not node:
            raise ValueError("id is required")
        kinds = [k] if (k := str(b.get("kind") or "").strip()) else None
        return plain(self.store.impact_answer(node, str(b.get("direction") or ""), int(b.get("max_depth") or 0), kinds, int(b.get("limit") or 0)))

    def create_source(self, q: dict, b: dict) -> dict:
        row = {k: str(b.get(k) or "").strip() for k in SOURCE_FIELDS} | {"config_json": merged_config(b.get("config_json") or "", b, False)}
        return plain(self.store.put_source(row | {"kind": row["kind"] or "local"}))

    def update_source(self, q: dict, b: dict, source_id: str) -> dict:
        old = self.store.source(source_id)
        row = {k: str(b[k] or "").strip() for k in SOURCE_FIELDS if k in b}
        return plain(self.store.update_source({"id": source_id} | row | {"config_json": merged_config(b.get("config_json") or old["config_json"], b, True)}))

    def sync(self, q: dict, b: dict, source_id: str) -> dict:
        return plain(sync_source(self.store, source_id, self.transport))

    def allowed(self, path: str, headers: dict[str, str]) -> bool:
        if self.auth.get("mode") != "token" or path == "/api/health":
            return True
        low = {k.lower(): v.strip() for k, v in headers.items()}
        bearer = low.get("authorization", "")
        got = low.get("x-api-token") or (bearer[7:].strip() if bearer.lower().startswith("bearer ") else "")
        return bool(got and self.auth.get("token")) and hmac.compare_digest(got.encode(), self.auth["token"].encode())

    def handle(self, method: str, target: str, body: bytes = b"", headers: dict[str, str] | None = None) -> tuple[int, Any]:
        """Status and JSON value of the answer."""
        u, began = urlsplit(target), time.time()
        try:
            if not self.allowed(u.path, headers or {}):
                return failure(401, "authentication required")
            query = {k: v[-1] for k, v in parse_qs(u.query, keep_blank_values=True).items()}
            for verb, pattern, run in self.routes:
                if verb == method and (m := re.fullmatch(pattern, u.path)):
                    try:
                        value = json.loads(body) if body.strip() else {}
                    except ValueError as e:
                        return failure(400, f"invalid JSON body: {e}")
                    return 201 if (method, u.path) == ("POST", "/api/sources") else 200, run(query, value, *map(unquote, m.groups()))
            return failure(404, "no such route")
        except NotFound as e:
            return failure(404, str(e))
        except (SyncInProgress, Conflict) as e:
            return failure(409, str(e))
        except ValueError as e:
            return failure(400, str(e))
        except Exception as e:
            log.exception("request failed")
            return failure(500, str(e))
        finally:
            log.info("request %s %s %.3f s", method, u.path, time.time() - began)


def failure(status: int, message: str) -> tuple[int, Any]:
    return status, {"error": {"code": HTTPStatus(status).phrase, "message": message}}


def server(api: Api, host: str, port: int, tools: Any = None) -> ThreadingHTTPServer:
    """An HTTP server; with ``tools`` (of ``lakeleaf.service.tools``) also their event stream under /mcp."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(size) if size else b""
            if tools is not None and self.path.startswith("/mcp/"):
                if api.allowed("/mcp", dict(self.headers)):
                    return tools.http(self, body)
                status, value = failure(401, "authentication required")
            else:
                status, value = api.handle(self.command, self.path, body, dict(self.headers))
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *args: Any) -> None:
            log.debug(*args)

    return ThreadingHTTPServer((host, port), Handler)
