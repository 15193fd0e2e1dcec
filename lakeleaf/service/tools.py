"""Tools over JSON-RPC: one request per line on standard streams, or an event stream over HTTP."""

from __future__ import annotations

import json
import queue
import uuid
from collections.abc import Iterable
from typing import IO, Any
from urllib.parse import parse_qs, urlsplit

from lakeleaf.operators.context import Request
from lakeleaf.operators.search import Options
from lakeleaf.plans.store import Store
from lakeleaf.service.routes import plain, search_answer

PROTOCOL = "2024-11-05"
WAIT_S, SLOTS = 300, 32
#: Older names of tools.
ALIASES = {f"product_{x}": f"doc_{x}" for x in ("search", "context", "get_node", "related", "impact")}


def _number(text: str, low: int, high: int) -> dict[str, Any]:
    return {"type": "integer", "minimum": low, "maximum": high, "description": text}


def _text(text: str, *values: str) -> dict[str, Any]:
    return {"type": "string", "description": text} | ({"enum": list(values)} if values else {})


NODE, WAY = _text("Id of the node."), _text("Which edges to follow.", "out", "in", "both")
#: Name to (description, properties, required).
TOOLS = {
    "doc_search": ("Search sections. By default only ids, titles, paths and snippets come back; read sections by id, or ask for detail content.", {
        "query": _text("Words or a phrase."), "limit": _number("Former name of max_results.", 1, 200), "max_searches": _number("Search strategies to try; 3 by default.", 1, 5),
        "max_results": _number("Sections to return; 8 by default.", 1, 30), "max_sections_per_document": _number("Sections of one document; 2 by default.", 1, 5),
        "profile_detail": _text("How much of the match to explain, with detail content.", "none", "compact", "full"), "max_chars_per_result": _number("Bytes of a section, with detail content; 1000 by default.", 1000, 4000),
        "detail": _text("summary (default) or content.", "summary", "content")}, ["query"]),
    "doc_context": ("Sections for a task, cut to a budget.", {"task": _text("What is to be done."), "query": _text("Words to search; the task by default."), "max_sections": _number("8 by default.", 1, 20), "max_chars": _number("Bytes in all; 12000 by default.", 1, 20000)}, []),
    "doc_get_node": ("One node of the graph.", {"id": NODE}, ["id"]),
    "doc_related": ("Neighbours of a node.", {"id": NODE, "direction": WAY, "kind": _text("Kind of edge."), "limit": _number("50 by default.", 1, 100)}, ["id"]),
    "doc_impact": ("Paths that lead from a node.", {"id": NODE, "direction": WAY, "kind": _text("Kind of edge."), "max_depth": _number("2 by default.", 1, 5), "limit": _number("50 by default.", 1, 200)}, ["id"]),
    "doc_get_section": ("One section with its whole text.", {"id": _text("Id of the section.")}, ["id"]),
}


def clamp(value: Any, default: int, most: int) -> int:
    value = int(value or 0)
    return default if value <= 0 else min(value, most)


class Tools:
    def __init__(self, store: Store, version: str = "0.1.0"):
        self.store, self.version = store, version
        self.sessions: dict[str, queue.Queue[str]] = {}

    def call(self, name: str, a: dict[str, Any]) -> Any:
        name = ALIASES.get(name, name)
        word = lambda key: str(a.get(key) or "").strip()
        if name in ("doc_get_node", "doc_related", "doc_impact", "doc_get_section") and not word("id"):
            raise ValueError("id is required")
        if name == "doc_search":
            if not word("query"):
                raise ValueError("query is required")
            detail = word("detail") or "summary"
            brief = detail == "summary"
            return search_answer(self.store.search(Options(
                word("query"), clamp(a.get("max_results") or a.get("limit"), 8, 30), clamp(a.get("max_searches"), 3, 5), clamp(a.get("max_sections_per_document"), 2, 5),
                "none" if brief else word("profile_detail"), 0 if brief else clamp(a.get("max_chars_per_result"), 1000, 4000), detail,
            )))
        if name == "doc_context":
            return plain(self.store.context(Request(word("task"), word("query"), int(a.get("max_sections") or 0), int(a.get("max_chars") or 0))))
        if name == "doc_get_node":
            return plain(self.store.node(word("id")))
        if name == "doc_related":
            return {"related": plain(self.store.related(word("id"), word("direction"), word("kind"), int(a.get("limit") or 0)))}
        if name == "doc_impact":
            return plain(self.store.impact_answer(word("id"), word("direction"), int(a.get("max_depth") or 0), [word("kind")] if word("kind") else None, int(a.get("limit") or 0)))
        if name == "doc_get_section":
            return plain(self.store.section(word("id")))
        raise ValueError(f"unknown tool {name!r}")

    def respond(self, line: str) -> dict[str, Any] | None:
        """The answer to one request; none to a notification."""
        try:
            request = json.loads(line)
            method, number = request.get("method"), request.get("id")
        except (ValueError, AttributeError):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if number is None:
            return None
        answer = {"jsonrpc": "2.0", "id": number}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lakeleaf", "version": self.version}}}
        if method == "tools/list":
            return answer | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p} | ({"required": r} if r else {})} for n, (d, p, r) in TOOLS.items()]}}
        if method == "tools/call":
            try:
                params = request.get("params") or {}
                value = self.call(str(params.get("name") or ""), params.get("arguments") or {})
                return answer | {"result": {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}]}}
            except Exception as e:
                return answer | {"error": {"code": -32602, "message": str(e)}}
        return answer | {"error": {"code": -32601, "message": f"method not found: {method}"}}

    def serve(self, lines: Iterable[str], out: IO[str]) -> None:
        for line in lines:
            if line.strip() and (answer := self.respond(line)) is not None:
                print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)

    def http(self, handler: Any, body: bytes) -> None:
        """GET /mcp/sse opens a stream of answers; POST /mcp/message?session_id=... sends a request to it."""
        u = urlsplit(handler.path)
        if handler.command == "GET" and u.path == "/mcp/sse":
            session = uuid.uuid4().hex
            self.sessions[session] = answers = queue.Queue(SLOTS)
            handler.send_response(200)
            handler.send_header("Content-Type", "text/event-stream")
            handler.end_headers()
            try:
                handler.wfile.write(f"event: endpoint\ndata: /mcp/message?session_id={session}\n\n".encode())
                handler.wfile.flush()
                while True:
                    handler.wfile.write(f"event: message\ndata: {answers.get(timeout=WAIT_S)}\n\n".encode())
                    handler.wfile.flush()
            except (queue.Empty, OSError):
                return
            finally:
                del self.sessions[session]
        session = parse_qs(u.query).get("session_id", [""])[0]
        status = 404
        if handler.command == "POST" and u.path == "/mcp/message" and session in self.sessions:
            status, answer = 202, self.respond(body.decode(errors="replace"))
            if answer is not None:
                try:
                    self.sessions[session].put_nowait(json.dumps(answer, ensure_ascii=False))
                except queue.Full:
                    status = 503
        handler.send_response(status)
        handler.send_header("Content-Length", "0")
        handler.end_headers()
