"""Command line: ``python -m lakeleaf.service.cli``; answers are JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from typing import IO, Any

from pyspark.sql import SparkSession

import lakeleaf
from lakeleaf.operators.context import Request
from lakeleaf.operators.search import Options
from lakeleaf.plans.store import Store
from lakeleaf.plans.sync import sync_source
from lakeleaf.service import config as C
from lakeleaf.service.routes import FLAG_SETTINGS, TEXT_SETTINGS, Api, merged_config, plain, search_answer, server
from lakeleaf.service.tools import Tools

DEFAULT_FILE = "server:\n  host: 127.0.0.1\n  port: 8787\n  data_dir: .lakeleaf\nstorage:\n  dsn: .lakeleaf/store\nauth:\n  mode: none\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeleaf")
    p.add_argument("--config", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "init", "serve", "status", "mcp"):
        sub.add_parser(name)
    src = sub.add_parser("source").add_subparsers(dest="action", required=True)
    for action in ("add", "update"):
        a = src.add_parser(action)
        if action == "update":
            a.add_argument("id")
        for f in ("kind", "name", "dsn", "product-hint", "module-hint", "sync-schedule", "config-json", *(t.replace("_", "-") for t in TEXT_SETTINGS)):
            a.add_argument(f"--{f}")
        for f in FLAG_SETTINGS:
            a.add_argument(f"--{f.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=None)
    src.add_parser("list")
    for action in ("delete", "sync", "jobs"):
        a = src.add_parser(action)
        a.add_argument("id")
        a.add_argument("--limit", type=int, default=20)
    a = sub.add_parser("search")
    a.add_argument("query", nargs="+")
    a.add_argument("--limit", type=int, default=20)
    a = sub.add_parser("context")
    a.add_argument("task", nargs="*")
    a.add_argument("--query", default="")
    a.add_argument("--max-sections", type=int, default=0)
    a.add_argument("--max-chars", type=int, default=0)
    node = sub.add_parser("node").add_subparsers(dest="action", required=True)
    node.add_parser("get").add_argument("id")
    for a in (node.add_parser("related"), sub.add_parser("impact")):
        a.add_argument("id")
        a.add_argument("--direction", default="")
        a.add_argument("--kind", default="")
        a.add_argument("--limit", type=int, default=0)
        a.add_argument("--depth", type=int, default=0)
    fb = sub.add_parser("feedback").add_subparsers(dest="action", required=True)
    for action in ("add", "list"):
        a = fb.add_parser(action)
        for f in ("target-kind", "target-id", "feedback-kind", "payload-json", "actor"):
            a.add_argument(f"--{f}", default="")
        a.add_argument("--limit", type=int, default=20)
    return p


def _source(store: Store, a: argparse.Namespace) -> Any:
    if a.action == "list":
        return {"sources": plain(store.sources())}
    if a.action == "delete":
        return store.delete_source(a.id) or {"deleted": a.id}
    if a.action == "sync":
        return plain(sync_source(store, a.id))
    if a.action == "jobs":
        return {"jobs": plain(store.jobs(a.id, a.limit))}
    given = {k: v for k, v in vars(a).items() if v is not None}
    row = {k: given[k] for k in ("kind", "name", "dsn", "product_hint", "module_hint", "sync_schedule") if k in given}
    if a.action == "add":
        return plain(store.put_source({"kind": "local"} | row | {"config_json": merged_config(a.config_json or "", given, False)}))
    return plain(store.update_source({"id": a.id} | row | {"config_json": merged_config(a.config_json or store.source(a.id)["config_json"], given, True)}))


def run(store: Store, a: argparse.Namespace) -> Any:
    if a.command == "status":
        return store.status()
    if a.command == "source":
        return _source(store, a)
    if a.command == "search":
        return search_answer(store.search(Options.preset(" ".join(a.query), a.limit)))
    if a.command == "context":
        return plain(store.context(Request(" ".join(a.task), a.query, a.max_sections, a.max_chars)))
    if a.command == "node":
        return plain(store.node(a.id)) if a.action == "get" else {"related": plain(store.related(a.id, a.direction, a.kind, a.limit))}
    if a.command == "impact":
        return plain(store.impact_answer(a.id, a.direction, a.depth, [a.kind] if a.kind else None, a.limit))
    if a.action == "list":
        return {"events": plain(store.feedback(a.target_kind, a.target_id, a.feedback_kind, a.limit))}
    event = {"target_id": a.target_id, "feedback_kind": a.feedback_kind, "payload_json": a.payload_json, "actor": a.actor} | ({"target_kind": a.target_kind} if a.target_kind else {})
    return plain(store.add_feedback(event))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out: IO[str] | None = None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    show = lambda v: print(json.dumps(v, ensure_ascii=False, indent=2), file=out)
    if a.command == "version":
        show({"version": lakeleaf.__version__})
        return 0
    try:
        if a.command == "init":
            path = a.config or "lakeleaf.yaml"
            if not os.path.exists(path):
                with open(path, "w", encoding="utf-8") as f:
                    f.write(DEFAULT_FILE)
            C.load(path)
            show({"config": path})
            return 0
        settings = C.load(a.config)
        store = Store(spark or SparkSession.builder.appName("lakeleaf").getOrCreate(), settings.storage["dsn"])
        if a.command in ("mcp", "serve"):
            store.fail_interrupted()
        if a.command == "mcp":
            Tools(store).serve(sys.stdin, out)
        elif a.command == "serve":
            with server(Api(store, settings.auth), str(settings.server["host"]), int(settings.server["port"]), Tools(store)) as s:
                s.serve_forever()
        else:
            show(run(store, a))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
