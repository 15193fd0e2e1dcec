"""OpenAPI specifications (JSON or YAML): one section for each operation."""

from __future__ import annotations

import json
from typing import Any

from lakeleaf.sources.model import Document, Section, base_name, digest

METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "trace")


class Spec:
    """A specification with its local components."""

    def __init__(self, name: str, content: bytes):
        if name.lower().endswith((".yaml", ".yml")):
            import yaml

            try:
                root = yaml.safe_load(content)
            except yaml.YAMLError as e:
                raise ValueError(f"parse OpenAPI YAML: {e}") from e
        else:
            try:
                root = json.loads(content)
            except ValueError as e:
                raise ValueError(f"parse OpenAPI JSON: {e}") from e
        self.root: dict[str, Any] = root if isinstance(root, dict) else {}

    def component(self, kind: str, ref: str) -> tuple[str, dict] | None:
        """Name and value of a reference to a local component; an unknown one is empty."""
        start = f"#/components/{kind}/"
        name = ref[len(start) :].strip() if ref.startswith(start) else ""
        return (name, (self.root.get("components") or {}).get(kind, {}).get(name) or {}) if name else None

    def resolved(self, kind: str, value: dict) -> dict:
        found = self.component(kind, value.get("$ref") or "")
        return value if found is None else found[1] | {"$ref": value["$ref"]}

    def label(self, schema: dict | None) -> str:
        """A schema in a few words; a reference is followed once."""
        schema = schema or {}
        if ref := schema.get("$ref"):
            found = self.component("schemas", ref)
            if found is None:
                return ref.rsplit("/", 1)[-1]
            name, value = found
            return " ".join(x for x in (name, text(value, "type"), text(value, "description").strip()) if x)
        parts = [text(schema, "type"), text(schema, "format"), text(schema, "description").strip()]
        if schema.get("items") and (item := self.label(schema["items"])):
            parts.append(f"items {item}")
        return " ".join(p for p in parts if p)

    def contents(self, content: dict | None) -> list[str]:
        labels = [(media, self.label((content[media] or {}).get("schema"))) for media in sorted(content or {})]
        return [f"  content {media} schema: {label}" for media, label in labels if label]

    def parameter(self, value: dict) -> str:
        p = self.resolved("parameters", value)
        name = text(p, "name").strip() or (p.get("$ref") or "").rsplit("/", 1)[-1]
        line = f"- {name} in {text(p, 'in').strip() or 'unknown'}" + " required" * bool(p.get("required"))
        if label := self.label(p.get("schema")):
            line += f" schema: {label}"
        return line + (f" description: {text(p, 'description').strip()}" if p.get("description") else "")

    def operation(self, method: str, path: str, op: dict) -> str:
        lines = [f"{method} {path}"]
        if op.get("operationId"):
            lines.append(f"operationId: {op['operationId']}")
        if op.get("tags"):
            lines.append("tags: " + ", ".join(map(str, op["tags"])))
        lines += [f"{key}: {text(op, key).strip()}" for key in ("summary", "description") if op.get(key)]
        if op.get("parameters"):
            lines += ["parameters:", *map(self.parameter, op["parameters"])]
        body = self.resolved("requestBodies", op.get("requestBody") or {})
        if body.get("description") or body.get("content"):
            lines.append("requestBody:" + " required" * bool(body.get("required")) + (f" {text(body, 'description').strip()}" if body.get("description") else ""))
            lines += self.contents(body.get("content"))
        if answers := {str(code): a for code, a in (op.get("responses") or {}).items()}:
            lines.append("responses:")
            for code in sorted(answers):
                answer = self.resolved("responses", answers[code] or {})
                lines += [f"- {code}" + (f" {text(answer, 'description').strip()}" if answer.get("description") else ""), *self.contents(answer.get("content"))]
        return "\n".join(lines) + "\n"


def text(value: dict, key: str) -> str:
    return str(value.get(key) or "")


def parse(name: str, content: bytes) -> Document:
    spec = Spec(name, content)
    title = text(spec.root.get("info") or {}, "title").strip() or base_name(name)
    sections = []
    for path, item in sorted((spec.root.get("paths") or {}).items()):
        for method in sorted(m.upper() for m in item or {} if m.lower() in METHODS):
            head = f"{method} {path}".strip()
            sections.append(Section(head, [title, "API", head], spec.operation(method, path, item.get(method.lower()) or {})))
    return Document(name, title, digest(content), sections).numbered()
