"""Include and exclude patterns as regular expressions, so that paths are tested inside Spark."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is read and what is left out unless a source says otherwise (fixed values).
INCLUDE = ["**/*.md", "**/*.markdown", "**/*.html", "**/*.htm", "**/*.txt"]
SKIPPED_DIRS = ["node_modules", "vendor", "build", "dist", "out", "target", "coverage", "__pycache__"]
EXCLUDE = ["**/.*/**", *(f"**/{d}/**" for d in SKIPPED_DIRS)]


def _segment(pattern: str) -> str:
    """One shell pattern: ``*`` and ``?`` stay within a path step. An open bracket without its end matches nothing."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", at + 2)
            if end < 0:
                return "(?!)"
            body = pattern[at + 1 : end]
            out += "[" + ("^" + re.escape(body[1:]) if body[0] in "^!" else re.escape(body)).replace("\\-", "-") + "]"
            at = end
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out += re.escape(pattern[at])
        else:
            out += re.escape(c)
        at += 1
    return out


def alternatives(pattern: str, mirrored: bool = False) -> list[str]:
    """Expressions of which one must match a whole relative path. ``mirrored``: the narrower rules for mirrored
    folders, where ``x/**`` is only a prefix test and a ``**`` between steps has no rule of its own."""
    pattern = pattern.strip().replace("\\", "/")
    if not pattern:
        return []
    out: list[str] = []
    if pattern.startswith("**/") and pattern.endswith("/**") and len(pattern) > 5:
        mid = re.escape(pattern[3:-3])
        out += [mid, f"{mid}/.*", f".*/{mid}/.*"]
    if pattern.startswith("**/"):
        out += alternatives(pattern[3:], mirrored)
    if pattern.endswith("/**"):
        out.append(re.escape(pattern[:-3]) + "(?:/.*)?")
        if mirrored:
            return out
    if "/**/" in pattern and not mirrored:
        head, tail = pattern.split("/**/", 1)
        out += [re.escape(head) + "/" + x for x in alternatives(tail, mirrored)]
    out.append(_segment(pattern))
    if pattern.count("**") == 1:
        head, tail = (p.strip("/") for p in pattern.split("**"))
        under = f"(?=(?:{re.escape(head)})(?:/|$))" if head else ""
        out += [f"{under}(?:.*/)?{_segment(tail)}", f"{under}.*{re.escape(tail)}"] if tail else [f"{under}.*"]
    return out


def expression(patterns: list[str], mirrored: bool = False) -> str:
    """One expression for all patterns; matches nothing if there are none."""
    found = list(dict.fromkeys(a for p in patterns for a in alternatives(p, mirrored)))
    return "^(?:" + "|".join(found) + ")$" if found else "(?!)"


def matches(patterns: list[str], path: str, mirrored: bool = False) -> bool:
    path = path.strip().removeprefix("./")
    return bool(path) and re.search(expression(patterns, mirrored), path, re.S) is not None


def string_list(value: Any) -> list[str]:
    """A list or a text; every element is cut at commas."""
    parts = value if isinstance(value, list) else [value] if isinstance(value, str) else []
    return [x for p in parts for x in (s.strip() for s in str(p).split(",")) if x]


def load_config(config_json: str, what: str) -> dict[str, Any]:
    text = (config_json or "").strip()
    if not text:
        return {}
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ValueError(f"parse {what} config_json: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"parse {what} config_json: not an object")
    return value


@dataclass
class Patterns:
    include: list[str]
    exclude: list[str]
    mirrored: bool = False

    @classmethod
    def of(cls, config: dict[str, Any], mirrored: bool = False) -> Patterns:
        """include replaces the default, exclude adds to it."""
        return cls(string_list(config.get("include")) or list(INCLUDE), [*EXCLUDE, *string_list(config.get("exclude"))], mirrored)

    def wanted(self, path: str) -> bool:
        steps = path.split("/")
        gone = any(s.startswith(".") or s in SKIPPED_DIRS for s in steps[:-1]) or any(matches(self.exclude, "/".join(steps[:i]) + "/", self.mirrored) for i in range(1, len(steps)))
        return not gone and not matches(self.exclude, path, self.mirrored) and matches(self.include, path, self.mirrored)

    def column(self, path: Column) -> Column:
        """``wanted`` inside Spark."""
        steps = F.split(path, "/")
        folders = F.slice(steps, 1, F.size(steps) - 1)
        above = F.transform(folders, lambda _, i: F.concat(F.array_join(F.slice(steps, 1, i + 1), "/"), F.lit("/")))
        hidden = F.exists(folders, lambda s: F.startswith(s, F.lit(".")) | s.isin(*SKIPPED_DIRS))
        gone = hidden | F.exists(above, lambda s: s.rlike(expression(self.exclude, self.mirrored)))
        return ~gone & ~path.rlike(expression(self.exclude, self.mirrored)) & path.rlike(expression(self.include, self.mirrored))
