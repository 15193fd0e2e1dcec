"""Markdown: ATX headings cut a text into sections. Fenced code is not looked at, nor are underlined headings."""

from __future__ import annotations

import re

from lakeleaf.sources.model import Document, Section, base_name, digest

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
CLOSING = re.compile(r"(?:^|[ \t]+)#+$")


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of an ATX heading line."""
    m = HEADING.fullmatch(line.rstrip("\r\n"))
    return None if m is None else (len(m[1]), CLOSING.sub("", (m[2] or "").strip()).strip())


def entered(path: list[str], level: int, title: str) -> list[str]:
    """The heading path below a heading: a skipped level adds no empty step."""
    return [*path[: level - 1], title]


def parse(path: str, content: bytes) -> Document:
    name, text = base_name(path), content.decode("utf-8", errors="replace")
    title, headings = name, []
    sections: list[Section] = []
    lines: list[str] = []
    current: tuple[str, list[str]] | None = None

    def close() -> None:
        body = "".join(lines)
        if current is not None:
            sections.append(Section(current[0], current[1], body))
        elif body.strip():
            sections.append(Section(name, [], body))

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if (found := heading(line)) is None:
            lines.append(line)
            continue
        close()
        lines = []
        level, words = found
        headings = entered(headings, level, words)
        current = words, list(headings)
        if level == 1 and words and title == name:
            title = words
    close()
    return Document(path, title, digest(content), sections).numbered()
