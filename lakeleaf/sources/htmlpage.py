"""HTML pages: headings cut a page into sections; paragraphs, list items, code and leaf boxes give their lines."""

from __future__ import annotations

from lakeleaf.sources import dom
from lakeleaf.sources.markdown import entered
from lakeleaf.sources.model import Document, Link, Section, base_name, digest, unique

SKIPPED = frozenset(("script", "style", "noscript", "nav"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
WHOLE = frozenset(("p", "li", "pre", "code"))
#: A box that holds one of these isn't a leaf.
BLOCKS = frozenset("div section article main header footer ul ol dl table form fieldset h1 h2 h3 h4 h5 h6 p blockquote pre hr iframe".split())
#: Links with these beginnings lead elsewhere.
FOREIGN = ("mailto:", "tel:", "javascript:", "data:")


def is_internal(href: str) -> bool:
    """Fragments, folders, ``.html``/``.htm`` files and names without a dot; nothing with a scheme."""
    href = href.strip()
    low = href.lower()
    if not href or "://" in low or low.startswith(FOREIGN):
        return False
    target = href.split("?", 1)[0].split("#", 1)[0]
    if not target or target.endswith("/"):
        return True
    name = target.rsplit("/", 1)[-1]
    return "." not in name or name.lower().endswith((".html", ".htm"))


def links_in(node: dom.Node) -> list[Link]:
    return [Link(n.attr("href").strip(), n.text()) for n in node.walk() if n.tag == "a" and is_internal(n.attr("href"))]


def is_leaf(node: dom.Node) -> bool:
    """Whether a div or span has text of its own and no block in it."""
    own = any(isinstance(c, str) and c.strip() for c in node.children)
    return own and not any(isinstance(c, dom.Node) and c.tag in BLOCKS for c in node.children)


def title_of(root: dom.Node) -> str:
    return next((t for n in root.walk() if n.tag == "title" and (t := n.text())), "")


def parse(path: str, content: bytes | str) -> Document:
    root = dom.parse(content)
    title = title_of(root) or base_name(path)
    sections: list[Section] = []
    anchors: list[str] = []
    headings: list[str] = []
    current = Section("", [], "")
    lines: list[str] = []
    links: list[Link] = []

    def close() -> None:
        nonlocal lines, links
        body = "\n".join(lines).strip()
        if not body and not current.title:
            return  # links found so far stay with the next section
        own = current.title or title
        sections.append(Section(own, list(current.heading_path) if current.title else [title], body, anchor=current.anchor, links=links))
        lines, links = [], []

    todo: list[dom.Node] = [root]
    while todo:
        node = todo.pop()
        if anchor := node.attr("id").strip():
            anchors.append(anchor)
        if node.tag in SKIPPED:
            continue
        if node.tag in HEADINGS:
            close()
            words = node.text() or title
            headings = entered(headings, int(node.tag[1]), words)
            current = Section(words, list(headings), "", anchor=anchor)
            continue
        if node.tag in WHOLE or node.tag in ("div", "span") and is_leaf(node):
            if words := node.text():
                lines.append(words)
            links += links_in(node)
            continue
        if node.tag == "a" and is_internal(node.attr("href")):
            links.append(Link(node.attr("href").strip(), node.text()))
        todo.extend(c for c in reversed(node.children) if isinstance(c, dom.Node))
    close()
    if not sections:
        sections = [Section(title, [title], root.text())]
    return Document(path, title, digest(content), sections, unique(anchors)).numbered()
