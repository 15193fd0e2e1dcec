"""A small HTML tree: the standard tokenizer with the implied end tags that matter to texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open paragraph ends before these.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the key's kind ends before any of these; the search stops at the last set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []

    def attr(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in page order."""
        todo: list[Node] = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """All texts below, each trimmed, the empty ones left out, joined by a space."""
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if node.strip():
                    parts.append(node.strip())
            else:
                todo.extend(reversed(node.children))
        return " ".join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and any(n.tag == "p" for n in self.stack):
            self.leave("p")
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ends:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in stop:
                    break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.leave(tag)

    def leave(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        children = self.stack[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse(content: bytes | str) -> Node:
    b = _Builder()
    b.feed(content.decode("utf-8", errors="replace") if isinstance(content, bytes) else content)
    b.close()
    return b.root
