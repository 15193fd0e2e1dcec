"""Source addresses, document URLs, and where links in pages lead to."""

from __future__ import annotations

import json
import posixpath
import re


def local_path(dsn: str) -> str:
    """The folder or file of a local source: ``file://`` or a path; Windows and WSL forms are mapped."""
    dsn = dsn.strip()
    if not dsn:
        raise ValueError("local source dsn is required")
    if dsn.startswith("file://"):
        if not dsn[7:]:
            raise ValueError("file DSN requires a path")
        return _mapped(dsn[7:])
    if "://" in dsn:
        raise ValueError(f"unsupported local source dsn {dsn!r}")
    return _mapped(dsn)


def _mapped(path: str) -> str:
    path = path.strip()
    if m := re.match(r"/?([A-Za-z]):[\\/](.*)", path, re.S):
        return posixpath.normpath(f"/mnt/{m[1].lower()}/" + m[2].lstrip("\\/").replace("\\", "/"))
    if path.startswith(("\\\\wsl$\\", "\\\\wsl.localhost\\")):
        steps = path.lstrip("\\").split("\\")
        if len(steps) >= 3:
            return posixpath.normpath("/" + "/".join(steps[2:]))
    return posixpath.normpath(path)


def document_url(prefix: str, path: str) -> str:
    prefix = prefix.strip()
    if not prefix:
        return path
    return prefix.rstrip("/") + "/" + path if "://" in prefix else posixpath.normpath(posixpath.join(prefix, path))


def url_prefix(config_json: str, fallback: str) -> str:
    """What the source's config says, else the fallback."""
    try:
        own = str(json.loads(config_json or "{}").get("url_prefix") or "").strip()
    except (ValueError, AttributeError):
        own = ""
    return own or fallback


def split_web_url(path: str) -> tuple[str, str]:
    """Path and web address, where both are packed into one text with a bar between."""
    own, _, url = path.partition("|")
    return own, url


def target_key(path: str, anchor: str = "") -> str:
    return f"{path}#{anchor.strip().removeprefix('#')}"


def _forms(path: str) -> list[str]:
    """A page path and the other names of the same page."""
    path = posixpath.normpath(path.strip()) if path.strip() else "."
    path = "index.html" if path == "." else path
    name = path.rsplit("/", 1)[-1]
    found = [path]
    if "." not in name and name.lower() != "index.html":
        found += [path + "/index.html", path + ".html"]
    if path.lower().endswith("/index.html"):
        found.append(path[: -len("/index.html")])
    return [f for f in dict.fromkeys(map(posixpath.normpath, found)) if f not in (".", "")]


def href_candidates(source_path: str, href: str) -> list[str]:
    """Keys of the pages that a link may mean, best first: beside the page, then from the root."""
    target, _, anchor = href.strip().split("?", 1)[0].partition("#")
    target = target.strip()
    if not target:
        paths = [source_path]
    else:
        plain = posixpath.normpath(target)
        plain = plain.lstrip("/") if target.startswith("/") else plain
        paths = [plain] if target.startswith("/") else [posixpath.normpath(posixpath.join(posixpath.dirname(source_path), target)), plain]
    return list(dict.fromkeys(target_key(f, anchor) for p in paths for f in _forms(p)))
