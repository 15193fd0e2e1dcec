"""Configuration: a small subset of YAML with sections server, storage, search, vector and auth."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Config:
    server: dict[str, str | int] = field(default_factory=lambda: {"host": "127.0.0.1", "port": 8787, "data_dir": ".lakeleaf"})
    storage: dict[str, str] = field(default_factory=lambda: {"dsn": ".lakeleaf/store"})
    search: dict[str, str] = field(default_factory=lambda: {"dsn": ".lakeleaf/store"})
    vector: dict[str, str] = field(default_factory=lambda: {"dsn": "none://"})
    auth: dict[str, str] = field(default_factory=lambda: {"mode": "none", "token": ""})


def load(path: str = "") -> Config:
    """Defaults, then the file's settings. An unknown section or key is an error; ``#`` starts a comment anywhere."""
    out, section = Config(), ""
    if not path:
        return out
    with open(path, encoding="utf-8") as f:
        for number, raw in enumerate(f, 1):
            line = raw.split("#", 1)[0].strip()
            if not line:
                continue
            if line.endswith(":") and " " not in line:
                section = line[:-1]
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"{path}:{number}: expected key: value")
            try:
                _set(out, section, key.strip(), value.strip().strip("\"'"))
            except ValueError as e:
                raise ValueError(f"{path}:{number}: {e}") from e
    if not out.storage["dsn"]:
        raise ValueError("storage.dsn is required")
    out.auth["mode"] = out.auth["mode"] or "none"
    if out.auth["mode"] not in ("none", "token"):
        raise ValueError("auth.mode must be none or token")
    if out.auth["mode"] == "token" and not out.auth["token"]:
        raise ValueError("auth.token is required when auth.mode is token")
    return out


def _set(config: Config, section: str, key: str, value: str) -> None:
    if not section:
        raise ValueError(f"top-level key {key!r} is not supported")
    if section not in vars(config):
        raise ValueError(f"unknown section {section!r}")
    own = getattr(config, section)
    if key not in own:
        raise ValueError(f"unknown {section} key {key!r}")
    if (section, key) == ("server", "port"):
        if not value.lstrip("+-").isdigit():
            raise ValueError("invalid server.port")
        own[key] = int(value)
    else:
        own[key] = value
