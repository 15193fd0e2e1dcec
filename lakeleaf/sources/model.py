"""What every parser gives: a document with ordered sections."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T


def digest(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@dataclass
class Link:
    href: str
    text: str = ""


@dataclass
class Section:
    title: str
    heading_path: list[str]
    content: str
    ordinal: int = 0
    hash: str = ""
    anchor: str = ""
    links: list[Link] = field(default_factory=list)


@dataclass
class Document:
    path: str
    title: str
    hash: str
    sections: list[Section]
    anchors: list[str] = field(default_factory=list)
    url: str = ""
    version: str = ""

    def numbered(self) -> Document:
        for i, s in enumerate(self.sections):
            s.ordinal, s.hash = i, digest(s.content)
        return self

    def row(self) -> dict[str, Any]:
        return asdict(self)


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
_SECTION = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("content", T.StringType()), T.StructField("ordinal", T.IntegerType()),
     T.StructField("hash", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]
)
#: One parsed document to a row.
PARSED = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("title", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("sections", T.ArrayType(_SECTION)),
     T.StructField("anchors", T.ArrayType(T.StringType())), T.StructField("url", T.StringType()), T.StructField("version", T.StringType())]
)


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in (x.strip() for x in values) if v))
