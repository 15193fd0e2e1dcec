"""Deterministic and random ids, canonical names."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 24


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """prefix _ first 24 hexadecimal digits of SHA-256 over the parts, each ended by a zero byte."""
    raw = [x for p in parts for x in (F.encode(F.col(p) if isinstance(p, str) else p.cast("string"), "utf-8"), F.unhex(F.lit("00")))]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(*raw), 256), 1, DIGITS))


def stable_id_of(prefix: str, *parts: str) -> str:
    """The same on the driver."""
    return f"{prefix}_{hashlib.sha256(b''.join(p.encode() + bytes(1) for p in parts)).hexdigest()[:DIGITS]}"


def random_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:DIGITS]}"


def canonical(*parts: str | Column) -> Column:
    """Parts joined by a space, lower-cased, each run of white space one space, trimmed."""
    joined = F.concat_ws(" ", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.trim(F.regexp_replace(F.lower(joined), r"(?U)\s+", " "))


def canonical_of(*parts: str) -> str:
    return re.sub(r"\s+", " ", " ".join(parts).lower()).strip()
