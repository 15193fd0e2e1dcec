"""Operator 11, fill-in-middle: texts are cut at two of their lines' ends and put together in another order.

An automaton over bytes, given as a table, reads each text once. Its states say how many continuation bytes of a
character are due, whether a unit (a line) is open and how much of a sentinel has been read; its transitions carry
flags, which are counted by block: characters, units that end, sentinels. The second pass finds the block in which a
cut falls from the counts and looks at that block only.

Which state holds before a byte depends on the three bytes before it alone, so all places of a block step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: States: nothing of note, a unit begins, "<" read, "<" and a sentinel's letter read, so many continuation bytes due.
TEXT, START, OPEN, LETTER, DUE1, DUE2, DUE3 = range(7)
#: Flags of transitions: a character begins, a unit ends, a sentinel ends.
CHARACTER, UNIT, SENTINEL = 8, 16, 32
STATE = 7
#: Bytes that are scanned at once.
BLOCK = 1 << 16


def transitions() -> np.ndarray:
    """TABLE[state * 256 + byte]: the next state and the transition's flags."""
    table = np.zeros((7, 256), dtype=np.uint8)
    letters = {PREFIX[1], SUFFIX[1], MIDDLE[1]}
    for state in range(7):
        for byte in range(256):
            if 0x80 <= byte < 0xC0:
                after = {DUE3: DUE2, DUE2: DUE1}.get(state, TEXT)
            elif byte >= 0xC0:
                after = (DUE1 if byte < 0xE0 else DUE2 if byte < 0xF0 else DUE3) | CHARACTER
            elif byte == 0x0A:
                after = START | CHARACTER | UNIT
            elif byte == PREFIX[0]:
                after = OPEN | CHARACTER
            elif state == OPEN and byte in letters:
                after = LETTER | CHARACTER
            elif state == LETTER and byte == PREFIX[2]:
                after = TEXT | CHARACTER | SENTINEL
            else:
                after = TEXT | CHARACTER
            table[state, byte] = after
    return table.reshape(-1)


TABLE = transitions()
_ROW = (np.arange(256, dtype=np.uint16) & STATE) * 256  # of a transition the table's row of its next state


def scan(data: np.ndarray, at: int, end: int) -> np.ndarray:
    """The transition of each byte of data[at:end], of a text that is ``data``."""
    first = max(0, at - 3)
    part = data[first:end].astype(np.uint16)
    moved = TABLE[part + (START * 256 if first == 0 else TEXT * 256)]
    if first == 0:  # what precedes a text's first bytes is its start only
        moved[1:] = TABLE[part[1:] + TEXT * 256]
    for _ in range(3):
        moved[1:] = TABLE[_ROW[moved[:-1]] + part[1:]]
    return moved[at - first :]


class Scan(NamedTuple):
    """Of one text: flags counted for each block, and whether its last unit has no line end."""

    characters: np.ndarray
    units: np.ndarray
    sentinels: int
    open_unit: bool

    @property
    def n(self) -> int:
        return int(self.units.sum()) + self.open_unit


def first_pass(data: np.ndarray) -> Scan:
    characters, units, sentinels, last = [], [], 0, START
    for at in range(0, len(data), BLOCK):
        moved = scan(data, at, min(at + BLOCK, len(data)))
        characters.append(np.count_nonzero(moved & CHARACTER))
        units.append(np.count_nonzero(moved & UNIT))
        sentinels += np.count_nonzero(moved & SENTINEL)
        last = int(moved[-1]) & STATE
    return Scan(np.array(characters, dtype=np.int64), np.array(units, dtype=np.int64), sentinels, last != START)


def cut(data: np.ndarray, seen: Scan, units: int) -> tuple[int, int]:
    """Second pass: bytes and characters before the end of so many units."""
    if units == 0:
        return 0, 0
    upto = np.cumsum(seen.units)
    if not len(upto) or units > upto[-1]:  # the last unit, which has no line end
        return len(data), int(seen.characters.sum())
    block = int(np.searchsorted(upto, units))
    at = block * BLOCK
    moved = scan(data, at, min(at + BLOCK, len(data)))
    before = int(upto[block - 1]) if block else 0
    place = int(np.flatnonzero(moved & UNIT)[units - before - 1]) + 1
    return at + place, int(seen.characters[:block].sum()) + int(np.count_nonzero(moved[:place] & CHARACTER))


class Settings(NamedTuple):
    """seed: put before the id that is hashed. rate: of 100 texts so many are cut; spm: of 100 cut ones so many begin with
    the suffix."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def arranged(data: bytes, draws: tuple[int, int, int, int], settings: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and the output of one text, as UTF-8."""
    signs = np.frombuffer(data, dtype=np.uint8)
    seen = first_pass(signs)
    n = seen.n
    if not data or seen.sentinels or draws[2] % 100 >= settings.rate:
        return n, "plain", None, None, data
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = cut(signs, seen, low), cut(signs, seen, high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    form = "spm" if draws[3] % 100 < settings.spm else "psm"
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, a_chars, b_chars - a_chars, b"".join(parts)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_binary())])
#: Bytes of output that go back to Spark in one batch, one text at least.
SENT = 1 << 23


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Arrange every whole text: doc_id, n, form, prefix_chars, middle_chars, output; one row per input row.

    A text has n units: lines with their line feed, the last maybe without. The four draws of a row are the first
    groups of eight hexadecimal digits of sha256(seed:doc_id); a null id counts as the empty text there. Empty and null
    texts, those that hold a sentinel, and those beyond ``rate`` are ``plain``: output is the text, and the lengths are
    null. Else the prefix ends after the smaller of two draws modulo n + 1, the middle after the larger, and output is
    ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). Lengths are in code points.

    Repeated rows are repeated with equal results, an empty table gives an empty one, other columns are ignored. A very
    long text is scanned in blocks; what a worker holds besides the batch is the counts and the output of that text.
    """
    hashed = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"draw{i}") for i in range(4)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, draws = batch.column("doc_id").to_pylist(), list(zip(*[batch.column(f"draw{i}").to_pylist() for i in range(4)], strict=True))
            found, size = [], 0
            for i, value in enumerate(batch.column("data")):
                found.append((ids[i], *arranged(value.as_py(), draws[i], settings)))
                size += len(found[-1][-1])
                if size >= SENT or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                    found, size = [], 0

    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A sentinel in it can only be one that was put there."""
    parts = F.split(output, "<[PSM]>", 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_in_middle_digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``fill_in_middle`` with the digests of the output and of the text restored from it in place of the output."""
    made = fill_in_middle(docs, settings)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
