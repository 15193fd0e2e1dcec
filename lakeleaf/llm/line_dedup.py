"""Operator 8, line dedup by an exact set-similarity join of lines.

A line is the set of its words. Lines whose sets have a Jaccard similarity of SIMILARITY or more are alike, and of
alike lines every one that has an earlier one (in the order of doc_id, then line number) is removed.

1. Word frequencies over all documents, in a table of a fixed size: words are ordered by rarity.
2. Each line sends a record for each word of its prefix (the shortest such that two alike lines share a word in
   both prefixes) to the word's part, and one for its digest to the digest's part. Records are packed, so a part is
   a few binary rows; a task sends each digest once, however many copies it has seen.
3. In a part, records of one word are paired under the length filter, the positional filter and a bitmap filter (the
   parity bitmaps of alike lines differ in few bits; they are as wide as a line is long, as a full bitmap tells nothing).
   Records of one digest show its first line.
4. For each later line the nearest earlier candidates are verified on the words (48 bits of each), which another pass
   gives for just those lines. A group of n near copies of a line thus gives some pairs for each, not all n x n / 2.
5. Lines that none of their nearest candidates removed, but that had more, get all their candidates in the end, from
   the records of the words that some line had more candidates by, which step 3 has set aside. So the result is that
   of comparing all lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeleaf.llm.common import distinct, materialise, release
from lakeleaf.llm.shingles import mixed, word_starts, words

SIMILARITY = 0.8
#: Counters of word frequencies (8 bytes each in a task, sent in pieces), and bits of the filter of digests. What they
#: can't tell apart costs time only: the order of words is the same for all lines, and filters let too much through.
COUNTERS, PIECE = 1 << 20, 1 << 12
#: The rank of a count of 1.
ONCE = np.uint64(64)
FILTER_BITS = 1 << 26
#: Spreads line numbers over a filter.
LINE_STEP = 2_654_435_761
#: Parts grow with the corpus: about so many of its words to a part, which holds a fifth of them as records.
WORDS_IN_PART, LEAST_PARTS, MOST_PARTS = 1 << 19, 64, 1 << 20
#: Candidate pairs looked at together in a part, and kept of each word and later line (the nearest) at first.
#: (DOUBTFUL times as many where even the nearest is not clearly alike, or where there are no more than that).
SLICE, KEEP, DOUBTFUL = 1 << 18, 8, 8

#: A line is known by the place of its first copy and by its ``mark``, 32 bits of its digest. Bitmaps stand beside records.
RECORD = np.dtype([("word", "<u4"), ("mark", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("size", "<u2"), ("at", "<u2")])
#: Copies agree in 128 bits, ``digest`` and ``check``.
FIRST = np.dtype([("digest", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("line", "<i4")])
#: An earlier line and a later one.
PAIR = np.dtype([("home", "<i8"), ("home_line", "<i4"), ("home_mark", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("mark", "<u4"), ("apart", "<i4"), ("more", "?")])
EARLIER, LATER = ("home", "home_line", "home_mark"), ("doc", "line", "mark")
#: Sizes up to which a line's bitmap has 1, 2 and 4 lanes of 64 bits; larger ones have 8. Sizes of alike lines are a level
#: apart at most, and the wider bitmap folds to the narrower.
WIDEST, LANES = np.array([80, 160, 320]), 8
MOST = 65_535
#: Characters whose words are found at once, and lines whose records are packed at once.
CHARS, LINES = 150_000, 50_000
#: Words of pairs that are compared at once.
PAIR_WORDS = 1 << 20


def counter(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(44)).astype(np.int64)


def least_overlap(size: np.ndarray) -> np.ndarray:
    """Words that a line of ``size`` shares at least with any alike line: ceil(SIMILARITY x size), exactly."""
    return -(-size * 4 // 5)


def level_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(WIDEST, size)


def lanes_of(size: np.ndarray) -> np.ndarray:
    """Lanes of the bitmap of a line of ``size`` words."""
    return 1 << level_of(size)


class Lines:
    """The lines of a text that have words: number, digest (of the multiset of words), and the set of words of each,
    rarest first."""

    def __init__(self, text: str, ranks: np.ndarray | None):
        words, line = word_starts(text)
        self.words, self.line = words, line
        if not len(words):
            self.number = np.empty(0, dtype=np.int64)
            return
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        self.number = line[starts]
        twisted = mixed(words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        self.digest = mixed(np.add.reduceat(twisted, starts))
        if ranks is None:
            return
        self.check = np.add.reduceat(mixed((words ^ (words >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(3)), starts)
        # One sort by (line, rank, word): 20 + 12 + 32 bits. The word's bits are those that tell it from others.
        place = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.r_[starts, len(words)]))
        keys = (place << np.uint64(44)) | (ranks[counter(words)].astype(np.uint64) << np.uint64(32)) | (words & np.uint64(0xFFFFFFFF))
        keys = distinct(keys)
        place = (keys >> np.uint64(44)).astype(np.int64)
        self.set_starts = np.searchsorted(place, np.arange(len(starts)))
        self.sizes = np.diff(np.r_[self.set_starts, len(keys)])
        self.keys, self.place = keys, place
        self.at = np.arange(len(keys)) - self.set_starts[place]
        short = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        spread = mixed(short.astype(np.uint64))
        lanes = lanes_of(self.sizes)
        n = int(lanes.max())
        bit, lane = np.uint64(1) << (spread >> np.uint64(58)), spread & np.uint64(n - 1)
        self.bits = np.zeros((len(starts), LANES), dtype=np.uint64)
        for j in range(n):
            self.bits[:, j] = np.bitwise_xor.reduceat(np.where(lane == j, bit, np.uint64(0)), self.set_starts)
        while n := n // 2:
            self.bits[:, :n] ^= np.where((lanes <= n)[:, None], self.bits[:, n : 2 * n], np.uint64(0))
        self.short = short


class Chunk(NamedTuple):
    """Some texts joined by line feeds, or a part of a giant one. Of each text: id, the chunk's line that it starts at,
    and its own number of that line."""

    text: str
    docs: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray

    def own(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and own line numbers of the chunk's lines."""
        at = np.searchsorted(self.starts, line, side="right") - 1
        return self.docs[at], line - self.starts[at] + self.numbers[at]


def chunks(docs: Iterable[int], texts: Iterable[str]) -> Iterator[Chunk]:
    """Whole lines, about CHARS at a time, so that arrays fit in the cache and none has 2**20 lines."""
    held: list[tuple[int, int, str]] = []
    size = 0

    def joined() -> Chunk:
        starts = np.cumsum([0, *[t.count("\n") + 1 for _, _, t in held[:-1]]])
        return Chunk("\n".join([t for _, _, t in held]), np.array([d for d, _, _ in held], dtype=np.int64), starts, np.array([n for _, n, _ in held], dtype=np.int64))

    for doc, text in zip(docs, texts):
        at, line = 0, 0
        while at <= len(text):
            end = len(text)
            if end - at > 1_000_000 and (cut := text.rfind("\n", at, at + 1_000_000)) >= 0:
                end = cut
            held.append((doc, line, text[at:end]))
            size += end - at
            line += held[-1][2].count("\n") + 1
            at = end + 1
            if size >= CHARS:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A rank (0 to 4095, rising with the frequency on a logarithmic scale) for each of COUNTERS counters of words, and
    the number of parts for so many words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            for chunk in chunks(repeat(0), batch["text"]):
                held.append(counter(words(chunk.text)))
                size += len(held[-1])
                if size >= COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        yield pd.DataFrame({"piece": np.arange(COUNTERS // PIECE), "counts": [x.tobytes() for x in total.reshape(-1, PIECE)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, dtype=np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, dtype=np.int64)
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "counts": [total.tobytes()]})

    found = docs.select("text").mapInPandas(count, "piece int, counts binary").groupBy("piece").applyInPandas(add, "piece int, counts binary").toPandas()
    total = np.zeros((COUNTERS // PIECE, PIECE), dtype=np.int64)
    for piece, x in zip(found["piece"], found["counts"]):
        total[piece] = np.frombuffer(x, dtype=np.int64)
    parts = 1 << (int(total.sum()) // WORDS_IN_PART).bit_length()
    return np.minimum(np.log2(total.ravel() + 1) * 64, 4095).astype(np.uint16), min(max(parts, LEAST_PARTS), MOST_PARTS)


def _records(docs: DataFrame, ranks: np.ndarray, parts: int) -> DataFrame:
    """kind 0: prefix records, 1: first lines of digests, 2: lines that are copies (FIRST records), each of a part."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order, firsts, records, owners, bits, seen = sent.value, [], [], [], [], 0
            for chunk in chunks(batch["doc_id"], batch["text"]):
                own = Lines(chunk.text, order)
                if len(own.number):
                    first = np.empty(len(own.number), dtype=FIRST)
                    first["digest"], first["check"] = own.digest, own.check
                    first["doc"], first["line"] = chunk.own(own.number)
                    firsts.append(first)
                    prefix = own.sizes - least_overlap(own.sizes) + 1
                    # No other line has a word that all texts have once.
                    taken = (own.at < prefix[own.place]) & ((own.keys >> np.uint64(32)) & np.uint64(4095) > ONCE)
                    place = own.place[taken]
                    record = np.empty(len(place), dtype=RECORD)
                    record["word"], record["mark"] = own.short[taken], own.digest[place] & np.uint64(0xFFFFFFFF)
                    record["doc"], record["line"] = first["doc"][place], first["line"][place]
                    record["size"], record["at"] = np.minimum(own.sizes[place], MOST), np.minimum(own.at[taken], MOST)
                    records.append(record)
                    owners.append(place + seen)
                    bits.append(own.bits)
                    seen += len(first)
                if seen >= LINES:
                    yield from packed(firsts, records, owners, bits)
                    firsts, records, owners, bits, seen = [], [], [], [], 0
            if seen:
                yield from packed(firsts, records, owners, bits)

    def packed(firsts: list[np.ndarray], records: list[np.ndarray], owners: list[np.ndarray], bits: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """Rows by part; of each digest only the first line's records, the other lines are copies."""
        first = np.concatenate(firsts)
        order = in_order(first)
        first = first[order]
        new = starts_of(first)
        kept = np.zeros(len(first), dtype=bool)
        kept[order] = new
        record, owner = np.concatenate(records), np.concatenate(owners)
        taken = np.flatnonzero(kept[owner])
        word = record["word"][taken].astype(np.uint64)
        taken = taken[np.argsort(((word % np.uint64(parts)) << np.uint64(32)) | word)]  # words that ascend compress
        record, owner, wide = record[taken], owner[taken], np.concatenate(bits)
        lanes = np.arange(LANES) < lanes_of(record["size"])[:, None]
        yield by_part(record, record["word"], parts, lambda a, b: with_bits(record[a:b], wide[owner[a:b]][lanes[a:b]])).assign(kind=0)[["kind", "part", "rows"]]
        for kind, rows in ((1, first[new]), (2, first[~new])):
            yield by_part(rows, rows["digest"], parts).assign(kind=kind)[["kind", "part", "rows"]]

    return docs.mapInPandas(run, "kind int, part int, rows binary")


def in_order(first: np.ndarray) -> np.ndarray:
    return np.lexsort((first["line"], first["doc"], first["check"], first["digest"]))


def starts_of(first: np.ndarray) -> np.ndarray:
    """Of FIRST records in order: whether each is the first of its copies."""
    return np.r_[True, (first["digest"][1:] != first["digest"][:-1]) | (first["check"][1:] != first["check"][:-1])]


def planes(rows: np.ndarray) -> bytes:
    """Records with all first bytes first, then all second bytes, and so on: high bytes of numbers, most of them zero or
    the same as in the record before, stand together, so compression finds them; also bytes of few values, which that
    of shuffles (LZ4) doesn't."""
    return squeezed(np.ascontiguousarray(rows.view(np.uint8).reshape(-1, rows.dtype.itemsize).T))


def squeezed(data: np.ndarray) -> bytes:
    return data.nbytes.to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def records_of(data: bytes, kind: np.dtype) -> np.ndarray:
    """What ``planes`` has packed."""
    if data:
        data = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def with_bits(record: np.ndarray, bits: np.ndarray) -> bytes:
    """RECORDs and the lanes of their bitmaps, one after the other."""
    rows = planes(record)
    return len(rows).to_bytes(8, "little") + rows + squeezed(bits)


def lines_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``with_bits`` has packed."""
    end = 8 + int.from_bytes(data[:8], "little")
    return records_of(data[8:end], RECORD), records_of(data[end:], np.dtype("<u1")).view(np.uint64)


def by_part(rows: np.ndarray, keys: np.ndarray, parts: int, pack: Callable[[int, int], bytes] | None = None) -> pd.DataFrame:
    """part and rows: the records of each part as one binary value. ``pack`` packs those of a range of rows that are in
    the order of parts."""
    part = (keys % keys.dtype.type(parts)).astype(np.int64)
    if pack is None:
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(part)]
    return pd.DataFrame({"part": part[cuts], "rows": [pack(a, b) if pack else planes(rows[a:b]) for a, b in zip(cuts, ends)]})


def in_words(record: np.ndarray) -> np.ndarray:
    """The order of RECORDs by word, size, mark, doc and line. Few differ in the last ones only, so one key sorts most."""
    key = (record["word"].astype(np.uint64) << np.uint64(32)) | (record["size"].astype(np.uint64) << np.uint64(16)) | (record["mark"] >> np.uint32(16))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    some = record[order[tied]]
    order[tied] = order[tied][np.lexsort((some["line"], some["doc"], some["mark"], key[tied]))]
    return order


class Bitmaps:
    """Bitmaps of records by level: at each level those of its lines, and those of the next one's folded."""

    def __init__(self, size: np.ndarray, start: np.ndarray, bits: np.ndarray):
        self.level = level_of(size)
        self.at, self.rows = [], []
        for k in range(len(WIDEST) + 1):
            n = 1 << k
            mine, next_ = np.flatnonzero(self.level == k), np.flatnonzero(self.level == k + 1)
            at = np.zeros(len(size), dtype=np.int32)
            at[mine], at[next_] = np.arange(len(mine)), np.arange(len(next_)) + len(mine)
            wide = bits[start[next_][:, None] + np.arange(2 * n)]
            self.at.append(at)
            self.rows.append(np.concatenate([bits[start[mine][:, None] + np.arange(n)], wide[:, :n] ^ wide[:, n:]]))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that two lines differ in, at the level of the shorter one, ``a``."""
        out, level = np.empty(len(a), dtype=np.int64), self.level[a]
        for k, (at, rows) in enumerate(zip(self.at, self.rows)):
            if len(mine := np.flatnonzero(level == k)):
                out[mine] = np.bitwise_count(rows[at[a[mine]]] ^ rows[at[b[mine]]]).sum(axis=1)
        return out


def candidates(record: np.ndarray, bits: np.ndarray, keep: int | None = KEEP, laters: np.ndarray | None = None) -> tuple[np.ndarray, bytes | None]:
    """PAIR records of lines with a word in common that no filter rules out: for each word and later line the ``keep``
    nearest earlier ones by their bitmaps (``more``: there were others), or all. ``laters``: only of these marks.
    And the packed records of the words by which some line had others."""
    order = in_words(record)
    lanes = lanes_of(record["size"])
    record, start = record[order], (np.cumsum(lanes) - lanes)[order]
    if len(record):  # of one word and line the first copy
        same = (record["word"][1:] == record["word"][:-1]) & (record["size"][1:] == record["size"][:-1]) & (record["mark"][1:] == record["mark"][:-1])
        first = np.r_[True, ~same | (bits[start[1:]] != bits[start[:-1]])]
        record, start = record[first], start[first]
    word, size, at, mark, doc, line = (np.ascontiguousarray(record[c]) for c in ("word", "size", "at", "mark", "doc", "line"))
    bitmaps = Bitmaps(size, start, bits)
    size, at = size.astype(np.int64), at.astype(np.int64)
    asked = None if laters is None else has(laters, mark % np.uint32(FILTER_BITS))
    more = np.zeros(len(record), dtype=bool)
    held: list[tuple[np.ndarray, ...]] = []
    total = 0

    def nearest() -> None:
        """Cut what is held down to the nearest."""
        nonlocal held, total
        if held:
            later, earlier, apart, able = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((earlier, apart, later))
            later, earlier, apart, able = later[order], earlier[order], apart[order], able[order]
            if keep is not None:
                starts = np.flatnonzero(np.r_[True, later[1:] != later[:-1]])
                sizes = np.diff(np.r_[starts, len(later)])
                place = np.arange(len(later)) - np.repeat(starts, sizes)
                # A line whose nearest candidate is doubtful may fail with all of them, so more are kept; so are a few more.
                most = np.repeat(np.where((apart[starts] * 2 > able[starts]) | (sizes <= DOUBTFUL * keep), DOUBTFUL * keep, keep), sizes)
                more[later[place >= most]] = True
                later, earlier, apart, able = (x[place < most] for x in (later, earlier, apart, able))
            held, total = [(later, earlier, apart, able)], 0

    # Alike lines of sizes x and y share o words with o / (x + y - o) >= 4/5, so x + y <= o * 9/4, and o is at most what
    # either has from the common word on: this caps the other's size. Saturated sizes are larger than they say.
    cap = np.where(size == MOST, MOST, (size - at) * 9 // 4 - size)
    # Sizes rise within a word: once too long, all later ones are.
    key = (word.astype(np.int64) << 17) | size
    room = np.searchsorted(key, (word.astype(np.int64) << 17) | np.clip(np.minimum(size * 5 // 4, cap), 0, MOST), side="right") - np.arange(len(record))
    left, step = np.arange(len(record)), 0
    while len(left):
        step += 1
        left = left[room[left] > step]
        for cut in range(0, len(left), SLICE):
            a = left[cut : cut + SLICE]
            b = a + step
            open_ = size[a] <= cap[b]
            a, b = a[open_], b[open_]
            apart = bitmaps.apart(a, b)
            both = size[a] + size[b]
            able = both - 2 * -(-both * 4 // 9)  # words that may be in one of two alike lines only
            near = (apart <= able) | (size[b] == MOST)
            a, b, apart, able = a[near], b[near], apart[near], able[near]
            a_first = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))
            later, earlier = np.where(a_first, b, a), np.where(a_first, a, b)
            if asked is not None:
                wanted = asked[later]
                later, earlier, apart, able = (x[wanted] for x in (later, earlier, apart, able))
            if len(later):
                held.append((later, earlier, apart, able))
                total += len(later)
            if total > 4 * SLICE:
                nearest()
    nearest()
    out = np.empty(len(held[0][0]) if held else 0, dtype=PAIR)
    if held:
        later, earlier, apart, _ = held[0]
        # All tasks with a line send it by the same words, so here its first place is known.
        for to, c in (("doc", doc), ("line", line), ("mark", mark)):
            out[to] = c[later]
        out["home"], out["home_line"], out["home_mark"], out["apart"], out["more"] = doc[earlier], line[earlier], mark[earlier], apart, more[later]
    aside = np.flatnonzero(np.isin(word, np.unique(word[more])))
    if not len(aside):
        return out, None
    lanes = lanes_of(size[aside])
    cells = np.repeat(start[aside] - np.cumsum(lanes) + lanes, lanes) + np.arange(lanes.sum())
    return out, with_bits(record[aside], bits[cells])


def cells_of(places: DataFrame) -> DataFrame:
    """cell and bits (64 of them): a filter of FILTER_BITS bits, however many rows there are, with the bits at ``place`` set."""
    bits = places.select(F.shiftright("place", 6).alias("cell"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    return bits.groupBy("cell").agg(F.bit_or("bit").alias("bits"))


def bitmap(places: DataFrame) -> np.ndarray:
    """``cells_of`` as an array."""
    cells = cells_of(places).toPandas()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def place_of(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)).alias("place")


def line_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return doc ^ (line * LINE_STEP)


def of_documents(docs: DataFrame, cells: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id may be among those of the cells (``left_semi``), or is not (``left_anti``; null never is). The
    cells are few enough to be broadcast, however many documents there are."""
    place = place_of("doc_id")
    bit = F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0
    return docs.join(F.broadcast(cells), (F.shiftright(place, 6) == F.col("cell")) & bit, how)


def has(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    p = place.astype(np.uint64)
    return ((table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_in(table: np.ndarray, docs: DataFrame, *key: str) -> Column:
    """Whether the key's bit is set: always for keys of the filter, seldom for others."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.BooleanType())
    def test(place: pd.Series) -> pd.Series:
        return pd.Series(has(sent.value, place.to_numpy(dtype=np.int64)))

    return test(place_of(*key))


def by_later(pairs: np.ndarray, parts: int) -> pd.DataFrame:
    key = mixed(pairs["doc"].astype(np.uint64) + (pairs["mark"].astype(np.uint64) << np.uint64(32)) + pairs["line"].astype(np.uint64))
    return by_part(pairs, key, parts).assign(what=0)[["what", "part", "rows"]]


def _found(packed: DataFrame, parts: int, keep: int) -> DataFrame:
    """what 0: pairs of digests, packed by part; 1: a copy to remove (doc_id, line); 2: records for ``_rest``."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["kind"].iat[0] == 0:
            record, bits = (np.concatenate(x) for x in zip(*map(lines_of, rows["rows"])))
            pairs, hot = candidates(record, bits, keep)
            out = by_later(pairs, parts)
            if hot is not None:
                out.loc[len(out)] = {"part": 0, "rows": hot, "what": 2}
            return out.assign(doc_id=0, line=0)[["what", "part", "doc_id", "line", "rows"]]
        first = np.concatenate([records_of(x, FIRST) for x in rows["rows"]])
        if rows["kind"].iat[0] == 1:
            first = first[in_order(first)]
            first = first[~starts_of(first)]
        return pd.DataFrame({"what": 1, "part": 0, "doc_id": first["doc"], "line": first["line"], "rows": None})

    return packed.groupBy("kind", "part").applyInPandas(group, "what int, part int, doc_id long, line int, rows binary")


def _rest(found: DataFrame, parts: int, laters: np.ndarray) -> DataFrame:
    """All candidate pairs of the marks in ``laters`` by the words set aside: what, part, rows as in ``_found``. By
    their other words they had all of them before."""
    sent = found.sparkSession.sparkContext.broadcast(laters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in batch["rows"]:  # a word has all its records in one row
                record, bits = lines_of(rows)
                mine = has(sent.value, record["mark"] % np.uint32(FILTER_BITS))
                taken = np.isin(record["word"], record["word"][mine])
                pairs, _ = candidates(record[taken], bits[np.repeat(taken, lanes_of(record["size"]))], None, sent.value)
                yield by_later(pairs, parts)

    return found.filter("what = 2").select("rows").mapInPandas(run, "what int, part int, rows binary")


def _pairs(found: DataFrame) -> DataFrame:
    """home, home_line, home_mark (the earlier line), doc_id, line, mark (the later one), place, more: each candidate
    pair once (it may have come from several words); place 0 is a later line's nearest; more: some word had further
    candidates for that line."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.concatenate([records_of(x, PAIR) for x in rows["rows"]])
        pairs = pairs[np.lexsort([pairs[c] for c in (*EARLIER, "apart", *LATER)])]
        new_later = np.r_[True, np.logical_or.reduce([pairs[c][1:] != pairs[c][:-1] for c in LATER])]
        new = new_later | np.r_[True, np.logical_or.reduce([pairs[c][1:] != pairs[c][:-1] for c in EARLIER])]
        more = np.logical_or.reduceat(pairs["more"], np.flatnonzero(new_later))
        pairs, new_later = pairs[new], new_later[new]
        starts = np.flatnonzero(new_later)
        sizes = np.diff(np.r_[starts, len(pairs)])
        columns = {"doc_id" if c == "doc" else c: pairs[c].astype(np.int64 if c in ("mark", "home_mark") else pairs[c].dtype) for c in (*EARLIER, *LATER)}
        return pd.DataFrame(columns | {"place": np.arange(len(pairs)) - np.repeat(starts, sizes), "more": np.repeat(more, sizes)})

    return found.filter("what = 0").select("part", "rows").groupBy("part").applyInPandas(group, "home long, home_line int, home_mark long, doc_id long, line int, mark long, place int, more boolean")


def short_words(words: np.ndarray) -> bytes:
    """Sorted word hashes as six bytes each."""
    return np.ascontiguousarray(distinct(words >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def long_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, line, mark, words (``short_words``) of the wanted lines (doc_id, line, mark).

    Filters of a fixed size say which documents, and which lines in them, are wanted; false hits only cost a row.
    """
    hashed = F.xxhash64("doc_id")
    cell = F.pmod(hashed.bitwiseXOR(F.col("line").cast("long") * F.lit(LINE_STEP)), F.lit(FILTER_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(cell.alias("place"))))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, str]]:
        for batch in batches:
            for doc, hash_, text in zip(batch["doc_id"], batch["hash"], batch["text"]):
                own = text.split("\n")
                for i in np.flatnonzero(has(sent.value, line_hash(hash_, np.arange(len(own))) & (FILTER_BITS - 1))).tolist():
                    yield doc, i, own[i]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for x in lines(batches):
            held.append(x)
            size += len(x[2])
            if size >= CHARS:
                yield words_in(held)
                held, size = [], 0
        if held:
            yield words_in(held)

    def words_in(held: list[tuple[int, int, str]]) -> pd.DataFrame:
        own = Lines("\n".join([x for _, _, x in held]), None)
        cuts = np.searchsorted(own.line, np.r_[own.number, len(held)]) if len(own.number) else []
        place = [held[i] for i in own.number]
        out = {"doc_id": [d for d, _, _ in place], "line": [n for _, n, _ in place], "mark": (own.digest & np.uint64(0xFFFFFFFF)).astype(np.int64) if place else []}
        return pd.DataFrame(out | {"words": [short_words(own.words[a:z]) for a, z in zip(cuts, cuts[1:])]}).astype({"doc_id": "int64", "line": "int32", "mark": "int64", "words": "object"})

    homes = of_documents(docs, cells_of(wanted.select(place_of("doc_id"))), "left_semi")
    return homes.select(hashed.alias("hash"), "doc_id", "text").mapInPandas(run, "doc_id long, line int, mark long, words binary")


def shared_words(earlier: list[bytes], later: list[bytes]) -> np.ndarray:
    """How many words each pair of lines shares; of up to 2**16 pairs."""
    both = [(np.repeat(np.arange(len(side), dtype=np.uint64) << np.uint64(48), [len(x) // 6 for x in side])) | long_words(b"".join(side)) for side in (earlier, later)]
    keys = np.sort(np.concatenate(both), kind="stable")  # two runs in order
    twice = keys[1:][keys[1:] == keys[:-1]]
    return np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=len(earlier))


def _alike(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, line and mark of the later lines of pairs whose words are SIMILARITY alike, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = batch["words_earlier"].tolist(), batch["words_later"].tolist()
            size = np.array([(len(a) + len(b)) // 6 for a, b in zip(x, y)], dtype=np.int64)
            both, a = np.empty(len(x), dtype=np.int64), 0
            upto = np.cumsum(size)
            while a < len(x):  # some pairs at a time
                z = min(max(int(np.searchsorted(upto, upto[a] + PAIR_WORDS)), a + 1), a + (1 << 16))
                both[a:z], a = shared_words(x[a:z], y[a:z]), z
            yield batch.loc[both * 5 >= (size - both) * 4, ["doc_id", "line", "mark"]]

    earlier = words.select(*(F.col(c).alias(to) for c, to in zip(("doc_id", "line", "mark"), EARLIER)), F.col("words").alias("words_earlier"))
    met = pairs.join(earlier, list(EARLIER)).join(words.withColumnRenamed("words", "words_later"), ["doc_id", "line", "mark"])
    return met.select("doc_id", "line", "mark", "words_earlier", "words_later").mapInPandas(run, "doc_id long, line int, mark long").distinct()


def _sides(pairs: DataFrame) -> DataFrame:
    """doc_id, line, mark of both lines of each pair."""
    earlier = F.struct(*(F.col(c).alias(to) for c, to in zip(EARLIER, ("doc_id", "line", "mark"))))
    return pairs.select(F.explode(F.array(earlier, F.struct("doc_id", "line", "mark"))).alias("side")).select("side.*")


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs: doc_id and text, neither null. The lines to remove: doc_id, line."""
    spark, key = docs.sparkSession, ["doc_id", "line", "mark"]
    ranks, parts = frequencies(docs)
    found = materialise(_found(_records(docs, ranks, parts), parts, KEEP), "lines-found")
    release(spark)
    copies = found.filter("what = 1").select("doc_id", "line")

    def words_of(pairs: DataFrame) -> DataFrame:
        return materialise(_words(docs, materialise(_sides(pairs).distinct(), "lines-wanted")), "lines-words")

    pairs = materialise(_pairs(found), "lines-pairs")
    words = words_of(pairs)
    # One alike earlier line is enough: the nearest by its bitmap is tried first, the other kept ones where it fails.
    done = materialise(_alike(pairs.filter("place = 0"), words), "lines-alike")
    others = materialise(pairs.filter("place > 0").join(done, key, "left_anti"), "lines-pairs")
    asked = bitmap(_sides(others).select(place_of(*key)))
    more = materialise(_alike(others, words.filter(maybe_in(asked, words, *key))), "lines-alike")
    later = done.unionByName(more)
    # Where all kept ones fail and there were others, all candidates of these lines are looked for.
    open_ = materialise(pairs.filter("place = 0 and more").select(*key).join(later, key, "left_anti"), "lines-open")
    if not open_.isEmpty():
        laters = bitmap(open_.select(F.pmod("mark", F.lit(FILTER_BITS)).alias("place")))
        rest = materialise(_pairs(_rest(found, parts, laters)).join(open_, key, "left_semi"), "lines-pairs")
        later = later.unionByName(materialise(_alike(rest, words_of(rest)), "lines-alike"))
    release(spark)
    return copies.unionByName(later.select("doc_id", "line")).distinct()


def without(text: str, lines: list[int]) -> str:
    gone = set(lines)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left); one row per input row.

    Lines end at a line feed. A line without words is never removed; a null text counts as empty. doc_id is meant to
    be unique: rows with a null doc_id keep all their lines, and of rows that share one each loses the lines that are
    removed from any of them. Other columns are ignored; an empty table gives an empty result. Very long texts and lines
    are read whole; a text's lines are dealt like those of others.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    removed = materialise(removed_lines(rows.filter("doc_id is not null")), "lines-removed")
    gone = removed.groupBy("doc_id").agg(F.collect_list("line").alias("gone"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [t if g is None else without(t, g.tolist()) for t, g in zip(batch["text"], batch["gone"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_lines": [t.count("\n") + 1 for t in batch["text"]], "n_removed": [0 if g is None else len(g) for g in batch["gone"]], "text": left})

    # Texts that lose no line are passed on as they are; the filter spares them the shuffle.
    cells = cells_of(removed.select(place_of("doc_id")))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    same = of_documents(rows, cells, "left_anti").select("doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), "text")
    cleaned = of_documents(rows, cells, "left_semi").join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInPandas(clean, "doc_id long, n_lines long, n_removed long, text string")
    return same.unionByName(cleaned)


def line_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``line_dedup`` with the SHA-256 of what is left instead of the text."""
    done = line_dedup(docs, text, doc_id)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
