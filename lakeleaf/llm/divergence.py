"""Operator 13, source divergence audit: how far the words of each source are from those of its peers in a language.

A group is a language and a source. Its counts of terms become a vector, cut into slices of the terms and compressed.
Groups have seats. A seat's vectors stay in their partition (a bucketed table); those of other seats come by in the
rounds of a round-robin tournament, in which any two seats of a language meet once. A meeting evaluates both directions
of each pair. The terms that stand out in a group are ranked by a heap for each slice, whose best rows are merged.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeleaf.llm.common import fresh_path, materialise

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Ranks of terms that are reported.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: About so many counted (group, term) rows come to a slice of the terms; a slice of a group is one compressed vector.
SLICE_ROWS = 1 << 17
#: Seats of a language: four, or as many as it takes to have at most so many groups on each.
LEAST_SEATS, SEAT_GROUPS = 4, 32
#: A task passes its counts on when it holds so many.
HELD = 1 << 18
#: Long texts are read in parts of about so many bytes, cut where no term is.
PART = 1 << 20

#: For each byte its lower case if it belongs to terms (letters of ASCII and all bytes beyond it), else a blank.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_parts(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, in lists of bounded length: runs of ASCII letters, of which A-Z are
    lower-cased, and of all characters beyond ASCII."""
    at = 0
    while at < len(data):
        part = data[at : at + PART].translate(FOLD)
        at += len(part)
        if at < len(data):
            last = part.rfind(b" ")
            if last > 0:
                at -= len(part) - last
                part = part[:last]
            else:  # a term as long as a part: up to its end
                more, stop = [part], -1
                while at < len(data) and stop < 0:
                    rest = data[at : at + PART].translate(FOLD)
                    stop = rest.find(b" ")
                    more.append(rest if stop < 0 else rest[:stop])
                    at += len(more[-1])
                part = b"".join(more)
        yield part.split()


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs: one row for each term of a group, and one without a term for each group."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def pass_on() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), (n, in_docs) in held.items():
                terms = [None, *n]
                columns = ([own_lang] * len(terms), [own_source] * len(terms), terms, [0, *n.values()], [0, *map(in_docs.__getitem__, n)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, COUNTED, strict=True)], schema=COUNTED)
            held.clear()

        size = 0
        for batch in batches:
            for group, value in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True), batch.column("data"), strict=True):
                if group not in held:
                    held[group] = Counter(), Counter()
                n, in_docs = held[group]
                before, own = len(n), set()
                for terms in term_parts(value.as_py()):
                    n.update(terms)
                    own.update(terms)
                in_docs.update(own)
                size += len(n) - before
                if size >= HELD:
                    yield from pass_on()
                    size = 0
        yield from pass_on()

    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def sliced(counts: DataFrame, slices: int, least_docs: int) -> DataFrame:
    """lang, slice, source, entries (id, n, lang_n, term of each kept term that occurs, by id), size (the slice's terms up
    to the group's last), total: one row for each group and slice.

    A slice's kept terms are numbered from 0 in byte order. One exchange: all steps go by language and slice.
    """
    of = F.when(F.col("term").isNull(), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")))
    rows = counts.withColumn("slice", F.explode(of)).repartition("lang", "slice")
    same = Window.partitionBy("lang", "slice", "term")
    rows = rows.withColumns({"in_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same)}).filter((F.col("in_docs") >= least_docs) | F.col("term").isNull())
    # The rows without a term, one of each group, come first and have number -1.
    rows = rows.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy(F.col("term").asc_nulls_first())) - 2)
    entry = F.when(F.col("term").isNotNull(), F.struct("id", "n", "lang_n", "term"))
    found = rows.groupBy("lang", "slice", "source").agg(F.sort_array(F.collect_list(entry)).alias("entries"), (F.max("id") + 1).alias("size"), F.sum("n").alias("total"))
    return found.select("lang", "slice", "source", "entries", "size", "total")


def _scaled(n: np.ndarray | int, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / whole), exact while ``whole`` is under 9 * 10**15: the digits come three at a time."""
    rest, out = np.asarray(n, dtype=np.int64) + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64)), np.frombuffer(data, "<i8", n, offset=4 * n)


SEATED = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("seat", pa.int32()), ("source", pa.string()), ("size", pa.int64()), ("whole", pa.int64()), ("vector", pa.large_binary()), ("best_term", pa.list_(pa.binary())), ("best_value", pa.list_(pa.int64()))])


def seated(rows: DataFrame, top: int) -> DataFrame:
    """Each slice of a group as a compressed vector, with the ``top`` terms of its heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, entries in enumerate(batch.column("entries")):
                at = {name: batch.column(name)[i].as_py() for name in ("lang", "slice", "seat", "source", "size", "whole", "lang_whole")}
                flat = entries.values
                ids, n, lang_n = (np.asarray(flat.field(k), dtype=np.int64) for k in range(3))
                p, q = _scaled(n, max(1, at["whole"])), _scaled(lang_n, max(1, at["lang_whole"]))
                value = _divergence(p, q)
                over = np.flatnonzero((p > q) & (n > 0))
                best = heapq.nsmallest(top, zip((-value[over]).tolist(), flat.field(3).take(pa.array(over)).to_pylist(), strict=True))
                row = (at["lang"], at["slice"], at["seat"], at["source"], at["size"], at["whole"], packed(ids, n), [t for _, t in best], [-v for v, _ in best])
                yield pa.RecordBatch.from_arrays([pa.array([c], k.type) for c, k in zip(row, SEATED, strict=True)], schema=SEATED)

    return rows.mapInArrow(run, "lang string, slice int, seat int, source string, size long, whole long, vector binary, best_term array<binary>, best_value array<long>")


class _Vectors:
    """The vectors of one seat in one slice: counts and scaled shares of the terms that occur, shares of all."""

    def __init__(self, rows: pa.Table):
        self.source, self.known, self.share, self.dense, self.has = rows.column("source").to_pylist(), [], [], [], []
        self.none = []  # share of a term that doesn't occur
        for size, whole, vector in zip(*(rows.column(c).to_pylist() for c in ("size", "whole", "vector")), strict=True):
            ids, n = unpacked(vector)
            share, none = _scaled(n, max(1, whole)), int(_scaled(0, max(1, whole)))
            dense, has = np.full(size, none, dtype=np.int64), np.zeros(size, dtype=bool)
            dense[ids], has[ids] = share, True
            self.size = size
            for held, x in ((self.known, ids), (self.share, share), (self.dense, dense), (self.has, has), (self.none, none)):
                held.append(x)

    def meet(self, i: int, other: _Vectors, j: int) -> tuple[int, int]:
        """Sums over all terms of the slice of what i is from j, and j from i."""
        p, q = self.share[i], other.dense[j][self.known[i]]
        only = other.known[j][~self.has[i][other.known[j]]]
        p2, q2 = self.none[i], other.dense[j][only]
        rest, a, b = self.size - len(p) - len(only), self.none[i], other.none[j]
        d, d2 = p - q, p2 - q2
        d *= d
        d2 *= d2
        return (
            int((d // q).sum() + (d2 // q2).sum()) + rest * ((a - b) ** 2 // b),
            int((d // p).sum() + (d2 // p2).sum()) + rest * ((a - b) ** 2 // a),
        )


MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _meeting(lang: str, here: _Vectors, there: _Vectors | None) -> pa.Table:
    found = []
    for i, a in enumerate(here.source):
        other = there or here
        for j in range(len(other.source)) if there else range(i):
            one, two = here.meet(i, other, j)
            found += [(lang, a, other.source[j], one), (lang, other.source[j], a, two)]
    return pa.table([pa.array(c, k.type) for c, k in zip(zip(*found, strict=True), MET, strict=True)] if found else [[]] * 4, schema=MET)


def partner(seat: Column, turn: int, seats: int) -> Column:
    """Whom a seat meets in a round, by the circle method: an even number of seats, rounds from 0 to seats - 2."""
    odd = seats - 1
    other = F.pmod(F.lit(turn) - seat, F.lit(odd))
    return F.when(seat == odd, F.lit(turn * (seats // 2) % odd)).when(other == seat, F.lit(odd)).otherwise(other).cast("int")


def tournament(spark: SparkSession, vectors: DataFrame, seats: int) -> DataFrame:
    """lang, source, item, value: the sum of both directions of any two groups of a language.

    The residents' table is bucketed by (lang, slice, seat), so in each round only the travelling half is shuffled, to
    the buckets of those that it meets.
    """
    cells = ["lang", "slice", "seat"]
    name = f"residents_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    light = vectors.select(*cells, "source", "size", "whole", "vector")
    light.repartition(buckets, *cells).write.bucketBy(buckets, *cells).format("parquet").option("path", fresh_path(spark, "residents")).saveAsTable(name)
    residents = spark.table(name)
    schema = "lang string, source string, item string, value long"
    home = residents.groupBy(*cells).applyInArrow(lambda key, rows: _meeting(key[0].as_py(), _Vectors(rows), None), schema)
    summed = lambda met: met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rounds = [materialise(summed(home), "meetings")]
    for turn in range(seats - 1):
        peer = partner(F.col("seat"), turn, seats)
        visitors = residents.filter(F.col("seat") > peer).withColumn("seat", peer)
        met = residents.groupBy(*cells).cogroup(visitors.groupBy(*cells)).applyInArrow(_visit, schema)
        rounds.append(materialise(summed(met), "meetings"))
    spark.sql(f"drop table if exists {name}")
    return summed(reduce(DataFrame.unionByName, rounds))


def _visit(key: tuple, here: pa.Table, there: pa.Table) -> pa.Table:
    if not here.num_rows or not there.num_rows:
        return MET.empty_table()
    return _meeting(key[0].as_py(), _Vectors(here), _Vectors(there))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each group (lang, source) apart.

    Of a language the V terms in at least ``least_docs`` of its documents are kept. Among them a group, or the whole
    language, with N occurrences in all gives a term with n >= 0 of them p = 1 + floor(10**9 (n + 1) / (N + V)), and
    f(p, q) = floor((p - q)**2 / q). Part ``pair``: for each other source of the language the sum of f over all kept
    terms (0 if there are none), q being the other's. Part ``term``: the ``top`` terms of the group with p > q and their
    f, q being the language's. Ranks go by value downwards, then by the item's bytes.

    Null texts, languages and sources are empty ones; each is a group like others, also without any term. Repeated rows
    count each time. An empty table gives an empty result, other columns are ignored, long texts are read in parts. A
    group with a third of all rows is one vector like the others, counted in each task before rows are shuffled.
    Exact while a language has under 9 * 10**15 occurrences.
    """
    spark = docs.sparkSession
    counts = materialise(counted(docs, text, lang, source), "term-counts")
    slices = max(16, counts.count() // SLICE_ROWS)
    pieces = materialise(sliced(counts, slices, least_docs), "slices")
    sizes = pieces.groupBy("lang", "slice").agg(F.max("size").cast("long").alias("size"))
    groups = pieces.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n_groups")).join(sizes.groupBy("lang").agg(F.sum("size").alias("kept")), "lang")
    langs = materialise(langs, "languages")
    seats = LEAST_SEATS
    if most := langs.agg(F.max("n_groups")).first()[0]:
        seats = max(seats, 2 * -(-most // (2 * SEAT_GROUPS)))
    seat = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) % seats).cast("int")
    groups = groups.withColumn("seat", seat).join(langs, "lang")
    groups = groups.select("lang", "source", "seat", (F.col("total") + F.col("kept")).alias("whole"), (F.col("lang_total") + F.col("kept")).alias("lang_whole"))
    rows = pieces.select("lang", "slice", "source", "entries").join(materialise(sizes, "slice-sizes"), ["lang", "slice"]).join(materialise(groups, "groups"), ["lang", "source"])
    vectors = materialise(seated(rows, top), "vectors")
    pairs = tournament(spark, vectors, seats)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = vectors.select("lang", "source", F.explode(F.arrays_zip("best_term", "best_value")).alias("b"))
    best = best.select("lang", "source", F.col("b.best_term").cast("string").alias("item"), F.col("b.best_value").alias("value"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(best.select(*columns("term")))
