"""The search index, in segments: each holds the sections of some documents, and hides these documents in the segments
before it. A change of documents writes one small segment; segments of like sizes are merged.

A segment is a folder of Parquet tables:
  rows      a row for each section, sorted by document: its number, terms with frequencies and places, grams
  postings  a row for each term and section, sorted by term, then level downwards: what a query reads is a few row groups
  levels    term, level: number of postings
  grams     gram, bucket: the numbers of the sections (or, scope 1, of documents' profiles) with that run of 2 or 3 signs
  hidden    documents that this segment replaces or deletes in those before it
  minus     term: how many postings that hides; totals: sections and tokens, added less hidden

Numbers of sections, tokens and postings are sums over segments, so ranks equal those of an index built at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.functions import text as X

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: A posting's level is so many times its score without the term's idf, at the mean length of the first segment's texts.
LEVELS = 100
#: A place is the number of the column (title, heading path, content) shifted by so many bits, and the token's number.
PART_BITS = 28
#: Postings that the first round of a search by bounds may read; each further round reads so many times more.
FIRST_READ, MORE = 1 << 16, 16
#: Up to so many canonical documents are scored from their own rows.
FEW_DOCUMENTS = 1000
#: Rarest grams of a term whose lists are intersected.
RAREST = 4
#: Sections of a bucket of gram lists, as a power of two.
BUCKET_BITS = 16
#: A segment of so few sections is one file of each table, sorted without a sampling job.
SMALL = 2000
#: So many segments at the end are merged, if none is over SIZES times as large as all after it.
MERGED, SIZES = 4, 4
#: A rare word's sections up to this number are broadcast to thin out the others' postings.
BROADCAST_IDS = 100_000

ROW = pa.schema([
    ("section_id", pa.string()), ("document_id", pa.string()), ("ordinal", pa.int32()), ("print", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("f", pa.list_(pa.int32())),
    ("places", pa.list_(pa.list_(pa.int32()))), ("grams", pa.list_(pa.int64())), ("profile_grams", pa.list_(pa.int64())),
])
ROWS = "section_id string, document_id string, ordinal int, print long, dl int, terms array<string>, f array<int>, places array<array<int>>, grams array<long>, profile_grams array<long>"
TABLES = {
    "rows": f"{ROWS}, no long", "postings": "term string, section_id string, document_id string, dl int, f int, places array<int>, level int", "levels": "term string, level int, n long",
    "grams": "scope int, gram long, bucket long, nos array<int>, n int", "hidden": "document_id string", "minus": "term string, n long", "totals": "n long, tokens long, sign int",
}
#: Rows of one batch that goes back to Spark.
SENT = 64


def grams_of(text: str) -> np.ndarray:
    """The distinct runs of two and of three signs, with ASCII capitals as small letters, as numbers; none across NUL."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    c += ((c >= 65) & (c <= 90)) * 32
    two = (c[:-1] << 21 | c[1:])[(c[:-1] > 0) & (c[1:] > 0)]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[(c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)] if len(c) > 2 else two[:0]
    return np.unique(np.concatenate((two, three)))


def asked_grams(term: str) -> list[int]:
    """The grams that a text with this term must have: of three signs if it is that long."""
    found = grams_of(term)
    three = found[found >= 1 << 42]
    return (three if len(three) else found).tolist()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, out = None, []

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), ROW, strict=True)], schema=ROW)

    for batch in batches:
        for r in batch.to_pylist():
            places: dict[str, list[int]] = {}
            dl = 0
            for part, name in enumerate(("title", "heading_path", "content")):
                tokens = X.index_tokens_of(r[name])
                dl += len(tokens)
                for i, t in enumerate(tokens, part << PART_BITS):
                    places.setdefault(t, []).append(i)
            texts = "\0".join(r[c] for c in ("document_title", "title", "heading_path", "content"))
            profile = grams_of(f"{r['desc']}\0{r['profile_json']}") if r["document_id"] != last else None
            last = r["document_id"]
            out.append((r["section_id"], last, r["ordinal"], r["print"], dl, list(places), [len(p) for p in places.values()], list(places.values()), grams_of(texts), profile))
            if len(out) >= SENT:
                yield sent()
                out.clear()
    if out:
        yield sent()


def searchable(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """section_id, document_id, ordinal, the texts of a section and of its document, print (of all of these; of the content
    by its hash where sections have one). documents: document_id, document_title, desc, profile_json."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = sections.select(F.col("id").alias("section_id"), "document_id", "ordinal", *[blank(c).alias(c) for c in ("title", "heading_path", "content")], F.col("content_hash" if "content_hash" in sections.columns else "content").alias("hashed"))
    of = documents.select("document_id", *[blank(c).alias(c) for c in ("document_title", "desc", "profile_json")])
    seen = F.xxhash64("ordinal", "title", "heading_path", "hashed", "document_title", "desc", "profile_json")
    return own.join(of, "document_id").withColumn("print", seen).drop("hashed")


def saturation(f: Column | float, dl: Column | float, mean: float) -> Column | float:
    return f * (K1 + 1.0) / (f + K1 * (1 - B + B * dl / mean))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


@dataclass
class Stats:
    """Of some terms: df, and n of each of their levels; n and avgdl of the index, and the mean length that levels are of."""

    df: dict[str, int]
    levels: dict[str, dict[int, int]]
    n: int
    avgdl: float
    mean: float

    def bound(self, level: int) -> float:
        """No posting of the level has this score. A score grows with the mean length, but not faster than it."""
        return (level + 1) / LEVELS * max(1.0, self.avgdl / self.mean)

    def idf(self, df: int) -> float:
        return max(log((self.n - df + 0.5) / (df + 0.5)), LEAST_IDF)


class Segments:
    """names: the segments' folders under root, the oldest first; sizes: their numbers of sections."""

    def __init__(self, spark: SparkSession, root: str, names: list[str], sizes: list[int]):
        self.spark, self.root, self.names, self.sizes = spark, root.rstrip("/"), names, sizes

    @classmethod
    def create(cls, sections: DataFrame, documents: DataFrame, root: str) -> Segments:
        """A new index in one segment."""
        return cls(sections.sparkSession, root, [], []).updated(sections, documents)

    # Tables ---------------------------------------------------------------------------------------------------------

    def _read(self, table: str, names: list[str] | None = None) -> DataFrame:
        """The table of all segments, with the segment's place as seg."""
        frames = [self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{name}/{table}").withColumn("seg", F.lit(i)) for i, name in enumerate(self.names if names is None else names)]
        return reduce(DataFrame.unionByName, frames)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the rows of documents that a later segment hides."""
        if len(self.names) < 2:
            return rows
        last = self._read("hidden").groupBy("document_id").agg(F.max("seg").alias("last"))
        return rows.join(last, "document_id", "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("seg"))).drop("last")

    def rows(self) -> DataFrame:
        return self._live(self._read("rows"))

    # Upkeep ---------------------------------------------------------------------------------------------------------

    def updated(self, sections: DataFrame, documents: DataFrame) -> Segments:
        """The index of these sections: a segment more for the documents that differ, if any do."""
        now = searchable(sections, documents)
        if not self.names:
            return self._with(now, None)
        mine, had = now.select("section_id", "document_id", "print"), self.rows().select("section_id", F.col("document_id").alias("had_document"), F.col("print").alias("had"))
        changed = mine.join(had, "section_id", "full_outer").filter(~F.col("print").eqNullSafe(F.col("had")) | ~F.col("document_id").eqNullSafe(F.col("had_document")))
        changed = changed.select(F.explode(F.array("document_id", "had_document")).alias("document_id")).filter("document_id is not null").distinct()
        name = f"index/{uuid.uuid4().hex}"
        changed.write.parquet(f"{self.root}/{name}/hidden")
        changed = self.spark.read.parquet(f"{self.root}/{name}/hidden")
        if changed.isEmpty():
            return self
        return self._with(now.join(changed, "document_id", "left_semi"), changed, name)._merged()

    def _with(self, texts: DataFrame, hidden: DataFrame | None, name: str = "") -> Segments:
        ordered = texts.repartitionByRange("document_id").sortWithinPartitions("document_id", "ordinal", "section_id")
        rows = ordered.select("section_id", "document_id", "ordinal", "print", "title", "heading_path", "content", "document_title", "desc", "profile_json").mapInArrow(_parsed, ROWS)
        return self._written(rows.withColumn("no", F.monotonically_increasing_id()), hidden, name or f"index/{uuid.uuid4().hex}")

    def _written(self, rows: DataFrame, hidden: DataFrame | None, name: str) -> Segments:
        """Adds a segment of these rows, which hides the documents ``hidden`` (written already) in what is there."""
        at = f"{self.root}/{name}"
        rows.write.parquet(f"{at}/rows")
        rows = self.spark.read.schema(rows.schema).parquet(f"{at}/rows")
        own, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        first = self._read("totals", self.names[:1]).filter("sign = 1").first() if self.names else {"n": own, "tokens": tokens}
        mean = max(1.0, first["tokens"] / max(1, first["n"]))

        def put(frame: DataFrame, table: str, *by: Column | str) -> None:
            dealt = frame.coalesce(1) if own <= SMALL else frame.repartitionByRange(*by)
            dealt.sortWithinPartitions(*by).write.parquet(f"{at}/{table}")

        posts = rows.select("section_id", "document_id", "dl", F.explode(F.arrays_zip("terms", "f", "places")).alias("t"))
        posts = posts.select(F.col("t.terms").alias("term"), "section_id", "document_id", "dl", F.col("t.f").alias("f"), F.col("t.places").alias("places"))
        posts = posts.withColumn("level", F.floor(saturation(F.col("f").cast("double"), F.col("dl"), mean) * LEVELS).cast("int"))
        put(posts, "postings", F.col("term"), F.col("level").desc(), F.col("section_id"))
        counts = self.spark.read.parquet(f"{at}/postings").groupBy("term", "level").agg(F.count("*").alias("n"))
        put(counts, "levels", "term")
        each = [rows.select("no", F.lit(scope).alias("scope"), F.explode(c).alias("gram")) for scope, c in enumerate(("grams", "profile_grams"))]
        grams = each[0].unionByName(each[1]).groupBy("scope", "gram", F.shiftright("no", BUCKET_BITS).alias("bucket"))
        grams = grams.agg(F.sort_array(F.collect_list(F.col("no").bitwiseAND((1 << BUCKET_BITS) - 1).cast("int"))).alias("nos"))
        put(grams.withColumn("n", F.size("nos")), "grams", "scope", "gram")
        if hidden is None:
            hidden = rows.limit(0).select("document_id")
            hidden.write.parquet(f"{at}/hidden")
        gone = self.rows().join(hidden, "document_id", "left_semi") if self.names else rows.limit(0)
        minus = gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        minus.coalesce(1).sortWithinPartitions("term").write.parquet(f"{at}/minus")
        sums = lambda f, sign: f.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).select((sign * F.col("n")).alias("n"), (sign * F.coalesce("tokens", F.lit(0))).alias("tokens"), F.lit(sign).alias("sign"))
        totals = sums(rows, 1).unionByName(sums(gone, -1))
        totals.coalesce(1).write.parquet(f"{at}/totals")
        return Segments(self.spark, self.root, [*self.names, name], [*self.sizes, own])

    def _merged(self) -> Segments:
        last = 1
        while last < len(self.names) and self.sizes[-last - 1] <= SIZES * sum(self.sizes[-last:]):
            last += 1
        if last < MERGED:
            return self
        first = len(self.names) - last
        before = Segments(self.spark, self.root, self.names[:first], self.sizes[:first])
        rows = self.rows().filter(F.col("seg") >= first).drop("seg", "no")
        # The order by document stays, so that the first row of a document still has its profile's grams.
        rows = rows.repartitionByRange("document_id").sortWithinPartitions("document_id", "ordinal", "section_id").withColumn("no", F.monotonically_increasing_id())
        name = f"index/{uuid.uuid4().hex}"
        hidden = None
        if first:
            self._read("hidden", self.names[first:]).select("document_id").distinct().write.parquet(f"{self.root}/{name}/hidden")
            hidden = self.spark.read.parquet(f"{self.root}/{name}/hidden")
        return before._written(rows, hidden, name)

    # Words and phrases ------------------------------------------------------------------------------------------------

    def stats(self, terms: list[str]) -> Stats:
        """One small job: at most LEVELS * 2.2 rows of each term."""
        asked = F.col("term").isin(*terms) if terms else F.lit(False)
        levels = self._read("levels").filter(asked).groupBy("term", "level").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("tokens"))
        minus = self._read("minus").filter(asked).select("term", F.lit(-1).alias("level"), (-F.col("n")).alias("n"), F.lit(0).cast("long").alias("tokens"))
        totals = self._read("totals").select(F.lit(None).cast("string").alias("term"), F.when((F.col("seg") == 0) & (F.col("sign") == 1), 0).otherwise(1).alias("level"), "n", "tokens")
        df, found, n, tokens, mean = dict.fromkeys(terms, 0), {t: {} for t in terms}, 0, 0, 1.0
        for r in levels.unionByName(minus).unionByName(totals).collect():
            if r["term"] is None:
                n, tokens = n + r["n"], tokens + r["tokens"]
                if r["level"] == 0:
                    mean = max(1.0, r["tokens"] / max(1, r["n"]))
            else:
                df[r["term"]] += r["n"]
                if r["level"] >= 0:
                    found[r["term"]][r["level"]] = r["n"]
        return Stats(df, found, n, tokens / n if n else 0.0, mean)

    def _postings(self, wanted: Column, *more: str) -> DataFrame:
        rows = self._read("postings").filter(wanted)  # reaches the scan
        return self._live(rows.select("term", "section_id", "document_id", "dl", "f", "seg", *more))

    def phrase(self, words: list[str], stats: Stats) -> DataFrame:
        """section_id, document_id, dl, f: how often the words stand in a row within one column of a section."""
        if len(words) == 1:
            return self._postings(F.col("term") == words[0]).select("section_id", "document_id", "dl", "f")
        own = self._postings(F.col("term").isin(*set(words)), "places")
        rare = min(set(words), key=lambda w: stats.df[w])
        if stats.df[rare] <= BROADCAST_IDS and 4 * stats.df[rare] < max(stats.df[w] for w in words):
            own = own.join(F.broadcast(self._postings(F.col("term") == rare).select("section_id")), "section_id", "left_semi")
        met = own.groupBy("section_id", "document_id", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("of"))
        starts = reduce(F.array_intersect, [_moved(F.element_at("of", F.lit(w)), i) for i, w in enumerate(words)])
        return met.filter(F.size("of") == len(set(words))).select("section_id", "document_id", "dl", F.size(starts).alias("f")).filter("f > 0")

    def match(self, phrases: list[list[str]], limit: int, canonical: DataFrame | None = None, stale: DataFrame | None = None) -> list[tuple[bool, float, str, str]]:
        """(canonical, rank, section_id, document_id) of the best sections: those of ``canonical`` documents (document_id)
        first, then by rank, then section_id; none of ``stale`` documents (each id once in both). rank is minus the BM25 sum over the phrases;
        phrases without words are none."""
        phrases = [p for p in phrases if p]
        if not phrases or not self.names:
            return []
        none = self.spark.createDataFrame([], "document_id string")
        canonical, stale = (none if f is None else f.select("document_id") for f in (canonical, stale))  # each id once
        stats = self.stats(sorted({w for p in phrases for w in p}))

        def ordered(scored: DataFrame) -> list[tuple[bool, float, str, str]]:
            flagged = scored.join(stale, "document_id", "left_anti").join(canonical.withColumn("canonical", F.lit(True)), "document_id", "left")
            best = flagged.withColumn("canonical", F.coalesce("canonical", F.lit(False))).orderBy(F.desc("canonical"), F.desc("score"), "section_id").limit(limit)
            return [(r["canonical"], -r["score"], r["section_id"], r["document_id"]) for r in best.select("canonical", "score", "section_id", "document_id").collect()]

        if any(len(p) > 1 for p in phrases):
            hits = reduce(DataFrame.unionByName, [self.phrase(p, stats).withColumn("phrase", F.lit(i)) for i, p in enumerate(phrases)]).persist()
            try:
                counts = {r["phrase"]: r["count"] for r in hits.groupBy("phrase").count().collect()}
                return ordered(self._scored(hits, "phrase", list(range(len(phrases))), [stats.idf(counts.get(i, 0)) for i in range(len(phrases))], stats))
            finally:
                hits.unpersist()
        words = [p[0] for p in phrases]
        if sum(sum(stats.levels[w].values()) for w in set(words)) <= FIRST_READ:
            return ordered(self._scored(self._postings(F.col("term").isin(*set(words))), "term", words, [stats.idf(stats.df[w]) for w in words], stats))
        canonical = canonical.join(stale, "document_id", "left_anti")
        few = [r["document_id"] for r in canonical.limit(FEW_DOCUMENTS + 1).collect()]
        if len(few) <= FEW_DOCUMENTS:
            first = self._exact(X.one_of("document_id", few), words, stats, limit) if few else []
        else:
            first = self._by_bounds(words, stats, limit, lambda rows: rows.join(canonical, "document_id", "left_semi"))
        others: list[tuple[float, str, str]] = []
        if len(first) < limit:
            others = self._by_bounds(words, stats, limit - len(first), lambda rows: rows.join(canonical.unionByName(stale), "document_id", "left_anti"))
        return [(True, *x) for x in first] + [(False, *x) for x in others]

    @staticmethod
    def _scored(hits: DataFrame, key: str, values: list, idf: list[float], stats: Stats) -> DataFrame:
        """section_id, document_id, score, seen (by place in ``values`` whether it hit); sums always in the same order."""
        distinct = list(dict.fromkeys(values))
        of = hits.groupBy("section_id", "document_id", "dl").agg(*[F.max(F.when(F.col(key) == v, F.col("f"))).alias(f"f{i}") for i, v in enumerate(distinct)])
        one = lambda i, w: F.coalesce(saturation(F.col(f"f{i}").cast("double"), F.col("dl"), stats.avgdl) * w, F.lit(0.0))
        score = reduce(Column.__add__, [one(distinct.index(v), w) for v, w in zip(values, idf, strict=True)])
        return of.select("section_id", "document_id", score.alias("score"), F.array(*[F.col(f"f{distinct.index(v)}").isNotNull() for v in values]).alias("seen"))

    def _by_bounds(self, words: list[str], stats: Stats, limit: int, keep: Callable[[DataFrame], DataFrame]) -> list[tuple[float, str, str]]:
        """The best sections for any of the words. Levels are read from the highest possible score downwards, until no
        section outside what was read can come among the best; those are then scored from their own rows."""
        idf = [stats.idf(stats.df[w]) for w in words]
        weight: dict[str, float] = {}
        for w, x in zip(words, idf, strict=True):
            weight[w] = weight.get(w, 0.0) + x
        parts = sorted(((weight[w] * stats.bound(level), w, level, n) for w in weight for level, n in stats.levels[w].items()), reverse=True)
        budget = FIRST_READ
        while parts:
            cut, read = {}, 0
            for _, w, level, n in parts:
                if read >= budget:
                    break
                cut[w], read = level, read + n
            left = {w: max((s for s, x, level, _ in parts if x == w and level < cut.get(w, 1 << 30)), default=0.0) for w in weight}
            wanted = reduce(Column.__or__, [(F.col("term") == w) & (F.col("level") >= c) for w, c in cut.items()])
            found = self._scored(keep(self._postings(wanted)), "term", words, idf, stats)
            if not any(left.values()):
                return [(-r["score"], r["section_id"], r["document_id"]) for r in found.orderBy(F.desc("score"), "section_id").limit(limit).collect()]
            unseen = {w: left[w] / words.count(w) for w in weight}
            upper = reduce(Column.__add__, [F.when(F.col("seen")[i], 0.0).otherwise(unseen[w]) for i, w in enumerate(words)], F.col("score"))
            best = found.withColumn("upper", upper).orderBy(F.desc("upper"), "section_id").limit(4 * limit + 1).collect()
            other = sum(left.values())
            if len(best) > 4 * limit:
                other = max(other, best.pop()["upper"])
            exact = self._exact(X.one_of("document_id", (r["document_id"] for r in best)) & X.one_of("section_id", (r["section_id"] for r in best)), words, stats, limit)
            if len(exact) >= limit and -exact[limit - 1][0] > other * (1 + 1e-9):
                return exact[:limit]
            budget *= MORE
        return []

    def _exact(self, wanted: Column, words: list[str], stats: Stats, limit: int) -> list[tuple[float, str, str]]:
        """The best of some sections by whole scores, from their own rows, which are sorted by document."""
        of = F.map_from_arrays("terms", "f")
        own = self._live(self._read("rows").filter(wanted)).select("section_id", "document_id", "dl", of.alias("of"))
        hits = own.select("section_id", "document_id", "dl", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.try_element_at("of", F.lit(w)).alias("f")) for w in dict.fromkeys(words)])).alias("h"))
        scored = self._scored(hits.select("section_id", "document_id", "dl", "h.*").filter("f is not null"), "term", words, [stats.idf(stats.df[w]) for w in words], stats)
        return [(-r["score"], r["section_id"], r["document_id"]) for r in scored.orderBy(F.desc("score"), "section_id").limit(limit).collect()]

    # Substrings -------------------------------------------------------------------------------------------------------

    def _candidates(self, terms: list[str], scope: int) -> DataFrame:
        """no, seg, term_no: the sections (scope 1: of each document one) that have the rarest grams of a term."""
        asked = {i: asked_grams(t) for i, t in enumerate(terms)}
        every = sorted({g for gs in asked.values() for g in gs})
        own = self._read("grams").filter((F.col("scope") == scope) & F.col("gram").isin(*every)) if every else None
        sizes = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.sum("n").alias("n")).collect()} if every else {}
        chosen, frames = [], []
        for i, gs in asked.items():
            if gs and all(g in sizes for g in gs):
                rare = sorted(gs, key=lambda g: (sizes[g], g))[:RAREST]
                chosen += [(g, i, len(rare)) for g in rare]
        if chosen:
            of = self.spark.createDataFrame(chosen, "gram long, term_no int, need int")  # a few for each term
            lists = own.filter(F.col("gram").isin(*{g for g, _, _ in chosen})).join(F.broadcast(of), "gram")
            met = lists.groupBy("seg", "bucket", "term_no", "need").agg(F.collect_list("nos").alias("lists")).filter(F.size("lists") == F.col("need"))
            both = F.aggregate("lists", F.element_at("lists", 1), F.array_intersect)
            frames.append(met.select("seg", "term_no", F.explode(both).alias("off"), "bucket").select((F.shiftleft("bucket", BUCKET_BITS) + F.col("off")).alias("no"), "seg", "term_no"))
        for i, gs in asked.items():
            if not gs:  # one sign only: any section may have it
                rows = self._read("rows")
                frames.append((rows.filter("profile_grams is not null") if scope else rows).select("no", "seg", F.lit(i).alias("term_no")))
        if not frames:
            return self._read("rows").limit(0).select("no", "seg", F.lit(0).alias("term_no"))
        return reduce(DataFrame.unionByName, frames)

    def substrings(self, terms: list[str], limit: int, documents: DataFrame, verified: Callable[[list[str], list[str]], set[tuple[str, int]]], in_profile: bool = False) -> list[tuple[int, int, str, str, int]]:
        """(term, place, section_id, document_id, ordinal) of at most ``limit`` sections for each term, canonical documents
        first, then by the document's title, ordinal and id. documents: document_id, document_title, canonical.
        verified: which of some sections (their ids, and their documents') hold which term.

        Candidates are ordered first and verified from the top, so common terms read few texts.
        """
        if not self.names or not terms:
            return []
        light = self._read("rows").select("no", "seg", "section_id", "document_id", "ordinal")
        found = self._candidates(terms, int(in_profile)).join(light, ["no", "seg"])
        if in_profile:
            every = self._live(light.drop("no")).withColumnRenamed("seg", "own_seg")
            found = self._live(found).select("term_no", "document_id", F.col("seg").alias("own_seg")).join(every, ["document_id", "own_seg"])
        else:
            found = self._live(found)
        order = W.partitionBy("term_no").orderBy(F.desc("canonical"), "document_title", "ordinal", "section_id")
        found = found.join(documents, "document_id").withColumn("place", F.row_number().over(order))
        taken, most, good, out = 0, 4 * limit, {i: 0 for i in range(len(terms))}, []
        while good:
            # A rank with a small bound: Spark cuts each task's rows to the bound before the shuffle by term.
            rows = found.filter(F.col("term_no").isin(*good) & (F.col("place") <= most)).filter(F.col("place") > taken).select("term_no", "place", "section_id", "document_id", "ordinal").collect()
            holds = verified(sorted({r["section_id"] for r in rows}), sorted({r["document_id"] for r in rows})) if rows else set()
            for r in sorted(rows, key=lambda r: (r["term_no"], r["place"])):
                if (r["section_id"], r["term_no"]) in holds and good[r["term_no"]] < limit:
                    good[r["term_no"]] += 1
                    out.append((r["term_no"], r["place"], r["section_id"], r["document_id"], r["ordinal"]))
            full = {i for i in good if sum(r["term_no"] == i for r in rows) == most - taken}  # there may be more
            good = {i: n for i, n in good.items() if i in full and n < limit}
            taken, most = most, 8 * most
        return out
