"""Operator 1, near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted
Jaccard similarity.

1. Exact document frequencies of all shingles. Documents are dealt to chunks of about CHUNK characters by a hash; a chunk
   sends each of its shingles once, with the number of its documents that have it, to the shingle's part. There the
   numbers are added up, and each chunk gets back those of its own shingles. A shingle that many documents have is
   thus one record for each chunk, and nothing that grows with the corpus is broadcast.
   A shingle's weight is tf x idf with idf = 1 + ln(N / df) / ln N, from 1 (in every document) to 2 (in one).
2. Every text gets BANDS x ROWS consistent weighted samples, a key for each band, and a digest of its shingles.
   Texts with the same digest are one node; copies, however many, never meet each other.
3. In every bucket (band, key) each member is paired with its sub-leader (the smallest node of the same salt) and
   each sub-leader with the leader. Pairs are verified exactly; verified links give components.
4. Buckets whose members lie in several components get new leaders, STARS - 1 times: in a large group of near copies
   that are just about SIMILARITY alike, each time only a share of the members stays outside the main component.
5. What is still outside is compared with every member of its bucket, in blocks: pairs of unlike components whose
   samples agree well enough for SIMILARITY are verified too, so no candidate link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import SALTS, distinct, materialise, release, salt
from lakeleaf.llm.components import components
from lakeleaf.llm.shingles import mixed, shingles

SIMILARITY, BANDS, ROWS = 0.8, 12, 4
STARS = 2
#: Members of a bucket compared at once when the stars left it open.
BLOCK = 128
#: Share of equal samples below which a pair can't be SIMILARITY alike: four standard deviations under it.
AGREE = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS))
#: Characters of a chunk, of which a task holds one, and shingles of a part (about one to 7 characters). A part takes its
#: worker about 70 bytes a shingle at once, and Spark's batches beside it 16 or more, outside the heap.
CHUNK, PART = 8_000_000, 1_000_000
LEAST_CHUNKS, MOST_PARTS = 64, 1 << 22
SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
SCRAMBLE = np.uint64(0xFF51AFD7ED558CCD)
MIX_A = np.uint64(0xC2B2AE3D27D4EB4F)


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the 65536 mid-points of (0, 1), and its logarithm, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


GAMMA, LOG_GAMMA = _quantiles()


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def weights(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """tf x idf, for ``n`` documents. The plain ln(1 + N / df) would let a few edited words outweigh all that the texts
    of a large group of near copies share; here the rarest shingle weighs twice the commonest."""
    return tf * (2 - np.log(df) / math.log(n)) if n > 1 else tf.astype(np.float64)


def samples(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """BANDS x ROWS consistent weighted samples (32-bit codes) of a text with any shingle.

    For shingle k, weight w and sample m: r, c ~ Gamma(2, 1) and b ~ U(0, 1) are drawn from the hash of (k, m);
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the sample is (k, t) of the least a.
    """
    logs = np.log(weight).astype(np.float32)
    best = np.full(len(SEEDS), np.inf, dtype=np.float32)
    code = np.zeros(len(SEEDS), dtype=np.uint64)
    places = np.arange(len(SEEDS))
    for at in range(0, len(index), 1024):
        k, lw = index[at : at + 1024], logs[at : at + 1024]
        x = k[None, :] ^ SEEDS[:, None]
        x *= MIX_A
        x ^= x >> np.uint64(32)
        x *= SCRAMBLE
        r = GAMMA[(x >> np.uint64(48)).astype(np.uint16)]
        lc = LOG_GAMMA[(x >> np.uint64(32)).astype(np.uint16)]
        b = (x >> np.uint64(8)).astype(np.uint16).astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(1 / 65536)
        t = np.floor(lw[None, :] / r + b)
        lc -= r * (t - b + np.float32(1))
        least = lc.argmin(axis=1)
        value = lc[places, least]
        better = value < best
        best[better] = value[better]
        chosen = mixed(k[least] + (t[places, least].astype(np.int64).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        code[better] = chosen[better]
    return (code >> np.uint64(32)).astype(np.uint32)


def band_keys(codes: np.ndarray) -> np.ndarray:
    rows = codes.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * MIX_A + rows[:, i])
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - both
    return both / whole if whole else 0.0


class Layout(NamedTuple):
    """Numbers of documents, of chunks, and of bits of a shingle that name its part."""

    docs: int
    chunks: int
    bits: int

    @classmethod
    def of(cls, docs: DataFrame) -> Layout:
        found = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        parts = min(-(-found["chars"] // (7 * PART)), MOST_PARTS)
        return cls(found["n"], max(LEAST_CHUNKS, -(-found["chars"] // CHUNK)), max(0, parts - 1).bit_length())

    def part(self, index: np.ndarray) -> np.ndarray:
        return (index >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(index), dtype=np.int64)


def united(indexes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some texts, sorted, and how many texts have each. indexes: distinct in each text."""
    every = np.sort(np.concatenate(indexes)) if indexes else np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    return every[starts], np.diff(np.r_[starts, len(every)])


def packed(index: np.ndarray) -> bytes:
    """Sorted shingles as bytes: differences, the first bytes of all of them first, so that the zeros among the last
    bytes stand together and compress."""
    steps = np.diff(index, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def added(group: pd.DataFrame) -> pd.DataFrame:
    """group: chunk, part, index, counts of the chunks that have shingles in a part. chunk, part, dfs of each."""
    index = np.concatenate([unpacked(x) for x in group["index"]])
    counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["counts"]])
    order = np.argsort(index)
    index = index[order]
    new = np.r_[True, index[1:] != index[:-1]]
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    df = np.empty(len(index), dtype=np.uint32)
    df[order] = total[np.cumsum(new) - 1]
    sizes = group["index"].map(len).to_numpy() // 8
    return pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "dfs": [x.tobytes() for x in np.split(df, np.cumsum(sizes)[:-1])]})


def frequencies(docs: DataFrame, layout: Layout) -> DataFrame:
    """docs: chunk, text. chunk, part, dfs: the document frequencies (u4) of a chunk's shingles in that part, in order."""

    def send(group: pd.DataFrame) -> pd.DataFrame:
        index, count = united([distinct(shingles(t)) for t in group["text"]])
        part = layout.part(index)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        ends = np.r_[cuts[1:], len(part)]
        count = count.astype(np.uint32)
        return pd.DataFrame({"chunk": group["chunk"].iat[0], "part": part[cuts], "index": [packed(index[a:z]) for a, z in zip(cuts, ends)], "counts": [count[a:z].tobytes() for a, z in zip(cuts, ends)]})

    sent = docs.select("chunk", "text").groupBy("chunk").applyInPandas(send, "chunk long, part int, index binary, counts binary")
    return sent.groupBy("part").applyInPandas(added, "chunk long, part int, dfs binary")


def signatures(docs: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """docs: chunk, row, doc_id, text, none null; found: of ``frequencies``. row, doc_id, digest (of the shingles with
    their counts), keys, codes, dfs (the document frequencies, u4, of the text's shingles, sorted).

    A text without words has null keys, codes and dfs, and a digest of its own.
    """

    def sign(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        vectors = [vector(t) for t in group["text"]]
        index, _ = united([v[0] for v in vectors])
        answers = answers.sort_values("part")
        df = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in answers["dfs"]]) if len(answers) else np.empty(0, np.uint32)
        out = []
        for row, doc_id, (own, tf) in zip(group["row"], group["doc_id"], vectors):
            if len(own):
                mine = df[np.searchsorted(index, own)]
                codes = samples(own, weights(tf, mine, layout.docs))
                digest = hashlib.blake2b(own.tobytes() + tf.astype(np.int64).tobytes(), digest_size=16).digest()
                out.append((row, doc_id, digest, band_keys(codes), codes.tobytes(), mine.tobytes()))
            else:
                out.append((row, doc_id, f"no words {doc_id}".encode(), None, None, None))
        return pd.DataFrame(out, columns=["row", "doc_id", "digest", "keys", "codes", "dfs"])

    both = docs.select("chunk", "row", "doc_id", "text").groupBy("chunk").cogroup(found.groupBy("chunk"))
    return both.applyInPandas(sign, "row long, doc_id long, digest binary, keys array<long>, codes binary, dfs binary")


def weighed(text: str, dfs: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and weights of a text."""
    index, tf = vector(text)
    return index, weights(tf, np.frombuffer(dfs, dtype=np.uint32), n)


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose texts are SIMILARITY alike. texts: node, text, dfs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def known(node: int, text: str, dfs: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in seen:
                if len(seen) > 256:
                    seen.clear()
                seen[node] = weighed(text, dfs, n)
            return seen[node]

        for batch in batches:
            alike = [weighted_jaccard(known(a, x, f), known(b, y, g)) >= SIMILARITY for a, b, x, f, y, g in zip(*(batch[c] for c in ("a", "b", "text_a", "dfs_a", "text_b", "dfs_b")))]
            yield batch.loc[alike, ["a", "b"]]

    met = pairs.select("a", "b")
    for side in ("a", "b"):
        met = met.hint("merge").join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"), F.col("dfs").alias(f"dfs_{side}")), side)
    return met.select("a", "b", "text_a", "dfs_a", "text_b", "dfs_b").mapInPandas(run, "a long, b long")


def star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """members: band, key, node, salt. Distinct pairs a < b: members with the sub-leader of their salt, sub-leaders
    with the leader. The leaders are the first in an order that ``seed`` sets."""
    order = F.struct(F.xxhash64("node", F.lit(seed)), F.col("node").alias("node"))
    subs = members.groupBy("band", "key", "salt").agg(F.min(order)["node"].alias("sub"), F.count("*").alias("n"))
    leaders = subs.groupBy("band", "key").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("sub", F.lit(seed)), F.col("sub").alias("node"))))["node"].alias("subs")).filter(F.size("subs") > 1)
    top = leaders.select(F.col("subs")[0].alias("a"), F.explode(F.slice("subs", 2, SALTS)).alias("b"))
    own = members.hint("merge").join(subs.filter("n > 1"), ["band", "key", "salt"]).filter("node <> sub").select(F.col("sub").alias("a"), F.col("node").alias("b"))
    return top.unionByName(own).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components and have more than two members, with their label, the
    bucket's main label (that of most members), and the numbers of main members and others."""
    known = materialise(members.hint("merge").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "minhash-labelled")
    parts = known.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.collect_set("salt").alias("salts"))
    most = F.max(F.struct("n", "label"))
    found = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), most.alias("most"), F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"))
    found = found.filter("n > 2 and labels > 1")
    found = found.select("band", "key", F.col("most.label").alias("main"), F.col("most.n").alias("mains"), (F.col("n") - F.col("most.n")).alias("others"), F.explode("salts").alias("salt"))
    return materialise(known.hint("merge").join(found, ["band", "key", "salt"]), "minhash-open")


def missed_links(open_: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links between unlike components of a bucket. Members outside the bucket's main component meet all members.

    The work is a grid: blocks of others against blocks of main members and against blocks of others, up to
    2 x BLOCK members to a task. A pair is looked at only in the first band that it shares, and only if its samples
    agree; pairs that a task has already connected are passed over.
    """
    chunk = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK).cast("int"), F.lit(1))
    rows = open_.withColumn("is_main", F.col("label") == F.col("main")).withColumn("us", chunk("others")).withColumn("ms", chunk("mains"))
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n)).cast("int")
    mine = F.when(F.col("is_main"), at("ms")).otherwise(at("us"))
    cell = lambda c, kind, t: F.struct(c.cast("int").alias("c"), F.lit(kind).alias("kind"), t.cast("int").alias("t"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = F.when(F.col("is_main"), F.transform(upto("us"), lambda c: cell(c, 0, F.col("block")))).otherwise(
        F.concat(F.transform(upto("ms"), lambda t: cell(F.col("block"), 0, t)), F.transform(upto("us"), lambda t: cell(F.least("block", t), 1, F.greatest("block", t))))
    )
    rows = rows.withColumn("block", mine).hint("merge").join(texts, "node").select("band", "key", "node", "label", "codes", "text", "dfs", "is_main", "block", F.explode(cells).alias("cell"))
    rows = rows.select("band", "key", "cell.*", "node", "label", "codes", "text", "dfs", "is_main", "block").repartition("band", "key", "c", "kind", "t").sortWithinPartitions("band", "key", "c", "kind", "t", "node")
    least = math.ceil(AGREE * BANDS * ROWS)

    def links(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack([np.frombuffer(c, dtype=np.uint32) for c in group["codes"]])
        node, label, text, dfs, main, block = (group[c].to_numpy() for c in ("node", "label", "text", "dfs", "is_main", "block"))
        band, kind, c, t = (group[x].iat[0] for x in ("band", "kind", "c", "t"))
        over = {x: x for x in set(label.tolist())}

        def top(x: int) -> int:
            while over[x] != x:
                over[x] = x = over[over[x]]
            return x

        vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def known(x: int) -> tuple[np.ndarray, np.ndarray]:
            if x not in vectors:
                vectors[x] = weighed(text[x], dfs[x], n)
            return vectors[x]

        found = []
        for x in range(len(group)):
            if main[x]:
                continue
            same = codes == codes[x]
            able = (same.sum(axis=1) >= least) & (label != label[x]) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
            if kind == 0:
                able &= main
            elif c == t:
                able[:x] = False
            else:
                able &= block == t if block[x] == c else False
            for y in np.flatnonzero(able).tolist():
                a, b = top(label[x]), top(label[y])
                if a != b and weighted_jaccard(known(x), known(y)) >= SIMILARITY:
                    over[max(a, b)] = min(a, b)
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            numbers = batch.groupby(["band", "key", "c", "kind", "t"], sort=False).ngroup().to_numpy()
            if len(numbers):
                done = numbers < numbers[-1]  # the last group may go on in the next batch
                yield from (links(g) for _, g in batch[done].groupby(numbers[done], sort=False) if len(g) > 1)
                rest = batch[~done]
        if rest is not None and len(rest) > 1:
            yield links(rest)

    return rows.mapInPandas(run, "a long, b long").distinct()


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``near_classes`` keeps, with all their columns, whatever their names and types.

    Of rows that share both doc_id and text one stays (the least as JSON), if any. Rows with a null doc_id, and texts
    that are null or without a word, all stay. An empty table gives an empty result.
    """
    classes = materialise(_classes(docs, text, doc_id), "minhash-classes")
    gone = classes.filter("not kept").select("row", "doc_id").distinct()
    repeated = classes.filter("doc_id is not null and has_words").groupBy("row", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    key = F.struct(_row_key(docs[doc_id], docs[text]).alias("row"), docs[doc_id].cast("long").alias("doc_id"))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("all"), key.alias("key"))
    stays = wide.join(gone, (F.col("key.row") == gone["row"]) & (F.col("key.doc_id") == gone["doc_id"]), "left_anti")
    repeated = materialise(repeated.select(F.struct("row", "doc_id").alias("key")), "minhash-repeated")
    if not repeated.isEmpty():
        several = stays.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("all", F.to_json("all")).alias("all")).select("all", "key")
        stays = stays.join(repeated, "key", "left_anti").select("all", "key").unionByName(several)
    return stays.select("all.*")


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), kept (whether this row stays); one row per input row.

    Classes are the connected components of texts that are SIMILARITY alike, texts with the same shingles among
    them. Texts that are null or without a word, and rows with a null doc_id, are alike to none (class_id doc_id,
    kept). doc_id is meant to be unique: of rows that share one, each gets the class of its own text, and links are
    verified by the smallest of their texts. Very long texts are read whole. Other columns are ignored; an empty table
    gives an empty result.
    """
    return _classes(docs, text, doc_id).select("doc_id", "class_id", "kept")


def _classes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``near_classes`` with row (the key of doc_id and text) and has_words."""
    spark = docs.sparkSession
    every = docs.select(_row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = every.filter("doc_id is not null")
    layout = Layout.of(rows)
    n = layout.docs
    chunked = rows.withColumn("chunk", F.pmod("row", F.lit(layout.chunks)).cast("long"))
    found = materialise(frequencies(chunked, layout), "minhash-frequencies")
    release(spark)
    signed = materialise(signatures(chunked, found, layout).withColumn("salt", salt("doc_id")), "minhash-signatures")
    release(spark)
    # One node for each digest; its copies are remembered by their salts only.
    nodes = materialise(signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.collect_set("salt").alias("salts"), F.first("keys").alias("keys"), F.first("codes").alias("codes")), "minhash-nodes")
    members = nodes.filter("keys is not null").select("node", "codes", F.posexplode("keys").alias("band", "key")).withColumn("salt", salt("node"))
    buckets = members.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.collect_set("salt").alias("salts")).filter("low < high")
    full = buckets.select("band", "key", F.explode("salts").alias("salt"))
    members = materialise(members.hint("merge").join(full, ["band", "key", "salt"]).distinct(), "minhash-members")
    involved = members.select("node").distinct()
    wanted = signed.select("row", F.col("doc_id").alias("node"), "dfs").hint("merge").join(involved, "node", "left_semi").groupBy("row", "node").agg(F.first("dfs").alias("dfs"))
    met = rows.select("row", F.col("doc_id").alias("node"), "text").hint("merge").join(wanted, ["row", "node"])
    texts = materialise(met.groupBy("node").agg(F.min(F.struct("text", "dfs")).alias("t")).select("node", "t.text", "t.dfs"), "minhash-texts")
    release(spark)
    tried = materialise(star_pairs(members, 0), "minhash-pairs")
    links = materialise(verified(tried, texts, n), "minhash-links")
    labels = components(links)
    for seed in range(1, STARS + 1):
        open_ = open_members(members, labels)
        if seed == STARS or open_.isEmpty():
            break
        # Other leaders connect many of those that the first ones happened not to.
        more = materialise(star_pairs(open_, seed).join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        tried, links = tried.unionByName(more), links.unionByName(materialise(verified(more, texts, n), "minhash-links"))
        labels = components(links)
    if not open_.isEmpty():
        labels = components(links.unionByName(materialise(missed_links(open_, texts, n), "minhash-links")))
    found = nodes.select("digest", "node", F.explode("salts").alias("salt")).hint("merge").join(labels, "node", "left").withColumn("class_id", F.coalesce("label", "node")).select("digest", "salt", "class_id")
    placed = signed.select("row", "doc_id", "digest", "salt", F.col("keys").isNotNull().alias("has_words")).hint("merge").join(found, ["digest", "salt"])
    placed = placed.select("row", "doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "has_words")
    none = every.filter("doc_id is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(False).alias("has_words"))
    return placed.unionByName(none)
