"""Operator 5, exact dedup: a persistent digest index, bucketed and sorted by digest.

A batch is cut to one row per digest before it meets the index, so both sides of the sort-merge anti-join have
distinct keys and no group of copies, however large, lands in one task. Each (digest, salt) that has rows is
remembered, so the way back from groups to documents is an equi-join on (digest, salt) without replication.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.llm.common import fresh_path, materialise, salt

#: Deleted before the comparison: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def buckets_for(n_digests: int, per_bucket: int = 1_000_000) -> int:
    """A power of two, at least 16, with about ``per_bucket`` digests to a bucket."""
    return max(16, 1 << max(0, (n_digests - 1) // per_bucket).bit_length())


class DigestIndex:
    """The digests of every text kept so far: (digest, keep_id, points, batch), one row per digest, and another for each
    time that a better row took its place.

    The table is bucketed and sorted by ``digest``, lives under ``path`` and only grows. ``DigestIndex(spark, path,
    buckets)`` on an existing path registers it again, so the index outlives the session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id bigint, points bigint, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table's name out of the catalogue. Its files stay, and frames made from it can still be read."""
        self.spark.sql(f"drop table if exists {self.name}")

    def append(self, new: DataFrame) -> None:
        (
            new.select("digest", "keep_id", "points", "batch")
            .repartition(self.buckets, "digest")  # one file per bucket and append
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
            .option("path", self.path).saveAsTable(self.name)
        )

    def best(self) -> DataFrame:
        """digest, keep_id, points, batch: of each digest the row with the most code points, then the smallest id (null
        last). No shuffle: a bucket holds all rows of its digests."""
        order = F.struct((-F.col("points")).alias("less"), F.col("keep_id").isNull().alias("none"), "keep_id", "batch")
        found = self.table().groupBy("digest").agg(F.min(order).alias("b"))
        return found.select("digest", "b.keep_id", (-F.col("b.less")).alias("points"), "b.batch")

    def add(self, groups: DataFrame, batch: str | None = None, better: bool = False) -> DataFrame:
        """Append the groups whose digest the index lacks, and with ``better`` also those whose row is better than the
        index's; return digest, keep_id and new for each group.

        ``groups`` (one row per digest: digest, first_id, points) must be a written table, since it is read twice. A
        batch that is added again under its name, after a failure or by mistake, gives the same answer and changes nothing.
        """
        batch = batch or uuid.uuid4().hex
        have = self.best().select(F.col("digest").alias("had"), F.col("keep_id").alias("had_id"), F.col("points").alias("had_points"))
        known = F.col("digest") == F.col("had")
        if better:
            sooner = F.col("first_id").isNull() | (F.col("had_id") <= F.col("first_id"))
            known &= (F.col("had_points") > F.col("points")) | (F.col("had_points") == F.col("points")) & F.coalesce(sooner, F.lit(False))
        fresh = groups.hint("merge").join(have, known, "left_anti")
        self.append(fresh.select("digest", F.col("first_id").alias("keep_id"), "points", F.lit(batch).alias("batch")))
        return groups.hint("merge").join(self.best().select("digest", "keep_id", "batch"), "digest").withColumn("new", F.col("batch") == batch)


def digest_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Written tables: keys (digest, salt, doc_id, points, copies) and groups (digest, first_id, points, group_size,
    salts). A group's row with the most code points, then the smallest doc_id (null last), is its first."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("points"))
    keys = materialise(rows.withColumn("salt", salt("doc_id")).groupBy("digest", "salt", "doc_id", "points").agg(F.count("*").alias("copies")), "digest-keys")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = keys.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("group_size"), F.collect_set("salt").alias("salts"))
    return keys, materialise(groups.select("digest", F.col("best.doc_id").alias("first_id"), (-F.col("best.less")).alias("points"), "group_size", "salts"), "digest-groups")


def _added(spark: SparkSession, groups: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    if index is not None:
        return index.add(groups, batch)
    index = DigestIndex(spark, buckets=buckets_for(groups.count()))
    found = index.add(groups, batch)
    index.close()
    return found


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """Dedupe ``docs`` against ``index`` (a new one by default) and within itself; append what is new to it.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Equal texts are those with the
    same digest. A text that the index had before is not kept, and its keep_id is the index's; else the row with
    the most code points, then the smallest doc_id (null last) stays. group_size counts the rows of this batch.
    Null and empty texts are equal to each other. Of fully repeated rows one stays. An empty table gives an empty
    result. Other columns are ignored. Very long texts are hashed whole. ``batch`` names the rows, so that a run can be
    repeated against the same index.
    """
    keys, groups = digest_groups(docs, text, doc_id)
    found = _added(docs.sparkSession, groups, index, batch).select("digest", "keep_id", "new", "first_id", F.col("points").alias("most"), "group_size", F.explode("salts").alias("salt"))
    each = keys.hint("merge").join(found, ["digest", "salt"]).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("points") == F.col("most")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup_in_batches(docs: DataFrame, batches: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``exact_dedup`` of a table that comes to a new index in ``batches`` parts, dealt by doc_id. A later batch meets the
    index of those before it: its digests that are there already are dropped by the anti-join, unless their row is
    better. So of equal texts the same row stays as if all came at once, and group_size counts all rows.
    """
    spark, index, keys = docs.sparkSession, None, None
    for k in range(batches):
        own, groups = digest_groups(docs.filter(F.pmod(F.xxhash64(docs[doc_id].cast("long")), F.lit(batches)) == k), text, doc_id)
        index = index or DigestIndex(spark, buckets=buckets_for(batches * groups.count()))
        index.add(groups, better=True)
        keys = own if keys is None else keys.unionByName(own)
    sizes = keys.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.collect_set("salt").alias("salts"))
    found = sizes.hint("merge").join(index.best().select("digest", "keep_id", F.col("points").alias("most")), "digest").withColumn("salt", F.explode("salts")).drop("salts")
    index.close()
    each = keys.hint("merge").join(found, ["digest", "salt"]).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names and types.

    Rows that share both doc_id and digest are told apart by nothing else, so one of them is taken by its columns (the
    least as JSON). Of null and empty texts one stays; an empty table gives an empty result.
    """
    keys, groups = digest_groups(docs, text, doc_id)
    stays = _added(docs.sparkSession, groups, index, batch).filter("new").select("digest", F.col("first_id").alias("stay_id"), F.col("points").alias("most"))
    repeated = keys.groupBy("digest", "doc_id", "points").agg(F.sum("copies").alias("n")).filter("n > 1")
    mine = F.struct(digest(F.col(text)).alias("digest"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("points"))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), mine.alias("key"))
    same = (F.col("key.digest") == F.col("digest")) & F.col("key.id").eqNullSafe(F.col("stay_id")) & (F.col("key.points") == F.col("most"))
    # The join is on digest and doc_id together: a hot digest is spread over its doc_ids.
    joined = wide.hint("merge").join(stays, same, "left_semi")
    if not repeated.isEmpty():
        joined = joined.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return joined.select("row.*")
