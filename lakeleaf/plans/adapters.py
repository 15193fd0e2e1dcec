"""Engine tables over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.functions.ids import stable_id
from lakeleaf.operators.graph import edge_rows, node_rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text documents; ``source`` is the source id."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.concat(name, F.lit(".txt")).alias("external_id"), name.alias("title"), F.lit("").alias("url"), F.sha2("text", 256).alias("content_hash"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section for each text document."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("ordinal"), name.alias("title"), name.alias("heading_path"), F.col("text").alias("content"))


def documents_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_sections`` with a sentence of API references at the end of each text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "source")
    said = F.concat(F.lit(" see GET /docs/"), "id", F.lit("?lang="), text("lang"), F.lit("&n=1, POST /v1/~"), text("source"), F.lit("/%7Bid%7D/new(2);k='x'. HEAD /a[0]@b!$*+#top;: get /none"))
    rows = document_sections(spark, sf_dir).join(d.select("id", said.alias("said")), "id")
    return rows.withColumn("content", F.concat(text("content"), "said")).drop("said")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents; five sources."""
    d = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.concat(F.lit("talk"), F.col("conv_id").cast("string"))
    return d.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("talks"), (F.col("conv_id") % 5).cast("string")).alias("source_id"), name.alias("external_id"), name.alias("title"), F.lit("").alias("url"))


def talk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections, titled by their role."""
    d = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return d.select(F.concat(conv, F.lit("-"), turn).alias("id"), conv.alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("title"), F.concat(F.lit("turn "), turn).alias("heading_path"), F.col("text").alias("content"))


def no_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "document_id string, desc string, retrieval_profile_json string, generated_from_hash string")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as events: quality 1 says canonical, toxic 1 says stale."""
    d = read(spark, sf_dir, "labels")
    kinds = F.filter(F.array(F.when(F.col("quality") == 1, "document_canonical"), F.when(F.col("toxic") == 1, "document_stale")), lambda k: k.isNotNull())
    rows = d.select(F.col("doc_id").cast("string").alias("target_id"), F.explode(kinds).alias("feedback_kind"))
    return rows.select(stable_id("fb", "target_id", "feedback_kind").alias("id"), F.lit("document").alias("target_kind"), "target_id", "feedback_kind", F.lit("{}").alias("payload_json"), F.lit("label").alias("actor"))


def no_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, target_kind string, target_id string, feedback_kind string, payload_json string, actor string")


#: Kind, table, key and name of each kind of node in the star schema.
STAR_NODES = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"))
#: Table, kind and key of the source end, kind of edge, kind and key of the other end.
STAR_EDGES = (("nation", "region", "n_regionkey", "contains", "nation", "n_nationkey"), ("customer", "nation", "c_nationkey", "has_customer", "customer", "c_custkey"), ("supplier", "nation", "s_nationkey", "has_supplier", "supplier", "s_suppkey"), ("lineitem", "supplier", "l_suppkey", "ships", "part", "l_partkey"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, table, key, name in STAR_NODES:
        rows = read(spark, sf_dir, table).select(F.col(key).cast("string").alias("key"), F.col(name).alias("name"))
        own = node_rows(rows, stable_id("node", F.lit(kind), F.col("key")), kind, F.col("name"), {"key": F.col("key")})
        out = own if out is None else out.unionByName(own)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, src, src_key, kind, dst, dst_key in STAR_EDGES:
        rows = read(spark, sf_dir, table).select(F.col(src_key).cast("string").alias("a"), F.col(dst_key).cast("string").alias("b")).distinct()
        own = edge_rows(rows, stable_id("node", F.lit(src), F.col("a")), stable_id("node", F.lit(dst), F.col("b")), kind, "rule")
        out = own if out is None else out.unionByName(own)
    return out
