"""The graph's adjacency as a kept table: a base, and a folder for each change of nodes or edges.

``rows`` of a folder are those of ``graph.adjacency``, sorted by the node that a step starts from; a node's rows of one
direction stand in blocks, in the order in which ``related`` gives them, so a limit reads a hub's first block. ``gone``
are the edges that a folder replaces or deletes in those before it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeleaf.operators import graph

#: Rows of a block, at least as many as a limit may ask for.
BLOCK = 1024
#: Folders of changes after which the table is written anew.
CHANGES = 16
ROWS = "from_id string, branch int, src_id string, edge_id string, edge_kind string, node_id string, node_kind string, node_canonical string, node_name string, block long"


class Adjacency:
    """names: the folders under root, the oldest first."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root, names

    def _read(self, table: str, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{table}").withColumn("seq", F.lit(i)) for i, name in enumerate(self.names)])

    def rows(self) -> DataFrame:
        """The rows that hold now; filters on from_id and block reach the scan."""
        rows = self._read("rows", ROWS)
        if len(self.names) > 1:
            last = self._read("gone", "edge_id string").groupBy("edge_id").agg(F.max("seq").alias("last"))
            rows = rows.join(last, "edge_id", "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("seq"))).drop("last")
        return rows.drop("seq")

    def _with(self, rows: DataFrame, gone: DataFrame, name: str) -> Adjacency:
        order = W.partitionBy("from_id", "branch").orderBy(*graph.STEP_ORDER)
        blocked = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("long"))
        blocked.repartitionByRange("from_id", "branch", "block").sortWithinPartitions("from_id", "branch", "block", *graph.STEP_ORDER[1:]).write.parquet(f"{self.root}/{name}/rows")
        if gone is not None:
            gone.select("edge_id").distinct().write.parquet(f"{self.root}/{name}/gone")
        return Adjacency(self.spark, self.root, [*self.names, name])

    def rebuilt(self, nodes: DataFrame, edges: DataFrame) -> Adjacency:
        new = Adjacency(self.spark, self.root, [])
        return new._with(graph.adjacency(nodes, edges), edges.limit(0).select(F.col("id").alias("edge_id")), f"adjacency/{uuid.uuid4().hex}")

    def updated(self, nodes: DataFrame, edges: DataFrame, changed_nodes: DataFrame | None = None, changed_edges: DataFrame | None = None) -> Adjacency:
        """The adjacency of these nodes and edges. changed_nodes, changed_edges (id): where the rest is known to be as it
        was; without them all rows are compared. Only changed edges' rows are written."""
        if not self.names or len(self.names) > CHANGES:
            return self.rebuilt(nodes, edges)
        if changed_nodes is not None and changed_edges is not None:
            had = self.rows().join(changed_nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("edge_id")
            new = [edges.join(changed_nodes.select(F.col("id").alias(end)), end, "left_semi").select(F.col("id").alias("edge_id")) for end in ("src_id", "dst_id")]  # an end that was missing
            found = reduce(DataFrame.unionByName, [had, *new, changed_edges.select(F.col("id").alias("edge_id"))]).distinct()
        else:
            of = lambda rows, name: rows.groupBy("edge_id").agg(F.sum(F.xxhash64("from_id", "branch", "src_id", "edge_kind", "node_id", "node_kind", "node_canonical", "node_name").cast("decimal(30)")).alias(name))
            both = of(graph.adjacency(nodes, edges), "now").join(of(self.rows(), "had"), "edge_id", "full_outer")
            found = both.filter(~F.col("now").eqNullSafe(F.col("had"))).select("edge_id")
        name = f"adjacency/{uuid.uuid4().hex}"
        found.write.parquet(f"{self.root}/{name}/gone")
        found = self.spark.read.schema("edge_id string").parquet(f"{self.root}/{name}/gone")
        if found.isEmpty():
            return self
        return self._with(graph.adjacency(nodes, edges.join(found.withColumnRenamed("edge_id", "id"), "id", "left_semi")), None, name)
