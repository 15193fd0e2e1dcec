"""What the operators share: the cluster's shared folder, written intermediate tables, fold membership."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for the deletion of a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Salts that a hot key is dealt over. A key with a third of all rows leaves 1/768 of them in one task.
SALTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set a new one of our own, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeleaf-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of this write again
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of plans that nothing refers to any more. It does so after the
    driver's JVM has collected its garbage, by itself only every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt(*cols: str | Column, n: int = SALTS) -> Column:
    """A salt from 0 to n - 1 that depends on the row's values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def id_fold(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once. For the short arrays of one text faster than ``np.unique``, which hashes first."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values
