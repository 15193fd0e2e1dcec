"""What a session needs beyond its own settings."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once for each application, so that workers can import it wherever
    the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    target = os.path.join(tempfile.mkdtemp(prefix="lakeleaf-code-"), f"{root.name}_code.zip")
    Path(target).write_bytes(packed.getvalue())
    sc.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; where none is set a new one of our own, in local
    mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not local_mode(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeleaf-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def local_mode(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def visible(spark: SparkSession, folder: str) -> str:
    """A folder of the driver's machine as executors can read it: a copy in the shared folder, but in local mode."""
    if local_mode(spark):
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = f"{shared_dir(spark)}/copied-{uuid.uuid4().hex}"
    path(target).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path(folder), path(target))
    return target


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: worked out once, whatever becomes of the executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
