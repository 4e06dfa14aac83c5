"""Getting the package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_strandsift_shipped", False):
        return spark
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="strandsift-"), "strandsift_src.zip")
    Path(path).write_bytes(out.getvalue())
    sc.addPyFile(path)
    sc._strandsift_shipped = True
    return spark


def shared(df: DataFrame) -> DataFrame:
    """``df`` written once and read again, below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="strandsift-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def spread(df: DataFrame, key: str, rows: int = 1 << 12) -> DataFrame:
    """``df`` dealt by ``key`` over tasks of about ``rows`` rows each, for small rows that much is computed from, whose file has few parts. It is written
    once: filters on what is computed would else move in front of the exchange, into those few parts."""
    n = -(-df.count() // rows)
    return shared(df.repartition(n, key)) if n > 1 else df


def sized(spark: SparkSession, rows: int, each: int = 1 << 18, size: int = 16 << 20) -> None:
    """Shuffles of ``rows`` rows and what is made of them, for this session: as many partitions as have ``each`` rows, where that is more than the session has,
    and merged (AQE) up to ``size`` bytes. A task sorts and groups many times what its partition has in shuffle files, so with few partitions or
    Spark's 64 MB its memory is near a gigabyte. Smaller tables change nothing, nor is a size that was set changed."""
    start, target = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    n, now = -(-rows // each), int(spark.conf.get(start, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if n > now:
        spark.conf.set(start, str(n))
    if n > spark.sparkContext.defaultParallelism and spark.conf.get(target, None) is None:
        spark.conf.set(target, str(size))
